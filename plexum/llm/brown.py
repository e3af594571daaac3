"""Language-model scores from a class-based bigram model.

Exchange clustering puts words into classes: on the driver for the HEAD most frequent words, from their exact bigram counts over all training
texts, and by one distributed exchange step for every other word, from its counts beside those classes. A text's probability is the product of
class transitions and word emissions. Words without training counts are one more class; its transitions are those of words seen once,
as each of them would be unknown without its one text.

Texts are read once into blocks of token numbers with a vocabulary of their own. From then on only packed tables of (word, numbers) move:
each block splits its vocabulary by word hash into buckets, a bucket sums over blocks, and answers each block in the block's own
order. No step holds more than a block or a bucket, and the number of buckets follows the size of the vocabularies.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import Scratch, as_bytes, batch_bytes, crc_mod, partitions, sliced

CLASSES = 32
#: Words that are clustered on the driver.
HEAD = 600
SWEEPS = 20
#: Bytes of text in a block, and vocabulary entries of blocks in a bucket, about.
BLOCK_BYTES = 4_000_000
BUCKET_WORDS = 200_000
#: Bytes of rows that go to a worker at once; a row is a block, so at Spark's own 64 MB all of a task's blocks would be in memory, some four times over.
BATCH_BYTES = 8_000_000
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: The end of a text, as a word; no word is empty.
END = b""
_BLOCK = "block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, vocab binary, counts binary, n_words long"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


class _Plain(pickle.Unpickler):
    """Arrays and plain values only."""

    def find_class(self, module, name):
        if module.split(".")[0] == "numpy":
            return super().find_class(module, name)
        raise pickle.UnpicklingError(name)


def _unpack(blob: bytes) -> tuple:
    return _Plain(io.BytesIO(zstandard.ZstdDecompressor().decompress(bytes(blob)))).load()


def _words(vocab: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(bytes(vocab)).split(b"\n")


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, held, text. A row per block; counts are over texts that are not held out. Word 0 of a block is END."""

    def close(number, rows, numbers):
        ids, held, tokens = zip(*rows)
        lengths = [len(x) for x in tokens]
        joined = np.concatenate(tokens)
        learned = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(joined[learned], minlength=len(numbers)).astype(np.int64)
        vocab = zstandard.ZstdCompressor(level=1).compress(b"\n".join(numbers))
        columns = [[number], [ids], [held], [lengths], [_pack(joined)], [vocab], [_pack(counts)], [len(numbers)]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, numbers, size = [], _Numbers({END: 0}), 0
        for batch in sliced(batches):
            for key, held, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = as_bytes(text).translate(_LOWER)
                words = data.split()
                words.append(END)
                rows.append((key, held, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                size += len(data) + 64
                if size >= block_bytes:
                    yield close(number, rows, numbers)
                    number, rows, numbers, size = number + 1, [], _Numbers({END: 0}), 0
        if rows:
            yield close(number, rows, numbers)

    return docs.mapInArrow(run, _BLOCK)


def _bucket_slices(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket with words of the block, their numbers in rising order."""
    at = np.fromiter((xxhash.xxh32_intdigest(x) for x in words), np.int64, len(words)) % buckets
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    for b, own in zip(found.tolist(), np.split(order, first[1:])):
        yield b, own


def _blob_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["block", "bucket", "blob"])


def _tree_sum(rows: DataFrame, count: int, fan: int = 64) -> list[np.ndarray]:
    """The sums of packed arrays. rows: at, blob; `count` rows at most. Groups of about `fan` are added, again and again, so that neither
    a task nor the driver gets more at once."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "blob": [_pack(*_added(pdf["blob"]))]})

    n = max(1, count)
    while n > fan:
        n = -(-n // fan)
        rows = rows.select(F.pmod(F.xxhash64("at"), F.lit(n)).alias("at"), "blob").groupBy("at").applyInPandas(add, "at long, blob binary")
    return _added([r.blob for r in rows.collect()])


def _added(blobs) -> list[np.ndarray]:
    total: list[np.ndarray] = []
    for blob in blobs:
        parts = _unpack(blob)
        total = [a + b for a, b in zip(total, parts)] if total else list(parts)
    return total


def word_totals(stored: DataFrame, buckets: int, head: int) -> DataFrame:
    """A row per bucket: v (words with counts), n (their tokens), and its most frequent words with counts, `head` at most."""

    def ask(batches):
        for batch in sliced(batches, 1):
            for block, vocab, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words, (counts,) = _words(vocab), _unpack(counts)
                yield from _blob_rows([(block, b, _pack(b"\n".join([words[i] for i in own]), counts[own])) for b, own in _bucket_slices(words, buckets)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        for blob in pdf["blob"]:
            words, counts = _unpack(blob)
            for w, c in zip(words.split(b"\n"), counts.tolist()):
                if c:
                    total[w] = total.get(w, 0) + c
        top = sorted((w for w in total if w), key=lambda w: (-total[w], w))[:head]
        return pd.DataFrame({"v": [len(total)], "n": [sum(total.values())], "words": [[*top]], "counts": [[total[w] for w in top]]})

    return stored.select("block", "vocab", "counts").mapInArrow(ask, "block long, bucket long, blob binary").groupBy("bucket").applyInPandas(add, "v long, n long, words array<binary>, counts array<long>")


def _training(joined: np.ndarray, lengths: list[int], held: list[bool], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours (before, at) among training tokens, END before a text's first, with each token mapped by own."""
    learned = np.repeat(~np.array(held, bool), lengths)
    at = own[joined]
    before = np.concatenate(([own[0]], at[:-1]))
    return np.stack([before[learned], at[learned]]), learned


def head_bigrams(stored: DataFrame, head: list[bytes], tasks: int) -> np.ndarray:
    """Bigram counts among the head words, END (index len(head)) and all other words (the last index)."""
    k = len(head) + 2
    place = {w: i for i, w in enumerate(head)} | {END: k - 2}

    def count(batches):
        total = np.zeros(k * k, np.int64)
        for batch in sliced(batches, 1):
            for held, lengths, tokens, vocab in zip(*(batch.column(c).to_pylist() for c in range(4))):
                own = np.array([place.get(w, k - 1) for w in _words(vocab)])
                (a, b), _ = _training(_unpack(tokens)[0], lengths, held, own)
                total += np.bincount(a * k + b, minlength=k * k)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_pack(total)], pa.binary())], names=["at", "blob"])

    rows = stored.select("held", "lengths", "tokens", "vocab").mapInArrow(count, "at long, blob binary")
    got = _tree_sum(rows, tasks)
    return (got[0] if got else np.zeros(k * k, np.int64)).reshape(k, k)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each word that keeps the mutual information of neighbouring classes highest.

    The first words start in classes of their own, the others with the rest, from where the first sweep puts them. A sweep takes each word out of its class and puts it where the class bigrams' likelihood gains most.
    The last two indices are END and the rest, classes of their own that never move.
    """
    k = len(bigrams) - 2
    own = np.concatenate([np.where(np.arange(k) < classes, np.arange(k), classes + 1), [classes, classes + 1]]).astype(np.int64)
    size = classes + 2
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    m = np.zeros((size, size))
    np.add.at(m, (own[:, None], own[None, :]), bigrams)
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            a = np.bincount(own, bigrams[:, w], size)
            b = np.bincount(own, bigrams[w], size)
            s, old = float(bigrams[w, w]), own[w]
            a[old] -= s
            b[old] -= s
            m[:, old] -= a
            m[old] -= b
            m[old, old] -= s
            left, right = m.sum(axis=1), m.sum(axis=0)
            c = np.arange(classes)
            gain = (f(m[:, :classes] + a[:, None]) - f(m[:, :classes])).sum(axis=0) + (f(m[:classes] + b[None, :]) - f(m[:classes])).sum(axis=1)
            gain += f(m[c, c] + a[c] + b[c] + s) + f(m[c, c]) - f(m[c, c] + a[c]) - f(m[c, c] + b[c])
            gain -= f(left[c] + b.sum() + s) - f(left[c]) + f(right[c] + a.sum() + s) - f(right[c])
            best = int(np.argmax(gain))
            best = int(old) if old < classes and gain[best] <= gain[old] + 1e-9 else best
            m[:, best] += a
            m[best] += b
            m[best, best] += s
            moved += best != old
            own[w] = best
        if not moved:
            break
    return own


def assign(stored: DataFrame, buckets: int, head: list[bytes], own: np.ndarray, bigrams: np.ndarray, classes: int) -> DataFrame:
    """(block, bucket, blob) for each block and bucket: counts, classes, and once per bucket (block -1) the tokens and singletons by class.

    A word outside the head goes where its neighbours' classes, on both sides, are likeliest.
    """
    size = classes + 2
    m = np.full((size, size), 0.5)
    np.add.at(m, (own[:, None], own[None, :]), bigrams)
    ahead = np.log(m / m.sum(axis=1, keepdims=True))[:classes]
    behind = np.log(m / m.sum(axis=0, keepdims=True))[:, :classes].T
    likely = np.concatenate([behind, ahead], axis=1).T.astype(np.float32)
    known = dict(zip(head, own.tolist()))

    def ask(batches):
        for batch in sliced(batches, 1):
            for block, held, lengths, tokens, vocab, counts in zip(*(batch.column(k).to_pylist() for k in range(6))):
                words, (joined,), (counts,) = _words(vocab), _unpack(tokens), _unpack(counts)
                cls = np.array([known.get(w, classes + 1) for w in words])
                cls[0] = classes
                learned = np.repeat(~np.array(held, bool), lengths)
                at, beside = joined.astype(np.int64), cls[joined]
                # A text's last token is END; what follows it is another text's.
                before = np.concatenate(([classes], beside[:-1]))
                keys = np.concatenate([(at * 2 * size + before)[learned], (at[:-1] * 2 * size + size + beside[1:])[learned[:-1] & (at[:-1] != 0)]])
                keys = keys[cls[keys // (2 * size)] == classes + 1]
                keys, n = np.unique(keys, return_counts=True)
                word, code = keys // (2 * size), (keys % (2 * size)).astype(np.uint8)
                rows = []
                for b, mine in _bucket_slices(words, buckets):
                    new = np.full(len(words), -1)
                    new[mine] = np.arange(len(mine))
                    has = new[word] >= 0
                    rows.append((block, b, _pack(b"\n".join([words[i] for i in mine]), counts[mine], new[word[has]].astype(np.int32), code[has], n[has].astype(np.int32))))
                yield from _blob_rows(rows)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, asked = _Numbers(), []
        for block, blob in zip(pdf["block"], pdf["blob"]):
            words, counts, word, code, n = _unpack(blob)
            asked.append((block, np.fromiter(map(numbers.__getitem__, words.split(b"\n")), np.int64, len(counts)), counts, word, code, n))
        total, beside = np.zeros(len(numbers), np.int64), np.zeros((len(numbers), 2 * size), np.float32)
        for _, at, counts, word, code, n in asked:
            total[at] += counts
            beside[at[word], code] += n
        cls = (beside @ likely).argmax(axis=1)
        for w, i in numbers.items():
            if w in known:
                cls[i] = known[w]
        if END in numbers:
            cls[numbers[END]] = classes
        cls[total == 0] = classes + 1
        by = [np.bincount(cls, weights, size).astype(np.int64) for weights in (total, total == 1)]
        rows = [(block, _pack(total[at], cls[at].astype(np.uint8))) for block, at, *_ in asked]
        rows.append((-1, _pack(*by)))
        return pd.DataFrame({"block": [x[0] for x in rows], "bucket": int(pdf["bucket"].iloc[0]), "blob": [x[1] for x in rows]})

    return stored.select("block", "held", "lengths", "tokens", "vocab", "counts").mapInArrow(ask, "block long, bucket long, blob binary").groupBy("bucket").applyInPandas(answer, "block long, bucket long, blob binary")


@dataclass(frozen=True)
class Model:
    """n training tokens of v kinds; classes 0..k-1, END (k) and the unknown word (k + 1), with their tokens."""

    n: int
    v: int
    classes: int
    by_class: np.ndarray


def _scored(model: Model, buckets: int):
    """Per text: base score, known tokens, sum of emissions, and its counts of class pairs; per block of training texts one row of sums."""
    size = model.classes + 2
    spread = np.log10(np.maximum(model.by_class, 1))

    def run(batches):
        for batch in sliced(batches, 1):
            for ids, held, lengths, tokens, vocab, blobs in zip(*(batch.column(k).to_pylist() for k in range(6))):
                words, (joined,) = _words(vocab), _unpack(tokens)
                total, cls = np.zeros(len(words), np.int64), np.full(len(words), model.classes + 1)
                answers = {x["bucket"]: x["blob"] for x in blobs}
                for b, mine in _bucket_slices(words, buckets):
                    total[mine], cls[mine] = _unpack(answers[b])
                base = np.log10((total + 1) / (model.n + model.v + 1))
                emit = np.where(total > 0, np.log10(np.maximum(total, 1)) - spread[cls], 0.0)
                cls[0] = model.classes
                emit[0] = 0.0
                at = cls[joined]
                pair = np.concatenate(([model.classes], at[:-1])) * size + at
                ends = np.cumsum(lengths)
                starts = ends - lengths
                learned = np.repeat(~np.array(held, bool), lengths)
                once = total[joined] == 1
                after = np.concatenate(([False], once[:-1]))
                sums = [np.bincount(pair[learned & x], minlength=size * size) for x in (np.ones(len(pair), bool), once, after)]
                sums = _pack(*sums)
                sum_of = lambda x: np.add.reduceat(x, starts)
                known, bases, emits = sum_of((total[joined] > 0).astype(np.int64)), sum_of(base[joined]), sum_of(emit[joined])
                jumps = []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    i, n = np.unique(pair[a:b], return_counts=True)
                    jumps.append(i.astype(np.uint16).tobytes() + n.astype(np.uint32).tobytes())
                count = len(lengths)
                columns = [[*ids, None], [*held, None], [*lengths, 0], [*known.tolist(), 0], [*bases.tolist(), 0.0], [*emits.tolist(), 0.0], [*jumps, None], [None] * count + [sums]]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emit", "jumps", "sums"])

    return run


def transitions(sums: list[np.ndarray], classes: int, by_class: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log10 P(class | class before), each row a distribution over the classes, END and the unknown word.

    The unknown word's share after a class is that of words seen once; after the unknown word it goes as after those words. The rest is
    the training frequency, smoothed with `weight` counts of the class's own frequency.
    """
    size = classes + 2
    pairs, once, after = (x.reshape(size, size).astype(float) for x in sums)
    pairs[size - 1] = after.sum(axis=0)
    once[size - 1] = np.divide(once.sum(axis=0), max(1.0, pairs[: size - 1].sum())) * pairs[size - 1].sum()
    prior = (by_class.astype(float) + 1) * (np.arange(size) < size - 1)
    prior /= prior.sum()
    known = pairs * (np.arange(size) < size - 1)
    seen = known.sum(axis=1, keepdims=True)
    overall = (once.sum() + 1) / (seen.sum() + 2)
    unknown = (once.sum(axis=1, keepdims=True) + weight * overall) / (seen + weight)
    unknown = np.clip(unknown, 1e-9, 1 - 1e-6)
    out = (1 - unknown) * (known + weight * prior) / (seen + weight)
    out[:, size - 1] = unknown[:, 0]
    return np.log10(np.maximum(out / out.sum(axis=1, keepdims=True), 1e-300))


def class_scores(docs: DataFrame, classes: int = CLASSES, head: int = HEAD, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is the end token alone. A row without an id is learned from. Repeated rows count and are scored each; other columns are
    not read. Without training texts every word is unknown.
    """
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        return _class_scores(docs, classes, head, folds, held, id_col, text_col, block_bytes)


def _class_scores(docs: DataFrame, classes: int, head: int, folds: int, held: int, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    held_out = F.coalesce(crc_mod(docs[id_col], folds) == held, F.lit(False))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out.alias("held"), docs[text_col].cast("string").alias("text"))
    stored = scratch.save(blocks(texts, block_bytes), "blocks")
    entries, n_blocks = stored.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(partitions(spark), -(-entries // BUCKET_WORDS))
    totals = scratch.save(word_totals(stored, buckets, head), "totals")
    size = totals.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = totals.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.*").orderBy(F.desc("counts"), "words").limit(head).collect()
    words = [bytes(r.words) for r in top]
    bigrams = head_bigrams(stored, words, n_blocks)
    own = exchange(bigrams, classes)
    answers = scratch.save(assign(stored, buckets, words, own, bigrams, classes), "answers")
    by = _tree_sum(answers.filter(F.col("block") == -1).select(F.col("bucket").alias("at"), "blob"), buckets)
    by_class = by[0] if by else np.zeros(classes + 2, np.int64)
    model = Model(int(size[1]), int(size[0]), classes, by_class)
    lists = answers.filter(F.col("block") >= 0).groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
    joined = stored.select("block", "ids", "held", "lengths", "tokens", "vocab").join(lists, "block").drop("block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emit double, jumps binary, sums binary"
    scored = scratch.save(joined.mapInArrow(_scored(model, buckets), schema), "scored")
    scratch.drop("blocks", "totals", "answers")
    n = (classes + 2) ** 2

    sums = _tree_sum(scored.filter(F.col("sums").isNotNull()).select(F.xxhash64("sums").alias("at"), F.col("sums").alias("blob")), n_blocks) or [np.zeros(n)] * 3
    jump = transitions(sums, classes, by_class).ravel()

    def finish(batches):
        for batch in batches:
            score = []
            for emit, jumps in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                k = len(jumps) // 6
                score.append(emit + float(np.frombuffer(jumps, np.uint32, k, 2 * k).astype(np.float64) @ jump[np.frombuffer(jumps, np.uint16, k)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array([model.n] * len(score), pa.int64()), batch.column(6), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = scored.filter(F.col("sums").isNull()).select("doc_id", "held_out", "n_tokens", "n_known", "emit", "jumps", "base_score")
    return rows.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
