"""Exact substring removal by prefix doubling over sampled positions.

Ranks of strings of 1, 2, 4, ... bytes are named from pairs (rank at i, rank at i + h), the offset h doubling; a string of any length between
two powers is the pair of the ranks at its begin and of its last bytes. Names are 64-bit hashes of the pairs, the same everywhere, so that
a rank is made where its text is, and only pairs that have to be held against other documents' pairs move. Spark groups the pairs, in rounds
of growing length; a pair that is unique ends its position's part, and each round keeps only what the last one could not tell apart:

* Round 0 ranks `gram`-byte strings. Each window is led by its gram of least rank (first of equals), so equal windows have equal leaders at
  equal offsets, and only positions of leaders need a rank. Windows in a row with one leader are a span. Unique leaders end here.
* Spans of a leader that are equal throughout are repeated throughout, whatever their number, and go on as one.
* Doubling rounds pair ranks at offset h = gram, 2 gram, ... up to the threshold, on from the leader and back from it. A pair that only one
  span of the leader has ends all windows that hold both of its halves.
* The next round pairs, for STEP windows in a row, the ranks of the string that they have in common; unique ones end. If the string
  that covers those windows occurs twice, all of them are repeated.
* The last round pairs the ranks of single windows, the full length, for what is left.

A pair is 128 bits, or a rank under that of its leader. Pairs are grouped by aggregation, which combines before the shuffle, and joined
back, so a passage that very many documents share is never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import Scratch, as_bytes, sliced

LENGTH = 200
GRAM = 32
STEP = 21
#: Bytes whose hashes a task holds at once.
CHUNK = 1 << 20
_LOW = (1 << 26) - 1
_ROW = ("rk", "rk2")
_SPAN = "rk long, rk2 long, lo long, hi long, p long, g long, sig long"


def ranks(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Ranks of all strings of 1, 2, 4, ... `most` bytes (a power of two): each is named from the pair of ranks of its halves."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out, m = {1: h}, 1
    while m < most:
        a = h[:-m] * np.uint64(0xBF58476D1CE4E5B9 + 2 * m)
        a ^= a >> np.uint64(29)
        a += h[m:]
        a *= np.uint64(0x94D049BB133111EB)
        a ^= a >> np.uint64(32)
        h = a
        m *= 2
        out[m] = h
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    return ranks(data, gram)[gram]


def top_of(length: int, step: int) -> int:
    """The longest power of two within the string that `step` windows in a row have in common; two such strings cover all of them."""
    top = 1 << ((length - step + 1).bit_length() - 1)
    if length + step - 1 > 2 * top:
        raise ValueError("step is too large for the length")
    return top


def _named(h: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """One name from the ranks h at several places and plain numbers."""
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x.astype(np.uint64)
        out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def spans(texts: list[bytes], length: int, gram: int, top: int) -> tuple[np.ndarray, ...]:
    """Per span of the texts in a row: leader rank, leader place, first and last window start, and the span's own rank. Windows never cross texts."""
    data, wide = b"".join(texts), length - gram + 1
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    sizes = np.array([len(x) for x in texts], np.int64)
    if n <= 0 or not (sizes >= length).any():
        return none, none, none, none, none
    named = ranks(np.frombuffer(data, np.uint8), max(gram, top))
    h = named[gram]
    key = (h & ~np.uint64(_LOW)) | np.arange(len(h), dtype=np.uint64)
    key = np.concatenate([key, np.full(-len(key) % wide, np.iinfo(np.uint64).max)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(key, axis=1).ravel()[wide - 1 :]
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    leader = (np.minimum(behind[:n], ahead[:n]) & np.uint64(_LOW)).astype(np.int64)
    ends = np.cumsum(sizes)
    turn = np.zeros(len(data) + 1, np.int8)
    whole = sizes >= length
    np.add.at(turn, (ends - sizes)[whole], 1)
    np.add.at(turn, (ends - length + 1)[whole], -1)
    at = np.flatnonzero(np.cumsum(turn[:n]))
    cut = np.flatnonzero((np.diff(leader[at]) != 0) | (np.diff(at) != 1)) + 1
    first, last = at[np.concatenate(([0], cut))], at[np.concatenate((cut, [len(at)])) - 1]
    # Strings of `top` bytes that follow each other within `top` bytes from the span's begin to its end, with its length and the leader's place.
    r, size = named[top], last - first + length
    k = -(-(2 * length - gram - top) // top)
    blocks = [r[first + (size - top) * i // k] for i in range(k + 1)]
    sig = _named(r, [*blocks, size, leader[first] - first])
    return h[leader[first]].view(np.int64), leader[first], first, last, sig.view(np.int64)


def _chunks(keys: list, texts: list, length: int) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Rows in chunks of about CHUNK bytes: keys, where the part begins in its text, and the part. Long texts are split with an overlap."""
    own, begin, parts, size = [], [], [], 0
    for key, text in zip(keys, texts):
        data = as_bytes(text)
        if len(data) < length:
            continue
        for a in range(0, len(data) - length + 1, CHUNK):
            part = data[a : a + CHUNK + length - 1]
            own.append(key)
            begin.append(a)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield own, begin, parts
                own, begin, parts, size = [], [], [], 0
    if parts:
        yield own, begin, parts


def _spans(docs: DataFrame, length: int, gram: int, top: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for own, begin, parts in _chunks(keys, batch.column(2).to_pylist(), length):
                g, p, lo, hi, sig = spans(parts, length, gram, top)
                sizes = np.array([len(x) for x in parts])
                ends = np.cumsum(sizes)
                row = np.searchsorted(ends, lo, "right")
                shift = np.array(begin)[row] - (ends - sizes)[row]
                own = np.array(own, np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[:, 0], own[:, 1], lo + shift, hi + shift, p + shift, g, sig)], names=["rk", "rk2", "lo", "hi", "p", "g", "sig"])

    return docs.select(*_ROW, "text").mapInArrow(run, _SPAN)


def _packed(docs: DataFrame) -> DataFrame:
    """(rk, rk2, doc_id, z): texts compressed before they move."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            z = [packer.compress(as_bytes(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3)), pa.array(z, pa.binary())], names=[*_ROW, "doc_id", "z"])

    return docs.select(*_ROW, "text", "doc_id").mapInArrow(run, "rk long, rk2 long, doc_id long, z binary")


def _levels(gram: int, length: int) -> list[int]:
    """Lengths of the doubling rounds: 2 gram, 4 gram, ... under the threshold."""
    out, h = [], 2 * gram
    while h < length:
        out.append(h)
        h *= 2
    return out


def _strings(asked: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, sig, off, s) and, by level h, pairs of ranks at the leader (f) and back from its end (b): the span's bytes, and how far the
    leader is from its first window's start. A pair is null where the span's windows do not hold it. asked: g, sig, rk, rk2, lo, hi, p."""
    lists = asked.groupBy(*_ROW).agg(F.collect_list(F.struct("g", "sig", "lo", "hi", "p")).alias("own"))
    drawn = _packed(docs).select(*_ROW, "z").dropDuplicates(list(_ROW)).join(lists, list(_ROW)).select("z", "own")
    levels = _levels(gram, length)
    names = [f"{side}{h}{half}" for h in levels for side in "fb" for half in "xy"]
    schema = ", ".join(["g long, sig long, off int, s binary", *(f"{x} long" for x in names)])

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            rows = []
            for z, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = opener.decompress(z)
                rows += [(x["g"], x["sig"], x["p"] - x["lo"], data[x["lo"] : x["hi"] + length]) for x in own]
            for i in range(0, len(rows), 4096):
                g, sig, off, s = zip(*rows[i : i + 4096])
                sizes = np.array([len(x) for x in s])
                base, off_ = np.cumsum(sizes) - sizes, np.array(off)
                named = ranks(np.frombuffer(b"".join(s), np.uint8), levels[-1] // 2) if levels else {}
                columns = []
                for h in levels:
                    for at in (off_, off_ + gram - h):
                        fits = (at >= 0) & (at + h <= sizes)
                        for place in (at, at + h // 2):
                            r = named[h // 2]
                            columns.append(pa.array(r[np.clip(base + place, 0, len(r) - 1)].view(np.int64), mask=~fits))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip((g, sig, off, s), kinds)), *columns], names=["g", "sig", "off", "s", *names])

    return drawn.mapInArrow(run, schema)


def _narrowed(strings: DataFrame, length: int, gram: int, scratch: Scratch) -> DataFrame:
    """(g, sig, low, high): how far before the leader the windows begin that no doubling round could end; spans without any are left out."""
    ends = F.col("off") - F.length("s") + length
    now = strings.select("g", "sig", ends.cast("int").alias("low"), F.col("off").alias("high"), *[c for c in strings.columns if c[0] in "fb" and c[1:2].isdigit()])
    for h in _levels(gram, length):
        for side in "fb":
            pair = [f"{side}{h}x", f"{side}{h}y"]
            alone = now.filter(F.col(pair[0]).isNotNull()).groupBy("g", *pair).agg(F.count(F.lit(1)).alias("_n"), F.first("sig").alias("sig")).filter(F.col("_n") == 1).select("g", "sig", F.lit(True).alias("_alone"))
            now = now.join(alone, ["g", "sig"], "left").drop(*pair)
            if side == "f":
                now = now.withColumn("low", F.when(F.col("_alone"), F.greatest("low", F.lit(length - h + 1))).otherwise(F.col("low")))
            else:
                now = now.withColumn("high", F.when(F.col("_alone"), F.least("high", F.lit(h - gram - 1))).otherwise(F.col("high")))
            now = now.drop("_alone").filter(F.col("low") <= F.col("high"))
        now = scratch.save(now, f"level-{h}")
    return now.select("g", "sig", "low", "high")


def _batches(batch: pa.RecordBatch, top: int, at: int):
    """Ranks of `top` bytes over the strings of a batch in a row, and where each begins."""
    s = batch.column(at).to_pylist()
    sizes = np.array([len(x) for x in s], np.int64)
    return ranks(np.frombuffer(b"".join(s), np.uint8), top)[top], np.cumsum(sizes) - sizes


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counted things the row it is of, and its number there."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _steps(strings: DataFrame, length: int, gram: int, step: int, top: int) -> DataFrame:
    """(g, sig, j, core pair, cover pair, a, b): for windows whose leader is j*step and up to `step` bytes in, the ranks of the string they have
    in common, of the string that covers all of them (null if the span has only some), and which offsets a..b of them the span has."""
    most = length - gram

    def run(batches):
        for batch in sliced(batches):
            r, base = _batches(batch, top, 3)
            off, low, high = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 4, 5))
            row, k = _spread(high // step - low // step + 1)
            j = (low // step)[row] + k
            x, y = j * step, np.minimum(j * step + step - 1, most)
            at, lo, up = (base + off)[row], low[row], high[row]
            whole = (lo <= x) & (y <= up)
            pick = lambda place: r[np.clip(place, 0, len(r) - 1)].view(np.int64)
            columns = [pick(at - x), pick(at - y + length - top)]
            covers = [pa.array(pick(at - y), mask=~whole), pa.array(pick(at - x + length - top), mask=~whole)]
            own = [batch.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip((*own, j, *columns), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))), *covers, pa.array(np.maximum(x, lo), pa.int32()), pa.array(np.minimum(y, up), pa.int32())], names=["g", "sig", "j", "core", "core2", "cover", "cover2", "a", "b"])

    return strings.select("g", "sig", "off", "s", "low", "high").mapInArrow(run, "g long, sig long, j int, core long, core2 long, cover long, cover2 long, a int, b int")


def _windows(drawn: DataFrame, length: int, top: int) -> DataFrame:
    """(g, sig, l, w, w2): the windows whose leader is l bytes in, as pairs of ranks, for the ranges asked for."""

    def run(batches):
        for batch in sliced(batches):
            r, base = _batches(batch, top, 3)
            ranges = [(i, x["a"], x["b"]) for i, own in enumerate(batch.column(4).to_pylist()) for x in own]
            if not ranges:
                continue
            who, a, b = (np.array(c, np.int64) for c in zip(*ranges))
            row, k = _spread(b - a + 1)
            l, who = a[row] + k, who[row]  # noqa: E741
            at = (base + batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))[who] - l
            own = [batch.column(c).to_numpy(zero_copy_only=False)[who] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*own, l, r[at].view(np.int64), r[at + length - top].view(np.int64)), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["g", "sig", "l", "w", "w2"])

    return drawn.select("g", "sig", "off", "s", "own").mapInArrow(run, "g long, sig long, l int, w long, w2 long")


def _repeated(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows whose keys occur twice or more. Rows and counts are written first: rows are made once, and Spark can split the join's sides."""
    rows = scratch.save(rows, f"{name}-rows")
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*keys)
    out = scratch.save(rows.join(scratch.save(twice, f"{name}-keys"), keys, "left_semi"), name)
    scratch.drop(f"{name}-rows", f"{name}-keys")
    return out


def repeated_bytes(docs: DataFrame, length: int, gram: int, step: int, scratch: Scratch) -> DataFrame:
    """(rk, rk2, runs): per row key the byte ranges (a, b), b excluded, of repeated windows; ranges may overlap. docs: rk, rk2, text, doc_id;
    copies of a row share its key, and their spans, found once each, make equal ranges, which are kept once."""
    top = top_of(length, step)
    # Texts are ranked once; only the leaders' column is read to count them.
    every = scratch.save(_spans(docs, length, gram, top), "every")
    twice = scratch.save(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("g"), "leaders")
    held = scratch.save(every.join(twice, "g", "left_semi"), "spans")
    scratch.drop("every", "leaders")
    first = [F.first(c).alias(c) for c in (*_ROW, "lo", "hi", "p")]
    ranked = scratch.save(held.groupBy("g", "sig").agg(F.count(F.lit(1)).alias("n"), *first), "ranked")
    rivals = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1).select("g")
    strings = scratch.save(_strings(ranked.join(rivals, "g", "left_semi").drop("n"), docs, length, gram), "strings")
    narrowed = _narrowed(strings, length, gram, scratch)
    strings = scratch.save(strings.select("g", "sig", "off", "s").join(narrowed, ["g", "sig"]), "live")
    scratch.drop("strings", *(f"level-{h}" for h in _levels(gram, length)))
    steps = _repeated(_steps(strings, length, gram, step, top), ["g", "j", "core", "core2"], scratch, "steps")
    covered = _repeated(steps.filter(F.col("cover").isNotNull()).select("g", "sig", "j", "cover", "cover2", "a", "b"), ["g", "j", "cover", "cover2"], scratch, "covered").select("g", "sig", "j", "a", "b")
    # A span that occurs twice is decided, but its windows are still rivals of the others.
    asked = steps.join(covered.select("g", "sig", "j"), ["g", "sig", "j"], "left_anti")
    meets = scratch.save(asked.select("g", "j").distinct(), "meets")
    asked = steps.join(meets, ["g", "j"], "left_semi").groupBy("g", "sig").agg(F.collect_list(F.struct("a", "b")).alias("own"))
    windows = _repeated(_windows(strings.join(asked, ["g", "sig"]), length, top), ["g", "l", "w", "w2"], scratch, "windows").select("g", "sig", F.col("l").alias("a"), F.col("l").alias("b"))
    offsets = scratch.save(covered.select("g", "sig", "a", "b").unionByName(windows).groupBy("g", "sig").agg(F.collect_set(F.struct("a", "b")).alias("own")), "offsets")
    scratch.drop("live", "steps", "covered", "windows", "meets")
    marked = ranked.select("g", "sig", (F.col("n") > 1).alias("whole")).join(offsets, ["g", "sig"], "left").filter(F.col("whole") | F.col("own").isNotNull())
    # Both sides of the next join are plain exchanges, so Spark can split a span that very many texts, or one text, repeat.
    marked = scratch.save(marked, "marked")
    rows = held.join(marked, ["g", "sig"])
    part = F.transform("own", lambda x: F.struct((F.col("p") - x["b"]).alias("a"), (F.col("p") - x["a"] + length).alias("b")))
    all_of = F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b")))
    runs = rows.select(*_ROW, F.explode(F.when(F.col("whole"), all_of).otherwise(part)).alias("r")).groupBy(*_ROW).agg(F.collect_set("r").alias("runs"))
    runs = scratch.save(runs, "runs")
    scratch.drop("spans", "ranked", "offsets", "marked")
    return runs


def cut(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes that are left, how many were removed, and in how many maximal runs."""
    kept, end, start, n, gone = [], 0, 0, 0, 0
    for a, b in sorted(runs):
        if not n or a > end:
            kept.append(data[end:a])
            n, start = n + 1, a
        if b > end:
            gone += b - max(end, start)
            end = b
    kept.append(data[end:])
    return b"".join(kept), gone, n


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes that are left, `kept`.

    A null text is empty; texts of under `length` bytes lose nothing. Repeated rows are copies of each other and lose every window; null
    ids stay null; other columns are not read. Texts of any length are hashed chunk by chunk.
    """
    if gram & (gram - 1) or not 0 < gram < length:
        raise ValueError("gram is a power of two under length")
    top_of(length, step)
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # Copies of a row have one key; their equal runs are one run.
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64(F.lit(1), "text", "doc_id").alias("rk2"), "text", "doc_id")
    runs = repeated_bytes(docs, length, gram, step, scratch)

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            rows = []
            for z, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = opener.decompress(z)
                kept, gone, n = cut(data, [(x["a"], x["b"]) for x in own or ()])
                rows.append((len(data), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return _packed(docs).join(runs, list(_ROW), "left").select("doc_id", "z", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
