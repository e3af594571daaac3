import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plexum.llm import common, packing


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan(histogram):
    planned = packing.plan(histogram, 64, rounds=30)
    got = defaultdict(int)
    for lengths, n in planned:
        assert 0 < sum(lengths) <= 64 and n > 0
        for x in lengths:
            got[x] += n
    assert got == histogram
    used, least = sum(n for _, n in planned), -(-sum(k * v for k, v in histogram.items()) // 64)
    assert least <= used <= 1.05 * sum(n for _, n in packing.best_fit(histogram, 64)) + 1


def test_program_covers_and_places():
    """Many lengths, most of them rare: all are covered, by about as many sequences as have to be, and best-fit gets a small rest."""
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(np.clip(rng.lognormal(4.4, 1.1, 3000), 1, 511).astype(int), return_counts=True))}
    got = packing.solve(histogram, 512)
    shares, covered, bound = got[0], defaultdict(float), sum(k * n for k, n in histogram.items()) / 512
    for lengths, share in shares:
        assert sum(lengths) <= 512
        for x in lengths:
            covered[x] += share
    assert min(covered[x] / n for x, n in histogram.items()) >= 1 - 1e-6 and got[1] >= 1 - 1e-6
    assert got[2] <= bound + 1 and sum(x for _, x in shares) <= 1.15 * bound
    out, left = packing.place(histogram, 512)
    assert sum(left.values()) <= 0.1 * sum(histogram.values())
    assert sum(n for _, n in packing.plan(histogram, 512)) <= sum(n for _, n in packing.best_fit(histogram, 512)) + 1


def test_price():
    rng = random.Random(0)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 20), 5)))
        value = np.array([rng.random() for _ in sizes])
        got = packing.price(sizes, np.full(5, 99), value, 24)
        best = [0.0] * 25
        for c in range(1, 25):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(sizes, value) if s <= c])
        assert sizes @ got <= 24 and abs(value @ got - best[24]) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Bc", "'s", "12", "é", "漢字", "\x1c", "\x85", "!?", "<|endoftext|>", "🙂", "   \n ", "'ll ", "　", "Wörter,", " ñandú!?", "Слово.", "λόγος;", "ʯ", "ªº", "a%b", "(see)", " x.y"]), max_size=12).map("".join))
def test_tokenizer(x):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.Ids(path, most=3).of(x) == packing.tokenizer_of(path).encode(x, add_special_tokens=False).ids


def test_ids_are_kept_packed():
    """A word met before costs no number objects: what is remembered and given are the ids' bytes."""
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    text = "the cat, the dog (see) the cat,"
    assert ids.packed(text) == np.array(ids.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == ids.packed(text)
    assert ids.known and all(isinstance(x, bytes) for x in ids.known.values())


def test_long_runs():
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(ids.of(" " * 1_000_000)) == 1_000_000 and len(ids.of("\n" * 1_000_000)) == 500_000
    assert ids.of("a" * 30_000) == ids.model.encode("a" * 30_000, add_special_tokens=False).ids


def test_long_white_space(spark):
    got = packing.pack(spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 5000)], "doc_id long, text string")).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {1: 1_000_001, 2: 2501}


def test_operator(spark, docs, no_docs, rows):
    long = " ".join(f"word{k}" for k in range(3000))
    docs = docs.unionByName(spark.createDataFrame([(900, long)], "doc_id long, text string"), allowMissingColumns=True)
    out = packing.pack(docs).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for k, text in [*((r[0], r[1]) for r in rows), (900, long)]:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in out) // 2048) + 1
    assert packing.pack(no_docs).count() == 0


def test_a_worker_drops_what_other_tasks_remembered():
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    made = [common.remembered(x, lambda: [x]) for x in ("one", "two")]
    list(common.sliced(iter([batch]), keeps="two"))
    assert common.remembered("two", list) is made[1] and common.remembered("one", list) is not made[0]
    list(common.sliced(iter([])))
    assert common.remembered("two", list) is not made[1]
