import random

import numpy as np
import pandas as pd
import pytest

from plexum.llm import neardup
from plexum.llm.common import Scratch
from plexum.llm.components import components

LOW = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def brute(rows, width):
    """doc id -> (set size, least reachable id), from all pairs."""
    sets, up = [], {}
    for key, text in rows:
        w = (text or "").encode().translate(LOW).split()
        sets.append((key, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
        up.setdefault(key, key)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets}


def edited(rng, base, words, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


@pytest.mark.parametrize("width,short,block", [(2, 16, 256), (5, 16, 256), (2, 2, 8)])
def test_against_all_pairs(spark, words, monkeypatch, width, short, block):
    """Groups near the threshold, small sets, common shingles; also with short lists and small blocks, so that all ways are taken."""
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(width)
    rows = []
    for g in range(6):
        base = " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.choice([6, 20, 60, 150])))
        for _ in range(25):
            rows.append(edited(rng, base, words, rng.randint(0, max(1, len(base.split()) // 12))))
    rows += [" ".join(rng.choice(words[:8]) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["", " ", None, "A", "a"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    out = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    want = brute(rows, width)
    assert {k: (r.n_shingles, r.component_id) for k, r in out.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in out.items())


def test_odd_rows(docs, no_docs, rows):
    out = neardup.near_duplicates(docs, 2).collect()
    assert len(out) == len(rows)
    want = brute([(r[0], r[1]) for r in rows if r[0] is not None], 2)
    assert all(r.component_id == want[r.doc_id][1] for r in out if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {k for k, (_, c) in brute([(r[0], r[1]) for r in rows if r[0] is not None], 5).items() if k == c}
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.drop_near_duplicates(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, i) for i in range(201, 260)] + [(300, 300), (None, 4), (400, 401), (401, 400)]
    out = dict(components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect())
    assert out == {i: 0 for i in range(91)} | {i: 200 for i in range(200, 260)} | {400: 400, 401: 400}


def test_equal_upper_halves(spark):
    """A pair at exactly .8, 40 of 50, stays one when two shared values of a sketch agree in their upper halves."""
    value = lambda i: (10 << 32) + i if i in (10, 11) else (i << 32) + 5
    sets = {1: range(45), 2: range(5, 50)}
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in s)) for k, s in sets.items()], "doc_id long, text string")
    heads = spark.createDataFrame([(k, len(s), sorted(map(value, s))) for k, s in sets.items()], "doc_id long, n int, sketch array<long>")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    links = neardup.verify(pairs, docs, heads, 1, 64, 30, 4, 5, Scratch(spark, "test"), "halves").collect()
    assert [tuple(r) for r in links] == [(1, 2)]


@pytest.mark.parametrize("share", [0.5, 0.78, 0.9])
def test_sketches_of_a_block(share):
    """A block's rows keep a partner by the same line that the union of two sketches draws."""
    rng = np.random.default_rng(int(share * 100))
    pool = rng.integers(-(2**62), 2**62, 400)
    sizes = rng.integers(20, 200, 60)
    sets = [np.unique(np.concatenate([pool[: int(n * share)], rng.integers(-(2**62), 2**62, n - int(n * share))])) for n in sizes]
    least = [np.sort(x.view(np.uint64))[:64] for x in sets]
    roots = rng.integers(0, 3, 60)
    pdf = pd.DataFrame({"doc_id": range(60), "root": roots, "n": [len(x) for x in sets], "sketch": [x.view(np.int64) for x in least]})
    want = []
    for i, x in enumerate(least):
        found = False
        for j, y in enumerate(least):
            a, b = len(sets[i]), len(sets[j])
            if roots[i] == roots[j] or 5 * a < 4 * b or 5 * b < 4 * a:
                continue
            union, both = sorted({*x.tolist()} | {*y.tolist()}), {*x.tolist()} & {*y.tolist()}
            found |= 5 * len(both) >= 4 * len(union) if max(a, b) <= 64 else len(both & {*union[:64]}) >= neardup.FULL_OVERLAP
        want.append(found)
    assert neardup._with_partner(pdf, 64, neardup.FULL_OVERLAP, 4, 5).tolist() == want


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Values, lists and keys of blocks are many rows behind small files; on the driver a large group's take hundreds of MB."""
    plans, save = {}, Scratch.save

    def saved(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", saved)
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(40)) + f" end{k}") for k in range(30)], "doc_id long, text string")
    assert neardup.near_duplicates(docs, 2).filter("kept").count() == 1
    for name in ("lists", "others", "near"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], name
