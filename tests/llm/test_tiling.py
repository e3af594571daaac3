import random
import time

from plexum.llm import tiling


def greedy(a, b, least):
    """Greedy string tiling as defined: the longest common run of unmarked tokens, the first in a and then in b, again and again."""
    ma, mb, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and a[i + k] and i + k not in ma and j + k not in mb:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        out.append(best)
        ma.update(range(best[0], best[0] + best[2]))
        mb.update(range(best[1], best[1] + best[2]))


def test_against_definition():
    for seed in range(150):
        rng = random.Random(seed)
        item = [rng.choice("abcd") for _ in range(rng.randint(5, 25))]
        doc = [rng.choice("abcdxy") for _ in range(rng.randint(0, 40))]
        if seed % 2:
            k = len(item) // 2
            doc[3:3] = item[k:] + ["x"] + item[:k]
        items = tiling.Items([(7, " ".join(item).encode())], 3)
        ids, found = items.candidates(" ".join(doc).encode())
        tiles = tiling.tile(ids, items.items[0][1], 3) if found else []
        assert tiles == greedy(ids.tolist(), items.items[0][1].tolist(), 3), seed
        for width in (1, 3, 5):
            h = tiling.rolling(ids, width).tolist()
            assert all((h[i] == h[j]) == (ids[i : i + width].tolist() == ids[j : j + width].tolist()) for i in range(len(h)) for j in range(i))


def test_short_items_and_unspaced_scripts():
    items = tiling.Items([(1, b"alpha beta"), (2, "\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059".encode()), (3, b"x"), (4, b"")], 5)
    found = lambda t: {items.items[o][0] for o in items.candidates(t.encode())[1] if tiling.covered_by(items.candidates(t.encode())[0], items.items[o][1], 5)[0] == len(items.items[o][1])}
    assert found("so Alpha, beta it is") == {1} and found("beta alpha") == set() == found("") == found("alpha x2 beta")
    assert found("\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059\u3002") == {2} and found("an x") == {3}


def test_repeats_in_linear_time():
    items = tiling.Items([(1, b"spam " * 300)], 5)
    start = time.process_time()
    ids, found = items.candidates(b"spam " * 200_000)
    assert found == [0] and tiling.tile(ids, items.items[0][1], 5) == [(0, 0, 300)]
    assert time.process_time() - start < 10


def test_operator(spark, docs, no_docs):
    rng = random.Random(1)
    passage = [f"w{rng.randrange(90)}" for _ in range(40)]
    noise = lambda n: " ".join(f"n{rng.randrange(900)}" for _ in range(n))
    texts = {1: noise(50) + " " + " ".join(passage).upper() + ", " + noise(50), 2: " ".join(passage[20:]) + " " + noise(30) + " " + " ".join(passage[:20]), 3: noise(300), 4: " ".join(passage[:12]) + noise(100), 5: None, 6: "", 7: " ".join(passage) * 2}
    bench = spark.createDataFrame([(1, " ".join(passage), "x"), (2, None, "x"), (3, "short one", "x"), (4, "", None)], "item_id long, text string, coverage string")
    own = spark.createDataFrame([(k, t, "c") for k, t in texts.items()] + [(2, texts[2], "c"), (None, texts[1], "c")], "doc_id long, text string, coverage string")
    got = sorted((r.doc_id or 0, r.item_id) for r in tiling.leaks(own, bench).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1), (7, 1)]
    assert sorted((r.doc_id or 0, r.item_id) for r in tiling.leaks(own, bench, block_bytes=1).collect()) == got
    kept = tiling.drop_leaking(own, bench)
    assert kept.columns == own.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert sorted(r.doc_id for r in tiling.drop_leaking(own, bench, block_bytes=1).collect()) == [3, 4, 5, 6]
    assert tiling.leaks(no_docs, bench).count() == 0 == tiling.leaks(docs, bench.limit(0)).count()
    assert tiling.drop_leaking(docs, bench.limit(0)).count() == docs.count()
