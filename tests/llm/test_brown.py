import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from plexum.llm import brown, common

LOW = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def tokens(text):
    return (text or "").encode().translate(LOW).split() + [b""]


def test_base_and_counts(docs, no_docs, rows):
    out = brown.class_scores(docs, classes=4, head=20, block_bytes=3000).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    count = Counter(w for k, t, *_ in rows if not held(k) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = [(k, held(k), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for k, t, *_ in rows for w in [tokens(t)]]
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out], key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in out)
    assert brown.class_scores(no_docs).count() == 0


def test_model_is_a_distribution(spark):
    """Texts of one word, known or not, and the empty text are together no likelier than 1; word order counts."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["red", "blue", "green"]) + " " + rng.choice(["cat", "dog", "cow", "pig"]) for _ in range(9)) + f" once{k}" for k in range(60)]
    known = sorted({w.decode() for t in texts for w in tokens(t)})
    held = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 7 == 2]
    learned = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 7 != 2]
    probe = [*known, "unseen", "red cat blue dog once0", "red blue cat dog once0"]
    out = {r.doc_id: r.score for r in brown.class_scores(spark.createDataFrame(list(zip(learned, texts)) + list(zip(held, probe)), "doc_id long, text string"), classes=3, head=6).collect()}
    score = {t: out[k] for k, t in zip(held, probe)}
    assert 0 < sum(10 ** score[w] for w in [*known, "unseen"]) <= 1 + 1e-9
    assert score["red cat blue dog once0"] > score["red blue cat dog once0"]


def test_transitions_sum_to_one():
    rng = np.random.default_rng(0)
    k = 5
    pairs = rng.integers(0, 50, (k + 2) ** 2)
    once = (pairs * rng.random((k + 2) ** 2) * 0.5).astype(int)
    jump = brown.transitions([pairs, once, once], k, rng.integers(1, 90, k + 2))
    assert np.allclose((10**jump).sum(axis=1), 1)
    empty = brown.transitions([np.zeros((k + 2) ** 2)] * 3, k, np.zeros(k + 2, int))
    assert np.allclose((10**empty).sum(axis=1), 1)


def test_exchange_finds_classes():
    rng = random.Random(2)
    n = 30
    bigrams = np.zeros((n + 2, n + 2), int)
    for _ in range(20_000):
        a = rng.randrange(n)
        b = rng.choice([x for x in range(n) if x // 10 == (a // 10 + 1) % 3])
        bigrams[a, b] += 1
    own = brown.exchange(bigrams, 3)
    assert all(len(set(own[10 * g : 10 * g + 10])) == 1 for g in range(3)) and len(set(own[:n])) == 3


def test_better_than_base(spark):
    rng = random.Random(3)
    tongues = [[f"{c}{a}{b}" for a in "aeiou" for b in "ndrstl"] for c in "bkv"]
    rows = [(k, " ".join(rng.choice(rng.choice([tongues[k % 3]])) for _ in range(60)) + f" rare{rng.randrange(900)}") for k in range(300)]
    out = brown.class_scores(spark.createDataFrame(rows, "doc_id long, text string"), classes=6, head=50).filter("held_out").collect()
    assert sum(r.score for r in out) > 0.85 * sum(r.base_score for r in out)


def test_workers_get_few_blocks_at_once(spark, docs, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, step = spark.conf.get(key), brown.assign
    monkeypatch.setattr(brown, "assign", lambda *a: seen.append(spark.conf.get(key)) or step(*a))
    brown.class_scores(docs, classes=4, head=20, block_bytes=3000)
    assert seen == [str(brown.BATCH_BYTES)] and spark.conf.get(key) == before
    rows = spark.range(40, numPartitions=1).selectExpr("repeat('x', 50000) as x")
    with common.batch_bytes(spark, 100_000):
        sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 4
