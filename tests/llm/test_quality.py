import random
import zlib

import numpy as np

from plexum.llm import quality


def test_forest_matches_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    f = quality.fit(x, y, trees=30)
    for row, got in zip(x[:50], f.raw(x[:50])):
        total = f.base
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        assert abs(total - got) < 1e-9
    assert ((f.predict(x) > 0.5) == y).mean() > 0.95
    again = quality.fit(x, y, trees=30)
    assert np.array_equal(f.predict(x), again.predict(x))


def test_constant():
    for y in (np.zeros(0), np.ones(50)):
        f = quality.fit(np.zeros((len(y), 3)), y)
        assert len(f.predict(np.zeros((4, 3)))) == 4 and len(f.predict(np.zeros((0, 3)))) == 0


def test_operator(spark, docs, no_docs, words):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        bad = rng.random() < 0.3
        text = " | ".join(rng.choice(words) for _ in range(80)) if bad else " ".join(rng.choice(words) for _ in range(80)) + "."
        rows.append((k, text, int(not bad)))
    own = spark.createDataFrame([(k, t, "q") for k, t, _ in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(own, labels)
    out = {r.doc_id: r for r in quality.score_documents(own, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())
    held = [(out[k].predicted, q) for k, _, q in rows if out[k].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    mixed = quality.score_documents(docs, model)
    assert mixed.count() == docs.count() and mixed.filter("score is null").count() == 0
    kept = quality.keep_good(own, model)
    assert kept.columns == own.columns and kept.count() == sum(r.predicted for r in out.values())
    assert quality.score_documents(no_docs, quality.train(no_docs, labels.limit(0))).count() == 0
