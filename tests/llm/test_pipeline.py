import random

import corpus_pipeline
from plexum.llm import lines, neardup, quality, tiling

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(tmp_path, spark, words):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n)) + "."
    item = prose(30)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        text = " | ".join(rng.choice(words) for _ in range(70)) if bad else prose(rng.randint(60, 90))
        if not bad and k % 4 == 0:
            text = "Shared by all sites here.\n" + text
        if k % 50 == 7:
            text += " " + item
        labels.append((k, int(not bad), 0))
        rows.append((k, text, "en", f"s{k % 9}", len(text)))
    rows += [(1000 + k, rows[k][1] + " more", "en", "s1", 0) for k in (1, 2, 3)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "x", "en", None, 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, prose(25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path, words):
    rows = make(tmp_path, spark, words)
    d = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    docs, at = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert name == "best_fit_packing" or out.dtypes == docs.dtypes
        out.write.parquet(f"{d}/{name}")
        before, docs = docs, spark.read.parquet(f"{d}/{name}")
        at[name] = (before, docs)
    ids = lambda x: {r.doc_id for r in x.select("doc_id").collect()}
    source = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(source, spark.read.parquet(f"{d}/labels.parquet"))
    assert ids(at["quality_classifier"][1]) == {r.doc_id for r in quality.score_documents(source, model).filter("predicted = 1").collect()}
    kept = ids(at["quality_classifier"][1])
    assert not kept & {k for k in range(400) if k % 5 == 0} and kept >= {k for k in range(400) if k % 5}
    before, after = at["line_dedup"]
    assert ids(before) == ids(after)
    want = {r.doc_id: r.text for r in lines.line_report(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want and not any("Shared by all" in (t or "") for t in want.values())
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.doc_id < 400)
    before, after = at["near_dedup"]
    assert ids(after) == {r.doc_id for r in neardup.near_duplicates(before).filter("kept").collect()} and not ids(after) & {1001, 1002, 1003}
    before, after = at["decontamination"]
    leaking = {r.doc_id for r in tiling.leaks(before, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert ids(before) - ids(after) == leaking == {k for k in range(400) if k % 50 == 7 and k % 5} & ids(before)
    packed = at["best_fit_packing"][1]
    assert ids(packed) == ids(after)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, d).select(key).collect()))
    assert len(rows) > packed.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
