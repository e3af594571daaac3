import gzip
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plexum import schema as S
from plexum.plans import cli
from plexum.plans import experiment as E
from plexum.plans.evaluation import evaluate_results
from plexum.plans.figures import generate
from plexum.sources import artifacts, molecules
from plexum.sources import results as R
from plexum.streaming.append import stream_results

TINY = E.Experiment("tiny", (E.Dataset("er", "erdos_renyi", 4, 8, p=0.45), E.Dataset("sbm", "stochastic_block_model", 4, 8, p=0.8, p_out=0.05, blocks=2)), ("edge_insertion", "edge_deletion"), (0.0, 0.5, 1.0), (0, 1, 2, 3), ("structural_statistics_mmd", "wl_subtree_kernel_mmd"))
KEY = ["dataset", "perturbation", "alpha", "seed", "workflow"]


def scores(df):
    return {tuple(r[k] for k in KEY): (r.distribution_score, r.mean_shift_score, r.paired_score, r.edit_distance_raw) for r in df.collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    E.run_experiment(spark, TINY, out)
    return out


def test_grid(spark, whole):
    df = R.read_results(spark, f"{whole}/results")
    assert df.count() == E.expected_rows(TINY) == 96 and df.columns == [f.split()[0] for f in S.RESULTS.split(", ")]
    assert df.filter("status <> 'success'").count() == 0
    zero = df.filter("alpha = 0").agg(F.max("distribution_score"), F.max("edit_distance_raw"), F.max("paired_score")).first()
    assert tuple(zero) == pytest.approx((0, 0, 0), abs=1e-9)
    assert df.filter("alpha > 0 and workflow = 'wl_subtree_kernel_mmd'").filter(F.abs(F.col("distribution_score") - F.col("mean_shift_score") ** 2) > 1e-9).count() == 0
    assert json.load(open(f"{whole}/run_manifest.json"))["expected_rows"] == 96


def test_shards_merge_to_the_whole(spark, whole, tmp_path):
    for part in ("0:2", "2:4"):
        E.run_experiment(spark, TINY, f"{tmp_path}/{part[0]}", seed_range=part)
    shards = [R.read_results(spark, f"{tmp_path}/{k}/results") for k in "02"]
    merged = E.merge_runs([*shards, shards[0]])
    assert scores(merged) == scores(R.read_results(spark, f"{whole}/results"))
    with pytest.raises(ValueError, match="do not fit"):
        E.merge_runs([shards[0], shards[1].withColumn("schema_version", F.lit("other"))])
    with pytest.raises(ValueError):
        E.with_seed_range(TINY, "2:9")


def test_resume(spark, whole, tmp_path):
    out = str(tmp_path)
    rows = R.read_results(spark, f"{whole}/results")
    part = rows.filter("not (dataset = 'er' and seed = 3)").withColumn("status", F.when((F.col("seed") == 1) & (F.col("alpha") == 1.0), "failed").otherwise(F.col("status")))
    part.write.partitionBy("dataset", "seed").parquet(f"{out}/results")
    with pytest.raises(FileExistsError):
        E.run_experiment(spark, TINY, out)
    got = E.run_experiment(spark, TINY, out, resume=True)
    assert got.count() == 96 and got.filter("status = 'failed'").count() == 8
    got = E.run_experiment(spark, TINY, out, resume=True, rerun_failed=True)
    assert got.count() == 96 and got.filter("status = 'failed'").count() == 0 and scores(got) == scores(rows)
    with pytest.raises(ValueError, match="differs"):
        E.run_experiment(spark, replace(TINY, alphas=(0.0, 1.0)), out, resume=True)


def test_failures_are_rows(spark):
    bad = replace(TINY, workflows=("no_such_workflow",), seeds=(0,))
    df = E.results(spark, bad)
    assert df.count() == 12 and {r.status for r in df.collect()} == {"failed"} and "unknown workflow" in df.first().error_message


def test_hashes():
    assert E.config_hash(TINY) == E.config_hash(replace(TINY, seeds=(9,), name="x")) != E.config_hash(replace(TINY, alphas=(0.0,)))
    assert E.run_id(TINY).endswith(E.config_hash(TINY)) and E.seeds_from_count(3, 5) == (5, 6, 7)
    assert E.expected_rows(E.replication_experiment()) == 3 * 6 * 11 * 24 * 4


def test_csv_round_trip(spark, whole, tmp_path):
    df = R.read_results(spark, f"{whole}/results")
    R.write_table(df.coalesce(1), f"{tmp_path}/csv/results.csv")
    assert scores(R.read_results(spark, f"{tmp_path}/csv")) == scores(df)
    part = next((tmp_path / "csv/results.csv").glob("part-*.csv"))
    with gzip.open(tmp_path / "results.csv.gz", "wb") as f:
        f.write(part.read_bytes())
    assert R.resolve(spark, f"{tmp_path}/results.csv") == f"{tmp_path}/results.csv.gz" and R.read_results(spark, f"{tmp_path}/results.csv").count() == 96
    assert R.parse_csv(spark, part.read_text()).count() == 96
    odd = R.parse_csv(spark, "dataset,alpha,distribution_score,status\nd,x,inf,success\n").first()
    assert odd.alpha is None and odd.dataset == "d" and odd.seed is None
    assert [p.rsplit("/", 1)[-1] for p in R.discover_runs(spark, str(tmp_path))] == ["csv"]
    with pytest.raises(FileNotFoundError):
        R.resolve(spark, f"{tmp_path}/none")
    assert R.prepare(df, datasets=["er"]).count() == 48
    assert {r.dataset for r in R.labelled(df, "dataset", {"er": "ER"}).collect()} == {"ER", "sbm"}


def test_evaluation_figures_cli(spark, whole, tmp_path, capsys):
    got = evaluate_results(spark, f"{whole}/results", f"{tmp_path}/evaluation")
    assert got["evaluation_summary"].count() == 8 and got["final_matrix"].count() == 2 and got["failure_map"].count() == 4
    assert R.exists(spark, f"{tmp_path}/evaluation/final_matrix/_SUCCESS")
    names = generate(R.read_results(spark, f"{whole}/results"), f"{tmp_path}/figures")
    assert len(names) == 7 and all(open(n).read().startswith("<svg") for n in names)
    assert cli.main(["evaluate", f"{whole}/results", "--output", f"{tmp_path}/e2"], spark) == 0
    assert cli.main(["merge", f"{whole}/results", f"{whole}/results", "--output", f"{tmp_path}/m"], spark) == 0
    assert R.read_results(spark, f"{tmp_path}/m").count() == 96
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "--output", "x"], spark)


def test_records(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame([("graph", "a"), ("graph", "b"), ("graph", "a")], "kind string, body string")
    assert artifacts.write(rows, path).count() == 3
    artifacts.write(rows.filter("body = 'a'"), path)
    got = artifacts.read(spark, path)
    assert got.count() == 2 and got.filter("valid").count() == 2
    damaged = got.withColumn("body", F.lit("x")).drop("valid")
    damaged.write.parquet(f"{tmp_path}/damaged")
    refs = got.select(F.col("sha256").alias("graph_sha256"))
    assert artifacts.broken(refs, got).count() == 0 and artifacts.broken(refs, artifacts.read(spark, f"{tmp_path}/damaged")).count() == 2


def test_molecules(spark, tmp_path):
    def save(records, **change):
        with gzip.open(tmp_path / "train.jsonl.gz", "wt") as f:
            f.write("\n".join(json.dumps(r) for r in records))
        entry = {"file": "train.jsonl.gz", "count": len(records), "sha256": molecules.file_sha256(str(tmp_path / "train.jsonl.gz"))} | change
        json.dump({"schema": molecules.SCHEMA_NAME, "fingerprint": "f", "splits": {"train": entry}}, open(tmp_path / "manifest.json", "w"))
        return str(tmp_path)

    record = lambda i, **kw: {"source_id": f"m{i}", "num_nodes": 5, "atom_types": [0] * 5, "edges": [[0, 1], [1, 2], [2, 3]], "bond_types": [1, 1, 1]} | kw
    root = save([record(i) for i in range(12)])
    rows = molecules.read_split(spark, root, "train")
    assert rows.count() == 12 and molecules.load_manifest(spark, root, "f")
    some = molecules.sample(rows, 5, 3).collect()
    assert len({r.source_id for r in some}) == 5 and some == molecules.sample(rows, 5, 3).collect()
    g, e = molecules.as_population(rows)
    assert e.count() == 36 and g.count() == 12
    with pytest.raises(ValueError, match="exceeds"):
        molecules.sample(rows, 13, 0)
    with pytest.raises(ValueError, match="fingerprint"):
        molecules.load_manifest(spark, root, "g")
    for bad in (record(0, edges=[[0, 1], [1, 0], [2, 3]]), record(0, edges=[[0, 0], [1, 2], [2, 3]]), record(0, edges=[[0, 9], [1, 2], [2, 3]]), record(0, bond_types=[1])):
        with pytest.raises(ValueError, match="bad records"):
            molecules.read_split(spark, save([bad]), "train")
    with pytest.raises(ValueError, match="checksum"):
        molecules.read_split(spark, save([record(0)], sha256="0"), "train")
    matrix = spark.createDataFrame([("m", [[0, 2, 0], [2, 0, 1], [0, 1, 0]])], "source_id string, matrix array<array<int>>")
    assert {(r.u, r.v, r.bond) for r in molecules.from_adjacency(matrix).collect()} == {(0, 1, 2), (1, 2, 1)}


def test_stream(spark, whole, tmp_path):
    rows = R.read_results(spark, f"{whole}/results")
    rows.filter("seed < 3").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream_results(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        rows.filter("seed >= 2").write.mode("append").parquet(f"{tmp_path}/in")
    stream_results(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert scores(spark.read.parquet(f"{tmp_path}/out")) == scores(rows) and spark.read.parquet(f"{tmp_path}/out").count() == 96


def test_own_workflow(spark):
    E.register_workflow("edge_count", lambda n, edges, options: [float(len(edges))])
    E.register_workflow("degree_counts", lambda n, edges, options: {f"d{d}": 1.0 for d in {len(x) for x in E.K.adjacency(n, edges)}})
    try:
        df = E.results(spark, replace(TINY, workflows=("edge_count", "degree_counts"), seeds=(0,), perturbations=("edge_deletion",)))
        rows = df.collect()
        assert len(rows) == 12 and {r.status for r in rows} == {"success"}
        assert all(r.mean_shift_score == pytest.approx(r.edit_distance_raw) for r in rows if r.workflow == "edge_count")
    finally:
        E.CUSTOM.clear()
    with pytest.raises(ValueError):
        E.register_workflow("native_netlsd", len)
