import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import plexum
from plexum.operators import diagnose
from plexum.operators import kernels as K
from plexum.plans import experiment as E
from plexum.sources import artifacts
from plexum.sources import results as R

TINY = E.Experiment("tiny", (E.Dataset("er", "erdos_renyi", 4, 8, p=0.45),), ("edge_insertion", "hub_modification"), (0.0, 0.3, 0.4), (0, 1))
KEY = [*diagnose.CELL, "workflow"]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    E.run_experiment(spark, TINY, out)
    return out


def test_artifacts_of_a_run(spark, run):
    rows, records = R.read_results(spark, f"{run}/results"), artifacts.read(spark, f"{run}/artifacts")
    assert rows.filter("graph_sha256 is null or workflow_sha256 is null or graph_artifact is null or workflow_artifact is null or memory_mb is null or diagnostic_seconds is null or not memory_mb > 1").count() == 0
    assert artifacts.row_artifacts_valid(rows, records).filter("not valid").count() == 0
    damaged = records.withColumn("valid", F.col("valid") & (F.col("kind") != "graph"))
    assert artifacts.row_artifacts_valid(rows, damaged).filter("valid").count() == 0
    pairs, distances = diagnose.pair_table(records), diagnose.distance_table(records)
    assert pairs.count() == 12 * 4 and distances.count() == 12 * 4 * 4
    for p in pairs.collect():
        old, new = {tuple(e) for e in p.original}, {tuple(e) for e in p.perturbed}
        assert len(old ^ new) == p.raw_edits and p.no_op == (p.raw_edits == 0) and (p.original_hash == p.perturbed_hash) == (old == new)
    means = distances.groupBy(*KEY).agg(F.avg("distance").alias("paired_score"))
    assert diagnose.assert_reproduced(rows, means, "paired_score", KEY) == 48
    kernel = distances.filter("contribution is not null").groupBy(*KEY).agg(F.greatest(F.avg("contribution"), F.lit(0.0)).alias("distribution_score"))
    assert diagnose.assert_reproduced(rows.filter("workflow like '%mmd'"), kernel, "distribution_score", KEY) == 24
    with pytest.raises(ValueError, match="not reproduced"):
        diagnose.assert_reproduced(rows, means.withColumn("paired_score", F.col("paired_score") + 1), "paired_score", KEY)
    both = distances.join(pairs.select(*diagnose.CELL, "graph_index", "raw_edits"), [*diagnose.CELL, "graph_index"])
    assert diagnose.trajectories(both).agg(F.min("graphs")).first()[0] == 4
    got = diagnose.transitions(both).collect()
    assert len(got) == 2 * 4 * 2 and all(r.rises + r.falls + r.stays == 4 for r in got)


def test_provenance(run):
    got = json.load(open(f"{run}/run_manifest.json"))
    assert got["code_fingerprint"].endswith(got["config_hash"]) and "operators/kernels.py" in got["code_files"] and not any("llm" in f for f in got["code_files"])
    assert got["acceleration"]["eigenvalue_solver"] and "finished" in open(f"{run}/run.log").read()


def test_details_are_held_against_scores():
    x, y = [[0.0, 1.0], [2.0, 1.0]], [[1.0, 1.0], [2.0, 3.0]]
    got = E.representation_details("structural_statistics_mmd", x, y, 10.0)
    scores = E.dense_scores(np.array(x), np.array(y), 10.0)
    E.assert_reconstructed(got, scores[0], scores[2])
    for wrong in ((scores[0] + 1e-6, scores[2]), (scores[0], scores[2] + 1e-6)):
        with pytest.raises(ValueError, match="reconstructed"):
            E.assert_reconstructed(got, *wrong)
    with pytest.raises(ValueError):
        E.representation_details("native_netlsd", x, y[:1], 10.0)


def test_control_and_ablation(spark):
    got = diagnose.regular_control()
    assert got["wl_subtree_kernel_mmd"] == (0.0, 0.0, 0.0) and all(got[w][0] > 1e-6 for w in got if w != "wl_subtree_kernel_mmd")
    x = spark.createDataFrame([(0, [0.0, 5.0]), (1, [1.0, 5.0])], "id int, x array<double>")
    y = spark.createDataFrame([(0, [0.0, 9.0]), (1, [1.0, 9.0])], "id int, x array<double>")
    by = {r.without: r.mmd for r in diagnose.ablation(x, y, 2).collect()}
    assert by[1] == pytest.approx(0, abs=1e-12) and by[0] == pytest.approx(2 - 2 * math.exp(-16 / 200))


def test_replacing_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    spark.range(5).write.parquet(f"{path}.new")
    R.replace_dir(spark, f"{path}.new", path)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")
    R.recover_dir(spark, path)
    assert spark.read.parquet(path).count() == 5


def jacobi(a):
    """Eigenvalues by rotations that clear the largest element beside the diagonal."""
    a = np.array(a, float)
    n = len(a)
    for _ in range(100 * n * n):
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(off.argmax()), n)
        if off[p, q] < 1e-12:
            break
        t = 0.5 * math.atan2(2 * a[p, q], a[q, q] - a[p, p])
        r = np.eye(n)
        r[p, p] = r[q, q] = math.cos(t)
        r[p, q], r[q, p] = math.sin(t), -math.sin(t)
        a = r.T @ a @ r
    return sorted(np.diag(a))


def test_spectrum_against_rotations():
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (4, 5)]
    n, d = 7, np.zeros(7)
    a = np.zeros((7, 7))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
        d[u] += 1
        d[v] += 1
    s = np.array([1 / math.sqrt(x) if x else 0 for x in d])
    assert np.allclose(K.laplacian_spectrum(n, edges), jacobi(np.diag((d > 0) * 1.0) - s[:, None] * a * s[None, :]), atol=1e-9)


def test_fixed_curve():
    path = [(k, k + 1) for k in range(5)]
    got = K.fixed_curve(6, path, 6)
    assert len(got) == 6 and got[0] == pytest.approx(1.0) and got[-1] == pytest.approx(K.spread(6, path)) and got == K.fixed_curve(6, path, 6)
    assert K.fixed_curve(0, [], 3) == [0.0] * 3 and K.even_scales(50, 3) == [1, 26, 50] or K.even_scales(50, 3) == [1, 25, 50]
    apart = K.fixed_curve(4, [(0, 1), (2, 3)], 4)
    assert apart[0] == pytest.approx(1.0) and apart[1] == pytest.approx(2.0)


def test_molecules_run(spark, tmp_path):
    rows = [{"source_id": f"m{k}", "num_nodes": 5, "atom_types": [0] * 5, "edges": [[0, 1], [1, 2], [2, 3], [3, 4]] + ([[0, 4]] if k % 2 else []), "bond_types": [1] * (5 if k % 2 else 4)} for k in range(8)]
    text = "".join(json.dumps(r) + "\n" for r in rows).encode()
    (tmp_path / "val.jsonl").write_bytes(text)
    import hashlib

    (tmp_path / "manifest.json").write_text(json.dumps({"schema": "zinc_topology_cache_v1", "fingerprint": "f", "splits": {"val": {"file": "val.jsonl", "sha256": hashlib.sha256(text).hexdigest(), "count": 8}}}))
    config = E.replace(E.molecule_run("molecules_debug", str(tmp_path), "f"), seeds=(0, 1), perturbations=("edge_deletion",), alphas=(0.0, 0.5), workflows=("structural_statistics_mmd",))
    config = E.replace(config, datasets=(E.replace(config.datasets[0], graphs=6),))
    got = E.results(spark, config).collect()
    assert len(got) == 4 and all(r.status == "success" and r.graph_count == 6 for r in got)
    assert all((r.edit_distance_raw > 0) == (r.alpha > 0) for r in got)


def test_public_names():
    assert all(getattr(plexum, name) for name in plexum.__all__)
    with pytest.raises(AttributeError):
        plexum.nothing  # noqa: B018
