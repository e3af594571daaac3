import math

import pytest
from pyspark.sql import functions as F

from plexum.functions.columns import average_rank, finite
from plexum.operators import charts, evaluate

COLUMNS = "dataset string, perturbation string, workflow string, alpha double, seed int, distribution_score double, mean_shift_score double, paired_score double, edit_distance_raw double, edit_distance_weighted double, runtime_seconds double, status string"


def rows(spark, data):
    number = lambda k, x: float(x) if isinstance(x, int) and k != 4 else x
    return spark.createDataFrame([tuple(number(k, x) for k, x in enumerate(r)) for r in data], COLUMNS)


def curve(scores, edits, workflow="w", perturbation="p", seeds=(0, 1, 2), runtime=1.0, status="success"):
    return [("d", perturbation, workflow, a, s, v, v, v, e, e, runtime, status) for s in seeds for (a, v), e in zip(scores, edits)]


def test_summary_of_linear_scores(spark):
    data = curve([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)], [0, 1, 2], "a", seeds=(0, 1)) + curve([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)], [0, 1, 2], "b", seeds=(0, 1), runtime=2.0)
    out = {r.workflow: r for r in evaluate.evaluation_summary(rows(spark, data)).collect()}
    assert set(out) == {"a", "b"}
    for r in out.values():
        assert abs(r.sensitivity - 1) < 1e-12 and r.monotonicity == 0 and r.ranking_stability_tau == 1.0 and r.mean_shift_duplicates_distribution
    assert out["a"].relative_runtime == 1.0 and out["b"].relative_runtime == 2.0


@pytest.mark.parametrize(
    "cause,data",
    [
        ("ok", curve([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)], [0, 5, 10])),
        ("perturbation_starved", curve([(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)], [0, 0, 0])),
        ("perturbation_starved", curve([(0.0, 0.0), (0.5, 0.005), (1.0, 0.01)], [0, 0, 0])),
        ("method_blind", curve([(0.0, 0.5), (0.5, 0.5), (1.0, 0.5)], [0, 6, 12])),
        ("unstable", curve([(0.0, 0.0), (0.25, 1.0), (0.5, 0.2), (0.75, 1.2), (1.0, 0.3)], [0, 2, 4, 6, 8])),
        ("inapplicable", curve([(0.0, None), (1.0, None)], [None, None], status="skipped")),
    ],
)
def test_failure_causes(spark, cause, data):
    df = rows(spark, data)
    got = evaluate.failure_map(df, evaluate.evaluation_summary(df)).collect()
    assert [r.cause for r in got] == [cause]
    if cause == "ok":
        assert got[0].note == "sensitivity=1.00, cv=0.00" and got[0].max_edit_distance_raw == 10.0


def test_monotonicity_and_variation(spark):
    df = rows(spark, curve([(0.0, 0.0), (0.3, 1.0), (0.6, 0.5), (1.0, 2.0)], [0] * 4, seeds=(0,)))
    assert abs(evaluate.monotonicity(df, ["workflow"]).first().monotonicity - 1 / 3) < 1e-12
    one = rows(spark, curve([(0.5, 1.0)], [0], seeds=(0,)))
    assert evaluate.monotonicity(one, ["workflow"]).first().monotonicity == 0
    vary = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(evaluate.variation(F.col("x"))).first()[0]
    assert vary([2.0, 4.0]) == 1 / 3 and vary([]) == 0 and vary([0.0, 0.0]) == 0 and vary([-1.0, 1.0]) == math.inf


def test_ranks_nan_and_constant(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 3.0), ("k", 3.0)], "k string, x double")
    assert [r.r for r in df.withColumn("r", average_rank(["k"], F.col("x"))).orderBy("x").collect()] == [1.0, 2.0, 3.5, 3.5]
    odd = spark.createDataFrame([("1.5",), ("x",), ("",), (None,), ("NaN",), ("inf",)], "x string").select(finite("x").alias("x")).collect()
    assert [r.x for r in odd] == [1.5, None, None, None, None, None]
    flat = rows(spark, curve([(0.0, 1.0), (1.0, 1.0)], [0, 0]))
    assert evaluate.spearman(flat, ["workflow"], {"s": ("alpha", "distribution_score")}).first().s == 0


def test_kendall_drops_ties(spark):
    at = lambda seed, **v: [("d", "p", w, 0.5, seed, x, x, x, 1.0, 1.0, 1.0, "success") for w, x in v.items()]
    stable = lambda data: evaluate.ranking_stability(rows(spark, data)).first().ranking_stability_tau
    assert stable(at(0, a=1.0, b=2.0, c=3.0) + at(1, a=1.0, b=3.0, c=2.0)) == pytest.approx(1 / 3)
    assert stable(at(0, a=1.0, b=1.0) + at(1, a=1.0, b=2.0)) == 1.0 and stable(at(0, a=1.0, b=2.0)) == 1.0
    assert stable(at(0, a=1.0, b=2.0) + at(1, a=2.0, b=1.0)) == -1.0


def test_labels(spark):
    base = dict(dataset="d", granularity_label="local/mesoscopic", paired_detectability=0.9, mean_shift_detectability=0.75, relative_runtime=1.25, interpretability_score=3)
    names = "workflow string, dataset string, perturbation string, granularity_label string, sensitivity double, monotonicity double, robustness_cv double, paired_detectability double, mean_shift_detectability double, relative_runtime double, interpretability_score int"
    data = []
    for w, (s, m, r) in {"a": (0.90, 0.05, 0.10), "b": (0.75, 0.15, 0.20), "c": (0.50, 0.30, 0.35), "d": (0.49, 0.31, 0.36)}.items():
        data.append((w, "d", "p", base["granularity_label"], s, m, r, 0.9, 0.75, 1.25, 3))
    data.append(("native_netlsd", "d", "p", "global", 0.1, 0.0, 0.0, 0.1, 0.1, 9.0, 2))
    out = {r.workflow: r for r in evaluate.final_matrix(spark.createDataFrame(data, names)).collect()}
    steps = ["Very high", "High", "Medium", "Low"]
    for w, want in zip("abcd", steps):
        assert (out[w].sensitivity_label, out[w].monotonicity_label, out[w].robustness_label) == (want,) * 3
    assert out["a"].granularity_label == "local/mesoscopic" and out["d"].granularity_label in ("local", "mesoscopic")
    n = out["native_netlsd"]
    assert n.mean_shift_label == "Duplicate" and n.granularity_label == "global" and n.efficiency_label == "Low" and n.interpretability_label == "High"


def test_charts(spark):
    df = rows(spark, curve([(0.5, 1.0)], [0], seeds=(0,)) + curve([(0.5, 3.0)], [0], seeds=(1,)))
    band = charts.seed_band(df).first()
    assert (band["mean"], band["std"], band["n"], band["lower"], band["upper"]) == (2.0, 1.0, 2, 1.0, 3.0)
    panel = rows(spark, curve([(0.1, 50.0), (0.2, 100.0)], [0, 0], "a", seeds=(0,)) + curve([(0.1, 0.2)], [0], "b", seeds=(0,)))
    assert sorted(r.normalized for r in charts.normalized_scores(panel).collect()) == [0.5, 1.0, 1.0]
    boot = charts.bootstrap_band(rows(spark, curve([(0.5, 1.0)], [0], seeds=range(6)) + curve([(0.5, 2.0)], [0], seeds=range(6, 12)))).first()
    assert 1.0 <= boot.low < 1.5 < boot.high <= 2.0
    empty = rows(spark, [])
    assert evaluate.evaluation_summary(empty).count() == 0 and charts.seed_band(empty).count() == 0
