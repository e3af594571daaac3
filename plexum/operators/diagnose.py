"""Analyses of pairs of graphs within cells: structure before and after, distances along the strength, and what a score is made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexum.operators import evaluate

CELL = ("dataset", "perturbation", "seed", "alpha")
_PAIRS = "dataset string, seed int, perturbation string, alpha double, pairs array<struct<graph_index:int,num_nodes:int,raw_edits:int,no_op:boolean,original_hash:string,perturbed_hash:string,original:array<struct<u:int,v:int>>,perturbed:array<struct<u:int,v:int>>>>"
_DETAILS = "dataset string, seed int, perturbation string, alpha double, workflow string, graph_index array<int>, paired_distances array<double>, mmd_contributions array<double>"


def pair_table(records: DataFrame) -> DataFrame:
    """A row per pair of a run's graph records: cell, graph_index, edges of both, raw_edits, no_op, original_hash, perturbed_hash."""
    body = records.filter("kind = 'graph' and valid").select(F.from_json("body", _PAIRS).alias("b")).select("b.*")
    return body.select(*CELL, F.explode("pairs").alias("p")).select(*CELL, "p.*")


def distance_table(records: DataFrame) -> DataFrame:
    """A row per pair and workflow of a run's workflow records: cell, workflow, graph_index, distance, contribution (null where there is none)."""
    body = records.filter("kind = 'workflow' and valid").select(F.from_json("body", _DETAILS).alias("b")).select("b.*")
    none = F.transform("paired_distances", lambda _: F.lit(None).cast("double"))
    body = body.withColumn("mmd_contributions", F.coalesce("mmd_contributions", none))
    rows = body.select(*CELL, "workflow", F.explode(F.arrays_zip("graph_index", "paired_distances", "mmd_contributions")).alias("p"))
    return rows.select(*CELL, "workflow", "p.graph_index", F.col("p.paired_distances").alias("distance"), F.col("p.mmd_contributions").alias("contribution"))


def cell_structure(pairs: DataFrame, before: Sequence[str], after: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """Per cell: graphs, no_ops, mean_raw_edits, and the means of the columns of statistics before and after."""
    means = [F.avg(c).alias(f"mean_{c}") for c in (*before, *after)]
    return pairs.groupBy(*cell).agg(F.count(F.lit(1)).alias("graphs"), F.count_if(F.col("raw_edits") == 0).alias("no_ops"), F.avg("raw_edits").alias("mean_raw_edits"), *means)


def distance_rows(distances: DataFrame, keys: Sequence[str] = (*CELL, "workflow")) -> DataFrame:
    """Per cell and workflow: quantiles of the paired distances, changed graphs, and those of them at no distance. distances: keys, distance, raw_edits."""
    q = F.percentile("distance", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0))))
    out = distances.groupBy(*keys).agg(q.alias("q"), F.avg("distance").alias("paired_score"), F.count_if(F.col("raw_edits") > 0).alias("changed_graphs"), F.count_if((F.col("raw_edits") > 0) & (F.col("distance") <= 1e-10)).alias("changed_at_zero"))
    return out.select(*keys, "paired_score", *(F.col("q")[k].alias(n) for k, n in enumerate(("q0", "q25", "q50", "q75", "q90", "q100"))), "changed_graphs", "changed_at_zero")


def trajectories(distances: DataFrame, keys: Sequence[str] = ("dataset", "perturbation", "workflow", "seed"), graph: str = "graph_index") -> DataFrame:
    """Per setting, over graphs and neighbouring strengths: graphs whose distance falls at a positive strength, falls despite more edits, and pairs
    of strengths with more edits. A fall counts beyond 1e-10 of the setting's largest distance, or of 1. distances: keys, graph, alpha, distance, raw_edits."""
    step, whole = Window.partitionBy(*keys, graph).orderBy("alpha"), Window.partitionBy(*keys)
    rows = distances.select(*keys, graph, "alpha", "distance", "raw_edits", F.lag("distance").over(step).alias("d0"), F.lag("raw_edits").over(step).alias("e0"), F.lag("alpha").over(step).alias("a0"))
    rows = rows.withColumn("tol", 1e-10 * F.greatest(F.lit(1.0), F.max(F.abs("distance")).over(whole)))
    falls, more = F.col("distance") - F.col("d0") < -F.col("tol"), F.col("raw_edits") > F.col("e0")
    by_graph = rows.groupBy(*keys, graph).agg(F.coalesce(F.max(falls & (F.col("a0") > 0)), F.lit(False)).alias("falls"), F.count_if(falls & more).alias("despite"), F.count_if(more).alias("more"))
    return by_graph.groupBy(*keys).agg(F.count(F.lit(1)).alias("graphs"), F.count_if("falls").alias("graphs_that_fall"), F.sum("despite").alias("falls_despite_more_edits"), F.sum("more").alias("steps_with_more_edits"))


def transitions(distances: DataFrame, low: float = 0.3, high: float = 0.4, keys: Sequence[str] = ("dataset", "perturbation", "workflow", "seed"), graph: str = "graph_index") -> DataFrame:
    """Between two strengths, per setting: graphs whose distance rises, falls or stays (1e-10), mean and median change, and of the contributions their rises, falls and mean."""
    at = lambda c, a: F.max(F.when(F.abs(F.col("alpha") - a) < 1e-9, F.col(c)))
    by = distances.groupBy(*keys, graph).agg((at("distance", high) - at("distance", low)).alias("d"), (at("contribution", high) - at("contribution", low)).alias("c")).filter(F.col("d").isNotNull())
    return by.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("graphs"), F.count_if(F.col("d") > 1e-10).alias("rises"), F.count_if(F.col("d") < -1e-10).alias("falls"), F.count_if(F.abs("d") <= 1e-10).alias("stays"), F.avg("d").alias("mean_change"), F.median("d").alias("median_change"),
        F.count_if(F.col("c") > 1e-10).alias("contribution_rises"), F.count_if(F.col("c") < -1e-10).alias("contribution_falls"), F.avg("c").alias("mmd_change"),
    )


def reproduction(saved: DataFrame, again: DataFrame, value: str, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Two tables joined on the full key: both values, their difference, and whether it is within tolerance; a key of one side only is not."""
    a, b = saved.select(*keys, F.col(value).alias("saved")), again.select(*keys, F.col(value).alias("again"))
    error = F.abs(F.col("saved") - F.col("again"))
    return a.join(b, list(keys), "full_outer").select(*keys, "saved", "again", error.alias("error"), F.coalesce(error <= tolerance, F.lit(False)).alias("reproduced"))


def assert_reproduced(saved: DataFrame, again: DataFrame, value: str, keys: Sequence[str], tolerance: float = 1e-9) -> int:
    """The number of keys; an error if a value is not reproduced."""
    n, bad = reproduction(saved, again, value, keys, tolerance).agg(F.count(F.lit(1)), F.count_if(~F.col("reproduced"))).first()
    if bad:
        raise ValueError(f"{bad} of {n} values of {value} are not reproduced")
    return n


def community_comparison(rows: DataFrame, keys: Sequence[str] = ("dataset", "workflow"), value: str = "distribution_score") -> DataFrame:
    """Per setting, over replicates: the median rank correlation with positive strengths, replicates, and falls between neighbouring ones."""
    up = rows.filter(F.col("alpha") > 0)
    own = [*keys, "seed"]
    rho = evaluate.spearman(up, own, {"rho": ("alpha", value)})
    step = Window.partitionBy(*own).orderBy("alpha")
    falls = up.select(*own, (F.col(value) - F.lag(value).over(step)).alias("d")).groupBy(*own).agg(F.count_if(F.col("d") < -1e-10).alias("falls"))
    return rho.join(falls, own).groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), F.median("rho").alias("median_rho"), F.sum("falls").alias("falls"))


def ablation(left: DataFrame, right: DataFrame, size: int, bandwidth: float = 10.0, id_col: str = "id", x: str = "x") -> DataFrame:
    """The squared MMD without each of the descriptors in turn: without (its place), mmd. A cell for each, so one pass serves all."""
    parts = []
    for side in (left, right):
        rows = side.select(id_col, x, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("without"))
        kept = F.filter(F.transform(x, lambda v, i: F.when(i != F.col("without"), v)), lambda v: v.isNotNull())
        parts.append(rows.select("without", id_col, kept.alias(x)))
    from plexum.operators.vectors import rbf_mmd

    return rbf_mmd(*parts, keys=["without"], bandwidth=bandwidth, id_col=id_col, x=x).select("without", "mmd")


def regular_control() -> dict[str, tuple[float, float, float]]:
    """Scores of a cycle of six nodes against two triangles, by workflow: all degrees agree, so subtree counts cannot tell them apart."""
    from plexum.plans import experiment as E

    cycle = sorted((min(u, (u + 1) % 6), max(u, (u + 1) % 6)) for u in range(6))
    triangles = [(b + u, b + v) for b in (0, 3) for u, v in ((0, 1), (0, 2), (1, 2))]
    options, out = E.Experiment("control", ()).options, {}
    for w in ("structural_statistics_mmd", "wl_subtree_kernel_mmd", "native_netlsd", "diversity_curves_shortest_path"):
        (x, a), (y, b) = (E.representation(w, 6, e, options, range(1, 7)) for e in (cycle, triangles))
        if x is None:
            out[w] = E.sparse_scores([a], [b])
        else:
            out[w] = E.dense_scores(E.np.array([x]), E.np.array([y]), options["bandwidth"] if w == "structural_statistics_mmd" else None)
    return out
