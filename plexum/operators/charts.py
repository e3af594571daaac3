"""Aggregates behind tables and charts of a results table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum.functions.columns import finite, mean0

PANEL = ("dataset", "perturbation")


def seed_band(df: DataFrame, score: str = "distribution_score", keys: Sequence[str] = ("workflow", "alpha")) -> DataFrame:
    """Mean over rows, population deviation, mean minus and plus it, and the number of finite rows."""
    out = df.select(*keys, finite(score).alias("s")).dropna(subset=["s"]).groupBy(*keys).agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.count("s").alias("n"))
    return out.withColumn("lower", F.col("mean") - F.col("std")).withColumn("upper", F.col("mean") + F.col("std"))


def seed_band_normalized(df: DataFrame, score: str = "distribution_score") -> DataFrame:
    """Mean and deviation over the workflow's highest mean (1e-12 at least)."""
    band = seed_band(df, score)
    top = F.greatest(F.max("mean").over(Window.partitionBy("workflow")), F.lit(1e-12))
    return band.select("workflow", "alpha", (F.col("mean") / top).alias("mean"), (F.col("std") / top).alias("std"), "n")


def normalized_scores(df: DataFrame, score: str = "distribution_score", keys: Sequence[str] = (*PANEL, "workflow")) -> DataFrame:
    """Rows with `normalized`: the score over its group's maximum, over 1 where that is not positive."""
    top = F.max(finite(score)).over(Window.partitionBy(*keys))
    return df.withColumn("normalized", finite(score) / F.when(top > 0, top).otherwise(1.0))


def status_summary(df: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")]
    return df.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_distinct("dataset").alias("datasets"), F.count_distinct("workflow").alias("workflows"))


def status_pivot(df: DataFrame) -> DataFrame:
    """Rows by workflow and status, and the highest count of all."""
    out = df.groupBy("workflow").pivot("status", ["success", "failed", "skipped"]).count().fillna(0)
    return out.withColumn("highest", F.max(F.greatest("success", "failed", "skipped")).over(Window.partitionBy(F.lit(1))))


def line_means(df: DataFrame, y: str = "distribution_score", keys: Sequence[str] = (*PANEL, "workflow", "alpha")) -> DataFrame:
    return df.select(*keys, finite(y).alias("y")).dropna(subset=["y"]).groupBy(*keys).agg(F.avg("y").alias("y"))


def line_panels(df: DataFrame, y: str = "distribution_score") -> DataFrame:
    """Line means with population deviation, over the workflow's highest mean of the panel (1 where that is 0)."""
    keys = (*PANEL, "workflow", "alpha")
    out = df.select(*keys, finite(y).alias("y")).dropna(subset=["y"]).groupBy(*keys).agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    top = F.max("m").over(Window.partitionBy(*PANEL, "workflow"))
    top = F.when(top == 0, 1.0).otherwise(top)
    return out.select(*keys, (F.col("m") / top).alias("mean"), (F.col("sd") / top).alias("std"))


def alpha_stats(df: DataFrame, y: str = "distribution_score", keys: Sequence[str] = ("workflow",), normalize: str = "max") -> DataFrame:
    """Mean, sample deviation (0 for one row) and count by strength; mean over the highest mean ('max') or highest absolute mean ('abs')."""
    out = df.select(*keys, "alpha", finite(y).alias("y")).dropna(subset=["y"]).groupBy(*keys, "alpha").agg(F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"), F.count("y").alias("n"))
    top = F.max(F.abs("mean") if normalize == "abs" else F.col("mean")).over(Window.partitionBy(*keys))
    return out.withColumn("normalized", F.coalesce(F.try_divide(F.col("mean"), F.nullif(top, F.lit(0.0))), F.lit(0.0)))


def community_means(df: DataFrame, y: str = "distribution_score", label: str = "label_source") -> DataFrame:
    """Mean score by dataset, label source and strength, over the dataset's highest mean (1e-12 at least)."""
    out = line_means(df, y, ("dataset", label, "alpha"))
    return out.withColumn("normalized", F.col("y") / F.greatest(F.max("y").over(Window.partitionBy("dataset")), F.lit(1e-12)))


def metric_pivot(summary: DataFrame, metric: str = "sensitivity", rows: str = "perturbation", columns: str = "workflow", values: Sequence[str] | None = None, fill: float | None = None) -> DataFrame:
    """Mean of a metric, rows by columns. Give values to spare the scan that finds them."""
    out = summary.select(rows, columns, finite(metric).alias("m")).groupBy(rows).pivot(columns, list(values) if values else None).agg(F.avg("m"))
    return out if fill is None else out.fillna(fill)


def workflow_means(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Finite means per workflow, for bars and scatter points."""
    return df.groupBy("workflow").agg(*(F.avg(finite(m)).alias(m) for m in metrics))


def minmax_goodness(summary: DataFrame, higher: Sequence[str] = ("sensitivity", "paired_detectability"), lower: Sequence[str] = ("monotonicity", "robustness_cv", "relative_runtime")) -> DataFrame:
    """Workflow means scaled to 0..1 by column, 1 the best; a constant column gives .5."""
    means = workflow_means(summary, [*higher, *lower])
    w = Window.partitionBy(F.lit(1))
    out = [F.col("workflow")]
    for c in (*higher, *lower):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        x = F.when(F.round(hi - lo, 12) == 0, 0.5).otherwise(F.try_divide(F.col(c) - lo, hi - lo))
        out.append((x if c in higher else 1 - x).alias(c))
    return means.select(*out)


def granularity_values(summary: DataFrame) -> DataFrame:
    """Mean sensitivity, cut to 0..1, by workflow and scale; 'multiscale' is the mean over all rows."""
    s = F.least(F.greatest(finite("sensitivity"), F.lit(0.0)), F.lit(1.0))
    rows = summary.select("workflow", s.alias("s"), F.explode(F.concat(F.split("granularity_label", "/"), F.array(F.lit("multiscale")))).alias("scale"))
    return rows.groupBy("workflow", "scale").agg(mean0(F.col("s")).alias("value"))


def failure_matrix(failures: DataFrame) -> DataFrame:
    """Every dataset by every perturbation with its cause; 'inapplicable' where there is no cell. Both dimensions are small by nature."""
    every = failures.select("dataset").distinct().crossJoin(failures.select("perturbation").distinct())
    return every.join(failures.select(*PANEL, "cause"), list(PANEL), "left").fillna("inapplicable", ["cause"])


def scatter_scaled(df: DataFrame, x: str = "mean_shift_score", y: str = "paired_score", keys: Sequence[str] = ()) -> DataFrame:
    """Points finite in both, over the maxima of all or of each panel (1 where not positive)."""
    w = Window.partitionBy(*(keys or (F.lit(1),)))
    out = df.withColumns({x: finite(x), y: finite(y)}).dropna(subset=[x, y])
    scaled = lambda c: F.col(c) / F.when(F.max(c).over(w) > 0, F.max(c).over(w)).otherwise(1.0)
    return out.withColumn("px", scaled(x)).withColumn("py", scaled(y))


def curve_summary(df: DataFrame, keys: Sequence[str] = ("workflow", "dataset", "perturbation"), score: str = "distribution_score") -> DataFrame:
    """Of the mean curve over strength: its peak, the first strength that has it, the endpoint, the early share (the mean at .1 of the
    peak) and the drop from the peak to the endpoint."""
    means = line_means(df, score, (*keys, "alpha")).withColumn("y", F.round("y", 9))
    out = means.groupBy(*keys).agg(
        F.max("y").alias("peak"), F.min(F.struct((-F.col("y")).alias("k"), F.col("alpha").alias("a")))["a"].alias("peak_alpha"), F.max(F.struct("alpha", "y"))["y"].alias("endpoint"),
        F.max(F.when(F.abs(F.col("alpha") - 0.1) < 1e-9, F.col("y"))).alias("early"),
    )
    top = F.nullif(F.col("peak"), F.lit(0.0))
    return out.select(*keys, "peak", "peak_alpha", "endpoint", F.try_divide(F.col("early"), top).alias("early_fraction"), F.try_divide(F.col("peak") - F.col("endpoint"), top).alias("endpoint_drop"))


def tiers(summary: DataFrame, family: Column | None = None) -> DataFrame:
    """Workflow and dataset means of sensitivity with a tier, ordered by family and then falling."""
    out = summary.groupBy("dataset", "workflow").agg(F.avg(finite("sensitivity")).alias("sensitivity"))
    s = F.round("sensitivity", 9)
    return out.withColumn("tier", F.when(s >= 0.75, "strong").when(s >= 0.5, "moderate").otherwise("weak")).withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(s), "workflow")))


def run_resources(df: DataFrame) -> DataFrame:
    """Rows, total, mean and highest runtime by workflow, and its share of all."""
    out = df.select("workflow", finite("runtime_seconds").alias("r")).groupBy("workflow").agg(F.count(F.lit(1)).alias("rows"), F.sum("r").alias("total_seconds"), F.avg("r").alias("mean_seconds"), F.max("r").alias("max_seconds"))
    return out.withColumn("share", F.try_divide(F.col("total_seconds"), F.sum("total_seconds").over(Window.partitionBy(F.lit(1)))))


def bootstrap_band(df: DataFrame, keys: Sequence[str] = ("workflow", "alpha"), score: str = "distribution_score", draws: int = 400) -> DataFrame:
    """Percentile interval of the mean from `draws` resamples whose draws are hashes of (keys, resample, position): 2.5 and 97.5 %.

    Native: a group's values are one array, and each draw picks from it by hash.
    """
    groups = df.select(*keys, finite(score).alias("s")).dropna(subset=["s"]).groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("v"))
    size = F.size("v")
    drawn = groups.select(*keys, "v", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("d"))
    pick = lambda i: F.element_at("v", (F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.col("d"), i), size) + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda acc, i: acc + pick(i))
    means = drawn.select(*keys, (total / size).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
