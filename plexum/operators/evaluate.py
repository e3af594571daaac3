"""The evaluation of a results table: summary, final matrix and failure map, and the measures they are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum import schema as S
from plexum.functions.columns import at_least, at_most, average_rank, finite, guarded_corr, lookup, mean0, number

CELL = ("dataset", "perturbation")


def successes(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "success")


def spearman(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Rank correlations by keys, each over the rows where both sides are finite; under two rows: 0.

    All windows and the aggregate share one exchange by keys.
    """
    ranked, aggs = df, {}
    for name, (x, y) in measures.items():
        both = finite(x).isNotNull() & finite(y).isNotNull()
        ranked = ranked.withColumn(f"_in_{name}", both)
        part = [*keys, f"_in_{name}"]
        ranked = ranked.withColumn(f"_x_{name}", average_rank(part, finite(x))).withColumn(f"_y_{name}", average_rank(part, finite(y)))
        aggs[name] = guarded_corr(*(F.when(F.col(f"_in_{name}"), F.col(f"_{c}_{name}")) for c in "xy")).alias(name)
    return ranked.groupBy(*keys).agg(*aggs.values())


def monotonicity(df: DataFrame, keys: Sequence[str], score: str = "distribution_score", alpha: str = "alpha") -> DataFrame:
    """The share of steps in strength at which the mean score falls; 0 with under two strengths."""
    means = df.select(*keys, finite(alpha).alias("alpha"), finite(score).alias("s")).dropna(subset=["alpha", "s"]).groupBy(*keys, "alpha").agg(F.avg("s").alias("m"))
    before = F.lag("m").over(Window.partitionBy(*keys).orderBy("alpha"))
    steps = means.withColumn("before", before).withColumn("falls", F.when(F.col("before").isNotNull(), (F.round(F.col("m") - F.col("before"), 12) < 0).cast("double")))
    return steps.groupBy(*keys).agg(F.coalesce(F.avg("falls"), F.lit(0.0)).alias("monotonicity"))


def variation(value: Column) -> Column:
    """Population deviation over the absolute mean, as an aggregate; a mean of 0 gives 0 or infinity, no value 0."""
    mean, sd = F.avg(value), F.coalesce(F.stddev_pop(value), F.lit(0.0))
    return F.when(F.count(value) == 0, 0.0).when(F.abs(mean) < 1e-12, F.when(sd < 1e-12, 0.0).otherwise(F.lit(float("inf")))).otherwise(sd / F.abs(mean))


def seed_variation(df: DataFrame, keys: Sequence[str], score: str = "distribution_score") -> DataFrame:
    means = df.groupBy(*keys, "seed").agg(mean0(number(score)).alias("m"))
    return means.groupBy(*keys).agg(variation(F.col("m")).alias("robustness_cv"))


def relative_runtime(df: DataFrame) -> DataFrame:
    """The rows with relative_runtime: runtime over the fastest of the same dataset, perturbation, strength and seed."""
    w = Window.partitionBy(*CELL, "alpha", "seed")
    runtime = number("runtime_seconds")
    fastest = F.coalesce(F.min(F.when(runtime >= 0, runtime)).over(w), F.lit(0.0))
    return df.withColumn("relative_runtime", F.when(fastest <= 0, 1.0).otherwise(F.try_divide(runtime, fastest)))


def ranking_stability(df: DataFrame) -> DataFrame:
    """Per dataset and perturbation the mean over seed pairs of (concordant - discordant) / (both) workflow pairs; 1 without such pairs."""
    means = df.groupBy(*CELL, "seed", "workflow").agg(mean0(number("distribution_score")).alias("m"))
    a, b = means.alias("a"), means.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*CELL, "seed")]
    pairs = a.join(b, [*same, F.col("a.workflow") < F.col("b.workflow")]).select(*(F.col(f"a.{c}").alias(c) for c in (*CELL, "seed")), F.col("a.workflow").alias("w1"), F.col("b.workflow").alias("w2"), F.signum(F.round(F.col("a.m") - F.col("b.m"), 12)).alias("d"))
    p, q = pairs.alias("p"), pairs.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in (*CELL, "w1", "w2")]
    signs = p.join(q, [*same, F.col("p.seed") < F.col("q.seed")]).select(*(F.col(f"p.{c}").alias(c) for c in CELL), F.col("p.seed").alias("s1"), F.col("q.seed").alias("s2"), (F.col("p.d") * F.col("q.d")).alias("sign"))
    found = signs.groupBy(*CELL, "s1", "s2").agg(F.try_divide(F.sum("sign"), F.nullif(F.sum(F.abs("sign")), F.lit(0.0))).alias("tau"))
    seeds = df.select(*CELL, "seed").distinct()
    x, y = seeds.alias("x"), seeds.alias("y")
    every = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in CELL] + [F.col("x.seed") < F.col("y.seed")]).select(*(F.col(f"x.{c}").alias(c) for c in CELL), F.col("x.seed").alias("s1"), F.col("y.seed").alias("s2"))
    taus = every.join(found, [*CELL, "s1", "s2"], "left").groupBy(*CELL).agg(F.avg(F.coalesce("tau", F.lit(1.0))).alias("tau"))
    return df.select(*CELL).distinct().join(taus, list(CELL), "left").select(*CELL, F.coalesce("tau", F.lit(1.0)).alias("ranking_stability_tau"))


def duplicate_mean_shift(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the two scores agree within 1e-12 wherever both are finite; false without such rows."""
    same = F.abs(finite("mean_shift_score") - finite("distribution_score")) <= 1e-12
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(same), F.lit(False)).alias("mean_shift_duplicates_distribution"))


MEASURES = {
    "sensitivity": ("alpha", "distribution_score"),
    "paired_detectability": ("alpha", "paired_score"),
    "mean_shift_detectability": ("alpha", "mean_shift_score"),
    "edit_distance_validation": ("edit_distance_weighted", "distribution_score"),
    "paired_edit_distance_validation": ("edit_distance_weighted", "paired_score"),
}


#: Columns that the measures read.
_READ = (*S.SETTING, "alpha", "seed", "distribution_score", "mean_shift_score", "paired_score", "edit_distance_weighted", "runtime_seconds")


def evaluation_summary(results: DataFrame) -> DataFrame:
    """A row per workflow, dataset and perturbation with successful rows: SUMMARY_COLUMNS and mean_shift_duplicates_distribution."""
    keys = list(S.SETTING)
    # Six branches read these rows; they are computed once and kept while memory and disk allow.
    ok = successes(results).select(*_READ).persist()
    out = spearman(ok, keys, MEASURES)
    out = out.join(monotonicity(ok, keys), keys, "left").fillna(0.0, ["monotonicity"])
    out = out.join(seed_variation(ok, keys), keys, "left").join(duplicate_mean_shift(ok, keys), keys, "left")
    out = out.join(relative_runtime(ok).groupBy(*keys).agg(mean0(F.col("relative_runtime")).alias("relative_runtime")), keys, "left")
    out = out.join(ranking_stability(ok), list(CELL), "left")
    out = out.withColumn("interpretability_score", lookup("workflow", S.INTERPRETABILITY, F.lit(1))).withColumn("granularity_label", lookup("perturbation", S.GRANULARITY, F.lit("unknown")))
    return out.select(*S.SUMMARY_COLUMNS, "mean_shift_duplicates_distribution")


# Cut-offs of the labels.
CORRELATION = ((0.90, "Very high"), (0.75, "High"), (0.50, "Medium"))
VIOLATIONS = ((0.05, "Very high"), (0.15, "High"), (0.30, "Medium"))
ROBUSTNESS = ((0.10, "Very high"), (0.20, "High"), (0.35, "Medium"))
EFFICIENCY = ((1.25, "Very high"), (1.75, "High"), (2.50, "Medium"))


def granularity(summary: DataFrame) -> DataFrame:
    """Per workflow: the scales of mean sensitivity .5 or more joined by '/', 'multiscale' from three on, else the best scale."""
    scales = summary.select("workflow", "dataset", "perturbation", finite("sensitivity").alias("s"), F.posexplode(F.split("granularity_label", "/")).alias("i", "scale"))
    means = scales.groupBy("workflow", "scale").agg(mean0(F.col("s")).alias("m"), F.min(F.struct("dataset", "perturbation", "i")).alias("first"))
    found = means.groupBy("workflow").agg(F.array_sort(F.collect_set(F.when(F.round("m", 9) >= 0.5, F.col("scale")))).alias("seen"))
    best = means.withColumn("r", F.row_number().over(Window.partitionBy("workflow").orderBy(F.desc("m"), "first"))).filter("r = 1").select("workflow", F.col("scale").alias("best"))
    label = F.when(F.size("seen") >= 3, "multiscale").when(F.size("seen") > 0, F.array_join("seen", "/")).otherwise(F.col("best"))
    return found.join(best, "workflow").select("workflow", label.alias("granularity_label"))


def final_matrix(summary: DataFrame) -> DataFrame:
    """A row of labels per workflow. Means are taken at 9 decimals, so that a cut-off does not depend on the order of addition."""
    m = lambda c: mean0(number(c))
    if "mean_shift_duplicates_distribution" in summary.columns:
        flags = F.coalesce(F.bool_and(F.coalesce("mean_shift_duplicates_distribution", F.lit(False))), F.lit(False))
    else:
        flags = F.max(F.lit(False))
    means = summary.groupBy("workflow").agg(*(m(c).alias(c) for c in ("sensitivity", "monotonicity", "paired_detectability", "mean_shift_detectability", "robustness_cv", "relative_runtime", "interpretability_score")), flags.alias("same"))
    col = F.col
    out = means.join(granularity(summary), "workflow").select(
        "workflow", at_least(col("sensitivity"), CORRELATION, "Low").alias("sensitivity_label"), at_most(col("monotonicity"), VIOLATIONS, "Low").alias("monotonicity_label"),
        at_least(col("paired_detectability"), CORRELATION, "Low").alias("paired_label"),
        F.when(col("workflow").isin(*S.DUPLICATE_MEAN_SHIFT) | col("same"), "Duplicate").otherwise(at_least(col("mean_shift_detectability"), CORRELATION, "Low")).alias("mean_shift_label"),
        "granularity_label", at_most(col("robustness_cv"), ROBUSTNESS, "Low").alias("robustness_label"), at_most(col("relative_runtime"), EFFICIENCY, "Low").alias("efficiency_label"),
        at_least(col("interpretability_score"), ((3, "Very high"), (2, "High")), "Medium").alias("interpretability_label"),
    )
    return out


def best_workflows(summary: DataFrame) -> DataFrame:
    """Per cell the workflow of highest sensitivity, of equals the first by name."""
    order = Window.partitionBy(*CELL).orderBy(F.desc_nulls_last(number("sensitivity")), "workflow")
    best = summary.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select(*CELL, F.col("workflow").alias("best_workflow"), finite("sensitivity").alias("best_sensitivity"), finite("monotonicity").alias("monotonicity"), finite("robustness_cv").alias("robustness_cv"))


def edits_by_cell(ok: DataFrame) -> DataFrame:
    by_alpha = ok.select(*CELL, finite("alpha").alias("alpha"), finite("edit_distance_raw").alias("e")).dropna(subset=["alpha", "e"]).groupBy(*CELL, "alpha").agg(F.avg("e").alias("e")).filter("alpha > 0")
    return by_alpha.groupBy(*CELL).agg(F.avg("e").alias("mean_edits"), F.max("e").alias("max_edits"))


def failure_map(results: DataFrame, summary: DataFrame) -> DataFrame:
    """A row per dataset and perturbation of any status, with the first cause that holds and a note in numbers of two decimals."""
    cells = results.groupBy(*CELL).agg(F.count_if(F.col("status") == "success").alias("n"))
    out = cells.join(edits_by_cell(successes(results)), list(CELL), "left").join(best_workflows(summary), list(CELL), "left")
    out = out.withColumn("mean_edits", F.coalesce("mean_edits", F.lit(0.0))).withColumn("max_edits", F.coalesce("max_edits", F.lit(0.0)))
    two = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.2f", F.bround(F.round(c, 9), 2)))
    four = lambda c: F.bround(F.round(c, 9), 4)
    blind = F.col("best_sensitivity").isNull() | (F.round("best_sensitivity", 9) < S.BLIND_SENSITIVITY)
    shaky = F.coalesce(F.round("monotonicity", 9) > S.UNSTABLE_VIOLATIONS, F.lit(False)) | F.coalesce(F.round("robustness_cv", 9) > S.UNSTABLE_CV, F.lit(False))
    rules = (
        (F.col("n") == 0, "inapplicable", F.lit("no successful rows (cell skipped)")),
        (F.round("max_edits", 9) < S.STARVED_EDITS, "perturbation_starved", F.concat(F.lit("max mean edits at alpha>0 = "), two("max_edits"), F.lit(f" (< {S.STARVED_EDITS})"))),
        (blind, "method_blind", F.concat(F.lit("edits occurred but best sensitivity = "), two("best_sensitivity"))),
        (shaky, "unstable", F.concat(F.lit("monotonicity="), two("monotonicity"), F.lit(", cv="), two("robustness_cv"))),
    )
    cause, note = F.lit("ok"), F.concat(F.lit("sensitivity="), two("best_sensitivity"), F.lit(", cv="), two("robustness_cv"))
    for when, name, said in reversed(rules):
        cause, note = F.when(when, name).otherwise(cause), F.when(when, said).otherwise(note)
    return out.select(
        *CELL, cause.alias("cause"), four("mean_edits").alias("mean_edit_distance_raw"), four("max_edits").alias("max_edit_distance_raw"), F.coalesce("best_workflow", F.lit("")).alias("best_workflow"),
        four("best_sensitivity").alias("best_sensitivity"), four("monotonicity").alias("monotonicity"), four("robustness_cv").alias("robustness_cv"), note.alias("note"),
    )
