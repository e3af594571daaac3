"""Evaluate a results table: the three derived tables, written as CSV and given as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexum import schema as S
from plexum.operators import evaluate
from plexum.sources import results as R


def evaluate_results(spark: SparkSession, path: str, out_dir: str | None = None) -> dict[str, DataFrame]:
    rows = R.read_results(spark, path)
    summary = evaluate.evaluation_summary(rows)
    out = {"evaluation_summary": summary.orderBy(*S.SETTING), "final_matrix": evaluate.final_matrix(summary).orderBy("workflow"), "failure_map": evaluate.failure_map(rows, summary).orderBy("dataset", "perturbation")}
    if out_dir:
        for name, df in out.items():
            R.write_table(df, f"{out_dir}/{name}", S.SUMMARY_COLUMNS if name == "evaluation_summary" else None)
    return out


def load_failure_map(spark: SparkSession, run_dir: str, rows: DataFrame) -> DataFrame:
    """The failure map that a run has already, else one from its rows."""
    for path in (f"{run_dir}/evaluation/failure_map", f"{run_dir}/evaluation/failure_map.csv"):
        if R.exists(spark, path):
            return spark.read.option("header", True).csv(path)
    return evaluate.failure_map(rows, evaluate.evaluation_summary(rows))
