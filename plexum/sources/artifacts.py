"""Content-addressed records: a table of (kind, sha256, body) to which only new bodies are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum.sources.results import exists


def addressed(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(body).cast("binary"), 256))


def write(df: DataFrame, path: str) -> DataFrame:
    """Append the bodies that the table lacks (df: kind, body); gives kind and sha256 of all. Each body is stored once."""
    spark = df.sparkSession
    rows = addressed(df.select("kind", F.col("body").cast("string").alias("body")))
    new = rows.dropDuplicates(["kind", "sha256"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("kind", "sha256"), ["kind", "sha256"], "left_anti")
    new.write.mode("append").parquet(path)
    return rows.select("kind", "sha256")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records with `valid`: whether the body still has its checksum."""
    return spark.read.parquet(path).withColumn("valid", F.sha2(F.col("body").cast("binary"), 256) == F.col("sha256"))


def broken(rows: DataFrame, records: DataFrame, column: str = "graph_sha256") -> DataFrame:
    """Rows whose record is missing or damaged."""
    good = records.filter("valid").select(F.col("sha256").alias(column)).distinct()
    return rows.join(good, column, "left_anti")


def row_artifacts_valid(rows: DataFrame, records: DataFrame) -> DataFrame:
    """The rows with `valid`: whether both records that they name are there undamaged. Failed rows have no workflow record to have."""
    good = records.filter("valid").select("kind", "sha256").distinct()
    for kind in ("graph", "workflow"):
        have = good.filter(F.col("kind") == kind).select(F.col("sha256").alias(f"{kind}_sha256"), F.lit(True).alias(f"_{kind}"))
        rows = rows.join(have, f"{kind}_sha256", "left")
    ok = F.coalesce("_graph", F.lit(False)) & (F.coalesce("_workflow", F.lit(False)) | (F.col("status") != "success"))
    return rows.withColumn("valid", ok).drop("_graph", "_workflow")
