"""Incremental results: shards that arrive in a folder are appended to a table, each key once, as a Structured Streaming query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plexum import schema as S
from plexum.sources.results import exists


def append_new(batch: DataFrame, path: str, keys: Sequence[str] = S.ROW_KEY) -> None:
    """Append the rows whose key the table lacks; of rows with one key in a batch the first by all columns. Running it twice changes nothing."""
    spark = batch.sparkSession
    keys = list(keys)
    order = [F.col(c).cast("string") for c in batch.columns if c not in keys] or [F.lit(1)]
    new = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").partitionBy("dataset").parquet(path)


def stream_results(spark: SparkSession, source: str, path: str, checkpoint: str, ddl: str = S.RESULTS, format: str = "parquet", **options) -> StreamingQuery:
    """Append what the source folder has now, batch by batch, and end; state is in the checkpoint."""
    rows = spark.readStream.schema(ddl).format(format).options(**options).load(source)
    return rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_status(spark: SparkSession, source: str, ddl: str = S.RESULTS, format: str = "parquet") -> DataFrame:
    """A running count by workflow and status, for a complete-mode sink."""
    return spark.readStream.schema(ddl).format(format).load(source).groupBy("workflow", "status").count()
