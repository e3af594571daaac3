"""Deterministic views over the generic tables, shaped as results, populations of graphs and vectors.

Each view exists as a DataFrame builder and as SQL text for other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum.shipping import ship

#: Added before rounding, so that no engine meets a tie.
UP = 1e-7
#: Orders whose lines make a graph, so that the number of graphs follows the table, and nodes of a graph.
ORDERS, NODES = 64, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def results_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results-shaped rows: scores of four decimals, edits of six, by dataset, perturbation, workflow, strength and seed; a few failed and skipped cells."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    keyed = l.select(
        F.col("l_linestatus").alias("dataset"), F.col("l_linenumber").cast("string").alias("perturbation"), F.col("l_returnflag").alias("workflow"),
        (F.round(F.col("l_discount") * 100) / 10).alias("alpha"), (F.col("l_suppkey") % 6).cast("int").alias("seed"),
        "l_extendedprice", "l_quantity", "l_tax", "l_partkey",
    )
    out = keyed.groupBy("dataset", "perturbation", "workflow", "alpha", "seed").agg(
        F.round(F.avg("l_extendedprice") / 1000 + UP, 4).alias("distribution_score"), F.round(F.avg("l_quantity") + UP, 4).alias("mean_shift_score"), F.round(F.avg("l_tax") + UP, 4).alias("paired_score"),
        F.round(F.avg(F.col("l_partkey") % 50) / 10, 6).alias("edit_distance_raw"), F.round(F.avg(F.col("l_partkey") % 50) * (F.col("alpha") + 1) + UP, 4).alias("edit_distance_weighted"),
        F.round(F.avg("l_quantity") / 10 + UP, 4).alias("runtime_seconds"), F.count(F.lit(1)).alias("n_rows"),
    )
    state = F.when((F.col("seed") == 5) & (F.col("alpha") > 0.85), "failed").when((F.col("perturbation") == "7") & (F.col("dataset") == "F"), "skipped").otherwise("success")
    return out.withColumn("status", state)


RESULTS_SQL = f"""
rview0 AS (SELECT l_linestatus AS dataset, CAST(l_linenumber AS VARCHAR) AS perturbation, l_returnflag AS workflow, round(l_discount * 100) / 10 AS alpha,
  CAST(l_suppkey % 6 AS INTEGER) AS seed, l_extendedprice, l_quantity, l_tax, l_partkey FROM lineitem),
rview AS (SELECT dataset, perturbation, workflow, alpha, seed, round(avg(l_extendedprice) / 1000 + {UP}, 4) AS distribution_score, round(avg(l_quantity) + {UP}, 4) AS mean_shift_score,
  round(avg(l_tax) + {UP}, 4) AS paired_score, round(avg(l_partkey % 50) / 10, 6) AS edit_distance_raw, round(avg(l_partkey % 50) * (alpha + 1) + {UP}, 4) AS edit_distance_weighted,
  round(avg(l_quantity) / 10 + {UP}, 4) AS runtime_seconds, count(*) AS n_rows,
  CASE WHEN seed = 5 AND alpha > CAST(0.85 AS DOUBLE) THEN 'failed' WHEN perturbation = '7' AND dataset = 'F' THEN 'skipped' ELSE 'success' END AS status
  FROM rview0 GROUP BY dataset, perturbation, workflow, alpha, seed)"""


def graph_view(spark: SparkSession, sf_dir: str, orders: int = ORDERS, nodes: int = NODES) -> tuple[DataFrame, DataFrame]:
    """(graphs, edges) from all lines: side 'original' or 'perturbed', u < v, every graph with nodes 0..nodes-1."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    gid = F.floor(F.col("l_orderkey") / orders).cast("int").alias("gid")
    a, b = (F.col("l_partkey") % nodes).cast("int"), ((F.col("l_suppkey") * 7 + F.floor(F.col("l_partkey") / nodes)) % nodes).cast("int")
    side = F.when(F.col("l_linenumber") % 2 == 0, "perturbed").otherwise("original")
    edges = l.select(gid, side.alias("side"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()
    every = l.select(gid).distinct().select("gid", F.explode(F.array(F.lit("original"), F.lit("perturbed"))).alias("side"), F.lit(nodes).alias("num_nodes"))
    return every, edges


GRAPH_SQL = f"""
gedges AS (SELECT DISTINCT gid, side, least(a, b) AS u, greatest(a, b) AS v FROM (SELECT CAST(l_orderkey // {ORDERS} AS INTEGER) AS gid,
  CASE WHEN l_linenumber % 2 = 0 THEN 'perturbed' ELSE 'original' END AS side, CAST(l_partkey % {NODES} AS INTEGER) AS a,
  CAST((l_suppkey * 7 + l_partkey // {NODES}) % {NODES} AS INTEGER) AS b FROM lineitem) WHERE a <> b),
ggraphs AS (SELECT gid, side, {NODES} AS num_nodes FROM (SELECT DISTINCT CAST(l_orderkey // {ORDERS} AS INTEGER) AS gid FROM lineitem), (VALUES ('original'), ('perturbed')) s(side)),
gnodes AS (SELECT gid, side, CAST(n AS INTEGER) AS node FROM ggraphs, range({NODES}) t(n))"""


def vector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, side X (even label) or Y, pair (rank of the id within the side), x (doubles)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "X").otherwise("Y").alias("side"), F.col("embedding").cast("array<double>").alias("x"))
    return e.withColumn("pair", F.row_number().over(Window.partitionBy("side").orderBy("vec_id")).cast("long"))


VECTOR_SQL = """
vview AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'X' ELSE 'Y' END AS side, CAST(embedding AS DOUBLE[]) AS x,
  row_number() OVER (PARTITION BY label % 2 = 0 ORDER BY vec_id) AS pair FROM embeddings)"""
