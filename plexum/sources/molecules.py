"""Graphs from a JSON-lines cache with a manifest of checksums."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The cache's record and manifest formats.
RECORD = "source_id string, num_nodes int, atom_types array<int>, edges array<array<int>>, bond_types array<int>"
SCHEMA_NAME = "zinc_topology_cache_v1"


def load_manifest(spark: SparkSession, root: str, fingerprint: str | None = None) -> dict:
    """The manifest; its schema name, its splits and, if given, its fingerprint are checked."""
    got = json.loads(spark.read.text(f"{root}/manifest.json", wholetext=True).first()[0])
    if got.get("schema") != SCHEMA_NAME or not got.get("splits"):
        raise ValueError("not a manifest of this kind")
    if fingerprint is not None and got.get("fingerprint") != fingerprint:
        raise ValueError("the cache has another fingerprint")
    return got


def _violations() -> F:
    e, n = F.col("edges"), F.col("num_nodes")
    norm = F.transform(e, lambda x: F.concat_ws("-", F.array_min(x).cast("string"), F.array_max(x).cast("string")))
    bad = F.exists(e, lambda x: (F.size(x) != 2) | (x[0] == x[1]) | (x[0] < 0) | (x[1] < 0) | (x[0] >= n) | (x[1] >= n))
    return F.coalesce(bad | (F.size(F.array_distinct(norm)) != F.size(e)) | (F.size("bond_types") != F.size(e)) | (F.size("atom_types") != n) | (n < 1), F.lit(True))


def read_split(spark: SparkSession, root: str, split: str, manifest: dict | None = None) -> DataFrame:
    """Records of a split. A wrong checksum, count, repeated id or bad edge is an error."""
    manifest = manifest or load_manifest(spark, root)
    entry = manifest["splits"][split]
    path = f"{root}/{entry['file']}"
    data = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if data != entry["sha256"]:
        raise ValueError(f"{split}: wrong checksum")
    rows = spark.read.schema(RECORD).json(path)
    n, ids, bad = rows.agg(F.count(F.lit(1)), F.count_distinct("source_id"), F.count_if(_violations())).first()
    if bad or n != entry["count"] or ids != n:
        raise ValueError(f"{split}: {bad} bad records, {n} of {entry['count']} rows, {ids} ids")
    return rows


def sample(records: DataFrame, k: int, seed: int) -> DataFrame:
    """k records without replacement, by the order of a hash of seed and id, numbered by id. Too many is an error."""
    n = records.count()
    if k > n:
        raise ValueError(f"{k} exceeds {n} records")
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "source_id"), 256)
    from pyspark.sql import Window

    top = records.orderBy(order, "source_id").limit(k)
    return top.withColumn("graph_index", F.row_number().over(Window.orderBy("source_id")) - 1)


def as_population(records: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    graphs = records.select(key, "num_nodes")
    edges = records.select(key, F.explode("edges").alias("e")).select(key, F.least(F.col("e")[0], F.col("e")[1]).alias("u"), F.greatest(F.col("e")[0], F.col("e")[1]).alias("v"))
    return graphs, edges


def from_adjacency(matrices: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, u, v, bond) from square matrices (array<array<int>>) of bonds."""
    rows = matrices.select(key, F.posexplode("matrix").alias("u", "row")).select(key, "u", F.posexplode("row").alias("v", "bond"))
    return rows.filter((F.col("u") < F.col("v")) & (F.col("bond") != 0))


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
