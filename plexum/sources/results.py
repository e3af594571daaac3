"""Results tables: CSV (plain or gzip) and Parquet, in and out, with one declared schema."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from plexum import schema as S
from plexum.functions.columns import finite


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace_dir(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder `new` in the place of `path`. Should it stop between its two renames, recover_dir brings the old one back."""
    fs, target = _fs(spark, path)
    made, old = _fs(spark, new)[1], _fs(spark, f"{path}.old")[1]
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(made, target):
        raise OSError(f"{new} cannot be moved")
    fs.delete(old, True)


def recover_dir(spark: SparkSession, path: str) -> None:
    """After a replacement that was cut off, the old folder is the one that counts."""
    fs, target = _fs(spark, path)
    old = _fs(spark, f"{path}.old")[1]
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)


def resolve(spark: SparkSession, path: str) -> str:
    """The file itself, or a run folder's results.csv, results.csv.gz or results (Parquet), also below a results folder."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and (fs.getFileStatus(p).isFile() or exists(spark, f"{path}/_SUCCESS")):
        return path
    for name in ("results.csv", "results.csv.gz", "results", "results/results.csv", "results/results.csv.gz"):
        if exists(spark, f"{path}/{name}"):
            found, q = _fs(spark, f"{path}/{name}")
            if found.getFileStatus(q).isFile() or exists(spark, f"{path}/{name}/_SUCCESS"):
                return f"{path}/{name}"
    if path.endswith(".csv") and exists(spark, f"{path}.gz"):
        return f"{path}.gz"
    raise FileNotFoundError(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows. Text that is no number and an empty field are null; columns that a file lacks are null."""
    at = resolve(spark, path)
    target = StructType.fromDDL(S.RESULTS)
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(at) if ".csv" in at.rsplit("/", 1)[-1] else spark.read.parquet(at)
    have = set(raw.columns)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in target))


def parse_csv(spark: SparkSession, text: str) -> DataFrame:
    """Rows of CSV text that is in memory already, as read_results gives them."""
    import csv
    import io

    target = StructType.fromDDL(S.RESULTS)
    rows = list(csv.DictReader(io.StringIO(text)))
    names = [f.name for f in target]
    data = [tuple((row.get(n) or None) for n in names) for row in rows]
    raw = spark.createDataFrame(data, StructType.fromDDL(", ".join(f"{n} string" for n in names)))
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in target))


def encoded(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text-safe columns: nested ones as JSON, numbers that are not finite as null."""
    out = []
    for f in df.select(*(columns or df.columns)).schema:
        c = F.col(f.name)
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType))
        out.append((F.to_json(c) if nested else finite(c) if f.dataType.simpleString() in ("double", "float") else c).alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, format: str = "csv", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write in a fixed column order; nulls are empty fields."""
    writer = (encoded(df, columns) if format == "csv" else df.select(*(columns or df.columns))).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)


def discover_runs(spark: SparkSession, root: str) -> list[str]:
    """Run folders with a results table, the newest name first."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        path = status.getPath().toString()
        if status.isDirectory() and any(exists(spark, f"{path}/{n}") for n in ("results.csv", "results.csv.gz", "results")):
            found.append(path)
    return sorted(found, reverse=True)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# The default `legacy` names are fixed values: labels of two retired perturbations in old tables.
def prepare(df: DataFrame, datasets: Sequence[str] | None = None, perturbations: Sequence[str] | None = None, workflows: Sequence[str] | None = None, score: str = "distribution_score", legacy: Sequence[str] = ("edge_addition_deletion", "triangle_injection_removal")) -> DataFrame:
    """Rows for charts: successful, with a finite score, of the chosen values, without perturbations that mix two directions."""
    out = df.filter((F.col("status") == "success") & finite(score).isNotNull() & ~F.col("perturbation").isin(*legacy))
    for column, chosen in (("dataset", datasets), ("perturbation", perturbations), ("workflow", workflows)):
        if chosen is not None:
            out = out.filter(F.col(column).isin(*chosen))
    return out


def labelled(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Display names; a value without one keeps its own."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return df.withColumn(column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))) if pairs else df


def write_json(path: str, value: dict) -> None:
    """A driver-side document, written beside and moved into place."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.tmp", path)
