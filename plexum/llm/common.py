"""Helpers shared by the text operators: table access, hashing columns, and durable intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum.shipping import ship

#: Bytes that separate words: the space and U+0009 to U+000D; bytes.split() splits at just these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Rows of an Arrow batch. Texts are long: at Spark's default of 10,000 rows batches take hundreds of MB outside the heap.
ARROW_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The package on the executors, and small Arrow batches unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))
    return ship(spark)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int):
    """Arrow batches of about `most` bytes at most, for what runs meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


#: What a worker process remembers between its tasks, by what it was made for.
_REMEMBERED: dict[str, object] = {}


def remembered(key: str, make: Callable[[], object]) -> object:
    """The worker process's object for `key`, made at the first call. Idle workers live on through later stages, so a task that does not keep
    the key drops it."""
    if key not in _REMEMBERED:
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Non-empty parts of at most `rows` rows, so that few texts are Python objects at a time. Of what the process remembers, only `keeps` stays."""
    for key in [x for x in _REMEMBERED if x != keeps]:
        del _REMEMBERED[key]
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str, keeps: str | None = None) -> DataFrame:
    """Run fn on parts of Arrow batches; fn gives a dict of column lists for a batch of output rows, or None. keeps: see `sliced`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in sliced(batches, keeps=keeps):
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="plexum-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Parquet tables in the shared folder that cut lineage; drop() removes one, and all go when the session's JVM ends."""

    def __init__(self, spark: SparkSession, tag: str):
        prepared(spark)
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/plexum-{tag}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back; a lost executor loses nothing that later steps need."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
