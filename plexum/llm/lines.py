"""Cross-site line removal: HyperLogLog sketches of the sites that carry a line.

Each (line, site) adds one register value to the line's sketch; a sketch is kept as rows (line, register, highest rank), so merging is
an aggregation by maximum that combines before the shuffle and never holds more than `registers` rows of a line. Lines whose estimate is far
from the threshold are decided by it; the rest get exact distinct counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexum.llm.common import Scratch, as_bytes, sliced

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 8
REGISTERS = 1024
#: How far from the threshold, as a share of it, the estimate decides.
SLACK = 0.5
#: Boilerplate lines that are sent to every task at most (12 bytes each); beyond that they are joined by document.
MAX_SENT = 1_000_000

_KEY = ("h1", "h2")


def _lines(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """Lines with a word, as hashes of 96 bits together, with the hash of their site."""
    line = F.explode(F.split(docs[text_col].cast("string"), "\n", -1)).alias("line")
    found = docs.select(docs[site_col].cast("string").alias("site"), line).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return found.select(F.xxhash64("line").alias("h1"), F.crc32(F.col("line").cast("binary")).cast("long").alias("h2"), "site")


def site_sketches(docs: DataFrame, text_col: str = "text", site_col: str = "source", registers: int = REGISTERS) -> DataFrame:
    """A row per line hash: occurrences n, registers in use, and the estimate of distinct sites. A null site is no site."""
    bits = registers.bit_length() - 1
    h = F.xxhash64(F.lit(7), "site")
    # Leading zeros of the 64 - bits upper bits, from the length of their binary form.
    rank = F.when(F.col("site").isNotNull(), 64 - bits - F.length(F.bin(F.shiftrightunsigned(h, bits))) + F.when(F.shiftrightunsigned(h, bits) == 0, 2).otherwise(1))
    register = F.when(F.col("site").isNotNull(), h.bitwiseAND(registers - 1).cast("int"))
    rows = _lines(docs, text_col, site_col).select(*_KEY, register.alias("register"), rank.cast("int").alias("rank"))
    merged = rows.groupBy(*_KEY, "register").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    sketch = merged.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.count("register").alias("used"), F.coalesce(F.sum(F.when(F.col("register").isNotNull(), F.pow(F.lit(2.0), -F.col("rank")))), F.lit(0.0)).alias("z"))
    m = float(registers)
    raw = F.lit((0.7213 / (1 + 1.079 / m)) * m * m) / (F.col("z") + m - F.col("used"))
    linear = F.lit(m) * F.log(F.lit(m) / F.greatest(m - F.col("used"), F.lit(0.5)))
    return sketch.select(*_KEY, "n", "used", F.when((raw <= 2.5 * m) & (F.col("used") < registers), linear).otherwise(raw).alias("sites"))


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, registers: int = REGISTERS, slack: float = SLACK, max_sent: int = MAX_SENT) -> DataFrame:
    """The hashes (h1, h2) of lines on `min_sites` distinct sites or more.

    The estimate decides lines that are far from the threshold: `slack` of it under or over. Of the lines between, those with `min_sites`
    registers in use have as many sites for sure, as sites in one register count once; the rest get exact distinct counts, for
    which only their own (line, site) pairs are dealt. A line at the threshold has half of it as its estimate with a chance of
    under 1e-8, at 1024 registers and 8 sites.
    """
    spark = docs.sparkSession
    drawn = site_sketches(docs, text_col, site_col, registers).filter(F.col("n") >= min_sites)
    state = F.when(F.col("sites") >= min_sites * (1 + slack), "sure").when(F.col("sites") <= min_sites * (1 - slack), "never").when(F.col("used") >= min_sites, "sure").otherwise("near")
    drawn = Scratch(spark, "lines").save(drawn.select(*_KEY, state.alias("state")).filter(F.col("state") != "never"), "states")
    near = drawn.filter(F.col("state") == "near").select(*_KEY)
    # A line's hashes are 16 bytes; beyond the bound the join deals both sides.
    few = near.limit(max_sent + 1).count() <= max_sent
    own = _lines(docs, text_col, site_col).filter(F.col("site").isNotNull()).join(F.broadcast(near) if few else near, list(_KEY), "left_semi").dropDuplicates([*_KEY, "site"])
    exact = own.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select(*_KEY)
    return drawn.filter(F.col("state") == "sure").select(*_KEY).unionByName(exact)


def _cleaner(h1: np.ndarray, h2: np.ndarray):
    known = dict.fromkeys(zip(h1.tolist(), h2.tolist()))

    def clean(text: str | None) -> tuple[str | None, int, int]:
        """The text without boilerplate lines, the number of lines with a word, and the number removed."""
        if text is None:
            return None, 0, 0
        kept, n, gone = [], 0, 0
        for line in text.split("\n"):
            data = as_bytes(line)
            if data.strip():
                n += 1
                if (((xxhash.xxh64_intdigest(data, 42) + 2**63) % 2**64) - 2**63, zlib.crc32(data)) in known:
                    gone += 1
                    continue
            kept.append(line)
        return ("\n".join(kept), n, gone) if gone else (text, n, 0)

    return clean


def remove_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_sent: int = MAX_SENT) -> DataFrame:
    """docs with all columns, boilerplate lines cut from the text, and long columns `line_count` and `lines_removed` at the end.

    Null texts stay null and count no lines. Columns of docs with those two names are replaced. Up to `max_sent` boilerplate hashes go
    to every task; more are joined to the documents' own lines and then by id, null ids included.
    """
    docs = docs.drop("line_count", "lines_removed")
    schema = StructType(list(docs.schema.fields)).add("line_count", "long").add("lines_removed", "long")
    at = docs.columns.index(text_col)
    names = docs.columns
    sent = found.limit(max_sent + 1).toPandas()
    if len(sent) <= max_sent:
        h1, h2 = sent["h1"].to_numpy(np.int64), sent["h2"].to_numpy(np.int64)

        def run(batches):
            clean = _cleaner(h1, h2)
            for batch in sliced(batches):
                yield _with(batch, names, at, [clean(x) for x in batch.column(at).to_pylist()])

        return docs.mapInArrow(run, schema)
    line = F.explode(F.split(docs[text_col].cast("string"), "\n", -1))
    own = docs.select(docs[id_col].alias("_id"), line.alias("line"))
    own = own.select("_id", F.xxhash64("line").alias("h1"), F.crc32(F.col("line").cast("binary")).cast("long").alias("h2")).dropDuplicates()
    lists = own.join(found, list(_KEY), "left_semi").groupBy("_id").agg(F.collect_list("h1").alias("_h1"), F.collect_list("h2").alias("_h2"))
    joined = docs.join(lists, docs[id_col].eqNullSafe(lists["_id"]), "left").drop("_id")

    def run_joined(batches):
        for batch in sliced(batches):
            a, b = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            got = [_cleaner(np.array(x or [], np.int64), np.array(y or [], np.int64))(t) for t, x, y in zip(batch.column(at).to_pylist(), a, b)]
            yield _with(batch.select(range(len(names))), names, at, got)

    return joined.mapInArrow(run_joined, schema)


def _with(batch: pa.RecordBatch, names: list[str], at: int, got: list[tuple]) -> pa.RecordBatch:
    columns = list(batch.columns)
    columns[at] = pa.array([x[0] for x in got], pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names=[*names, "line_count", "lines_removed"])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: doc_id, n_lines with a word, n_removed, and the text that is left (null for a null text)."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[site_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"))
    out = remove_lines(docs, boilerplate(docs, min_sites=min_sites))
    return out.select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_removed").alias("n_removed"), "text")


ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT line FROM l WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
q AS (SELECT doc_id, i, parts[i] AS line FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
f AS (SELECT q.doc_id, q.i, q.line, b.line IS NOT NULL AS gone FROM q LEFT JOIN b ON q.line = b.line)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '[^ \\t-\\r]')) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM f GROUP BY doc_id
"""
