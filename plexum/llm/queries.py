"""The registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plexum.llm import brown, compression, html_cut, lines, neardup, packing, quality, repeats, surrogates, tiling
from plexum.llm.common import table


def op1_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract_pages(table(spark, sf_dir, "pages"))


#: The setting that holds the key of surrogates, and the public key that stands in for it over test data.
KEY_SETTING, TEST_KEY = "spark.plexum.surrogates.key", "not a secret: test data only"


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY).encode())


def op3_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(table(spark, sf_dir, "documents"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(table(spark, sf_dir, "documents"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_min_cut, op2_surrogates, op3_greedy_tiling, op4_boosted_quality, op5_brown_classes, op6_compression_bands, op7_bottom_k, op8_line_spread, op9_config_lp_packing, op10_prefix_doubling)
}
ORACLE_SQL: dict[str, str] = {"op8_line_spread": lines.ORACLE}
