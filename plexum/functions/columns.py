"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """A double; null for text that is none, for NaN and for null. Infinities stay."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column | str) -> Column:
    """A finite double or null."""
    x = number(c)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def mean0(c: Column) -> Column:
    """The mean of numbers that are there, 0 without any."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def average_rank(part: Sequence[Column | str], value: Column) -> Column:
    """1-based rank; ties share the mean of their ranks."""
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*part, value)) - 1) / 2.0


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate: 0 when a side is constant or there are no pairs."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))), F.lit(0.0))


def lookup(c: Column | str, table: dict, default: Column) -> Column:
    """A small fixed table as an expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(c) if isinstance(c, str) else c], default)


def at_most(c: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that the value, at 9 decimals, does not exceed."""
    out, x = F.lit(last), F.round(c, 9)
    for bound, label in reversed(steps):
        out = F.when(x <= bound, label).otherwise(out)
    return out


def at_least(c: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    out, x = F.lit(last), F.round(c, 9)
    for bound, label in reversed(steps):
        out = F.when(x >= bound, label).otherwise(out)
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at so many decimals, without negative zeros, for comparison between engines."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def pairwise_finite(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns({x: finite(x), y: finite(y)}).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
