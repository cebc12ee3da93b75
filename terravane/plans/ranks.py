"""Ranks and cumulative counts without one task per key (or one task for all rows).

Values are cut into ranges at approximate quantiles; a window inside (key, range) and a window over the few range
totals of each key add up to the exact cumulative count. The cut points only steer the spread, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 128


def _range_of(value: Column, cuts: list, lo: int = 0) -> Column:
    """Number of ``cuts`` at or below ``value``, by a balanced tree of comparisons."""
    if not cuts:
        return F.lit(lo)
    middle = len(cuts) // 2
    return F.when(value >= F.lit(cuts[middle]), _range_of(value, cuts[middle + 1 :], lo + middle + 1)).otherwise(
        _range_of(value, cuts[:middle], lo)
    )


def range_column(df: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """A column that numbers ranges of ``value`` in order; numbers are cut at quantiles, other types are one range."""
    kind = dict(df.dtypes)[value]
    if kind.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return F.lit(0)
    shares = [i / ranges for i in range(1, ranges)]
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    found = df.select(F.percentile_approx(clean, shares, 1000)).first()[0] or []
    return _range_of(F.col(value).cast("double"), sorted(set(found)))


def repeated(df: DataFrame, n: str, at_once: int = 65_536) -> DataFrame:
    """Each row ``n`` times (not at all for 0), the column dropped; no array of more than ``at_once`` numbers is made,
    nor of more than n / at_once."""
    parts = F.explode(F.sequence(F.lit(0), F.expr(f"CAST((`{n}` - 1) DIV {at_once} AS INT)")))
    cut = df.filter(F.col(n) > 0).withColumn("_part", parts)
    size = F.least(F.lit(at_once), F.col(n) - F.col("_part") * F.lit(at_once)).cast("int")
    return cut.withColumn("_i", F.explode(F.sequence(F.lit(1), size))).drop("_part", "_i", n)


def cumulative_counts(counted: DataFrame, key: str | None, value: str, n: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``_upto`` (rows with values up to this one), ``_below`` (with smaller ones) and ``_total`` per key.

    ``counted`` has one row for each (key, value) with its number of rows ``n``. ``key`` None: one series for all.
    """
    keys = [key] if key else []
    ranged = counted.withColumn("_range", range_column(counted, value, ranges))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(n).alias("_in_range"))
    per_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = per_key.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_offset"),
        F.sum("_in_range").over(per_key).alias("_total"),
    )
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = ranged.withColumn("_here", F.sum(n).over(inside)).join(offsets, same)
    return joined.select(
        *counted.columns,
        (F.col("_offset") + F.col("_here")).alias("_upto"),
        (F.col("_offset") + F.col("_here") - F.col(n)).alias("_below"),
        "_total",
    )
