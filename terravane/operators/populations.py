"""Population indicators: uniques, reach, dwell time, frequency, percent ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.hotkeys import value_counts
from terravane.operators.maths import number
from terravane.plans.ranks import cumulative_counts, repeated
from terravane.stream import KEY


def count_uniques(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, _uniques``: distinct non-null values per group, counted over distinct pairs."""
    pairs = df.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{value}`").alias("_v")).distinct()
    return pairs.groupBy("_g").agg(F.count("_v").alias("_uniques")).withColumnRenamed("_g", group)


def reach(signals: DataFrame, user: str, target: DataFrame, target_user: str, target_group: str) -> DataFrame:
    """``_group, _reach``: distinct users of a group in ``target`` over the distinct users of ``signals``."""
    everyone = signals.select(F.col(f"`{user}`").alias("u")).distinct().agg(F.count("u").alias("n")).scalar()
    pairs = target.select(F.col(f"`{target_group}`").alias("_group"), F.col(f"`{target_user}`").alias("_user")).distinct()
    counted = pairs.groupBy("_group").agg(F.count("_user").alias("_n")).withColumn("_all", everyone)
    return counted.select("_group", F.try_divide(F.col("_n").cast("double"), F.col("_all").cast("double")).alias("_reach"))


def dwell_time(signals: DataFrame, user: str, target: DataFrame, target_user: str, target_group: str) -> DataFrame:
    """``_group, _dwell_time``: over a group's users, the mean of their signals in the group over all their signals."""
    totals = signals.groupBy(F.col(f"`{user}`").alias("_user")).agg(F.count(F.lit(1)).alias("_all"))
    inside = target.groupBy(F.col(f"`{target_group}`").alias("_group"), F.col(f"`{target_user}`").alias("_user")).agg(F.count(F.lit(1)).alias("_n"))
    joined = inside.join(totals, "_user")
    return joined.groupBy("_group").agg(F.avg(F.col("_n") / F.col("_all")).alias("_dwell_time"))


def frequency(df: DataFrame, value: str, count: str) -> DataFrame:
    """``count, _frequency``: per value of ``count``, the median over ``value`` of its share of the value's rows.

    Shares are grouped by equal share before the median, so its state holds distinct shares only.
    """
    pairs = df.groupBy(F.col(f"`{value}`").alias("_v"), F.col(f"`{count}`").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    totals = pairs.groupBy("_v").agg(F.sum("_n").alias("_all"))
    shares = pairs.join(totals.withColumnRenamed("_v", "_w"), F.col("_v").eqNullSafe(F.col("_w")))
    shares = shares.groupBy("_c", (F.col("_n") / F.col("_all")).alias("_share")).agg(F.count(F.lit(1)).alias("_times"))
    return shares.groupBy("_c").agg(F.percentile("_share", F.lit(0.5), F.col("_times")).alias("_frequency")).withColumnRenamed("_c", count)


def percent_rank(df: DataFrame, value: str, by_key: bool = False) -> DataFrame:
    """``[_key,] _value, _rank``: the share of other rows (of the key) with smaller values, one row for each row.

    Values that are null or no number have no rank and are left out; a single row ranks NaN. Equal values are counted
    first and ranks are made in value ranges, so neither all rows nor a hot key meet in one task.
    """
    keys = [KEY] if by_key else []
    base = df.select(*keys, number(df, value).alias("_value")).filter(F.col("_value").isNotNull())
    counted = base.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative_counts(counted, KEY if by_key else None, "_value", "_n")
    rank = F.when(F.col("_total") == 1, F.lit(float("nan"))).otherwise(F.col("_below") / (F.col("_total") - 1))
    return repeated(ranked.select(*keys, "_value", rank.alias("_rank"), "_n"), "_n")


def percentile_filter(df: DataFrame, column: str, top: int = -1, bottom: int = -1) -> DataFrame:
    """Rows whose value lies between the values at ``floor(n * p / 100)`` in sorted order, for the percentiles given.

    Rows come in the order of their values. Nulls and text that is no number do not count and are left out.
    """
    if top < 0 and bottom < 0 or 0 <= top < bottom:
        raise ValueError("give top, bottom or both, top not below bottom")
    base = df.withColumn("_x", number(df, column)).filter(F.col("_x").isNotNull())
    counted = base.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative_counts(counted, None, "_x", "_n")
    at = lambda p: F.least(F.floor(F.col("_total") * p / 100), F.col("_total") - 1)
    holds = lambda p: (F.col("_below") <= at(p)) & (F.col("_upto") > at(p))
    row = ranked.agg(
        F.max(F.when(holds(max(top, 0)), F.col("_x"))).alias("t"), F.max(F.when(holds(max(bottom, 0)), F.col("_x"))).alias("b")
    ).first()
    keep = F.lit(row is not None and row["t"] is not None)
    if top >= 0:
        keep = keep & (F.col("_x") <= F.lit(row["t"]))
    if bottom >= 0:
        keep = keep & (F.col("_x") >= F.lit(row["b"]))
    return base.filter(keep).orderBy("_x").drop("_x")


def metrics(df: DataFrame, name: str, column: str | None) -> DataFrame:
    """One row: ``_streamName, _counterColumn, _totalCount, _uniqueCounters, _counterAverage, _counterMedian`` by key counts."""
    key = F.md5(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in df.columns])) if column is None else F.col(f"`{column}`").cast("string")
    counted = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counted.groupBy("_n").agg(F.count(F.lit(1)).alias("_times"))
    return sizes.agg(
        F.lit(name).alias("_streamName"), F.lit(column).cast("string").alias("_counterColumn"),
        F.coalesce(F.sum(F.col("_n") * F.col("_times")), F.lit(0)).alias("_totalCount"),
        F.coalesce(F.sum("_times"), F.lit(0)).alias("_uniqueCounters"),
        F.try_divide(F.sum(F.col("_n") * F.col("_times")).cast("double"), F.sum("_times").cast("double")).alias("_counterAverage"),
        F.percentile("_n", F.lit(0.5), F.col("_times")).alias("_counterMedian"),
    )


__all__ = ["count_uniques", "dwell_time", "frequency", "metrics", "percent_rank", "percentile_filter", "reach", "value_counts"]
