"""Per-key results that do not depend on how rows spread over keys: value-frequency compression.

Rows are first grouped by (key, value, ...) with map-side partial aggregation, so what is shuffled is bounded by
distinct pairs, never by the rows of a hot key. Counts, modes, scores and percentiles then come from weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.plans.ranks import cumulative_counts

EXACT = "decimal(38,12)"


def deliver_once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``; rows delivered again have the same content, so any of them will do."""
    return df.dropDuplicates(keys)


def value_counts(df: DataFrame, key: str, value: str, *more: str) -> DataFrame:
    """Distinct (key, value, ...) with ``_n``, the number of rows."""
    return df.groupBy(key, value, *more).agg(F.count(F.lit(1)).alias("_n"))


def parametric_score(
    values: DataFrame, multipliers: DataFrame, group: str, value: str, count: str, mult_key: str, mult: str, top: int = 1
) -> DataFrame:
    """``_group, _score_1, _value_1, ...``: per group the ``top`` values with the greatest sums of multipliers.

    Every row adds the multiplier of its ``count``; equal scores rank by the bytes of the value, smallest first.
    Rows with null group, null or empty value, null count or a count without multiplier do not count; a group without
    counting rows does not appear; places beyond a group's values are null. Several multipliers for one count each
    apply. Sums are decimals, so neither ties nor results depend on the order of rows. A non-finite multiplier is none.
    """
    lookup = multipliers.select(
        F.col(f"`{mult_key}`").alias("_count"), F.col(f"`{mult}`").cast("double").cast(EXACT).alias("_mult")
    ).dropna()
    counted = (
        values.select(
            F.col(f"`{group}`").cast("string").alias("_group"),
            F.col(f"`{value}`").cast("string").alias("_value"),
            F.col(f"`{count}`").alias("_count"),
        )
        .filter(F.col("_group").isNotNull() & (F.length("_value") > 0) & F.col("_count").isNotNull())
        .groupBy("_group", "_value", "_count")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    scores = (
        counted.join(lookup, "_count")
        .groupBy("_group", "_value")
        .agg(F.sum((F.col("_mult") * F.col("_n")).cast(EXACT)).alias("_score"))
    )
    best = top_per_key(scores, "_group", "_score", "_value", top)
    places = []
    for i in range(top):
        place = F.get(F.col("_best"), F.lit(i))
        places += [(-place["s"]).cast("double").alias(f"_score_{i + 1}"), place["v"].alias(f"_value_{i + 1}")]
    return best.select("_group", *places)


def top_per_key(df: DataFrame, key: str, score: str, value: str, top: int) -> DataFrame:
    """``key, _best``: the ``top`` structs (s = negated score, v = value) per key, best first.

    A partial minimum for top = 1. For more, the limit on the rank goes below the shuffle: every partition sends on only
    its own ``top`` rows of a key, however many it has.
    """
    entry = F.struct((-F.col(score)).alias("s"), F.col(value).alias("v"))
    if top == 1:
        return df.groupBy(key).agg(F.array(F.min(entry)).alias("_best"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), F.asc(value)))
    best = df.withColumn("_place", place).filter(F.col("_place") <= top)
    return best.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_best"))


def distinct_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, _rows, _values``: rows and exact distinct non-null values per key; a null key is a key of its own."""
    pairs = value_counts(df, key, value)
    return pairs.groupBy(key).agg(F.sum("_n").alias("_rows"), F.count(value).alias("_values"))


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, _mode, _n``: the most frequent non-null value per key, the smallest of equally frequent ones."""
    pairs = value_counts(df.filter(F.col(value).isNotNull()), key, value)
    best = pairs.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias("_mode"), (-F.col("b.n")).alias("_n"))


def percentiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """``key, _p1, _p2, ...``: exact nearest-rank percentiles of the non-null values per key.

    Share p is the smallest value with at least ``ceil(p * n)`` (one at least) values up to it. The cumulative counts
    are made in value ranges (plans.ranks), so a hot key is spread over tasks. Null keys are a key of their own.
    """
    counted = value_counts(df.filter(F.col(value).isNotNull()), key, value)
    ranked = cumulative_counts(counted, key, value, "_n")

    def at(share: float) -> Column:
        need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_total")))
        return F.min(F.when(F.col("_upto") >= need, F.col(value)))

    return ranked.groupBy(key).agg(*[at(p).alias(f"_p{i + 1}") for i, p in enumerate(shares)])
