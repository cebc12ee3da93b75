"""Equi-joins that stay balanced when a few keys hold most rows of one side or both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side with one key that one task may take.
ROWS_PER_TASK = 100_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner join on ``keys`` (a column of both sides; null keys never match).

    A key with more than ``rows_per_task`` rows on either side is split on both: rows of the left go by hash to one of a
    blocks and those of the right to one of b, so many that none holds more, and every block of one side meets every
    block of the other. Such keys are at most ``rows / rows_per_task`` and found with partial aggregation. No row is lost
    or doubled.
    """
    both = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys)
    blocks = lambda c: F.ceil(F.col(c) / rows_per_task).cast("int")
    hot = both.filter((F.col("_l") > rows_per_task) | (F.col("_r") > rows_per_task)).select(*keys, blocks("_l").alias("_a"), blocks("_r").alias("_b"))
    if hot.isEmpty():
        return left.join(right, keys)

    def spread(side: DataFrame, own: str, other: str, at: str, across: str) -> DataFrame:
        count = lambda c: F.coalesce(c, F.lit(1))
        out = side.join(hot, keys, "left").withColumn(at, F.pmod(F.xxhash64(*side.columns), count(own)).cast("int"))
        return out.withColumn(across, F.explode(F.sequence(F.lit(0), count(other) - 1))).drop("_a", "_b")

    return spread(left, "_a", "_b", "_i", "_j").join(spread(right, "_b", "_a", "_j", "_i"), [*keys, "_i", "_j"]).drop("_i", "_j")
