"""Math per key, per row and over a whole series, and weighted sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.dialect.compiler import kind_of
from terravane.stream import KEY

KEYED = ["SUM", "SUBTRACT", "POWERMEAN", "AVERAGE", "RMS", "MIN", "MAX", "MUL", "DIV", "EQUALITY", "MEDIAN"]
BY_ROW = ["POWERMEAN", "RMS", "AVERAGE", "MIN", "MAX", "MEDIAN"]


def number(df: DataFrame, column: str) -> Column:
    """The column as double; text that is no number is null."""
    c = F.col(f"`{column}`")
    return c.cast("double") if kind_of(dict(df.dtypes)[column]) == "number" else c.cast("string").try_cast("double")


def _largest_steps(base: DataFrame, order: str | None) -> DataFrame:
    """``_key, _step``: the greatest difference of successive values ``_x`` in order, per key; null for a single value.

    Rows are ranged by key and order (without one they stay where they are), so a hot key goes to many tasks. Each task
    gives first and last value and the greatest step of its part of a key; the borders between parts, one row for each
    key and task, are compared afterwards.
    """
    rows = base.filter(F.col("_x").isNotNull()).select(F.col(KEY).alias("k"), (F.col(f"`{order}`") if order else F.monotonically_increasing_id()).alias("o"), F.col("_x").alias("x"))
    ranged = rows.repartitionByRange("k", "o") if order else rows
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            key, x = batch["k"].to_numpy(), batch["x"].to_numpy(float)
            new = np.concatenate([[True], (key[1:] != key[:-1]) & ~(pd.isna(key[1:]) & pd.isna(key[:-1]))])
            start = np.flatnonzero(new)
            step = np.concatenate([[-1.0], np.abs(np.diff(x))])
            step[new] = -1.0
            found = pd.DataFrame({"k": key[start], "part": part, "first": x[start], "last": x[np.append(start[1:], len(x)) - 1], "step": np.maximum.reduceat(step, start)})
            if held is not None:  # the key that the batch before ended with may go on
                same = held["k"] == found["k"][0] or (pd.isna(held["k"]) and pd.isna(found["k"][0]))
                if same:
                    found.loc[0, "step"] = max(held["step"], found["step"][0], abs(found["first"][0] - held["last"]))
                    found.loc[0, "first"] = held["first"]
                else:
                    yield pd.DataFrame([held])
            held = found.iloc[-1].to_dict()
            if len(found) > 1:
                yield found.iloc[:-1]
        if held is not None:
            yield pd.DataFrame([held])

    parts = ranged.sortWithinPartitions("k", "o").drop("o").mapInPandas(run, f"k {kind}, part int, first double, last double, step double")
    border = F.abs(F.col("first") - F.lag("last").over(W.partitionBy("k").orderBy("part")))
    best = F.max(F.greatest(F.col("step"), F.coalesce("_border", F.lit(-1.0))))
    return parts.withColumn("_border", border).groupBy(F.col("k").alias(KEY)).agg(F.when(best >= 0, best).alias("_step"))


def keyed_math(df: DataFrame, function: str, column: str | None = None, const: float | None = None, full: bool = False, order: str | None = None) -> DataFrame:
    """``_key, _result`` (or, for MIN and MAX with ``full``, the whole rows of the extremes).

    Values that are null or no number do not count; a key without any gives null. SUBTRACT, DIV and EQUALITY with a
    constant depend on the order of rows: ``order`` names the column that gives it (without one, any row is first).
    All aggregates combine partially before the shuffle; MEDIAN groups equal values first.
    """
    function = function.upper()
    column = column or next(c for c in df.columns if c != KEY)
    x = number(df, column)
    base = df.withColumn("_x", x)
    c = F.lit(const)
    if full and function in ("MIN", "MAX"):
        pick = F.min_by if function == "MIN" else F.max_by
        row = F.struct(*[F.col(f"`{n}`") for n in df.columns if n != KEY])
        best = base.filter(F.col("_x").isNotNull()).groupBy(KEY).agg(pick(row, "_x").alias("_row"))
        return best.select(KEY, "_row.*")
    if function in ("POWERMEAN",) and const is None:
        raise ValueError("POWERMEAN needs a constant")
    if function == "MEDIAN":
        counted = base.groupBy(KEY, "_x").agg(F.count(F.lit(1)).alias("_n"))
        return counted.groupBy(KEY).agg(F.percentile("_x", F.lit(0.5), F.col("_n")).alias("_result"))
    if function == "EQUALITY" and const is not None:
        steps = _largest_steps(base, order)
        same = F.coalesce(F.col("_step"), F.lit(0.0)) < abs(const)
        return steps.select(KEY, F.when(same, 1.0).otherwise(F.when(F.col("_step").isNull() | (F.col("_step") == 0), 1.0).otherwise(0.0)).alias("_result"))
    x = F.col("_x")
    if function in ("SUBTRACT", "DIV"):
        place = F.col(f"`{order}`") if order else F.monotonically_increasing_id()
        base = base.withColumn("_order", F.when(x.isNotNull(), F.struct(place.alias("o"), x.alias("x"))))
        grouped = base.groupBy(KEY).agg(
            F.min("_order").getField("x").alias("_first"), F.sum("_x").alias("_sum"), F.count("_x").alias("_n"),
            F.product(F.when(x != 0, x).otherwise(1.0)).alias("_product"), F.sum((x == 0).cast("int")).alias("_zeros"),
        )
        first = F.col("_first")
        if function == "SUBTRACT":
            result = 2 * first - F.col("_sum") - (c if const is not None else 0.0)
        else:
            rest_zeros = F.col("_zeros") - (first == 0).cast("int")
            rest = F.when(F.col("_n") == 1, 1.0).otherwise(F.col("_product") / F.when(first == 0, 1.0).otherwise(first))
            by_zero = F.when(first > 0, F.lit(float("inf"))).when(first < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
            result = F.when(rest_zeros > 0, by_zero).otherwise(first / rest)
            if const is not None:
                result = result / c
        return grouped.select(KEY, result.alias("_result"))
    results = {
        "SUM": lambda: F.sum(x) + (const or 0.0),
        "POWERMEAN": lambda: F.pow(F.avg(F.pow(x, c)), 1 / c),
        "RMS": lambda: F.sqrt(F.avg(x * x)),
        "AVERAGE": lambda: (F.sum(x) + (const or 0.0)) / F.count(x),
        "MIN": lambda: F.min(x) if const is None else F.when(F.count(x) > 0, F.greatest(F.min(x), c)),
        "MAX": lambda: F.max(x) if const is None else F.when(F.count(x) > 0, F.least(F.max(x), c)),
        "MUL": lambda: F.product(x) * (1.0 if const is None else const),
        "EQUALITY": lambda: (F.min(x) == F.max(x)).cast("double"),
    }
    return base.groupBy(KEY).agg(results[function]().alias("_result"))


def columns_math(df: DataFrame, function: str, columns: list[str], const: float | None = None) -> DataFrame:
    """Adds ``_result`` from the named columns of each row (a single name that ends in ``*`` is a prefix); nulls do not count."""
    if len(columns) == 1 and columns[0].endswith("*"):
        columns = [c for c in df.columns if c.startswith(columns[0][:-1])]
    values = [number(df, c) for c in dict.fromkeys(columns)]
    if not values:
        raise ValueError("no columns to calculate with")
    function = function.upper()
    total = lambda xs: reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in xs])
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    some = F.when(n > 0, n)
    pick = lambda f: values[0] if len(values) == 1 else f(*values)
    if function in ("POWERMEAN", "RMS"):
        p = 2.0 if function == "RMS" else const
        if p is None:
            raise ValueError("POWERMEAN needs a constant")
        result = F.pow(total([F.pow(v, F.lit(p)) for v in values]) / some, F.lit(1 / p))
    elif function == "AVERAGE":
        result = (total(values) + (const or 0.0)) / some
    elif function == "MIN":
        result = pick(F.least) if const is None else F.when(some.isNotNull(), F.greatest(pick(F.least), F.lit(const)))
    elif function == "MAX":
        result = pick(F.greatest) if const is None else F.when(some.isNotNull(), F.least(pick(F.greatest), F.lit(const)))
    elif function == "MEDIAN":
        ordered = F.array_sort(F.array_compact(F.array(*values)))
        half = F.floor((F.size(ordered) - 1) / 2).cast("int")
        other = F.floor(F.size(ordered) / 2).cast("int")
        result = (F.get(ordered, half) + F.get(ordered, other)) / 2
    else:
        raise ValueError(f"no function {function}")
    return df.withColumn("_result", result)


def series_math(df: DataFrame, function: str, column: str, const: float = 100.0) -> DataFrame:
    """Adds ``_result``: the z-score (population deviation below 30 values) or the value over the maximum, times ``const``.

    Totals are one row, joined as scalar subqueries; rows whose value is null or no number get null.
    """
    x = number(df, column)
    base = df.withColumn("_x", x)
    if function.upper() == "NORMALIZE":
        top = base.agg(F.max("_x").alias("m")).scalar()
        return base.withColumn("_result", F.try_divide(F.col("_x"), top) * F.lit(float(const))).drop("_x")
    if function.upper() != "STDDEV":
        raise ValueError(f"no function {function}")
    deviation = F.when(F.count("_x") < 30, F.stddev_pop("_x")).otherwise(F.stddev_samp("_x"))
    stats = base.agg(F.struct(F.avg("_x").alias("mean"), deviation.alias("sd")).alias("s")).scalar()
    return base.withColumn("_s", stats).withColumn("_result", F.try_divide(F.col("_x") - F.col("_s.mean"), F.col("_s.sd"))).drop("_x", "_s")


def weighted_sum(inputs: list[DataFrame], payload: list[str], count: str, value: str) -> DataFrame:
    """``_payload_<c>..., _total_count, _total_value, _weighted_sum`` over all inputs, by the payload columns.

    Missing columns of an input count as null; rows without count or value add nothing to the sums.
    """
    parts = []
    for df in inputs:
        have = set(df.columns)
        keys = [(F.col(f"`{c}`") if c in have else F.lit(None)).cast("string").alias(f"_payload_{c}") for c in payload]
        n = number(df, count).cast("bigint") if count in have else F.lit(None).cast("bigint")
        v = number(df, value) if value in have else F.lit(None).cast("double")
        parts.append(df.select(*keys, n.alias("_n"), v.alias("_v")))
    every = reduce(DataFrame.unionByName, parts)
    sums = every.groupBy(*[f"_payload_{c}" for c in payload]).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_total_count"), F.coalesce(F.sum(F.col("_n") * F.col("_v")), F.lit(0.0)).alias("_total_value")
    )
    return sums.withColumn("_weighted_sum", F.try_divide(F.col("_total_value"), F.col("_total_count").cast("double")))
