"""Matching against a list of values, date filters, and splits by columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.maths import number


def split_match(
    source: DataFrame, source_column: str, values: DataFrame, values_column: str, take: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``source`` with a partner in ``values``, and the rows without.

    Matched rows may take columns of ``values`` (as ``values.<column>``); evicted ones have nulls there. Of several
    values with one key, the one with the greatest columns counts, so the result does not depend on order. Nulls do
    not match.
    """
    take = take or []
    extra = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(take)]) if take else F.lit(1)
    unique = values.select(F.col(f"`{values_column}`").alias("_m"), extra.alias("_v")).filter(F.col("_m").isNotNull())
    unique = unique.groupBy("_m").agg(F.max("_v").alias("_v"))
    left = F.col(f"`{source_column}`").cast("string")
    kept = [F.col(f"`{c}`") for c in source.columns]
    matched = source.join(unique, left == F.col("_m").cast("string"))
    matched = matched.select(*kept, *[F.col("_v").getField(f"c{i}").alias(f"values.{c}") for i, c in enumerate(take)])
    evicted = source.join(unique, left == F.col("_m").cast("string"), "left_anti")
    types = dict(values.dtypes)
    return matched, evicted.select(*kept, *[F.lit(None).cast(types[c]).alias(f"values.{c}") for c in take])


# Ranges of the parts of a date.
RANGES = {"year": (0, 9999), "month": (1, 12), "date": (1, 31), "dow": (1, 7), "hour": (0, 23), "minute": (0, 59)}


def _moment(text: str) -> Column:
    """Epoch seconds or milliseconds, or ISO text, as seconds."""
    if re.fullmatch(r"-?\d+(\.\d*)?", text):
        value = float(text)
        return F.lit(value if abs(value) < 1e11 else value / 1000)
    return F.unix_micros(F.try_to_timestamp(F.lit(text))) / 1e6


def filter_by_date(
    df: DataFrame,
    columns: dict[str, str],
    start: str | None = None,
    end: str | None = None,
    allowed: dict[str, list[str]] | None = None,
    hhmm_start: int | None = None,
    hhmm_end: int | None = None,
) -> DataFrame:
    """Rows whose exploded date parts pass every filter given.

    ``columns`` names the column of year, month (1-12), date, dow (1 = Monday), hour and minute. ``start`` and ``end``
    are strict and need year, month and date; ``allowed`` lists values by part, those out of range dropped, a list of
    none but such values filters nothing. ``hhmm_start`` is exclusive, ``hhmm_end`` inclusive; if start is not before
    end, the span wraps over midnight. Rows with a null part that is asked for do not pass.
    """
    part = {p: number(df, c).cast("int") for p, c in columns.items()}
    tests: list[Column] = []
    if start or end:
        if not {"year", "month", "date"} <= part.keys():
            raise ValueError("start and end need the columns of year, month and date")
        zero = F.lit(0)
        at = F.try_make_timestamp_ntz(part["year"], part["month"], part["date"], part.get("hour", zero), part.get("minute", zero), F.lit(0))
        seconds = F.unix_micros(at.cast("timestamp")) / 1e6
        tests += [seconds > _moment(start)] if start else []
        tests += [seconds < _moment(end)] if end else []
    for name, values in (allowed or {}).items():
        low, high = RANGES[name]
        fit = [int(v) for v in values if re.fullmatch(r"\s*-?\d+\s*", str(v)) and low <= int(v) <= high]
        if fit:
            tests.append(part[name].isin(*fit))
    if hhmm_start is not None or hhmm_end is not None:
        clock = part.get("hour", F.lit(0)) * 100 + part.get("minute", F.lit(0))
        lo, hi = hhmm_start if hhmm_start is not None else -1, hhmm_end if hhmm_end is not None else 2359
        tests.append((clock > lo) & (clock <= hi) if lo < hi else (clock > lo) | (clock <= hi))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def split_name(template: str, columns: list[str]) -> Column:
    """The name a row's split has: ``{column}`` in the template replaced by the row's values."""
    pieces = re.split(r"\{([^{}]*)\}", template)
    known = {c: c for c in columns}
    parts = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        else:
            name = piece if piece in known else piece.rsplit(".", 1)[-1]
            parts.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
    return F.concat(*parts)


def distinct_splits(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns]).distinct()


def split(df: DataFrame, columns: list[str], template: str) -> dict[str, DataFrame]:
    """One DataFrame per distinct tuple of ``columns``, by the name the template gives.

    The names are driver values by nature; for many splits write with ``partitionBy`` instead (``split_name`` as column).
    Rows stay in the plan: each split is a filter that is pushed to the source.
    """
    tuples = distinct_splits(df, columns).withColumn("_name", split_name(template, columns)).collect()
    out: dict[str, list[Column]] = {}
    for row in tuples:
        same = [F.col(f"`{c}`").eqNullSafe(F.lit(row[c])) for c in columns]
        out.setdefault(row["_name"], []).append(reduce(lambda a, b: a & b, same))
    return {name: df.filter(reduce(lambda a, b: a | b, tests)) for name, tests in sorted(out.items())}
