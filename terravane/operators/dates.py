"""Timestamps exploded in their own zone and in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.clock import SECOND, in_zone

PARTS = ["date", "dow_int", "day_int", "month_int", "year_int", "hour_int", "minute_int"]


def _iso(wall: Column, offset: Column, zone: Column) -> Column:
    """ISO text with offset and region, seconds left out only as far as ISO printing does."""
    at = F.timestamp_micros(wall)
    seconds = F.when((wall % (60 * SECOND)) == 0, "").otherwise(F.date_format(at, ":ss"))
    minutes = F.abs(offset) / (60 * SECOND)
    sign = F.when(offset < 0, "-").otherwise("+")
    text = F.when(offset == 0, "Z").otherwise(
        F.concat(sign, F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("int").cast("string"), 2, "0"))
    )
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm"), seconds, text, F.lit("["), zone, F.lit("]"))


def explode_zones(
    df: DataFrame,
    timestamp: str,
    source_zone: str = "GMT",
    destination_zone: str = "GMT",
    source_format: str | None = None,
    destination_format: str | None = None,
    source_zone_column: str | None = None,
    destination_zone_column: str | None = None,
) -> DataFrame:
    """Adds ``_input_<part>`` and ``_output_<part>`` (date, dow_int with 1 = Monday, day_int, ...) and ``_epoch_time``.

    The timestamp is text of ``source_format``, else a number (seconds below 1e11, else milliseconds), else ISO text.
    Its clock at GMT is read as the clock of the source zone and converted to the destination zone; ``_epoch_time`` is
    the second of that clock at GMT. Dates are ISO with offset and region unless ``destination_format`` is given. Text
    that is no timestamp gives nulls.
    """
    text = F.col(f"`{timestamp}`").cast("string")
    number = text.try_cast("double")
    if source_format:
        clock = F.unix_micros(F.try_to_timestamp(text, F.lit(source_format)))
    else:
        scaled = F.when(F.abs(number) < 1e11, number * 1000).otherwise(number)
        clock = F.coalesce((F.floor(scaled) * 1000).cast("bigint"), F.unix_micros(F.try_to_timestamp(text)))
    source = F.col(f"`{source_zone_column}`") if source_zone_column else F.lit(source_zone)
    target = F.col(f"`{destination_zone_column}`") if destination_zone_column else F.lit(destination_zone)
    out = df.withColumn("_clock", clock).withColumns({"_sz": source, "_dz": target})
    out = out.withColumn("_utc", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_clock"), F.col("_sz"))))
    out = out.withColumns({"_wall_input": in_zone(F.col("_utc"), F.col("_sz")), "_wall_output": in_zone(F.col("_utc"), F.col("_dz"))})
    for side, zone in (("input", "_sz"), ("output", "_dz")):
        wall = F.col(f"_wall_{side}")
        at = F.timestamp_micros(wall)
        date = F.date_format(at, destination_format) if destination_format else _iso(wall, wall - F.col("_utc"), F.col(zone))
        values = {
            "date": date, "dow_int": F.weekday(at) + 1, "day_int": F.day(at), "month_int": F.month(at), "year_int": F.year(at),
            "hour_int": F.hour(at), "minute_int": F.minute(at),
        }
        out = out.withColumns({f"_{side}_{k}": v for k, v in values.items()})
    seconds = F.floor(F.col("_clock") / F.lit(SECOND))
    return out.withColumn("_epoch_time", seconds).drop("_clock", "_sz", "_dz", "_utc", "_wall_input", "_wall_output")
