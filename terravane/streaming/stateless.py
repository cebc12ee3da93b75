"""Verbs on unbounded inputs: those without state run unchanged, counts by key get a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.dialect.planner import select
from terravane.stream import KEY, Kind, Stream

#: Verbs whose operators neither aggregate, sort, nor look at other rows.
STATELESS = frozenset(
    "columnarToolbox mapToPair collapsePair digest columnsMath filterByDate timezone h3 japanMesh pointCsvSource pointJsonSource polygonJsonSource polygonH3Source "
    "polygonEyeView polygonStats pointCsvOutput polygonJsonOutput nop".split()
)


def read_lines(spark: SparkSession, path: str, columns: list[str], delimiter: str = "\t", files_per_trigger: int | None = None) -> Stream:
    """Delimited files that keep arriving in a folder, as text columns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.readStream.schema(schema).option("sep", delimiter).option("quote", '"').option("escape", '"')
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return Stream(reader.csv(path), Kind.CSV)


def select_stream(query: str, stream: Stream, statics: dict[str, Stream] | None = None) -> Stream:
    """A filter or projection in the dialect over a stream; IN subqueries may name static streams."""
    return select(query, {stream.name: stream} | (statics or {}), [stream.name, *(statics or {})])


def count_by_key(stream: Stream, event_time: str, window: str, late: str) -> DataFrame:
    """``_key, start, _count`` by event-time window; rows later than ``late`` behind the newest are dropped by design."""
    timed = stream.df.withWatermark(event_time, late)
    counted = timed.groupBy(F.window(event_time, window).alias("w"), KEY).agg(F.count(F.lit(1)).alias("_count"))
    return counted.select(KEY, F.col("w.start").alias("start"), "_count")


def run_batches(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Processes all that has arrived and stops; with the same ``checkpoint`` the next call goes on where this one ended."""
    df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
