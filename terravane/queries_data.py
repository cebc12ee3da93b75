"""Queries p1 to p5: rows that fail to parse, nearness, instants, hot keys, trips. Tables marked D are read once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import hotkeys, instants, nearby, rejects, trips
from terravane.queries_geo import NEAR_AND_ZONES
from terravane.session import cut_lineage, table

TEST_DATA = [
    rejects.Field("ts", "int64"),
    rejects.Field("match", "int64"),
    rejects.Field("userid", "uuid"),
    rejects.Field("lat", "decimal", 90),
    rejects.Field("lon", "decimal", 180),
]
FOO = [
    rejects.Field("period", "text"),
    rejects.Field("catid", "int64"),
    rejects.Field("userid", "uuid"),
    rejects.Field("count", "int64"),
    rejects.Field("sum", "decimal"),
    *[rejects.Field(f"m{i}", "decimal") for i in range(1, 21)],
]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name, fields in (("test_data", TEST_DATA), ("foo", FOO)):
        bad = rejects.parse_lines(table(spark, sf, name).select("line_id", "c0"), "c0", fields).rejects()
        parts.append(bad.select(F.lit(name).alias("tab"), "line_id", F.col("_reason").alias("reason")))
    return parts[0].unionByName(parts[1]).distinct()


def p1_valid_test_data(spark: SparkSession, sf: str) -> DataFrame:
    good = rejects.parse_lines(table(spark, sf, "test_data").select("line_id", "c0"), "c0", TEST_DATA).valid()
    return good.drop("c0").dropDuplicates(["line_id"])


def p1_valid_foo(spark: SparkSession, sf: str) -> DataFrame:
    good = rejects.parse_lines(table(spark, sf, "foo").select("line_id", "c0"), "c0", FOO).valid()
    return good.drop("c0").dropDuplicates(["line_id"])


def _points(spark: SparkSession, sf: str) -> DataFrame:
    # Both joins count their hot cells first; they need not remove repeated rows each time anew.
    return cut_lineage(hotkeys.deliver_once(table(spark, sf, "points").select("point_id", "c0", "c1", "c2"), ["point_id"]))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    near = nearby.near_pairs(points, "point_id", "c0", "c1", "c2").select(F.lit("near").alias("kind"), "id_a", "id_b")
    zones = nearby.containing_zones(points, "point_id", "c0", "c1", table(spark, sf, "zones"), "zone_id", "geojson")
    return near.unionByName(zones.select(F.lit("zone").alias("kind"), F.col("point").alias("id_a"), F.col("zone").alias("id_b")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Instants of all records that determine one. Texts with a zone nowhere, neither their own nor ``source_tz``, are
    converted by the offset history estimated for their clock from load times; without evidence they are GMT."""
    columns = ["rec_id", "_input_date", "source_tz", "_epoch_time", "_output_date", "dest_tz", "loaded_at"]
    once = hotkeys.deliver_once(table(spark, sf, "timezone_operation").select(*columns), ["rec_id"])
    bare = F.when(F.coalesce(F.trim("source_tz"), F.lit("")) == "", F.lit("none"))
    guessed = instants.with_estimated_offsets(once.withColumn("clock", bare), "clock", "_input_date", "loaded_at").fillna({"_estimated_us": 0})
    done = instants.normalise_instants(guessed, "_input_date", "source_tz", "_epoch_time", "_output_date", "dest_tz", "_estimated_us")
    return done.filter(F.col("_utc_us").isNotNull()).select("rec_id", F.col("_utc_us").alias("utc_us"))


def _clocked(spark: SparkSession, sf: str) -> DataFrame:
    """Records once, with the clock behind each source_tz (only told apart by its name); those without any share one."""
    columns = ["rec_id", "_input_date", "source_tz", "_epoch_time", "_output_date", "dest_tz", "loaded_at"]
    once = hotkeys.deliver_once(table(spark, sf, "timezone_operation").select(*columns), ["rec_id"])
    return once.withColumn("clock", F.coalesce(F.nullif(F.lower(F.trim("source_tz")), F.lit("")), F.lit("none")))


def p3_offset_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets by hour of the local clock estimated from ingestion alone, for all clocks of zoneless texts."""
    walls = instants.with_zoneless_wall(_clocked(spark, sf), F.col("_input_date"))
    return instants.offset_histories(walls, "clock", "_wall_us", "loaded_at")


def p3_estimated_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Zoneless texts converted with the estimated offsets of their clocks, as if no zone were stated anywhere."""
    # Written once: planning a filter on the estimate down through the reading of the texts takes the optimiser a minute.
    guessed = cut_lineage(instants.with_estimated_offsets(_clocked(spark, sf), "clock", "_input_date", "loaded_at"))
    bare = guessed.filter(F.col("_estimated_us").isNotNull()).withColumn("source_tz", F.lit(None).cast("string"))
    done = instants.normalise_instants(bare, "_input_date", "source_tz", "_epoch_time", "_output_date", "dest_tz", "_estimated_us")
    return done.select("rec_id", F.col("_utc_us").alias("utc_us"), F.col("_estimated_us").alias("offset_us"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "parametric_score_operation").select("row_id", "_group", "_value", "hour")
    return hotkeys.deliver_once(rows, ["row_id"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    best = hotkeys.parametric_score(_scored(spark, sf), table(spark, sf, "multipliers"), "_group", "_value", "hour", "hour", "mult")
    return best.select("_group", "_value_1")


def p4_top3(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.parametric_score(_scored(spark, sf), table(spark, sf, "multipliers"), "_group", "_value", "hour", "hour", "mult", 3)


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.percentiles(_scored(spark, sf), "_group", "hour", [0.1, 0.5, 0.9])


def p4_distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.distinct_counts(_scored(spark, sf), "_group", "_value")


def p4_modes(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.modes(_scored(spark, sf), "_group", "_value")


def _movements(spark: SparkSession, sf: str) -> DataFrame:
    return trips.stops_and_trips(table(spark, sf, "track"), "c0", "c4", "c2", "c3", "c7")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _movements(spark, sf).select("kind", F.col("user").alias("c0"), "start_ts", "end_ts")


def p5_movements(spark: SparkSession, sf: str) -> DataFrame:
    """Stops and trips with duration, distance and place, metres rounded."""
    moved = _movements(spark, sf)
    return moved.withColumn("distance_m", F.round("distance_m", 1)).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_valid_test_data, p1_valid_foo, p2_found, p3_found, p3_offset_histories, p3_estimated_instants,
        p4_found, p4_top3, p4_percentiles, p4_distinct_values, p4_modes, p5_found, p5_movements,
    )
}

_QUOTED = '"(?:[^"]|"")*"[ \\t]*'
_FIELD = f'(?:{_QUOTED}|[^",]*)'
_INT, _DEC = "[+-]?[0-9]+", "[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_HEX = "-".join("[0-9a-fA-F]{%d}" % n for n in (8, 4, 4, 4, 12))


def _either(pattern: str) -> str:
    return f'(?:[ \\t]*(?:{pattern})[ \\t]*|"(?:{pattern})"[ \\t]*)'


def _typed(fields: list[rejects.Field]) -> str:
    kinds = {"int64": _either(_INT), "decimal": _either(_DEC), "uuid": _either(_HEX), "text": _FIELD}
    return ",".join(kinds[f.kind] for f in fields)


def _reasons(name: str, fields: list[rejects.Field]) -> str:
    """One regular expression per reason, the plainest statement of the rules."""
    commas = f"{_FIELD}(?:,{_FIELD}){{{len(fields) - 1}}}"
    bare = lambda i: f"""try_cast(trim(regexp_extract(line, '^(?:{_FIELD},){{{i}}}({_FIELD})', 1), ' "' || chr(9))"""
    ranges = [f"{bare(i)} AS BIGINT) IS NULL" for i, f in enumerate(fields) if f.kind == "int64"]
    ranges += [f"coalesce(abs({bare(i)} AS DOUBLE)) <= {f.limit or 1.7976931348623157e308}, false) = false" for i, f in enumerate(fields) if f.kind == "decimal"]
    return f"""
        SELECT DISTINCT '{name}' AS tab, line_id, CASE
            WHEN NOT regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') THEN 'quoting'
            WHEN NOT regexp_full_match(line, '{commas}') THEN 'column_count'
            ELSE 'invalid_value' END AS reason
        FROM (SELECT line_id, regexp_replace(coalesce(c0, ''), '\\r$', '') AS line FROM {name})
        WHERE NOT regexp_full_match(line, '{_typed(fields)}') OR {' OR '.join(ranges)}"""


_P4 = """WITH once AS (SELECT DISTINCT row_id, _group, _value, hour FROM parametric_score_operation)"""
_SCORES = """, scores AS (SELECT _group, _value, sum(mult) AS score FROM once JOIN multipliers USING (hour)
    WHERE _group IS NOT NULL AND _value <> '' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY _group ORDER BY score DESC, encode(_value)) AS place FROM scores)"""

ORACLES = {
    "p1_found": _reasons("test_data", TEST_DATA) + " UNION ALL " + _reasons("foo", FOO),
    "p2_found": NEAR_AND_ZONES,
    "p4_found": f"{_P4}{_SCORES} SELECT _group, _value AS _value_1 FROM ranked WHERE place = 1",
    "p4_top3": f"""{_P4}{_SCORES} SELECT _group, {', '.join(
        f"max(CASE WHEN place = {i} THEN score END) AS _score_{i}, max(CASE WHEN place = {i} THEN _value END) AS _value_{i}" for i in (1, 2, 3))}
        FROM ranked GROUP BY _group""",
    "p4_percentiles": f"""{_P4} SELECT _group, {', '.join(
        f"quantile_disc(hour, {p}) AS _p{i + 1}" for i, p in enumerate((0.1, 0.5, 0.9)))} FROM once WHERE hour IS NOT NULL GROUP BY _group""",
    "p4_distinct_values": f"{_P4} SELECT _group, count(*) AS _rows, count(DISTINCT _value) AS _values FROM once GROUP BY _group",
    "p4_modes": f"""{_P4}, counts AS (SELECT _group, _value, count(*) AS n FROM once WHERE _value IS NOT NULL GROUP BY ALL)
        SELECT _group, _value AS _mode, n AS _n FROM (SELECT *, row_number() OVER (PARTITION BY _group ORDER BY n DESC, encode(_value)) AS place FROM counts) WHERE place = 1""",
}
