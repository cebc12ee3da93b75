"""The verbs of the task language, bound to the operators."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.dialect.planner import select
from terravane.functions.mesh import japan_mesh
from terravane.operators import dates, filters, hexagons, hotkeys, maths, pairs, populations, spatial
from terravane.operators.maths import number
from terravane.registry import Call, OperationError, Param, bare, operation
from terravane.sources import spatial as shapes
from terravane.stream import KEY, Kind, Stream

Streams = dict


def _need(name: str, kind: str = "column", **more: object) -> Param:
    return Param(name, kind, required=True, **more)


def _csv(df: DataFrame, kind: Kind = Kind.CSV) -> Streams:
    return {0: Stream(df, kind)}


# Columns


@operation("columnarToolbox", _need("query", "str"))
def columnar_toolbox(call: Call) -> Streams:
    """SELECT over rows and pairs: filters, expressions, joins, unions and subqueries."""
    streams = {s.name: s for s in call.inputs}
    return {0: select(call["query"], streams, [s.name for s in call.inputs])}


@operation("spatialToolbox", _need("query", "str"))
def spatial_toolbox(call: Call) -> Streams:
    """SELECT of points, polygons, segments or tracks by their properties."""
    return {0: select(call["query"], {s.name: s for s in call.inputs}, [s.name for s in call.inputs])}


@operation(
    "mapToPair", _need("key.columns", "columns"), Param("value.columns", "columns"), Param("key.length", "int", -1), Param("key.digest")
)
def map_to_pair(call: Call) -> Streams:
    """Pairs with a key made of columns, cut or digested."""
    s = call.stream()
    delimiter = call.delimiters.get(call.outputs[0], ",") if call.outputs else ","
    df = pairs.map_to_pair(s.df, call.columns("key.columns"), call.columns("value.columns"), delimiter, call["key.length"], call["key.digest"])
    return {0: Stream(df, Kind.KV)}


@operation("collapsePair")
def collapse_pair(call: Call) -> Streams:
    """Rows of pairs: key and value, or the value's columns that the output names."""
    s = call.stream()
    wanted = [bare(c, s) for c in call.output_columns.get(call.outputs[0], [])] if call.outputs else []
    return _csv(pairs.collapse_pair(s.df, [c for c in wanted if c in s.df.columns] or None))


@operation("countByKey")
def count_by_key(call: Call) -> Streams:
    """Pairs of key and number of values."""
    return {0: Stream(pairs.count_by_key(call.stream().df), Kind.KV)}


@operation("distinct", Param("unique.column", "column"))
def distinct(call: Call) -> Streams:
    """Distinct values of a column, rows or pairs."""
    s = call.stream()
    return {0: Stream(pairs.distinct_rows(s.df, call.column("unique.column")), s.kind)}


@operation("subtract", Param("minuend.column", "column"), Param("subtrahend.column", "column"))
def subtract(call: Call) -> Streams:
    """Rows of the minuend that the subtrahend lacks: by column, by key or whole."""
    if len(call.inputs) != 2:
        raise OperationError("subtract needs a minuend and a subtrahend")
    a, b = call.inputs
    left, right = call.column("minuend.column", a), call.column("subtrahend.column", b)
    if a.kind is Kind.KV and left is None:
        left, right = KEY, KEY if b.kind is Kind.KV else right
    return {0: Stream(pairs.subtract(a.df, b.df, [left] if left else None, [right] if right else None), a.kind)}


@operation("nop")
def nop(call: Call) -> Streams:
    """Streams under other names, in order."""
    if len(call.inputs) != len(call.outputs):
        raise OperationError("nop needs as many outputs as inputs")
    return dict(enumerate(call.inputs))


@operation("digest")
def digest(call: Call) -> Streams:
    """Digests named by the output's columns: ``_PROVIDER_ALGORITHM_column``, or ``_PROVIDER_ALGORITHM_{a,b}`` of several."""
    s = call.stream()
    df = s.df
    for reference in call.output_columns.get(call.outputs[0], []):
        if reference.startswith("_") and reference not in df.columns:
            head, _, tail = reference.partition("_{") if "_{" in reference else _digest_parts(reference, s)
            columns = [bare(c.strip(), s) for c in tail.rstrip("}").split(",")]
            df = df.withColumn(reference, pairs.digest_columns(columns, head))
    return _csv(df)


def _digest_parts(reference: str, s: Stream) -> tuple[str, str, str]:
    """The longest ending of the reference that is a column, and the algorithm before it."""
    ends = [c for c in [*s.df.columns, *[f"{s.name}.{c}" for c in s.df.columns]] if reference.endswith(f"_{c}")]
    if not ends:
        raise OperationError(f"{reference} names no column")
    column = max(ends, key=len)
    return reference[: -len(column) - 1], "_", column


@operation("splitByColumn", _need("split.column"), _need("split.template", "str"), outputs=("template", "distinct_splits"))
def split_by_column(call: Call) -> Streams:
    """One stream for each value of a column."""
    return _split(call, [call.column("split.column")])


_PARTS = ("year", "month", "date", "dow", "hour", "minute")


@operation("splitByDate", *[Param(f"{p}.column", "column") for p in _PARTS], _need("split.template", "str"), outputs=("template", "distinct_splits"))
def split_by_date(call: Call) -> Streams:
    """One stream for each tuple of date parts."""
    columns = [c for p in _PARTS if (c := call.column(f"{p}.column"))]
    if not columns:
        raise OperationError("splitByDate needs at least one column")
    return _split(call, columns)


def _split(call: Call, columns: list[str]) -> Streams:
    s = call.stream()
    pattern = call.output_slots.get("template", "*")
    template = pattern.replace("*", call["split.template"])
    out: Streams = {f"={name}": Stream(df, s.kind) for name, df in filters.split(s.df, columns, template).items()}
    if "distinct_splits" in call.output_slots:
        out["distinct_splits"] = Stream(filters.distinct_splits(s.df, columns), Kind.FIXED)
    return out


# Math and populations


@operation(
    "keyedMath", _need("calc.function", "str", choices=tuple(maths.KEYED)), Param("calc.column", "column"), Param("calc.const", "float"),
    Param("minimax.full", "bool", False), Param("order.column", "column", doc="the order of rows for SUBTRACT, DIV and EQUALITY"),
)
def keyed_math(call: Call) -> Streams:
    """A function of the values of each key."""
    df = maths.keyed_math(call.stream().df, call["calc.function"], call.column("calc.column"), call["calc.const"], call["minimax.full"], call.column("order.column"))
    return {0: Stream(df, Kind.KV)}


@operation("columnsMath", _need("calc.columns", "columns"), _need("calc.function", "str", choices=tuple(maths.BY_ROW)), Param("calc.const", "float"))
def columns_math(call: Call) -> Streams:
    """A function of several columns of each row, as ``_result``."""
    return _csv(maths.columns_math(call.stream().df, call["calc.function"], call.columns("calc.columns"), call["calc.const"]))


@operation("seriesMath", _need("calc.column"), _need("calc.function", "str", choices=("STDDEV", "NORMALIZE")), Param("calc.const", "float", 100.0))
def series_math(call: Call) -> Streams:
    """Each value against the whole series, as ``_result``."""
    return _csv(maths.series_math(call.stream().df, call["calc.function"], call.column("calc.column"), call["calc.const"]))


@operation("weightedSum", _need("count.col"), _need("value.col"), _need("payload.cols", "columns"), Param("default.cols", "columns"), Param("default.delimiter"))
def weighted_sum(call: Call) -> Streams:
    """Sums weighted by counts over several inputs, by payload."""
    last = lambda r: r.rsplit(".", 1)[-1]
    names = [last(c) for c in call["payload.cols"]]
    inputs = []
    for s in call.inputs:
        unnamed = call["default.cols"] and all(c.startswith("_") and c.endswith("_") for c in s.df.columns)
        inputs.append(s.df.toDF(*[last(c) for c in call["default.cols"]]) if unnamed else s.df)
    return _csv(maths.weighted_sum(inputs, names, last(str(call["count.col"])), last(str(call["value.col"]))), Kind.FIXED)


@operation("countUniques", _need("count.column"), _need("value.column"))
def count_uniques(call: Call) -> Streams:
    """Distinct values by group."""
    return _csv(populations.count_uniques(call.stream().df, call.column("count.column"), call.column("value.column")), Kind.FIXED)


_TARGETS = (_need("signals.userid.column"), _need("target_signals.userid.column"), _need("target_signals.grouping.column"))


@operation("reach", *_TARGETS, inputs=("signals", "target_signals"))
def reach(call: Call) -> Streams:
    """Share of all users that each group reaches."""
    return _csv(populations.reach(*_target(call)), Kind.FIXED)


@operation("dwellTime", *_TARGETS, inputs=("signals", "target_signals"))
def dwell_time(call: Call) -> Streams:
    """Mean share of their signals that a group's users spend in it."""
    return _csv(populations.dwell_time(*_target(call)), Kind.FIXED)


def _target(call: Call) -> tuple:
    a, b = call.stream("signals"), call.stream("target_signals")
    return a.df, call.column("signals.userid.column", a), b.df, call.column("target_signals.userid.column", b), call.column("target_signals.grouping.column", b)


@operation("frequency", _need("value.column"), _need("count.column"))
def frequency(call: Call) -> Streams:
    """Median share by counted value."""
    return _csv(populations.frequency(call.stream().df, call.column("value.column"), call.column("count.column")), Kind.FIXED)


@operation(
    "parametricScore", _need("values.group.column"), _need("values.value.column"), _need("values.count.column"), _need("multipliers.count.column"), _need("multipliers.value.column"),
    Param("top.scores", "int", 1), inputs=("values", "multipliers"), outputs=("scores",),
)
def parametric_score(call: Call) -> Streams:
    """The values with the greatest sums of multipliers, by group."""
    v, m = call.stream("values"), call.stream("multipliers")
    df = hotkeys.parametric_score(
        v.df, m.df, call.column("values.group.column", v), call.column("values.value.column", v), call.column("values.count.column", v),
        call.column("multipliers.count.column", m), call.column("multipliers.value.column", m), call["top.scores"],
    )
    return {"scores": Stream(df, Kind.FIXED)}


@operation("percentRankInc", Param("value.column", "column"))
def percent_rank(call: Call) -> Streams:
    """Percent ranks of values, over all rows or by key."""
    s = call.stream()
    keyed = s.kind is Kind.KV
    column = call.column("value.column") or next(c for c in s.df.columns if c != KEY)
    return {0: Stream(populations.percent_rank(s.df, column, keyed), Kind.KV if keyed else Kind.FIXED)}


@operation("percentileFilter", _need("filtering.column"), Param("percentile.top", "int", -1), Param("percentile.bottom", "int", -1))
def percentile_filter(call: Call) -> Streams:
    """Rows between two percentiles of a column."""
    return _csv(populations.percentile_filter(call.stream().df, call.column("filtering.column"), call["percentile.top"], call["percentile.bottom"]))


@operation("splitMatch", _need("source.match.column"), _need("values.match.column"), inputs=("source", "values"), outputs=("matched", "evicted"))
def split_match(call: Call) -> Streams:
    """Rows with and without a partner in a list of values."""
    a, b = call.stream("source"), call.stream("values")
    wanted = [r for slot in ("matched", "evicted") for r in call.output_columns.get(call.output_slots.get(slot, ""), [])]
    take = list(dict.fromkeys(bare(r, b) for r in wanted if r.startswith(f"{b.name}.")))
    matched, evicted = filters.split_match(a.df, call.column("source.match.column", a), b.df, call.column("values.match.column", b), take)
    rename = {f"values.{c}": f"{b.name}.{c}" for c in take}
    return {"matched": Stream(matched.withColumnsRenamed(rename), a.kind), "evicted": Stream(evicted.withColumnsRenamed(rename), a.kind)}


# Dates


@operation(
    "filterByDate", *[Param(f"{p}.column", "column") for p in _PARTS], Param("start"), Param("end"),
    *[Param(f"{p}.value", "list") for p in ("year", "month", "date", "dow")], Param("hhmm.start", "int"), Param("hhmm.end", "int"),
)
def filter_by_date(call: Call) -> Streams:
    """Rows by their exploded date parts."""
    columns = {p: c for p in _PARTS if (c := call.column(f"{p}.column"))}
    allowed = {p: call[f"{p}.value"] for p in ("year", "month", "date", "dow") if call[f"{p}.value"]}
    s = call.stream()
    df = filters.filter_by_date(s.df, columns, call["start"], call["end"], allowed, call["hhmm.start"], call["hhmm.end"])
    return {0: Stream(df, s.kind)}


@operation(
    "timezone", _need("source.timestamp.column"), Param("source.timestamp.format"), Param("source.timezone.column", "column"),
    Param("source.timezone.default", default="GMT"), Param("destination.timestamp.format"), Param("destination.timezone.column", "column"),
    Param("destination.timezone.default", default="GMT"),
)
def timezone(call: Call) -> Streams:
    """Timestamps exploded in their own and in another zone."""
    df = dates.explode_zones(
        call.stream().df, call.column("source.timestamp.column"), call["source.timezone.default"], call["destination.timezone.default"],
        call["source.timestamp.format"], call["destination.timestamp.format"], call.column("source.timezone.column"), call.column("destination.timezone.column"),
    )
    return _csv(df)


# Geo


@operation("h3", _need("lat.column"), _need("lon.column"), Param("hash.level", "int", 9))
def h3(call: Call) -> Streams:
    """The hexagonal cell of each row, as ``_hash``."""
    df = call.stream().df
    return _csv(df.withColumn("_hash", hexagons.cell_column(number(df, call.column("lat.column")), number(df, call.column("lon.column")), call["hash.level"])))


@operation("japanMesh", _need("lat.column"), _need("lon.column"), Param("hash.level", "int", 6))
def mesh(call: Call) -> Streams:
    """The Japanese grid square of each row, as ``_hash``."""
    df = call.stream().df
    return _csv(df.withColumn("_hash", japan_mesh(number(df, call.column("lat.column")), number(df, call.column("lon.column")), call["hash.level"])))


@operation("h3UniformCoverage", Param("hash.level", "int", 9))
def uniform_coverage(call: Call) -> Streams:
    """Cells of one level that cover points (with their radius) or polygons, with the properties that the output names."""
    s = call.stream()
    return _csv(_with_props(hexagons.uniform_coverage(s.df, s.kind, call["hash.level"]), call, s))


@operation("h3CompactCoverage", Param("hash.level.from", "int", 1), Param("hash.level.to", "int", 9))
def compact_coverage(call: Call) -> Streams:
    """Cells of several levels that cover polygons, coarse ones inside, with ``_level`` and ``_parent``."""
    s = call.stream()
    return _csv(_with_props(hexagons.compact_coverage(s.df, call["hash.level.from"], call["hash.level.to"]), call, s))


def _with_props(df: DataFrame, call: Call, s: Stream) -> DataFrame:
    wanted = [bare(r, s) for r in call.output_columns.get(call.outputs[0], [])] if call.outputs else []
    extra = [c for c in wanted if c not in df.columns]
    return df.select(*[c for c in df.columns if c != "props"], *[F.col("props")[c].alias(c) for c in extra])


@operation("pointCsvSource", _need("lat.column"), _need("lon.column"), Param("radius.column", "column"), Param("radius.default", "float"))
def point_csv_source(call: Call) -> Streams:
    """Points from columns."""
    s = call.stream()
    keep = [bare(r, s) for r in call.output_columns.get(call.outputs[0], []) if bare(r, s) in s.df.columns] if call.outputs else None
    return {0: Stream(shapes.points_from_columns(s.df, call.column("lat.column"), call.column("lon.column"), call.column("radius.column"), call["radius.default"], keep), Kind.POINT)}


def _line(s: Stream) -> str:
    return s.df.columns[0]


def _kept(call: Call) -> list[str]:
    """Names of the properties that the output's columns ask for, without the output's name; none: all of them."""
    out = call.outputs[0] if call.outputs else ""
    return [str(c).removeprefix(f"{out}.") for c in call.output_columns.get(out, [])]


@operation("pointJsonSource", Param("radius.default", "float"))
def point_json_source(call: Call) -> Streams:
    """Points from GeoJSON lines, polygons by their centroids."""
    s = call.stream()
    return {0: Stream(shapes.points_from_geojson(s.df, _line(s), call["radius.default"], _kept(call)), Kind.POINT)}


@operation("polygonJsonSource")
def polygon_json_source(call: Call) -> Streams:
    """Polygons from GeoJSON lines."""
    s = call.stream()
    return {0: Stream(shapes.polygons_from_geojson(s.df, _line(s), _kept(call)), Kind.POLYGON)}


@operation("polygonH3Source", _need("hash.column"))
def polygon_h3_source(call: Call) -> Streams:
    """Polygons from the outlines of hexagonal cells."""
    s = call.stream()
    keep = [bare(r, s) for r in call.output_columns.get(call.outputs[0], []) if bare(r, s) in s.df.columns] if call.outputs else []
    return {0: Stream(hexagons.cell_polygons(s.df, call.column("hash.column"), keep), Kind.POLYGON)}


@operation(
    "polygonRoadMap", _need("name.col", "str"), _need("type.col", "str"), _need("width.col", "str"),
    Param("road.types", "list", ["primary", "secondary", "tertiary"]), Param("type.multiplier.", "float"),
)
def polygon_road_map(call: Call) -> Streams:
    """Polygons along roads."""
    s = call.stream()
    given = call.any("type.multiplier.")
    factors = {t: float(given.get(t, 1.0)) for t in call["road.types"]}
    names = [bare(str(call[p]), s) for p in ("name.col", "type.col", "width.col")]
    return {0: Stream(shapes.road_polygons(s.df, *names, factors, _line(s)), Kind.POLYGON)}


@operation("trackCsvSource", _need("lat.column"), _need("lon.column"), _need("ts.column"), _need("userid.column"), Param("trackid.column", "column"))
def track_csv_source(call: Call) -> Streams:
    """Tracks from columns."""
    s = call.stream()
    keep = [bare(r, s) for r in call.output_columns.get(call.outputs[0], []) if bare(r, s) in s.df.columns] if call.outputs else None
    names = [call.column(f"{p}.column") for p in ("lat", "lon", "ts", "userid", "trackid")]
    return {0: Stream(shapes.tracks_from_columns(s.df, *names, keep), Kind.TRACK)}


@operation("trackGpxSource")
def track_gpx_source(call: Call) -> Streams:
    """Tracks from GPX lines."""
    s = call.stream()
    return {0: Stream(shapes.tracks_from_gpx(s.df, _line(s)), Kind.TRACK)}


@operation("trackGpxOutput")
def track_gpx_output(call: Call) -> Streams:
    """GPX lines of tracks."""
    return {0: Stream(shapes.tracks_to_gpx(call.stream().df), Kind.PLAIN)}


@operation("trackPointOutput")
def track_point_output(call: Call) -> Streams:
    """Points of tracks with the properties of all levels."""
    return {0: Stream(shapes.tracks_to_points(call.stream().df), Kind.POINT)}


@operation("pointCsvOutput")
def point_csv_output(call: Call) -> Streams:
    """Properties of points as columns."""
    s = call.stream()
    return _csv(shapes.points_to_columns(s.df, [bare(r, s) for r in call.output_columns.get(call.outputs[0], [])]))


@operation("polygonJsonOutput")
def polygon_json_output(call: Call) -> Streams:
    """GeoJSON lines of polygons."""
    return {0: Stream(shapes.polygons_to_geojson(call.stream().df), Kind.PLAIN)}


@operation("spatialCentroid", Param("tracks.mode", default="BOTH", choices=("SEGMENTS", "TRACKS", "BOTH")))
def spatial_centroid(call: Call) -> Streams:
    """Centroids of polygons or tracks."""
    s = call.stream()
    df = spatial.track_centroids(s.df, call["tracks.mode"]) if s.kind is Kind.TRACK else spatial.polygon_centroids(s.df)
    return {0: Stream(df, Kind.POINT)}


@operation("polygonStats")
def polygon_stats(call: Call) -> Streams:
    """Perimeter and area of polygons."""
    return {0: Stream(spatial.polygon_stats(call.stream().df), Kind.POLYGON)}


@operation("trackStats", Param("pinning.mode", default="INPUT_PINS", choices=tuple(spatial.PINNING)), inputs=("tracks", "pins"), outputs=("tracks",))
def track_stats(call: Call) -> Streams:
    """Durations, distances, radii and azimuths of tracks."""
    pins = None
    if "pins" in call.slots:
        p = call.slots["pins"].df
        pins = p.select(F.col("props")["_userid"].alias("_userid"), "lat", "lon") if "props" in p.columns else p
    return {"tracks": Stream(spatial.track_stats(call.stream("tracks").df, call["pinning.mode"], pins), Kind.TRACK)}


@operation("polygonEyeView", _need("pois.azimuth.col", "column"), Param("pois.angle.col", "column"), Param("angle.default", "float", 110.0))
def polygon_eye_view(call: Call) -> Streams:
    """Viewing sectors of points."""
    return {0: Stream(shapes.eye_views(call.stream().df, call.column("pois.azimuth.col"), call.column("pois.angle.col"), call["angle.default"]), Kind.POLYGON)}


@operation("areaCovers", Param("encounter.once", "bool", False), inputs=("signals", "geometries"), outputs=("signals", "signals_evicted"))
def area_covers(call: Call) -> Streams:
    """Points inside polygons, and the others."""
    a, b = call.stream("signals"), call.stream("geometries")
    inside, others = spatial.area_covers(a.df, b.df, b.name, call["encounter.once"])
    return {"signals": Stream(inside, Kind.POINT), "signals_evicted": Stream(others, Kind.POINT)}


@operation("proximityFilter", Param("encounter.once", "bool", False), inputs=("signals", "pois"), outputs=("signals", "signals_evicted"))
def proximity_filter(call: Call) -> Streams:
    """Points within the radius of points of interest, and the others."""
    a, b = call.stream("signals"), call.stream("pois")
    near, others = spatial.proximity_filter(a.df, b.df, b.name, call["encounter.once"])
    return {"signals": Stream(near, Kind.POINT), "signals_evicted": Stream(others, Kind.POINT)}


