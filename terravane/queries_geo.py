"""Queries for spatial sources, joins, measures and grids, and for the task language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.dialect.planner import select
from terravane.functions.mesh import japan_mesh
from terravane.operators import hexagons, spatial
from terravane.session import table
from terravane.sources import spatial as shapes
from terravane.stream import Kind, Stream
from terravane.tdl.interpreter import run_task

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _points(spark: SparkSession, sf: str, default: float | None = None) -> DataFrame:
    once = table(spark, sf, "points").dropDuplicates(["point_id"])
    return shapes.points_from_columns(once, "c1", "c0", "c2", default, ["point_id", "category"])


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.polygons_from_geojson(table(spark, sf, "zones"), "geojson")


_PLACES = """points_once AS (SELECT DISTINCT point_id, c0, c1, c2, category FROM points),
    usable AS (SELECT * FROM points_once WHERE c0 BETWEEN -180 AND 180 AND c1 BETWEEN -90 AND 90 AND NOT isnan(c0) AND NOT isnan(c1) AND NOT (c0 = 0 AND c1 = 0)),
    shapes AS (SELECT zone_id, geojson::JSON AS g FROM zones),
    polygons AS (SELECT zone_id, unnest(CASE WHEN (g->'geometry'->>'type') = 'Polygon' THEN [json_transform((g->'geometry'->'coordinates'), '[[["DOUBLE"]]]')]
        ELSE json_transform((g->'geometry'->'coordinates'), '[[[["DOUBLE"]]]]') END) AS p FROM shapes),
    rings AS (SELECT zone_id, unnest(p) AS r FROM polygons),
    edges AS (SELECT zone_id, unnest(r) AS a, unnest(list_concat(r[2:], r[1:1])) AS b FROM rings),
    inside AS (SELECT point_id, zone_id FROM usable JOIN edges ON ((a[2] > c1) <> (b[2] > c1)) AND a[1] + (c1 - a[2]) * (b[1] - a[1]) / (b[2] - a[2]) > c0
        GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""
_REACH = """reach AS (SELECT point_id, radians(c0) AS x, radians(c1) AS y, CASE WHEN c2 > 0 AND NOT isnan(c2) THEN c2 ELSE 100 END AS r FROM usable),
    pairs AS (SELECT a.point_id AS id_a, b.point_id AS id_b FROM reach a JOIN reach b ON a.point_id < b.point_id
        AND abs(a.y - b.y) <= greatest(a.r, b.r) / 6300000.0
        AND 2 * 6371008.8 * asin(sqrt(least(1, sin((b.y - a.y) / 2) ** 2 + cos(a.y) * cos(b.y) * sin((b.x - a.x) / 2) ** 2))) <= greatest(a.r, b.r))"""
#: The plain statement of p2_found.
NEAR_AND_ZONES = f"""WITH {_PLACES}, {_REACH} SELECT 'near' AS kind, id_a, id_b FROM pairs UNION ALL SELECT 'zone', point_id, zone_id FROM inside"""


@_query("""SELECT point_id::VARCHAR AS point_id, coalesce(category, 'null') AS category, c1::VARCHAR AS "_center_lat" FROM
    (SELECT DISTINCT point_id, c0, c1, category FROM points) WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND abs(c1) > 0.001 AND abs(c1) < 1000""")
def point_source_output(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf).filter((F.abs("lat") > 0.001) & (F.abs("lat") < 1000))
    return shapes.points_to_columns(points, ["point_id", "category", "_center_lat"])


@_query(f"WITH {_PLACES} SELECT zone_id::VARCHAR AS zone, count(*) AS polygons, sum(len(p))::BIGINT AS rings FROM polygons GROUP BY 1")
def polygon_source(spark: SparkSession, sf: str) -> DataFrame:
    return _zones(spark, sf).groupBy(F.col("props")["id"].alias("zone")).agg(F.count(F.lit(1)).alias("polygons"), F.sum(F.size("rings")).alias("rings"))


@_query()
def point_json_source(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of the zones, by way of GeoJSON."""
    points = shapes.points_from_geojson(table(spark, sf, "zones"), "geojson", 250.0)
    return points.select(F.col("props")["id"].alias("zone"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "radius")


@_query()
def polygon_json_output(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.polygons_to_geojson(_zones(spark, sf))


@_query()
def polygon_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = spatial.polygon_stats(_zones(spark, sf))
    return stats.select(F.col("props")["id"].alias("zone"), *[F.round(F.col("props")[c].cast("double"), 1).alias(c[1:]) for c in ("_perimeter", "_area")])


@_query()
def polygon_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.polygon_centroids(_zones(spark, sf)).select(F.col("props")["id"].alias("zone"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@_query(f"WITH {_PLACES} SELECT point_id::VARCHAR AS point, zone_id::VARCHAR AS zone FROM inside")
def area_covers(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = spatial.area_covers(_points(spark, sf), _zones(spark, sf), "zones")
    return hits.select(F.col("props")["point_id"].alias("point"), F.col("props")["zones.id"].alias("zone"))


@_query(f"WITH {_PLACES} SELECT point_id::VARCHAR AS point FROM points_once WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND point_id NOT IN (SELECT point_id FROM inside)")
def area_covers_evicted(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.area_covers(_points(spark, sf), _zones(spark, sf), "zones", once=True)[1].select(F.col("props")["point_id"].alias("point"))


@_query(f"""WITH {_PLACES}, {_REACH}, pois AS (SELECT * FROM reach WHERE r >= 500)
    SELECT s.point_id::VARCHAR AS point, p.point_id::VARCHAR AS poi FROM reach s JOIN pois p ON abs(s.y - p.y) <= p.r / 6300000.0
    AND 2 * 6371008.8 * asin(sqrt(least(1, sin((p.y - s.y) / 2) ** 2 + cos(s.y) * cos(p.y) * sin((p.x - s.x) / 2) ** 2))) <= p.r""")
def proximity_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Points of interest are the places with 500 m and more, a twentieth; proximity_filter_all takes all of them.

    No pair lies within 1 % of its limit, so the sphere of the SQL and the ellipsoid agree.
    """
    points = _points(spark, sf, 100.0)
    hits, _ = spatial.proximity_filter(points, points.filter("radius >= 500"), "pois")
    return hits.select(F.col("props")["point_id"].alias("point"), F.col("props")["pois.point_id"].alias("poi"))


@_query()
def proximity_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest of the points of interest with 500 m and more: were all places such points, each would be its own nearest."""
    points = _points(spark, sf, 100.0)
    hits, _ = spatial.proximity_filter(points, points.filter("radius >= 500"), "pois", once=True)
    return hits.select(F.col("props")["point_id"].alias("point"), F.round(F.col("props")["_distance"].cast("double"), 3).alias("distance"))


def _near_all(spark: SparkSession, sf: str) -> DataFrame:
    reach = F.when((F.col("radius") > 0) & ~F.isnan("radius"), F.col("radius")).otherwise(100.0)
    points = _points(spark, sf).withColumn("radius", reach)
    return spatial.proximity_filter(points, points, "pois")[0].select(
        F.col("props")["point_id"].alias("point"), F.col("props")["pois.point_id"].alias("poi"), F.round(F.col("props")["_distance"].cast("double"), 3).alias("distance")
    )


# Chords of WGS84, as pairs may lie near the smaller of their two limits; at 5 km they are a ten thousandth of a metre short.
@_query(f"""WITH {_PLACES}, {_REACH}, normals AS (SELECT *, 6378137 / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(y) ** 2) AS n FROM reach),
    solid AS (SELECT *, n * cos(y) * cos(x) AS u, n * cos(y) * sin(x) AS v, n * (1 - 0.0066943799901413165::DOUBLE) * sin(y) AS w FROM normals)
    SELECT s.point_id::VARCHAR AS point, p.point_id::VARCHAR AS poi FROM solid s JOIN solid p ON abs(s.y - p.y) <= p.r / 6300000.0
    AND sqrt((s.u - p.u) ** 2 + (s.v - p.v) ** 2 + (s.w - p.w) ** 2) <= p.r""")
def proximity_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every place is a point of interest with its own radius, or 100 m if that is missing or not positive; each is near itself."""
    return _near_all(spark, sf).select("point", "poi")


@_query()
def proximity_distances_all(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of proximity_filter_all with their distance in metres."""
    return _near_all(spark, sf)


_MESH = """lpad((floor(c1 * 1.5)::BIGINT % 100)::VARCHAR, 2, '0') || lpad(floor(c0 - 100)::BIGINT::VARCHAR, 2, '0')"""


def _mesh_sql() -> str:
    """Codes of all six levels, one step of arithmetic for each."""
    height, width, y, x = "(2 / 3.0::DOUBLE)", "1.0::DOUBLE", "y", "x"
    steps, code = [f"l1 AS (SELECT point_id, {_MESH} AS mesh_1, c1 - floor(c1 * 1.5) * {height} AS y1, c0 - (floor(c0 - 100) + 100) AS x1 FROM usable WHERE c0 BETWEEN 100 AND 180 AND c1 BETWEEN 0 AND 66)"], ""
    for level, (rows, columns) in {2: (8, 8), 3: (10, 10), 4: (2, 2), 5: (2, 2), 6: (2, 2)}.items():
        height, width, y, x = f"({height} / {rows})", f"({width} / {columns})", f"y{level - 1}", f"x{level - 1}"
        j, i = f"floor({y} / {height})::BIGINT", f"floor({x} / {width})::BIGINT"
        code = f"{j} || {i}" if level < 4 else f"({j} * 2 + {i} + 1)"
        steps.append(f"l{level} AS (SELECT *, mesh_{level - 1} || {code} AS mesh_{level}, {y} - {j} * {height} AS y{level}, {x} - {i} * {width} AS x{level} FROM l{level - 1})")
    return f"WITH {_PLACES}, {', '.join(steps)} SELECT point_id, {', '.join(f'mesh_{k}' for k in range(1, 7))} FROM l6"


@_query(_mesh_sql())
def japan_mesh_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all levels for the places in the area that the standard covers."""
    once = table(spark, sf, "points").dropDuplicates(["point_id"]).filter("c0 BETWEEN 100 AND 180 AND c1 BETWEEN 0 AND 66 AND NOT isnan(c0) AND NOT isnan(c1)")
    return once.select("point_id", *[japan_mesh(F.col("c1"), F.col("c0"), k).alias(f"mesh_{k}") for k in range(1, 7)])


@_query()
def h3_cells(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "points").dropDuplicates(["point_id"])
    return once.select("point_id", hexagons.cell_column(F.col("c1"), F.col("c0"), 9).alias("cell"))


@_query()
def h3_polygons(spark: SparkSession, sf: str) -> DataFrame:
    rows = hexagons.cell_polygons(h3_cells(spark, sf), "cell", ["point_id"])
    return rows.select(F.col("props")["point_id"].alias("point_id"), F.size(F.col("rings")[0]).alias("corners"), F.round("center_lat", 4).alias("lat"))


@_query()
def h3_point_coverage(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf).filter("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
    return hexagons.uniform_coverage(points, Kind.POINT, 8).select(F.col("props")["point_id"].alias("point_id"), "_hash")


@_query()
def h3_uniform_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """At level 5; the default, 9, has 2,401 times the cells (README)."""
    return hexagons.uniform_coverage(_zones(spark, sf), Kind.POLYGON, 5).select(F.col("props")["id"].alias("zone"), "_hash")


@_query()
def h3_compact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """At levels 2 to 5; the defaults are 1 to 9 (README)."""
    return hexagons.compact_coverage(_zones(spark, sf), 2, 5).select(F.col("props")["id"].alias("zone"), "_hash", "_level", "_parent")


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "track").select("c0", "c2", "c3", "c4", "c5", "c14").filter("c2 BETWEEN -90 AND 90 AND NOT isnan(c2) AND c3 IS NOT NULL AND NOT isnan(c3)")
    return shapes.tracks_from_columns(once.distinct(), "c2", "c3", "c4", "c0", "c14", ["c5"])


_SEGMENTS = """once AS (SELECT DISTINCT c0, c2, c3, c4, c5, coalesce(c14, '') AS t FROM track WHERE c2 BETWEEN -90 AND 90 AND NOT isnan(c2) AND c3 IS NOT NULL AND NOT isnan(c3)),
    marked AS (SELECT *, coalesce(lag(t) OVER w <> t, false)::INT AS new FROM once WINDOW w AS (PARTITION BY c0 ORDER BY c4, t, c2, c3)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY c0 ORDER BY c4, t, c2, c3 ROWS UNBOUNDED PRECEDING)::INT AS seg FROM marked)"""


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, seg, t AS track, count(*) AS points, min(c4)::DOUBLE AS first, max(c4)::DOUBLE AS last FROM numbered GROUP BY ALL")
def track_segments(spark: SparkSession, sf: str) -> DataFrame:
    groups = _tracks(spark, sf).groupBy(F.col("_userid").alias("user"), F.col("seg_ord").alias("seg"), F.col("_track_id").alias("track"))
    return groups.agg(F.count(F.lit(1)).alias("points"), F.min("_ts").alias("first"), F.max("_ts").alias("last"))


@_query(f"""WITH {_SEGMENTS}, s AS (SELECT c0, seg, count(*) AS n, max(c4) - min(c4) AS d FROM numbered GROUP BY ALL)
    SELECT c0 AS user, sum(n)::BIGINT AS points, sum(d)::DOUBLE AS duration FROM s GROUP BY 1""")
def track_stats_counts(spark: SparkSession, sf: str) -> DataFrame:
    stats = spatial.track_stats(_tracks(spark, sf), "TRACK_STARTS")
    props = F.any_value("track_props").alias("p")
    users = stats.groupBy(F.col("_userid").alias("user")).agg(props)
    return users.select("user", F.col("p")["_points"].cast("bigint").alias("points"), F.col("p")["_duration"].cast("double").alias("duration"))


@_query()
def track_stats_measures(spark: SparkSession, sf: str) -> DataFrame:
    stats = spatial.track_stats(_tracks(spark, sf), "SEGMENT_CENTROIDS")
    values = [F.round(F.col("props")[c].cast("double"), 2).alias(c[1:]) for c in ("_distance", "_radius", "_azi_from_prev", "_azi_to_next")]
    return stats.select("_userid", "seg_ord", "pt_ord", *values)


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, count(*) AS n FROM numbered GROUP BY 1")
def track_gpx_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    back = shapes.tracks_from_gpx(shapes.tracks_to_gpx(_tracks(spark, sf)))
    return back.groupBy(F.col("_userid").alias("user")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, c5 AS kind, count(*) AS n FROM numbered GROUP BY 1, 2")
def track_point_output(spark: SparkSession, sf: str) -> DataFrame:
    points = shapes.tracks_to_points(_tracks(spark, sf))
    return points.groupBy(F.col("props")["_userid"].alias("user"), F.col("props")["c5"].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, seg, round(avg(c2) + 3.3e-8, 6) AS lat, round(avg(c3) + 3.3e-8, 6) AS lon FROM numbered GROUP BY 1, 2")
def track_centroids(spark: SparkSession, sf: str) -> DataFrame:
    tracks = _tracks(spark, sf).withColumn("seg_props", F.map_concat("seg_props", F.create_map(F.lit("seg"), F.col("seg_ord").cast("string"))))
    points = spatial.track_centroids(tracks, "SEGMENTS")
    # Positions have seven decimals, so means of two lie on ties of rounding; the small shift moves them off.
    mean = [F.round(F.col(c) + 3.3e-8, 6).alias(c) for c in ("lat", "lon")]
    return points.select(F.col("props")["_userid"].alias("user"), F.col("props")["seg"].cast("int").alias("seg"), *mean)


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, c4::DOUBLE AS ts FROM numbered WHERE c5 IN ('car', 'foot') AND t <> ''")
def spatial_select_points(spark: SparkSession, sf: str) -> DataFrame:
    found = select("SELECT Point FROM tracks WHERE c5 IN ('car', 'foot') AND _track_id != ''", {"tracks": Stream(_tracks(spark, sf), Kind.TRACK)})
    return found.df.select(F.col("_userid").alias("user"), F.col("_ts").alias("ts"))


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, seg, count(*) AS n FROM numbered WHERE regexp_full_match(t, '.*-(car|foot)') GROUP BY 1, 2")
def spatial_select_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = select("SELECT TrackSegment FROM tracks WHERE _track_id MATCH '.*-(car|foot)'", {"tracks": Stream(_tracks(spark, sf), Kind.TRACK)})
    return found.df.groupBy(F.col("_userid").alias("user"), F.col("seg_ord").alias("seg")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_PLACES} SELECT point_id::VARCHAR AS point FROM points_once WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 > 500 AND NOT isnan(c2)")
def spatial_select_radius(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate on a property that every point has of itself."""
    found = select("SELECT Point FROM places WHERE _radius > 500", {"places": Stream(_points(spark, sf), Kind.POINT)})
    return found.df.select(F.col("props")["point_id"].alias("point"))


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, c4::DOUBLE AS ts FROM numbered WHERE c4 % 7 = 3")
def spatial_select_ts(spark: SparkSession, sf: str) -> DataFrame:
    found = select("SELECT Point FROM tracks WHERE _ts % 7 = 3", {"tracks": Stream(_tracks(spark, sf), Kind.TRACK)})
    return found.df.select(F.col("_userid").alias("user"), F.col("_ts").alias("ts"))


@_query("SELECT 'bob' AS user, n_nationkey AS nation, 2 + k AS points, (n_nationkey + 40 * k + 0.5 * (1 + k))::DOUBLE AS lat FROM nation, (VALUES (0), (1)) t(k)")
def gpx_two_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Two tracks of one name in each document stay two tracks."""
    point = lambda lat: F.concat(F.lit('<trkpt lat="'), lat.cast("string"), F.lit('" lon="'), F.col("n_nationkey").cast("string"), F.lit('"/>'))
    track = lambda k: F.concat(F.lit("<trk><name>bob</name><trkseg>"), *[point(F.col("n_nationkey") + 40 * k + i) for i in range(2 + k)], F.lit("</trkseg></trk>"))
    lines = table(spark, sf, "nation").select(F.concat(F.lit("<gpx>"), track(0), track(1), F.lit("</gpx>")).alias("value"))
    found = shapes.tracks_from_gpx(lines).groupBy("_userid", "_trk").agg(F.count(F.lit(1)).cast("int").alias("points"), F.round(F.avg("lat"), 6).alias("lat"), F.max("lon").cast("int").alias("nation"))
    return found.select(F.col("_userid").alias("user"), "nation", "points", "lat")


@_query(f"""WITH {_SEGMENTS}, w AS (SELECT c0, seg, c4, c2, c3, row_number() OVER s AS n, c4 - min(c4) OVER (PARTITION BY c0, seg) AS d FROM numbered WINDOW s AS (PARTITION BY c0, seg ORDER BY c4, c2, c3))
    SELECT c0 AS user, seg, n::BIGINT AS points, d::BIGINT AS duration FROM w""")
def track_stats_running(spark: SparkSession, sf: str) -> DataFrame:
    """Running counts and durations of points within their segments."""
    stats = spatial.track_stats(_tracks(spark, sf), "SEGMENT_STARTS")
    return stats.select(F.col("_userid").alias("user"), F.col("seg_ord").alias("seg"), F.col("props")["_points"].cast("bigint").alias("points"), F.col("props")["_duration"].cast("bigint").alias("duration"))


@_query(f"WITH {_SEGMENTS} SELECT c0 AS user, count(*) AS points FROM numbered WHERE substr(md5(c0), 1, 1) < '8' GROUP BY 1")
def track_stats_pinned(spark: SparkSession, sf: str) -> DataFrame:
    """Pins from a stream of their own; users without one are left out."""
    tracks = _tracks(spark, sf)
    pins = tracks.filter(F.substring(F.md5("_userid"), 1, 1) < "8").groupBy("_userid").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    stats = spatial.track_stats(tracks, "INPUT_PINS", pins).filter(F.col("props")["_radius"].isNotNull())
    return stats.groupBy(F.col("_userid").alias("user")).agg(F.count(F.lit(1)).alias("points"))


@_query()
def road_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Roads along the shells of the zones."""
    road = F.struct(F.lit("LineString").alias("type"), F.transform(F.col("rings")[0], lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    props = F.struct(F.col("props")["id"].alias("name"), F.lit("primary").alias("kind"), F.lit(4).alias("lanes"))
    lines = _zones(spark, sf).select(F.to_json(F.struct(F.lit("Feature").alias("type"), road.alias("geometry"), props.alias("properties"))).alias("value"))
    shaped = shapes.road_polygons(lines, "name", "kind", "lanes", {"primary": 10.0})
    return shaped.select(F.col("props")["name"].alias("name"), F.size(F.col("rings")[0]).alias("corners"), F.round("center_lat", 5).alias("lat"))


@_query()
def eye_views(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "points").dropDuplicates(["point_id"]).filter("c0 BETWEEN -180 AND 180 AND c1 BETWEEN -90 AND 90")
    facing = once.withColumn("azimuth", F.col("point_id") % 360)
    views = shapes.eye_views(shapes.points_from_columns(facing, "c1", "c0", "c2", 100.0, ["point_id", "azimuth"]), "azimuth")
    return views.select(F.col("props")["point_id"].alias("point_id"), F.round("center_lat", 6).alias("lat"), F.size(F.col("rings")[0]).alias("corners"))


_TASK = """
task.input=orders,states
task.operations=$LET{STATES:states},$IF{RICH:yes},rich,$ELSE,nobody,$END,$ITER{STATES},pick,pairs,count,$END,all
task.output=counts*
op.operation.rich=columnarToolbox
op.inputs.rich=orders
op.definition.rich.query=SELECT * FROM orders WHERE o_totalprice > {LIMIT:50000}
op.outputs.rich=dear
op.operation.nobody=nop
op.inputs.nobody=orders
op.outputs.nobody=dear
op.operation.pick=columnarToolbox
op.inputs.pick=dear
op.definition.pick.query=SELECT o_orderpriority, o_orderkey FROM dear WHERE o_orderstatus = '{STATES}'
op.outputs.pick=picked/{STATES}
op.operation.pairs=mapToPair
op.inputs.pairs=picked/{STATES}
op.definition.pairs.key.columns=picked/{STATES}.o_orderpriority
op.outputs.pairs=pairs/{STATES}
op.operation.count=countByKey
op.inputs.count=pairs/{STATES}
op.outputs.count=counts/{STATES}
op.operation.all=columnarToolbox
op.inputs.all=counts*
op.definition.all.query=SELECT * FROM UNION counts *
op.outputs.all=total
"""


@_query("""SELECT o_orderpriority AS _key, count(*) AS _count FROM orders WHERE o_totalprice > 50000 AND o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority, o_orderstatus""")
def task_loop(spark: SparkSession, sf: str) -> DataFrame:
    """A task with a variable from data that a loop runs over, a condition and a union by wildcard."""
    states = table(spark, sf, "orders").select("o_orderstatus").filter("o_orderstatus <> 'O'").distinct()
    streams = run_task(_TASK, spark, streams={"orders": table(spark, sf, "orders"), "states": states})
    return streams["total"].df
