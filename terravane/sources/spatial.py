"""Points, polygons and tracks from columns and GeoJSON or GPX lines, and back."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.functions import geodesic
from terravane.operators.maths import number
from terravane.stream import POINT_COLUMNS, POLYGON_COLUMNS, TRACK_COLUMNS

GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"struct<geometry:{GEOMETRY},properties:map<string,string>>"
DOCUMENT = f"struct<type:string,geometry:{GEOMETRY},properties:map<string,string>,features:array<{FEATURE}>>"
RINGS = "array<array<struct<lon:double,lat:double>>>"


def text_map(df: DataFrame, columns: list[str]) -> Column:
    """A map of the columns' values as text; nulls are left out."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    full = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def points_from_columns(
    df: DataFrame, lat: str, lon: str, radius: str | None = None, default_radius: float | None = None, keep: list[str] | None = None
) -> DataFrame:
    """POINT rows; the radius is that of the column, else the default. Rows without a numeric position are left out."""
    r = number(df, radius) if radius else F.lit(None).cast("double")
    if default_radius is not None:
        r = F.coalesce(r, F.lit(float(default_radius)))
    out = df.select(number(df, lat).alias("lat"), number(df, lon).alias("lon"), r.alias("radius"), text_map(df, keep or df.columns).alias("props"))
    return out.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def _features(lines: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """``kind, coordinates, props`` of every feature, of the properties only those to ``keep`` if any are named; lines
    that are no GeoJSON give none."""
    wanted = (lambda k, v: v.isNotNull() & k.isin(*keep)) if keep else (lambda _, v: v.isNotNull())
    doc = F.from_json(F.col(f"`{column}`"), DOCUMENT)
    one = F.array(F.struct(F.col("d.geometry").alias("geometry"), F.col("d.properties").alias("properties")))
    rows = lines.select(doc.alias("d")).select(F.explode(F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(one)).alias("f"))
    return rows.select(
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"),
        F.map_filter(F.coalesce(F.col("f.properties"), F.create_map().cast("map<string,string>")), wanted).alias("props"),
    ).filter(F.col("kind").isNotNull())


def _rings(coordinates: Column) -> Column:
    """Rings as structs, from nested [lon, lat] arrays."""
    return F.transform(coordinates, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))


def flat_rings(rings: str = "rings") -> tuple[Column, Column, Column]:
    """Longitudes and latitudes of all points, and the size of each ring: what pandas UDFs can take of ragged rings."""
    axis = lambda name: F.flatten(F.transform(rings, lambda ring: F.transform(ring, lambda p: p[name])))
    return axis("lon"), axis("lat"), F.transform(rings, lambda ring: F.size(ring))


def split_rings(lon: np.ndarray, lat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Rings as arrays of (lon, lat) from their flat form."""
    points = np.stack([np.asarray(lon, float), np.asarray(lat, float)], 1)
    return np.split(points, np.cumsum(np.asarray(sizes, int))[:-1])


def _polygon_rows(features: DataFrame) -> DataFrame:
    single = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("kind") == "Polygon", single).when(F.col("kind") == "MultiPolygon", many)
    rows = features.select("props", F.explode(parts).alias("c")).select("props", _rings(F.col("c")).alias("rings"))
    return with_centres(rows.filter(F.size("rings") > 0))


def ring_centroid(ring: Column) -> Column:
    """struct(lon, lat, area): planar area centroid of a ring, twice its signed area; mean of the points of a flat one."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1))
    # Relative to the first point, for accuracy.
    x0, y0 = ring[0]["lon"], ring[0]["lat"]
    step = F.arrays_zip(ring.alias("a"), following.alias("b"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a"))

    def add(acc: Column, e: Column) -> Column:
        ax, ay = e[step_names[0]]["lon"] - x0, e[step_names[0]]["lat"] - y0
        bx, by = e[step_names[1]]["lon"] - x0, e[step_names[1]]["lat"] - y0
        cross = ax * by - bx * ay
        return F.struct((acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y"), (acc["a"] + cross).alias("a"))

    step_names = ("a", "b")
    return F.aggregate(
        step,
        zero,
        add,
        lambda t: F.struct(
            F.when(t["a"] != 0, x0 + t["x"] / (3 * t["a"])).otherwise(x0).alias("lon"),
            F.when(t["a"] != 0, y0 + t["y"] / (3 * t["a"])).otherwise(y0).alias("lat"),
            t["a"].alias("area"),
        ),
    )


def with_centres(rows: DataFrame) -> DataFrame:
    """POLYGON rows from ``rings`` and ``props``: centroids of the area, holes taken out."""
    parts = rows.withColumn("_c", F.transform("rings", ring_centroid))
    weights = F.transform(F.col("_c"), lambda c, i: F.when(i == 0, F.abs(c["area"])).otherwise(-F.abs(c["area"])))
    parts = parts.withColumn("_w", weights).withColumn("_t", F.aggregate("_w", F.lit(0.0), lambda a, b: a + b))

    def mean(axis: str) -> Column:
        total = F.aggregate(F.arrays_zip(F.col("_c").alias("c"), F.col("_w").alias("w")), F.lit(0.0), lambda a, z: a + z["c"][axis] * z["w"])
        return F.when(F.col("_t") != 0, total / F.col("_t")).otherwise(F.col("_c")[0][axis])

    return parts.select("rings", mean("lat").alias("center_lat"), mean("lon").alias("center_lon"), "props").select(*POLYGON_COLUMNS)


def polygons_from_geojson(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """POLYGON rows of the Polygon and MultiPolygon features; several polygons of a feature are rows of their own."""
    return _polygon_rows(_features(lines, column, keep))


def points_from_geojson(lines: DataFrame, column: str = "value", default_radius: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """POINT rows: points as they are, polygons by their centroids."""
    features = _features(lines, column, keep)
    r = F.lit(None if default_radius is None else float(default_radius)).cast("double")
    single = F.array(F.from_json("coordinates", "array<double>"))
    many = F.from_json("coordinates", "array<array<double>>")
    parts = F.when(F.col("kind") == "Point", single).when(F.col("kind") == "MultiPoint", many)
    points = features.select("props", F.explode(parts).alias("c")).select(F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"), r.alias("radius"), "props")
    centres = _polygon_rows(features).select(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"), r.alias("radius"), "props")
    return points.unionByName(centres).select(*POINT_COLUMNS)


def polygons_to_geojson(polygons: DataFrame) -> DataFrame:
    """``value``: a GeoJSON Feature line for each polygon, properties as text."""
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return polygons.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.col("props").alias("properties"))).alias("value"))


def points_to_columns(points: DataFrame, columns: list[str]) -> DataFrame:
    """Properties as columns; ``_center_lat``, ``_center_lon`` and ``_radius`` are the point's own, missing ones are ``null`` text."""
    own = {"_center_lat": "lat", "_center_lon": "lon", "_radius": "radius"}
    values = [F.coalesce(F.col("props")[c], F.col(own[c]).cast("string") if c in own else F.lit(None)) for c in columns]
    return points.select(*[F.coalesce(v, F.lit("null")).alias(c) for c, v in zip(columns, values)])


def tracks_from_columns(
    df: DataFrame, lat: str, lon: str, ts: str, user: str, track: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """TRACK rows: points of a user in order of time, a new segment wherever the track column changes.

    Rows without user, time or position are left out; equal times keep the order of the remaining columns.
    """
    base = df.select(
        F.col(f"`{user}`").cast("string").alias("_userid"),
        (F.coalesce(F.col(f"`{track}`").cast("string"), F.lit("")) if track else F.lit("0")).alias("_track_id"),
        number(df, ts).alias("_ts"),
        number(df, lat).alias("lat"),
        number(df, lon).alias("lon"),
        text_map(df, keep or df.columns).alias("props"),
    ).dropna(subset=["_userid", "_ts", "lat", "lon"])
    in_time = W.partitionBy("_userid").orderBy("_ts", "_track_id", "lat", "lon")
    changed = F.coalesce(F.lag("_track_id").over(in_time) != F.col("_track_id"), F.lit(False)).cast("int")
    numbered = base.withColumn("_changed", changed).withColumn("seg_ord", F.sum("_changed").over(in_time.rowsBetween(W.unboundedPreceding, 0)))
    order = W.partitionBy("_userid", "seg_ord").orderBy("_ts", "lat", "lon")
    user_props = F.create_map(F.lit("_userid"), F.col("_userid"))
    return (
        numbered.withColumn("pt_ord", F.row_number().over(order) - 1)
        .withColumn("track_props", user_props)
        .withColumn("seg_props", F.create_map(F.lit("_userid"), F.col("_userid"), F.lit("_track_id"), F.col("_track_id")))
        .withColumn("seg_ord", F.col("seg_ord").cast("int"))
        .withColumn("_trk", F.lit("0"))
        .select(*TRACK_COLUMNS)
    )


def tracks_to_points(tracks: DataFrame) -> DataFrame:
    """POINT rows of tracks; properties of track, segment and point, the inner ones win. ``_ts`` is one of them."""
    own = F.map_concat(F.map_filter("props", lambda k, _: k != "_ts"), F.create_map(F.lit("_ts"), F.col("_ts").cast("string")))
    middle = F.map_filter("seg_props", lambda k, _: ~F.map_contains_key(own, k))
    inner = F.map_concat(own, middle)
    outer = F.map_filter("track_props", lambda k, _: ~F.map_contains_key(inner, k))
    return tracks.select("lat", "lon", F.lit(None).cast("double").alias("radius"), F.map_concat(inner, outer).alias("props"))


_FLAT = "_userid string, _trk string, seg_ord int, _track_id string, pt_ord int, _ts double, lat double, lon double"


def _gpx_points(line: str, digest: str, place: str) -> Iterator[tuple]:
    """Points of one GPX document, the tracks told apart by ``place``; names are looked up without namespaces."""
    for element in (root := ET.fromstring(line)).iter():
        element.tag = element.tag.rpartition("}")[2]
    for number_, track in enumerate(root.iter("trk")):
        name = track.findtext("name") or f"{digest}-{number_}"
        for s, segment in enumerate(track.iter("trkseg")):
            for p, point in enumerate(segment.iter("trkpt")):
                time = point.findtext("time")
                ts = datetime.fromisoformat(time.strip().replace("Z", "+00:00")).timestamp() if time else float(p)
                yield name, f"{place}-{number_}", s, str(s), p, ts, float(point.get("lat")), float(point.get("lon"))


def tracks_from_gpx(lines: DataFrame, column: str = "value") -> DataFrame:
    """TRACK rows from one GPX document per line, every ``trk`` a track of its own, also those of one name; tracks
    without a name are called after the document's digest. Lines that are not well-formed give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            for line, digest in zip(batch["value"], batch["d"]):
                count += 1
                try:
                    rows += list(_gpx_points(line, digest, f"{digest}-{task}-{count}"))
                except (ET.ParseError, ValueError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FLAT.split(", ")])

    source = lines.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull()).withColumn("d", F.md5("value"))
    flat = source.mapInPandas(run, _FLAT)
    return flat.select(
        *TRACK_COLUMNS[:8],
        F.create_map(F.lit("_userid"), F.col("_userid")).alias("track_props"),
        F.create_map(F.lit("_userid"), F.col("_userid"), F.lit("_track_id"), F.col("_track_id")).alias("seg_props"),
        F.create_map(F.lit("_ts"), F.col("_ts").cast("string")).alias("props"),
    )


def tracks_to_gpx(tracks: DataFrame, creator: str = "terravane") -> DataFrame:
    """``value``: one GPX document per track, segments and points in order; assembled by segment, then by track."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    time = F.date_format(F.timestamp_seconds(F.floor("_ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.concat(
        F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"><time>'), time, F.lit("</time></trkpt>")
    )
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["x"]), "")
    segments = tracks.groupBy("_userid", "_trk", "seg_ord").agg(text(F.struct("pt_ord", point.alias("x"))).alias("points"))
    segment = F.concat(F.lit("<trkseg>"), F.col("points"), F.lit("</trkseg>"))
    users = segments.groupBy("_userid", "_trk").agg(text(F.struct("seg_ord", segment.alias("x"))).alias("body"))
    head = f'<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return users.select(F.concat(F.lit(head), escape(F.col("_userid")), F.lit("</name>"), F.col("body"), F.lit("</trk></gpx>")).alias("value"))


def _ring(lat: np.ndarray, lon: np.ndarray) -> list[dict]:
    return [{"lon": float(x), "lat": float(y)} for y, x in zip(lat, lon)]


def road_polygons(lines: DataFrame, name: str, kind: str, width: str, multipliers: dict[str, float], column: str = "value") -> DataFrame:
    """POLYGON rows along roads: a twelve-sided one around each vertex and a strip along each leg.

    Roads are LineString and MultiLineString features with a name, a width and a type among ``multipliers``; half of
    width times multiplier is the radius. Features without one of them, and lines of one point, give nothing.
    """
    features = _features(lines, column)
    factor = F.lit(None).cast("double")
    for road_type, m in multipliers.items():
        factor = F.when(F.col("props")[kind] == road_type, F.lit(float(m))).otherwise(factor)
    parts = F.when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>"))).when(
        F.col("kind") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>")
    )
    radius = F.col("props")[width].try_cast("double") * factor / 2
    roads = features.filter(F.col("props")[name].isNotNull()).select("props", radius.alias("r"), F.explode(parts).alias("line"))
    roads = roads.filter(F.col("r").isNotNull() & (F.size("line") > 1))
    legs = roads.select("props", "r", F.posexplode("line").alias("i", "b"), "line")
    legs = legs.select("props", "r", F.col("b")[1].alias("lat"), F.col("b")[0].alias("lon"), F.when(F.col("i") > 0, F.get("line", F.col("i") - 1)).alias("a"))

    legs = legs.select("props", "r", "lat", "lon", F.col("a")[1].alias("plat"), F.col("a")[0].alias("plon"))

    @F.pandas_udf(f"array<{RINGS}>")
    def outlines(r: pd.Series, lat: pd.Series, lon: pd.Series, plat: pd.Series, plon: pd.Series) -> pd.Series:
        r, lat, lon, plat, plon = (s.to_numpy(float, na_value=np.nan) for s in (r, lat, lon, plat, plon))
        turns = np.append(np.arange(-180.0, 180.0, 30.0), -180.0)
        cy, cx, _ = geodesic.direct(lat[:, None], lon[:, None], turns[None, :], r[:, None])
        legs_at = np.flatnonzero(~np.isnan(plat))
        azimuth = geodesic.inverse(plat[legs_at], plon[legs_at], lat[legs_at], lon[legs_at])[2]
        sides = azimuth[:, None] + np.array([90.0, -90.0, -90.0, 90.0, 90.0])
        ends = np.array([True, True, False, False, True])
        from_lat, from_lon = (np.where(ends, a[legs_at][:, None], b[legs_at][:, None]) for a, b in ((lat, plat), (lon, plon)))
        sy, sx, _ = geodesic.direct(from_lat, from_lon, sides, r[legs_at][:, None])
        out = [[[_ring(y, x)]] for y, x in zip(cy, cx)]
        for row, y, x in zip(legs_at, sy, sx):
            out[row].append([_ring(y, x)])
        return pd.Series(out)

    shaped = legs.withColumn("_shapes", outlines.asNondeterministic()("r", "lat", "lon", "plat", "plon")).select("props", F.explode("_shapes").alias("rings"))
    return with_centres(shaped)


def eye_views(points: DataFrame, azimuth: str, angle: str | None = None, default_angle: float = 110.0) -> DataFrame:
    """POLYGON rows: from each point a sector of its radius around the azimuth property, ``angle`` wide, in 12 steps.

    ``_radius, _azimuth`` and ``_angle`` are added to the properties; points without radius or azimuth give nothing.
    """
    az = F.col("props")[azimuth].try_cast("double")
    wide = F.coalesce(F.col("props")[angle].try_cast("double"), F.lit(default_angle)) if angle else F.lit(default_angle)
    rows = points.select("lat", "lon", "radius", "props", az.alias("az"), wide.alias("wide")).filter(F.col("az").isNotNull() & F.col("radius").isNotNull())

    @F.pandas_udf(RINGS)
    def sector(lat: pd.Series, lon: pd.Series, r: pd.Series, az: pd.Series, wide: pd.Series) -> pd.Series:
        steps = np.arange(-6, 7)
        a = az.to_numpy()[:, None] + wide.to_numpy()[:, None] / 12 * steps[None, :]
        y, x, _ = geodesic.direct(lat.to_numpy()[:, None], lon.to_numpy()[:, None], a, r.to_numpy()[:, None])
        apex = zip(lat, lon)
        return pd.Series([[_ring(np.concatenate([[p], yy, [p]]), np.concatenate([[q], xx, [q]]))] for (p, q), yy, xx in zip(apex, y, x)])

    extra = F.create_map(F.lit("_radius"), F.col("radius").cast("string"), F.lit("_azimuth"), F.col("az").cast("string"), F.lit("_angle"), F.col("wide").cast("string"))
    own = F.map_filter("props", lambda k, _: ~k.isin("_radius", "_azimuth", "_angle"))
    return with_centres(rows.select(sector("lat", "lon", "radius", "az", "wide").alias("rings"), F.map_concat(own, extra).alias("props")))
