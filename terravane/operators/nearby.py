"""Points near other points and the regions that contain them.

Near: points go once each into tiles of bounded size, within which a grid that follows the radius finds the pairs (see
``plans.tiles``). Regions: polygon edges are binned into latitude strips (and the longitude cells their region spans
there), joined to the points of the strip, and crossings of the ray due east are counted per point and region. Hot cells
are split on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.plans.salting import salted_join
from terravane.plans.tiles import EARTH_M, within_reach
from terravane.session import cut_lineage


def usable(lon: Column, lat: Column) -> Column:
    """Position present, no NaN, in range and not exactly (0, 0)."""
    inside = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    return F.coalesce(inside & ~F.isnan(lon) & ~F.isnan(lat) & ~((lon == 0) & (lat == 0)), F.lit(False))


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle metres on the mean-radius sphere; exact to millimetres for near points too."""
    a = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(F.radians(lon_b - lon_a) / 2), 2
    )
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def near_pairs(points: DataFrame, id_col: str, lon: str, lat: str, radius: str, default_m: float = 100.0) -> DataFrame:
    """``id_a < id_b, distance_m``: pairs of different points within the larger of their two radii.

    A null, NaN, zero or negative radius counts as ``default_m``. Points with an unusable position or a null id take no
    part. Expects one row for each id: points at one place are different points and pair with each other. Works across
    the date line and around the poles, for radii of any size.
    """
    given = F.col(f"`{radius}`").cast("double")
    base = points.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{lon}`").cast("double").alias("x"),
        F.col(f"`{lat}`").cast("double").alias("y"),
        F.when((given > 0) & ~F.isnan(given), given).otherwise(F.lit(float(default_m))).alias("r"),
    ).filter(usable(F.col("x"), F.col("y")) & F.col("id").isNotNull())
    found = within_reach(base.select(F.col("id").alias("i"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("r").alias("sr")))
    # Each pair counts from the point with the larger radius (of equal ones, the smaller id).
    counts = (F.col("sr") > F.col("r")) | ((F.col("sr") == F.col("r")) & (F.col("i") < F.col("id")))
    distance = haversine_m(F.col("sx"), F.col("sy"), F.col("x"), F.col("y"))
    found = found.filter(counts & (F.col("i") != F.col("id"))).withColumn("distance_m", distance).filter(F.col("distance_m") <= F.col("sr"))
    return found.select(F.least("i", "id").alias("id_a"), F.greatest("i", "id").alias("id_b"), "distance_m")


GEOJSON = (
    "struct<type:string,geometry:struct<type:string,coordinates:string>,"
    "features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
)


def rings(zones: DataFrame, id_col: str, geojson: str) -> DataFrame:
    """``zone, ring, pts``: every ring (outer or hole) of Polygon and MultiPolygon features, as arrays of [lon, lat].

    Null or unparsable GeoJSON and other geometry types give no rings.
    """
    parsed = zones.select(F.col(f"`{id_col}`").alias("zone"), F.from_json(F.col(f"`{geojson}`"), GEOJSON).alias("g"))
    shapes = parsed.select("zone", F.explode(F.concat(F.array(F.col("g.geometry")), F.coalesce(F.col("g.features.geometry"), F.array()))).alias("s"))
    polygon = F.from_json(F.col("s.coordinates"), "array<array<array<double>>>")
    multi = F.flatten(F.from_json(F.col("s.coordinates"), "array<array<array<array<double>>>>"))
    found = F.when(F.col("s.type") == "Polygon", polygon).when(F.col("s.type") == "MultiPolygon", multi)
    return shapes.select("zone", F.posexplode(found).alias("ring", "pts")).filter(F.size("pts") >= 3)


def edges(ring: DataFrame) -> DataFrame:
    """``zone, ax, ay, bx, by``: the straight edges of rings, closing edge included."""
    n = F.size("pts")
    following = F.concat(F.slice("pts", 2, n - 1), F.slice("pts", 1, 1))
    pairs = ring.select("zone", F.explode(F.arrays_zip(F.col("pts").alias("a"), following.alias("b"))).alias("e"))
    pairs = pairs.select("zone", F.col("e.a")[0].alias("ax"), F.col("e.a")[1].alias("ay"), F.col("e.b")[0].alias("bx"), F.col("e.b")[1].alias("by"))
    same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
    return pairs.filter(F.col("ax").isNotNull() & F.col("bx").isNotNull() & F.col("ay").isNotNull() & F.col("by").isNotNull() & ~same)


def contained(points: DataFrame, ring: DataFrame, strip_deg: float = 0.25, cell_deg: float = 2.0) -> DataFrame:
    """``point, zone`` for ``points`` (point, x, y; no nulls) strictly within the area of a zone's rings.

    Edges are binned into latitude strips and joined to the points of their strip; to keep points from meeting regions
    elsewhere on the strip, both are also keyed by the longitude cells the region spans there. A ray due east from the
    point crosses an edge if one end is above the point's latitude and the other is not, and the edge lies east of the
    point there; an odd number of crossings over all rings of a zone is inside, whatever the direction of rings and
    whether they are closed. Vertices count once by this half-open rule, and points on an edge are taken out explicitly.
    """
    base = points.withColumn("strip", F.floor((F.col("y") + 90) / strip_deg)).withColumn("cell", F.floor((F.col("x") + 180) / cell_deg))
    line = edges(ring).withColumns({"lo": F.least("ay", "by"), "hi": F.greatest("ay", "by"), "west": F.least("ax", "bx"), "east": F.greatest("ax", "bx")})
    in_strips = F.sequence(F.floor((F.col("lo") + 90) / strip_deg), F.floor((F.col("hi") + 90) / strip_deg))
    binned = line.withColumn("strip", F.explode(in_strips))
    spans = binned.groupBy("zone", "strip").agg(
        F.floor((F.min("west") + 180) / cell_deg).alias("c0"), F.floor((F.max("east") + 180) / cell_deg).alias("c1")
    )
    # A point west of all of a zone's edges in its strip crosses an even number, one east of them none: those cells need no edges.
    placed = binned.join(spans, ["zone", "strip"]).select("strip", F.explode(F.sequence("c0", "c1")).alias("cell"), "zone", "ax", "ay", "bx", "by")
    # Edges are read for the counts of hot cells and for the join; what they come from is read once.
    hits = salted_join(base, cut_lineage(placed), ["strip", "cell"])
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    at = ax + (y - ay) * (bx - ax) / F.when(ay != by, by - ay)
    crosses = F.coalesce(((ay > y) != (by > y)) & (at > x), F.lit(False))
    within = y.between(F.least(ay, by), F.greatest(ay, by)) & x.between(F.least(ax, bx), F.greatest(ax, bx))
    touches = within & ((x - ax) * (by - ay) == (y - ay) * (bx - ax))
    counted = hits.filter(crosses | touches).groupBy("point", "zone").agg(F.sum(crosses.cast("int")).alias("_crossings"), F.max(touches).alias("_on"))
    return counted.filter((F.col("_crossings") % 2 == 1) & ~F.col("_on")).select("point", "zone")


def containing_zones(points: DataFrame, id_col: str, lon: str, lat: str, zones: DataFrame, zone_id: str, geojson: str) -> DataFrame:
    """``point, zone``: the zones whose area, holes excluded, holds the point strictly; overlapping zones each count.

    Points with an unusable position (null, NaN, out of range, (0, 0)) and null ids take no part; zones without a
    readable Polygon or MultiPolygon hold nothing. Expects one row for each point id.
    """
    base = points.select(
        F.col(f"`{id_col}`").alias("point"), F.col(f"`{lon}`").cast("double").alias("x"), F.col(f"`{lat}`").cast("double").alias("y")
    ).filter(usable(F.col("x"), F.col("y")) & F.col("point").isNotNull())
    return contained(base, rings(zones, zone_id, geojson))
