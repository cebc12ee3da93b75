"""Spatial joins and measures on points, polygons and tracks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.functions import geodesic
from terravane.operators.nearby import contained, usable
from terravane.plans.tiles import within_reach
from terravane.sources.spatial import flat_rings, split_rings, with_centres
from terravane.stream import POINT_COLUMNS, POLYGON_COLUMNS, TRACK_COLUMNS

PINNING = ["SEGMENT_CENTROIDS", "TRACK_CENTROIDS", "SEGMENT_STARTS", "TRACK_STARTS", "INPUT_PINS"]


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with an id of their content (equal rows have one id), 16 bytes, stable when a lost task is run again.

    Centres follow from the rings and need not be computed for it; rings count by two hashes, 96 bits in all.
    """
    kinds = {c: t for c, t in df.dtypes if not ("rings" in df.columns and c.startswith("center_"))}
    text = lambda c, t: F.to_json(F.array_sort(F.map_entries(c))) if t.startswith("map") else F.col(c).cast("string")
    parts = [F.concat_ws(",", F.xxhash64(c).cast("string"), F.hash(c).cast("string")) if t.startswith(("array", "struct")) else text(c, t) for c, t in kinds.items()]
    return df.withColumn(name, F.unhex(F.md5(F.to_json(F.array(*parts)))))


def _joined_props(props: Column, other: Column, prefix: str) -> Column:
    """Properties with those of the partner added under ``prefix.``; the row's own win."""
    renamed = F.transform_keys(other, lambda k, _: F.concat(F.lit(f"{prefix}."), k))
    return F.map_concat(F.map_filter(renamed, lambda k, _: ~F.map_contains_key(props, k)), props)


def area_covers(signals: DataFrame, polygons: DataFrame, prefix: str = "geometries", once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Signals strictly inside a polygon (planar longitude and latitude), and the others.

    With ``once`` a signal comes once and unchanged; else once for each polygon that covers it, the polygon's
    properties added as ``prefix.<name>``. Equal signals share one test and keep their number. Signals with an unusable
    position are among the others.
    """
    points = _numbered(signals, "_sid")
    areas = _numbered(polygons, "_zid")
    distinct = points.select("_sid", F.col("lon").alias("x"), F.col("lat").alias("y")).filter(usable(F.col("x"), F.col("y"))).dropDuplicates(["_sid"])
    ring = areas.select(F.col("_zid").alias("zone"), "rings").dropDuplicates(["zone"]).select("zone", F.explode("rings").alias("ring"))
    ring = ring.select("zone", F.transform("ring", lambda p: F.array(p["lon"], p["lat"])).alias("pts"))
    hits = contained(distinct.select(F.col("_sid").alias("point"), "x", "y"), ring)
    inside = hits.select(F.col("point").alias("_sid")).distinct()
    evicted = points.join(inside, "_sid", "left_anti").drop("_sid")
    if once:
        return points.join(inside, "_sid", "left_semi").select(*POINT_COLUMNS), evicted
    pairs = hits.select(F.col("point").alias("_sid"), F.col("zone").alias("_zid"))
    joined = points.join(pairs, "_sid").join(areas.select("_zid", F.col("props").alias("_z")), "_zid")
    return joined.select("lat", "lon", "radius", _joined_props(F.col("props"), F.col("_z"), prefix).alias("props")), evicted


def proximity_filter(signals: DataFrame, pois: DataFrame, prefix: str = "pois", once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Signals within the radius of a point of interest by the WGS84 geodesic, and the others.

    With ``once`` each near signal comes once; else once for each point of interest, whose properties are added as
    ``prefix.<name>``; ``_distance`` (of the nearest, with ``once``) is added. Candidates come from a grid sized by the
    radius and a test on the sphere; only those left are measured exactly. Points of interest without a positive radius
    are near nothing; signals with an unusable position are among the others.
    """
    points = _numbered(signals, "_sid")
    places = _numbered(pois, "_pid").filter(F.col("radius") > 0)
    seekers = places.select(F.col("_pid").alias("i"), F.col("lon").alias("sx"), F.col("lat").alias("sy"), F.col("radius").alias("sr")).filter(usable(F.col("sx"), F.col("sy")))
    held = points.select(F.col("_sid").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y")).filter(usable(F.col("x"), F.col("y"))).dropDuplicates(["id"])
    near = within_reach(seekers.dropDuplicates(["i"]), held)
    near = near.withColumnsRenamed({"i": "_pid", "id": "_sid"})
    near = near.withColumn("_m", geodesic.distance_udf()("sy", "sx", "y", "x")).filter(F.col("_m") <= F.col("sr")).select("_sid", "_pid", "_m")
    nearest = near.groupBy("_sid").agg(F.min("_m").alias("_m"))
    evicted = points.join(nearest, "_sid", "left_anti").drop("_sid")
    extra = F.create_map(F.lit("_distance"), F.col("_m").cast("string"))
    own = F.map_filter("props", lambda k, _: k != "_distance")
    if once:
        return points.join(nearest, "_sid").select("lat", "lon", "radius", F.map_concat(own, extra).alias("props")), evicted
    joined = points.join(near, "_sid").join(places.select("_pid", F.col("props").alias("_p")), "_pid")
    props = F.map_concat(F.map_filter(_joined_props(F.col("props"), F.col("_p"), prefix), lambda k, _: k != "_distance"), extra)
    return joined.select("lat", "lon", "radius", props.alias("props")), evicted


def polygon_centroids(polygons: DataFrame) -> DataFrame:
    """POINT rows at the centroids of polygons."""
    return polygons.select(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"), F.lit(None).cast("double").alias("radius"), "props")


def track_centroids(tracks: DataFrame, mode: str = "BOTH") -> DataFrame:
    """POINT rows at the mean of the points of segments, of tracks, or of both."""
    nothing = F.lit(None).cast("double").alias("radius")
    mean = [F.avg("lat").alias("lat"), F.avg("lon").alias("lon")]
    segments = tracks.groupBy("_userid", "_trk", "seg_ord").agg(*mean, F.any_value("seg_props").alias("props")).select("lat", "lon", nothing, "props")
    whole = tracks.groupBy("_userid", "_trk").agg(*mean, F.any_value("track_props").alias("props")).select("lat", "lon", nothing, "props")
    return {"SEGMENTS": segments, "TRACKS": whole, "BOTH": segments.unionByName(whole)}[mode.upper()]


def polygon_stats(polygons: DataFrame) -> DataFrame:
    """Polygons with ``_perimeter`` of the shell (m) and ``_area`` of the shell less its holes (m2) among their properties."""

    @F.pandas_udf("perimeter double, area double")
    def measure(lons: pd.Series, lats: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, n in zip(lons, lats, sizes):
            found = [geodesic.ring_measures(r[:, 0], r[:, 1]) for r in split_rings(x, y, n)]
            rows.append((found[0][0], found[0][1] - sum(f[1] for f in found[1:])) if found else (0.0, 0.0))
        return pd.DataFrame(rows, columns=["perimeter", "area"])

    measured = polygons.withColumn("_m", measure(*flat_rings()))
    extra = F.create_map(F.lit("_perimeter"), F.col("_m.perimeter").cast("string"), F.lit("_area"), F.col("_m.area").cast("string"))
    own = F.map_filter("props", lambda k, _: ~k.isin("_perimeter", "_area"))
    return measured.withColumn("props", F.map_concat(own, extra)).select(*POLYGON_COLUMNS)


def track_stats(tracks: DataFrame, pinning: str = "INPUT_PINS", pins: DataFrame | None = None) -> DataFrame:
    """Tracks with ``_points, _duration, _distance, _radius`` and azimuths among the properties of points, segments and tracks.

    Running values of points count from the start of the segment for segment pinning, else of the track. Radii are
    distances from the pin: the centroid or first point of the segment or track, or the user's row in ``pins``
    (``_userid, lat, lon``; users without a pin are left out). Legs are measured within segments.
    """
    pinning = pinning.upper()
    if pinning not in PINNING:
        raise ValueError(f"pinning is one of {PINNING}")
    in_segment = W.partitionBy("_userid", "_trk", "seg_ord").orderBy("pt_ord")
    segment, user = W.partitionBy("_userid", "_trk", "seg_ord"), W.partitionBy("_userid", "_trk")
    rows = tracks.withColumns({"_plat": F.lag("lat").over(in_segment), "_plon": F.lag("lon").over(in_segment), "_pts": F.lag("_ts").over(in_segment)})
    rows = rows.withColumn("_leg", geodesic.leg_udf()("_plat", "_plon", "lat", "lon"))
    rows = rows.withColumns({"_d": F.coalesce(F.when(F.col("_plat").isNotNull(), F.col("_leg.metres")), F.lit(0.0)), "_t": F.coalesce(F.col("_ts") - F.col("_pts"), F.lit(0.0))})
    if pinning == "INPUT_PINS":
        if pins is None:
            raise ValueError("INPUT_PINS needs pins")
        rows = rows.join(pins.select("_userid", F.col("lat").alias("_slat"), F.col("lon").alias("_slon")).dropDuplicates(["_userid"]), "_userid")
        rows = rows.withColumns({"_tlat": F.col("_slat"), "_tlon": F.col("_slon")})
    elif pinning.endswith("CENTROIDS"):
        place = lambda w: (F.avg("lat").over(w), F.avg("lon").over(w))
    else:
        first = lambda w, *o: (F.first("lat").over(w.orderBy(*o)), F.first("lon").over(w.orderBy(*o)))
        place = lambda w: first(w, "pt_ord") if w is segment else first(w, "seg_ord", "pt_ord")
    if pinning != "INPUT_PINS":
        t_lat, t_lon = place(user)
        s_lat, s_lon = place(segment) if pinning.startswith("SEGMENT") else (t_lat, t_lon)
        if pinning.startswith("SEGMENT"):
            # Segments of a track are pinned each, the track by its first segment's pin.
            rows = rows.withColumns({"_slat": s_lat, "_slon": s_lon})
            start = user.orderBy("seg_ord", "pt_ord")
            rows = rows.withColumns({"_tlat": F.first("_slat").over(start), "_tlon": F.first("_slon").over(start)})
        else:
            rows = rows.withColumns({"_slat": s_lat, "_slon": s_lon, "_tlat": t_lat, "_tlon": t_lon})
    distance = geodesic.distance_udf()
    rows = rows.withColumns({"_r": distance("_slat", "_slon", "lat", "lon"), "_tr": distance("_tlat", "_tlon", "lat", "lon")})
    running = (in_segment if pinning.startswith("SEGMENT") else user.orderBy("seg_ord", "pt_ord")).rowsBetween(W.unboundedPreceding, 0)
    after = lambda c: F.lead(c).over(in_segment)
    rows = rows.withColumns(
        {
            "_run_t": F.sum("_t").over(running), "_run_d": F.sum("_d").over(running), "_run_n": F.count(F.lit(1)).over(running),
            "_next1": after("_leg.azi1"), "_next2": after("_leg.azi2"),
            "_seg": F.struct(F.sum("_t").over(segment).alias("t"), F.sum("_d").over(segment).alias("d"), F.count(F.lit(1)).over(segment).alias("n"), F.max("_r").over(segment).alias("r")),
            "_trk": F.struct(F.sum("_t").over(user).alias("t"), F.sum("_d").over(user).alias("d"), F.count(F.lit(1)).over(user).alias("n"), F.max("_tr").over(user).alias("r")),
        }
    )
    some = lambda values: F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    moved = F.col("_plat").isNotNull()
    point = some(
        {
            "_duration": F.col("_run_t").cast("bigint"), "_distance": F.col("_run_d"), "_points": F.col("_run_n"), "_radius": F.col("_r"),
            "_azi_from_prev": F.when(moved, F.col("_leg.azi2")), "_azi_to_prev": F.when(moved, F.col("_leg.azi1")),
            "_azi_from_next": F.col("_next1"), "_azi_to_next": F.col("_next2"),
        }
    )
    group = lambda c: some({"_duration": F.col(f"{c}.t").cast("bigint"), "_distance": F.col(f"{c}.d"), "_points": F.col(f"{c}.n"), "_radius": F.col(f"{c}.r")})
    over = lambda old, new: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return rows.select(
        *TRACK_COLUMNS[:8],
        over(F.col("track_props"), group("_trk")).alias("track_props"),
        over(F.col("seg_props"), group("_seg")).alias("seg_props"),
        over(F.col("props"), point).alias("props"),
    )


__all__ = ["area_covers", "polygon_centroids", "polygon_stats", "proximity_filter", "track_centroids", "track_stats", "with_centres"]
