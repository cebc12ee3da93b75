from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane import queries_geo
from terravane.functions import geodesic, hexgrid
from terravane.functions.mesh import japan_mesh
from terravane.operators import hexagons, spatial
from terravane.sources import spatial as shapes
from terravane.stream import Kind


def test_geodesics():
    metres, _, _ = geodesic.inverse([40.6, 0.0, 0.0, 5.0], [-73.8, 0.0, 0.0, 5.0], [51.6, 0.5, 0.0, 5.0], [-0.5, 179.5, 1.0, 5.0])
    assert np.allclose(metres, [5551759.400, 19936288.579, 111319.491, 0.0], atol=1e-2)
    lat, lon, _ = geodesic.direct(40.63972222, -73.77888889, 53.5, 5850e3)
    assert abs(lat - 49.01467) < 1e-5 and abs(lon - 2.56106) < 1e-5
    lats = [-63.1, -72.9, -71.9, -74.9, -74.3, -77.5, -77.4, -71.7, -65.9, -65.7, -66.6, -66.9, -69.8, -70.0, -71.0, -77.3, -77.9, -74.7]
    lons = [-58, -74, -102, -102, -131, -163, 163, 172, 140, 113, 88, 59, 25, -4, -14, -33, -46, -61]
    perimeter, area = geodesic.ring_measures(lons, lats)
    assert abs(perimeter - 16831067.893) < 1 and abs(area / 13662703680020.1 - 1) < 1e-6


@pytest.mark.parametrize(
    ("lat", "lon", "res", "cell"),
    [
        (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"),
        (37.3615593, -122.0553238, 7, "87283472bffffff"),
        (37.3615593, -122.0553238, 5, "85283473fffffff"),
        (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
    ],
)
def test_known_cells(lat, lon, res, cell):
    assert format(int(hexgrid.encode(lat, lon, res)[0]), "x") == cell


def test_cells_are_whole_and_invertible():
    rng = np.random.default_rng(0)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 60_000))), rng.uniform(-180, 180, 60_000)
    for res, total in ((0, 122), (1, 842), (2, 5882), (6, None), (15, None)):
        cells = np.unique(hexgrid.encode(lat, lon, res))[:6000]
        assert total is None or len(cells) == total
        again = hexgrid.encode(*hexgrid.centres(cells), res)
        assert (again == cells).all()
    for cell in np.unique(hexgrid.encode(lat[:300], lon[:300], 3)).tolist():
        near = hexgrid.neighbours(cell)
        assert len(near) in (5, 6) and all(cell in hexgrid.neighbours(n) for n in near)
    known = [(37.2713558, -121.9150803), (37.3539264, -121.8622232), (37.4283411, -121.92355), (37.4201286, -122.0377349), (37.337556, -122.0904289), (37.2631979, -122.0291013)]
    assert np.allclose(hexgrid.boundary(0x85283473FFFFFFF), known, atol=1e-5)
    assert not hexgrid.valid(0x85283473FFFFFF0) and hexgrid.valid(0x85283473FFFFFFF)


def test_mesh(spark):
    cases = [(38.12403, 137.59835, 5, "5737144744"), (32.95776, 132.56197, 6, "49323444444"), (26.08107, 127.68476, 6, "39270594423"), (43.05833334, 141.3375, 3, "64414277")]
    for lat, lon, level, code in cases:
        assert spark.range(1).select(japan_mesh(F.lit(lat), F.lit(lon), level)).first()[0] == code


SQUARE = '{"type":"Feature","properties":{"id":"s","n":3},"geometry":{"type":"Polygon","coordinates":[[[10,50],[11,50],[11,51],[10,51],[10,50]],[[10.4,50.4],[10.6,50.4],[10.6,50.6],[10.4,50.6],[10.4,50.4]]]}}'
MANY = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"p"},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":null,"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}'


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(SQUARE,), (MANY,), ("no json",), (None,)], "value string")


def test_geojson(lines):
    polygons = shapes.polygons_from_geojson(lines)
    centres = sorted((round(r["center_lat"], 6), round(r["center_lon"], 6), len(r["rings"])) for r in polygons.collect())
    assert centres == [(1.0, 1.0, 1), (5.333333, 5.666667, 1), (50.5, 10.5, 2)]
    points = {(round(r["lat"], 4), round(r["lon"], 4), r["radius"]) for r in shapes.points_from_geojson(lines, default_radius=5.0).collect()}
    assert points == {(2.0, 1.0, 5.0), (1.0, 1.0, 5.0), (5.3333, 5.6667, 5.0), (50.5, 10.5, 5.0)}
    back = shapes.polygons_from_geojson(shapes.polygons_to_geojson(polygons)).count()
    assert back == 3
    stats = {r["props"].get("id"): r["props"] for r in spatial.polygon_stats(polygons).collect()}
    assert float(stats["s"]["_area"]) == pytest.approx(7.576e9, rel=1e-3) and float(stats["s"]["_perimeter"]) == pytest.approx(364_400, rel=1e-3)


def test_joins(spark, lines):
    polygons = shapes.polygons_from_geojson(lines.limit(1))
    rows = [("in", 50.2, 10.2), ("hole", 50.5, 10.5), ("edge", 50.0, 10.5), ("out", 52.0, 10.0), ("in", 50.2, 10.2), ("odd", 95.0, 10.0)]
    signals = shapes.points_from_columns(spark.createDataFrame(rows, "name string, lat double, lon double"), "lat", "lon", None, None, ["name"])
    hits, others = spatial.area_covers(signals, polygons, "z")
    assert [(r["props"]["name"], r["props"]["z.id"]) for r in hits.collect()] == [("in", "s")] * 2
    assert sorted(r["props"]["name"] for r in others.collect()) == ["edge", "hole", "odd", "out"]
    once, rest = spatial.area_covers(signals, polygons, "z", once=True)
    assert once.count() == 2 and once.count() + rest.count() == len(rows)
    pois = shapes.points_from_columns(spark.createDataFrame([("a", 50.2, 10.2, 30_000.0), ("b", 50.21, 10.2, 2000.0), ("c", 1.0, 1.0, None)], "p string, lat double, lon double, r double"), "lat", "lon", "r", None, ["p"])
    near, far = spatial.proximity_filter(signals, pois, "q")
    assert sorted((r["props"]["name"], r["props"]["q.p"]) for r in near.collect()) == sorted([("in", "a"), ("in", "b")] * 2)
    assert near.filter("props['q.p'] = 'b'").select(F.round(F.col("props")["_distance"].cast("double"))).first()[0] == 1112.0
    assert spatial.area_covers(signals.limit(0), polygons)[0].count() == 0 and spatial.proximity_filter(signals, pois.limit(0))[1].count() == len(rows)


def test_tracks(spark):
    rows = [("u", 1, 0.0, 0.0, "a"), ("u", 2, 0.0, 0.001, "a"), ("u", 3, 0.001, 0.001, "b"), ("u", 4, 0.002, 0.001, "a"), ("v", 1, 5.0, 5.0, None), (None, 1, 1.0, 1.0, "a"), ("w", 1, None, 1.0, "a")]
    tracks = shapes.tracks_from_columns(spark.createDataFrame(rows, "user string, ts int, lat double, lon double, trk string"), "lat", "lon", "ts", "user", "trk")
    assert sorted((r["_userid"], r["seg_ord"], r["pt_ord"]) for r in tracks.collect()) == [("u", 0, 0), ("u", 0, 1), ("u", 1, 0), ("u", 2, 0), ("v", 0, 0)]
    stats = spatial.track_stats(tracks, "TRACK_STARTS").orderBy("_userid", "seg_ord", "pt_ord").collect()
    assert float(stats[1]["props"]["_distance"]) == pytest.approx(111.319, abs=0.01) and float(stats[1]["props"]["_azi_to_prev"]) == pytest.approx(90)
    assert stats[0]["track_props"]["_points"] == "4" and stats[3]["props"]["_points"] == "4"
    for mode in spatial.PINNING[:4]:
        assert spatial.track_stats(tracks, mode).count() == 5
    pins = spark.createDataFrame([("u", 0.0, 0.0)], "_userid string, lat double, lon double")
    assert spatial.track_stats(tracks, "INPUT_PINS", pins).count() == 4
    assert spatial.track_centroids(tracks).count() == 4 + 2
    gpx = shapes.tracks_to_gpx(tracks)
    back = shapes.tracks_from_gpx(gpx.union(spark.createDataFrame([("<gpx",), (None,)], "value string")))
    key = lambda df: sorted((r["_userid"], r["seg_ord"], r["pt_ord"], r["_ts"], r["lat"], r["lon"]) for r in df.collect())
    assert key(back) == key(tracks)


def test_shapes_and_coverages(spark, lines):
    road = '{"type":"Feature","properties":{"N":"r","K":"primary","W":2},"geometry":{"type":"LineString","coordinates":[[10,50],[10.01,50],[10.02,50.01]]}}'
    other = road.replace("primary", "path")
    assert shapes.road_polygons(spark.createDataFrame([(road,), (other,)], "value string"), "N", "K", "W", {"primary": 10.0}).count() == 5
    points = shapes.points_from_columns(spark.createDataFrame([(50.0, 10.0, 100.0, 90.0), (50.0, 10.0, None, 90.0)], "lat double, lon double, r double, az double"), "lat", "lon", "r")
    view = shapes.eye_views(points, "az").collect()
    assert len(view) == 1 and len(view[0]["rings"][0]) == 15 and view[0]["center_lon"] > 10.0
    polygons = shapes.polygons_from_geojson(lines.limit(1))
    fine = {r["_hash"] for r in hexagons.uniform_coverage(polygons, Kind.POLYGON, 5).collect()}
    inside = lambda c: hexagons._contains([np.array([(p["lon"], p["lat"]) for p in ring]) for ring in polygons.first()["rings"]], *[np.array([v]) for v in hexgrid.centre(int(c, 16))])[0]  # noqa: E731, SLF001
    assert fine and all(inside(c) for c in fine)
    assert len(fine) == pytest.approx(7.6e9 / 252_903_858, rel=0.2)
    compact = hexagons.compact_coverage(polygons, 4, 6).collect()
    assert {r["_level"] for r in compact} >= {6} and len({r["_parent"] for r in compact}) == 1
    assert {r["_hash"] for r in hexagons.uniform_coverage(points, Kind.POINT, 9).collect()} and hexagons.uniform_coverage(points, Kind.POINT, 9).count() == 7 + 1
    assert hexagons.cell_polygons(spark.createDataFrame([("85283473fffffff", "x"), ("zz", "y"), (None, "z")], "h string, n string"), "h", ["n"]).count() == 1


def test_all_places_are_points_of_interest(spark, tmp_path):
    """Radii from 20 m up, missing and not positive ones (100 m) included; the pair is near in the direction of the wider reach."""
    rows = [(1, 10.0, 50.0, 20.0), (2, 10.0, 50.0001, None), (3, 10.0, 50.0005, -5.0), (4, 10.0, 50.003, 900.0), (5, 0.0, 0.0, 900.0), (6, None, 50.0, 900.0)]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, rows[0]]], "point_id long, c0 double, c1 double, c2 double, category string")
    df.write.parquet(f"{tmp_path}/points.parquet")
    found = {(r["point"], r["poi"]): r["distance"] for r in queries_geo.proximity_distances_all(spark, str(tmp_path)).collect()}
    want = {(str(i), str(i)) for i in range(1, 5)} | {(str(i), "4") for i in range(1, 4)} | {("1", "2"), ("1", "3"), ("2", "1"), ("2", "3"), ("3", "2")}
    assert set(found) == want and abs(found["2", "1"] - 11.12) < 0.02
    assert {(r["point"], r["poi"]) for r in queries_geo.proximity_filter_all(spark, str(tmp_path)).collect()} == set(found)


def test_compact_coverage_leaves_rings_between_levels():
    """Level by level against the plain statement: kept are cells whose whole neighbourhood is uncovered polygon."""
    ring = np.array([[10.0, 45.0], [12.2, 45.1], [12.0, 46.8], [10.9, 46.2], [10.1, 46.9]])
    box, low, high = (-180.0, -90.0, 180.0, 90.0), 4, 6
    wanted, kept = set(), {}
    for level in range(low, high + 1):
        inside = hexagons._fill([ring], level, box)
        lat, lon = hexgrid.centres(inside)
        covered = np.zeros(len(inside), bool)
        for coarse in range(low, level):
            covered |= np.isin(hexgrid.encode(lat, lon, coarse), np.array(sorted(kept[coarse]), np.uint64))
        rest = set(inside[~covered].tolist())
        kept[level] = {c for c in rest if set(hexgrid.neighbours(c)) <= rest}
        wanted |= {(c, level) for c in (kept[level] if level < high else rest | {n for c in rest for n in hexgrid.neighbours(c)})}
    assert kept[low] and len({level for _, level in wanted}) == 3
    assert set(hexagons._Compact([ring], low).cells(high, box)) == wanted
