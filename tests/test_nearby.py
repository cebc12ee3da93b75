from __future__ import annotations

import json
import math
import random

import pytest

from terravane.operators.nearby import containing_zones, near_pairs
from terravane.plans import salting, tiles

SCHEMA = "id long, lon double, lat double, r double, strip string"


def metres(a, b):
    x1, y1, x2, y2 = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1, h)))


def pairs(spark, rows):
    return {(r["id_a"], r["id_b"]) for r in near_pairs(spark.createDataFrame(rows, SCHEMA), "id", "lon", "lat", "r").collect()}


@pytest.mark.parametrize("block", [50_000, 40, 7])
def test_against_brute_force(spark, monkeypatch, block):
    """Also where tiles are cut and what is left of them is split into blocks on both sides."""
    monkeypatch.setattr(tiles, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    centres = [(179.9999, -60.0), (-179.9995, -60.0), (10.0, 89.9995), (-170.0, 89.9996), (20.0, -89.999), (0.001, 0.0), (50.0, 45.0)]
    for i in range(500):
        x, y = rng.choice(centres)
        spread = rng.choice([0.001, 0.01, 0.2])
        x, y = x + rng.uniform(-spread, spread) * (1 if abs(y) < 80 else 900), min(90.0, max(-90.0, y + rng.uniform(-spread, spread)))
        rows.append((i, (x + 180) % 360 - 180, y, rng.choice([None, -1.0, 0.0, 20.0, 500.0, 5000.0, float("nan")]), "s"))
    rows += [(900, None, 1.0, 9.0, "s"), (901, 0.0, 0.0, 9.0, "s"), (902, 181.0, 1.0, 9.0, "s"), (903, float("nan"), 1.0, 9.0, "s"), (None, 50.0, 45.0, 9.0, "s")]
    reach = lambda r: r if r and r > 0 else 100.0
    want = {(a[0], b[0]) for i, a in enumerate(rows[:500]) for b in rows[i + 1 : 500] if metres(a, b) <= max(reach(a[3]), reach(b[3]))}
    assert want and pairs(spark, rows) == want


def test_same_place_and_empty(spark):
    assert pairs(spark, [(1, 5.0, 5.0, None, ""), (2, 5.0, 5.0, None, ""), (3, 5.0, 5.0, None, "")]) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(spark, []) == set()


def test_dense_spot_has_few_candidates(spark, monkeypatch):
    """The grid follows the radius: of 20,000 points in one spot of 55 m with reach 0.1 m, few candidates are no pairs."""
    rng = random.Random(4)
    rows = [(i, 10 + rng.uniform(0, 0.0005), 50 + rng.uniform(0, 0.0005), 0.1, "") for i in range(20_000)]
    compared = []
    ranges = tiles._portions
    monkeypatch.setattr(tiles, "_portions", lambda count: (compared.append(int(count.sum())), ranges(count))[1])
    blocks = spark.createDataFrame(rows, SCHEMA).toPandas().rename(columns={"lon": "x", "lat": "y"}).assign(key=0, block=0, role=3)
    found = sum(int(((p["i"] < p["id"]) & (p["i"] != p["id"])).sum()) for p in tiles._pairs(blocks))
    # Counts of candidates are every second; each point is a candidate of itself, and each pair is met from both sides.
    candidates = sum(compared[1::2]) - len(rows)
    assert found > 2000 and candidates < 10 * 2 * found


@pytest.mark.parametrize("rows_per_task", [100_000, 5])
def test_salted_join_of_hot_keys(spark, rows_per_task):
    left = spark.createDataFrame([(k % 3 if k < 60 else None, k) for k in range(70)], "k int, a int")
    right = spark.createDataFrame([(0, b) for b in range(40)] + [(1, 100), (7, 101), (None, 102)], "k int, b int")
    found = sorted(tuple(r) for r in salting.salted_join(left, right, ["k"], rows_per_task).select("k", "a", "b").collect())
    assert found == sorted((k % 3, k, b) for k in range(60) for b in ([*range(40)] if k % 3 == 0 else [100] if k % 3 == 1 else []))


def test_zones(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    shape = lambda kind, c: json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": c}})
    zones = spark.createDataFrame(
        [
            (10, shape("Polygon", [square(0, 10), square(4, 6)[::-1]])),  # with a hole, not closed
            (11, shape("MultiPolygon", [[square(5, 8) + [[5, 5]]], [square(20, 21)]])),
            (12, None),
            (13, "no json"),
            (14, shape("Point", [1, 1])),
        ],
        "z long, g string",
    )
    points = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 7.0, 7.0), (4, 20.5, 20.5), (5, 10.0, 5.0), (6, 3.0, 10.0), (7, None, 1.0), (8, 0.0, 0.0), (9, 5.5, 5.5)], "p long, x double, y double"
    )
    found = {tuple(r) for r in containing_zones(points, "p", "x", "y", zones, "z", "g").collect()}
    assert found == {(1, 10), (3, 10), (3, 11), (4, 11), (9, 11)}
    assert containing_zones(points.limit(0), "p", "x", "y", zones, "z", "g").count() == 0
    assert containing_zones(points, "p", "x", "y", zones.limit(0), "z", "g").count() == 0
