from __future__ import annotations

import math
import random

from terravane.operators.trips import StopRules, stops_and_trips

SCHEMA = "u string, t long, lat double, lon double, acc double, chunk string"
DEGREE = 6371008.8 * math.pi / 180


def rest(rng, t, y, x, minutes, step=40):
    out = []
    end = t + minutes * 60
    while t <= end:
        out.append((t, y + rng.gauss(0, 6) / DEGREE, x + rng.gauss(0, 6) / DEGREE))
        t += step
    return out, out[-1][0]


def move(rng, t, y, x, legs, step=30, metres=200):
    out = []
    for _ in range(legs):
        t, y = t + step, y + metres / DEGREE
        out.append((t, y, x))
    return out, t, y


def build(user, seed, days=3):
    """A path of stops and trips, with its truth; a silence after every fourth stop."""
    rng, t, y, x = random.Random(seed), 1_200_000_000 + seed, 10.0, 20.0
    rows, truth, before = [], [], None
    for k in range(days * 12):
        part, end = rest(rng, t, y, x, rng.choice([9, 30, 100, 700]))
        truth.append(("stop", part[0][0], end))
        if before is not None:
            truth.append(("trip", before, part[0][0]))
        rows += part
        before = end
        if k % 4 == 3:
            t, before = end + 7200, None
            y += 0.01
        else:
            legs, t, y = move(rng, end, y, x, rng.randrange(3, 30))
            rows += legs
            halt, t2 = rest(rng, t + 30, y, x, 3)  # a short halt is no stop
            rows += halt
            legs, t, y = move(rng, t2, y, x, 4)
            rows += legs
            t, y = t + 30, y + 200 / DEGREE
    noise = []
    for t, la, lo in rows[5:-5:17]:
        noise.append((user, t + 1, la + 0.2, lo, 5.0, "s"))  # a jump away and back
        noise.append((user, t + 2, la + 0.01, lo, 900.0, "s"))
        noise.append((user, t + 3, 0.0, 0.0, 5.0, "s"))
        noise.append((user, t + 4, None, lo, None, "s"))
    return [(user, t, la, lo, 10.0, "s") for t, la, lo in rows] + noise, {(kind, user, a, b) for kind, a, b in truth}


def found(spark, rows, **rules):
    df = spark.createDataFrame(rows, SCHEMA)
    out = stops_and_trips(df, "u", "t", "lat", "lon", "acc", StopRules(**rules)).collect()
    return {(r["kind"], r["user"], r["start_ts"], r["end_ts"]) for r in out}, out


def test_stops_and_trips(spark):
    rows, truth = [], set()
    for seed in range(4):
        a, b = build(f"u{seed}", seed)
        rows, truth = rows + a, truth | b
    rows += rows[::10]  # delivered twice
    random.Random(0).shuffle(rows)
    rows += [(None, 1, 1.0, 1.0, 1.0, ""), ("x", None, 1.0, 1.0, 1.0, ""), ("y", 5, 1.0, 1.0, None, "")]
    got, out = found(spark, rows)
    assert got == truth
    # Stops that span chunks are united whatever the chunks.
    small, other = found(spark, rows, chunk_s=4 * 3600)
    assert small == truth
    by = lambda rs: {(r["kind"], r["user"], r["start_ts"]): r["distance_m"] for r in rs}
    a, b = by(out), by(other)
    assert all(abs(a[k] - b[k]) < 1e-3 for k in a)
    trips = [r for r in out if r["kind"] == "trip"]
    assert all(r["distance_m"] > 1000 and r["duration_s"] == r["end_ts"] - r["start_ts"] for r in trips)


def test_empty(spark):
    assert found(spark, [])[0] == set()


def test_penalty_decides_what_is_a_change(spark):
    """Noise that throws two pings of a rest across its circle is a change of regime only if changes cost nothing."""
    degree = 111_195.0
    at = [(50.0 if k in (10, 11) else -50.0 if k % 2 else -45.0) for k in range(40)]  # metres east; all within 60 m of one place
    away = [(5_000.0 + 400.0 * k) for k in range(10)]
    rows = [("u", 60 * k, 0.0001, 10 + x / degree) for k, x in enumerate(at)] + [("u", 60 * (40 + k), 0.0001, 10 + x / degree) for k, x in enumerate(away)]
    df = spark.createDataFrame(rows, "u string, t long, lat double, lon double")
    stops = lambda penalty: [(r["start_ts"], r["end_ts"]) for r in stops_and_trips(df, "u", "t", "lat", "lon", rules=StopRules(penalty=penalty)).filter("kind = 'stop'").orderBy("start_ts").collect()]
    assert stops(0.5) == [(0, 60 * 39)]
    assert stops(0.0) == [(0, 60 * 9), (60 * 12, 60 * 39)]
