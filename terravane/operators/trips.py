"""Stops and trips from location pings of moving devices.

A device's pings are cut into time chunks with a margin on both sides, so a device (or a fleet behind one id) with a
third of all pings is spread over tasks. In each chunk unusable pings are dropped, and the steps between the others are
segmented by a penalised changepoint model: two regimes, resting and moving, a cost for each step from its displacement
and speed, and a penalty for every change; dynamic programming finds the cheapest segmentation. Resting segments are
checked against the stop radius. Stops seen from both sides of a chunk's border are united afterwards, on the far
smaller table of stops; trips lie between successive stops with no gap break.

What is ordered per device there is bounded by time, not by pings: stops last ``min_s`` or more and do not overlap, breaks
``gap_s``, chunk totals come once per chunk, so a year of one device is at most some 100,000 stops, 9,000 breaks and 365
totals, whether it has a thousand pings or a third of all. A chunk is bounded by the pings of one device in one day.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


@dataclass(frozen=True)
class StopRules:
    """radius_m and min_s define a stop, gap_s a break, max_accuracy_m and max_speed a usable ping.

    ``penalty`` is the cost of a change of regime, in units of the cost of one clear step; ``chunk_s`` the length of the
    time chunks, which must be longer than ``2 * gap_s``.
    """

    radius_m: float = 60.0
    min_s: int = 300
    gap_s: int = 3600
    max_accuracy_m: float = 200.0
    max_speed: float = 100.0
    penalty: float = 0.5
    chunk_s: int = 86_400


def _metres(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    a = np.sin((lat_b - lat_a) / 2) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin((lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def jumps(ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, cut: np.ndarray, max_speed: float) -> np.ndarray:
    """Pings reached and left faster than ``max_speed`` while the way past them is shorter than both legs.

    ``cut`` marks the steps from one device (or chunk) to the next.
    """
    out = np.zeros(len(ts), bool)
    if len(ts) < 3:
        return out
    d = _metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
    fast = (d > max_speed * np.maximum(np.diff(ts), 1e-9)) & ~cut
    past = _metres(lat[:-2], lon[:-2], lat[2:], lon[2:])
    out[1:-1] = fast[:-1] & fast[1:] & (past < np.minimum(d[:-1], d[1:]))
    return out


def regimes(step_m: np.ndarray, step_s: np.ndarray, breaks: np.ndarray, radius_m: float, penalty: float) -> np.ndarray:
    """True for moving steps: the two-regime segmentation with the least cost plus ``penalty`` per change.

    A step's cost in the wrong regime grows with the logarithm of its displacement over the reach of resting noise
    (1.5 radii); a step as slow as creeping noise counts half. A gap break resets the chain at no cost.
    """
    score = np.clip(np.log2((step_m + 1.0) / (1.5 * radius_m)), -1.0, 1.0)
    creeping = (score > 0) & (step_m < 0.05 * step_s)
    score[creeping] *= 0.5
    rest, move = np.maximum(score, 0.0).tolist(), np.maximum(-score, 0.0).tolist()
    cut = breaks.tolist()
    a = b = 0.0
    came_a, came_b = [], []
    for k in range(len(rest)):
        free = 0.0 if cut[k] else penalty
        from_b, from_a = b + free < a, a + free < b
        a, b = (b + free if from_b else a) + rest[k], (a + free if from_a else b) + move[k]
        came_a.append(from_b)
        came_b.append(from_a)
    moving = np.zeros(len(rest), bool)
    state = b < a
    for k in range(len(rest) - 1, -1, -1):
        moving[k] = state
        if came_b[k] if state else came_a[k]:
            state = not state
    return moving


def _spots(lat: np.ndarray, lon: np.ndarray, radius_m: float) -> list[tuple[int, int]]:
    """Cuts a resting run into maximal stretches within the radius of one place (first, last index), greedily.

    One stretch almost always; only drifts from place to place in short steps take the second branch.
    """
    x, y = lon * np.cos(lat.mean()) * EARTH_M, lat * EARTH_M
    mid_x, mid_y = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
    if np.hypot(x - mid_x, y - mid_y).max() <= radius_m:
        return [(0, len(x) - 1)]
    out, at = [], 0
    while at < len(x):
        lo_x, hi_x = np.minimum.accumulate(x[at:]), np.maximum.accumulate(x[at:])
        lo_y, hi_y = np.minimum.accumulate(y[at:]), np.maximum.accumulate(y[at:])
        wide = np.hypot(hi_x - lo_x, hi_y - lo_y) > 2 * radius_m
        size = int(wide.argmax()) if wide.any() else len(wide)
        out.append((at, at + max(size, 1) - 1))
        at += max(size, 1)
    return out


_EVENTS = "user string, chunk bigint, kind string, ts bigint, end_ts bigint, lat double, lon double, pings bigint, m0 double, m1 double, total double"


def _events(user: np.ndarray, chunk: np.ndarray, ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, rules: StopRules) -> pd.DataFrame:
    """Stops, breaks and chunk totals of whole (user, chunk) groups, sorted by user, chunk, time and position."""

    def changes() -> np.ndarray:
        return (chunk[1:] != chunk[:-1]) | (user[1:] != user[:-1])

    def keep(mask: np.ndarray) -> None:
        nonlocal user, chunk, ts, lat, lon
        user, chunk, ts, lat, lon = user[mask], chunk[mask], ts[mask], lat[mask], lon[mask]

    again = ~changes() & (ts[1:] == ts[:-1]) & (lat[1:] == lat[:-1]) & (lon[1:] == lon[:-1])
    keep(np.concatenate([[True], ~again]))
    lat, lon = np.radians(lat), np.radians(lon)
    keep(~jumps(ts, lat, lon, changes(), rules.max_speed))
    cut = changes()
    step_m, step_s = _metres(lat[:-1], lon[:-1], lat[1:], lon[1:]), np.diff(ts).astype(float)
    silent = cut | (step_s > rules.gap_s)
    moving = regimes(step_m, step_s, silent, rules.radius_m, rules.penalty)
    edge = np.flatnonzero(moving | silent)
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(ts) - 1]])
    long = ts[last] - ts[first] >= rules.min_s
    stops = [
        (i + a, i + b)
        for i, j in zip(first[long].tolist(), last[long].tolist())
        for a, b in _spots(lat[i : j + 1], lon[i : j + 1], rules.radius_m)
        if ts[i + b] - ts[i + a] >= rules.min_s
    ]
    along = np.concatenate([[0.0], np.cumsum(np.where(silent, 0.0, step_m))])
    own = np.floor_divide(ts, rules.chunk_s) == chunk
    opens = np.concatenate([[True], cut])
    group = np.cumsum(opens) - 1
    start = np.flatnonzero(opens)
    at = np.arange(len(ts))
    first_own = np.minimum.reduceat(np.where(own, at, len(ts)), start)
    last_own = np.maximum.reduceat(np.where(own, at, -1), start)
    # The leg into a chunk's first ping of its own belongs to that chunk.
    before = along[np.maximum(np.minimum(first_own, len(ts) - 1) - 1, start)]
    blank = np.nan

    def rows(kind: str, at: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
        out = {"user": user[at], "chunk": chunk[at], "kind": kind, "ts": columns.pop("ts", ts[at])}
        for name, kind_of in (("end_ts", "Int64"), ("lat", float), ("lon", float), ("pings", "Int64"), ("m0", float), ("m1", float), ("total", float)):
            out[name] = pd.array(columns[name] if name in columns else [None if kind_of == "Int64" else blank] * len(at), dtype=kind_of)
        return pd.DataFrame(out)

    used = last_own >= 0
    totals = rows("chunk", start[used], total=along[last_own[used]] - before[used])
    ends = own & np.append(silent, True)
    breaks = rows("break", np.flatnonzero(ends))
    i, j = (np.array([s[k] for s in stops], np.int64) for k in (0, 1))
    base = before[group[i]] if len(i) else np.zeros(0)
    place = [(np.degrees(lat[a : b + 1].mean()), np.degrees(lon[a : b + 1].mean())) for a, b in stops]
    found = rows(
        "stop", i, end_ts=ts[j], lat=[y for y, _ in place], lon=[x for _, x in place], pings=j - i + 1,
        m0=np.where(own[i], along[i] - base, blank), m1=np.where(own[j], along[j] - base, blank),
    )
    return pd.concat([totals, breaks, found], ignore_index=True)


def _segmented(batches: Iterator[pd.DataFrame], rules: StopRules) -> Iterator[pd.DataFrame]:
    """Hands whole groups to ``_events``; the last group of a batch waits for the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        user, chunk = batch["user"].to_numpy(object), batch["chunk"].to_numpy(np.int64)
        same = (user == user[-1]) & (chunk == chunk[-1])
        tail = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        if same.all() and held and (held[-1]["user"].iloc[-1], held[-1]["chunk"].iloc[-1]) == (user[-1], chunk[-1]):
            held.append(batch)
            continue
        whole = pd.concat([*held, batch.iloc[:tail]]) if held else batch.iloc[:tail]
        held = [batch.iloc[tail:]]
        if len(whole):
            yield _from_frame(whole, rules)
    if held:
        yield _from_frame(pd.concat(held), rules)


def _from_frame(pdf: pd.DataFrame, rules: StopRules) -> pd.DataFrame:
    kinds = {"user": object, "chunk": np.int64, "ts": np.int64, "lat": float, "lon": float}
    return _events(*[pdf[c].to_numpy(k) for c, k in kinds.items()], rules)


def stops_and_trips(
    pings: DataFrame, user: str, ts: str, lat: str, lon: str, accuracy: str | None = None, rules: StopRules = StopRules()
) -> DataFrame:
    """``kind`` (stop or trip), ``user, start_ts, end_ts, duration_s, distance_m, lat, lon``.

    Usable pings: user, time and position present and finite, not (0, 0), accuracy null or at most the limit, not a
    single jump away and back. Repeated pings count once; pings of one second at different places keep the order of
    their positions. A stop lasts from its first to its last ping (distance is the path within, lat/lon its middle);
    a trip from the end of one stop to the start of the next, if no gap break lies between. Devices without stops, and
    what comes before a first or after a last stop, give no rows. An empty input gives an empty result.
    """
    acc = F.col(f"`{accuracy}`").cast("double") if accuracy else F.lit(None).cast("double")
    base = pings.select(
        F.col(f"`{user}`").cast("string").alias("user"),
        F.col(f"`{ts}`").cast("bigint").alias("ts"),
        F.col(f"`{lat}`").cast("double").alias("lat"),
        F.col(f"`{lon}`").cast("double").alias("lon"),
        acc.alias("acc"),
    )
    real = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    good = base.filter(F.col("user").isNotNull() & F.col("ts").isNotNull() & real & (F.col("acc").isNull() | (F.col("acc") <= rules.max_accuracy_m)))
    chunk, margin = rules.chunk_s, 2 * rules.gap_s
    near = lambda side: F.floor((F.col("ts") + side * margin) / chunk).cast("bigint")
    # Each ping goes to its own chunk and to those within whose margin it lies; a chunk of a device is one group.
    views = good.select("user", F.explode(F.sequence(near(-1), near(1))).alias("chunk"), "ts", "lat", "lon")
    grouped = views.repartition("user", "chunk").sortWithinPartitions("user", "chunk", "ts", "lat", "lon")
    events = grouped.mapInPandas(lambda batches: _segmented(batches, rules), _EVENTS)
    # All below is per stop, break and chunk, not per ping. One pass over the events, in order, per user.
    by_chunk = W.partitionBy("user").orderBy("chunk").rangeBetween(W.unboundedPreceding, -1)
    events = events.withColumn("_base", F.coalesce(F.sum("total").over(by_chunk), F.lit(0.0)))
    found = events.filter(F.col("kind") != "chunk").select(
        "user", "kind", "ts", F.coalesce("end_ts", "ts").alias("end_ts"), "lat", "lon", "pings", (F.col("_base") + F.col("m0")).alias("m0"), (F.col("_base") + F.col("m1")).alias("m1")
    )
    in_time = W.partitionBy("user", "kind").orderBy("ts", F.desc("end_ts"))
    earlier = F.max("end_ts").over(in_time.rowsBetween(W.unboundedPreceding, -1))
    new = (F.col("kind") == "break") | earlier.isNull() | (F.col("ts") > earlier)
    found = found.withColumn("_new", new.cast("int")).withColumn("_no", F.sum("_new").over(in_time.rowsBetween(W.unboundedPreceding, 0)))
    united = found.groupBy("user", "kind", "_no").agg(
        F.min("ts").alias("ts"),
        F.max("end_ts").alias("end_ts"),
        F.max_by("lat", "pings").alias("lat"),
        F.max_by("lon", "pings").alias("lon"),
        F.min("m0").alias("m0"),
        F.max("m1").alias("m1"),
    )
    # A break at the time of a stop's end comes after the stop.
    order = W.partitionBy("user").orderBy("ts", F.when(F.col("kind") == "stop", 0).otherwise(1))
    follows = lambda c: F.lead(c).over(order)
    linked = united.withColumns({"_kind": follows("kind"), "_ts": follows("ts"), "_m": follows("m0")}).filter(F.col("kind") == "stop")
    stop = F.struct(
        F.lit("stop").alias("kind"), F.col("ts").alias("s"), F.col("end_ts").alias("e"), (F.col("m1") - F.col("m0")).alias("m"), "lat", "lon"
    )
    nowhere = F.lit(None).cast("double")
    trip = F.struct(
        F.lit("trip").alias("kind"), F.col("end_ts").alias("s"), F.col("_ts").alias("e"), (F.col("_m") - F.col("m1")).alias("m"), nowhere.alias("lat"), nowhere.alias("lon")
    )
    parts = F.when(F.col("_kind") == "stop", F.array(stop, trip)).otherwise(F.array(stop))
    return linked.select("user", F.explode(parts).alias("p")).select(
        F.col("p.kind").alias("kind"),
        "user",
        F.col("p.s").alias("start_ts"),
        F.col("p.e").alias("end_ts"),
        (F.col("p.e") - F.col("p.s")).alias("duration_s"),
        F.col("p.m").alias("distance_m"),
        F.col("p.lat").alias("lat"),
        F.col("p.lon").alias("lon"),
    )
