"""Candidate pairs of places within a reach: every place is shuffled once, into tiles of bounded size.

The earth is cut into tiles; a tile that holds too many places is cut into 64, twice if need be, and what is left too
full (one spot, or very many seekers) is split on both sides into blocks, every block of seekers meeting every block of
places. A seeker goes to each tile its reach touches, mostly its own alone. Within tiles a grid that follows the reach
(cells between one and two reaches wide, so few candidates are not pairs) finds the pairs in arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
DEGREE_M = EARTH_M * math.pi / 180
#: Degrees of latitude of a tile, pieces of a cut tile along each side, and how often a tile is cut.
TILE_DEG, PIECES, CUTS = 0.5, 8, 2
#: Places, or seekers, that one block may hold.
BLOCK = 50_000
#: Hot tiles (at most one for each BLOCK places) are broadcast up to this many, else joined.
BROADCAST_ROWS = 500_000
#: Reaches are taken by powers of two from this one on; pairs are laid out so many at a time.
LEAST_M, PAIRS = 1 / 64, 2_000_000


def _around(strip: Column, height: float) -> Column:
    """Tiles along the parallel in a strip: as many as keep each at least as wide as the strip is high."""
    furthest = F.least(F.greatest(F.abs(strip * height - 90), F.abs((strip + 1) * height - 90)), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(furthest)) / height)).cast("bigint")


def _key(level: int, strip: Column, cell: Column) -> Column:
    return (F.lit(level << 50) + F.shiftleft(strip.cast("bigint"), 25) + cell).cast("bigint")


def _own_key(level: int) -> Column:
    """The tile of a place (x, y): strips and the cells along them are nested in those of the level before."""
    k = PIECES**level
    strip = F.floor((F.col("y") + 90) / TILE_DEG)
    cells = _around(strip, TILE_DEG) * k
    return _key(level, F.floor((F.col("y") + 90) / TILE_DEG * k), F.pmod(F.floor((F.col("x") + 180) / 360.0 * cells), cells))


def _hot(keys: DataFrame) -> tuple[DataFrame, int]:
    """Keys (``key``) of more than BLOCK rows with their ``_rows``, and how many there are."""
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > BLOCK)
    count = hot.count()
    return (F.broadcast(hot) if count <= BROADCAST_ROWS else hot), count


def _divided(df: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is not hot, and those whose is."""
    marked = df.join(hot.select("key", F.lit(True).alias("_hot")), "key", "left")
    return marked.filter(F.col("_hot").isNull()).drop("_hot"), marked.filter(F.col("_hot")).drop("_hot")


def _seeking(seekers: DataFrame) -> DataFrame:
    """Seekers (i, sx, sy, sr) with the tiles that their reach touches: strip ``s``, cell ``c`` (not wrapped), ``n`` around."""
    reach = F.col("sr") / DEGREE_M * 1.01  # degrees of latitude; the margin covers the ellipsoid
    ratio = F.sin(F.radians(F.least(reach, F.lit(89.0)))) / F.greatest(F.cos(F.radians(F.col("sy"))), F.lit(1e-12))
    wide = (ratio >= 1.0) | (F.abs("sy") + reach >= 90) | (reach >= 89.0)
    spread = F.when(wide, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.001)
    out = seekers.withColumns({"_reach": reach, "_wide": wide, "_spread": spread})
    first = F.greatest(F.lit(0), F.floor((F.col("sy") - F.col("_reach") + 90) / TILE_DEG))
    last = F.least(F.lit(int(180 / TILE_DEG)), F.floor((F.col("sy") + F.col("_reach") + 90) / TILE_DEG))
    out = out.withColumn("s", F.explode(F.sequence(first, last))).withColumn("n", _around(F.col("s"), TILE_DEG))
    lo, hi = (F.floor((F.col("sx") + side * F.col("_spread") + 180) / 360.0 * F.col("n")) for side in (-1, 1))
    # Where the reach goes all around, so that it may end in the cell it begins in, all pieces of the cells count.
    out = out.withColumn("_wide", F.col("_wide") | (hi - lo + 1 >= F.col("n")))
    out = out.withColumn("c", F.explode(F.sequence(lo, F.least(hi, lo + F.col("n") - 1))))
    return out.withColumn("key", _key(0, F.col("s"), F.pmod("c", "n")))


def _seeking_within(cut: DataFrame, level: int) -> DataFrame:
    """The pieces, of tiles of the level before, that the reach touches."""
    k = PIECES**level
    s0, s1 = F.col("s") * PIECES, F.col("s") * PIECES + PIECES - 1
    first = F.greatest(s0, F.floor((F.col("sy") - F.col("_reach") + 90) / TILE_DEG * k))
    last = F.least(s1, F.floor((F.col("sy") + F.col("_reach") + 90) / TILE_DEG * k))
    out = cut.filter(first <= last).withColumn("s", F.explode(F.sequence(first, last)))
    c0, c1, n = F.col("c") * PIECES, F.col("c") * PIECES + PIECES - 1, F.col("n") * PIECES
    lo, hi = (F.floor((F.col("sx") + side * F.col("_spread") + 180) / 360.0 * n) for side in (-1, 1))
    lo, hi = F.when(F.col("_wide"), c0).otherwise(F.greatest(c0, lo)), F.when(F.col("_wide"), c1).otherwise(F.least(c1, hi))
    out = out.filter(lo <= hi).withColumn("c", F.explode(F.sequence(lo, hi))).withColumn("n", n)
    return out.withColumn("key", _key(level, F.col("s"), F.pmod("c", "n")))


#: What a row is in its block: a place, a seeker, or (3) both.
PLACE, SEEKER = 1, 2


def _placed(wanted: DataFrame, places: DataFrame, level: int, same: bool) -> DataFrame:
    """Rows ``key, id, x, y, r, role`` of seekers and places; where both are the same, one row is both in its own tile."""
    here = F.when(F.col("key") == _own_key(level), PLACE + SEEKER).otherwise(SEEKER) if same else F.lit(SEEKER)
    who = wanted.select("key", F.col("i").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sr").alias("r"))
    who = who.select("*", here.cast("tinyint").alias("role"))
    return who if same else who.unionByName(places.select("key", "id", "x", "y", F.lit(None).cast("double").alias("r"), F.lit(PLACE).cast("tinyint").alias("role")))


def _full(rows: DataFrame) -> DataFrame:
    """Keys with more seekers or places than one block may hold, and into how many blocks each side goes."""
    sums = [F.sum((F.col("role").bitwiseAND(bit) > 0).cast("bigint")).alias(n) for bit, n in ((SEEKER, "_w"), (PLACE, "_h"))]
    tally = rows.groupBy("key").agg(*sums).filter(((F.col("_w") > BLOCK) | (F.col("_h") > BLOCK)) & (F.col("_w") > 0) & (F.col("_h") > 0))
    return tally.select("key", F.ceil(F.col("_w") / BLOCK).cast("int").alias("_a"), F.ceil(F.col("_h") / BLOCK).cast("int").alias("_b"))


def _cut(wanted: DataFrame, places: DataFrame, same: bool) -> DataFrame:
    """The rows with the tiles that hold too many places cut into pieces."""
    parts: list[DataFrame] = []
    for level in range(CUTS + 1):
        hot, count = _hot(places.select("key")) if level < CUTS else (None, 0)
        if not count:
            return _union([*parts, _placed(wanted, places, level, same)])
        cold, wanted = _divided(wanted, hot)
        cold_places, places = _divided(places, hot)
        parts.append(_placed(cold, cold_places, level, same))
        wanted, places = _seeking_within(wanted, level + 1), places.withColumn("key", _own_key(level + 1))
    raise AssertionError("the last level is not cut")


def _split(rows: DataFrame) -> DataFrame:
    """The rows with their ``block``: where a tile has too many seekers or places for one, both are split and every block
    of one side meets every block of the other."""
    full = _full(rows)
    split = rows.join(F.broadcast(full) if full.count() <= BROADCAST_ROWS else full, "key", "left")
    apart = F.filter(F.array(*[F.lit(bit).cast("tinyint") for bit in (PLACE, SEEKER)]), lambda bit: bit.bitwiseAND(F.col("role")) > 0)
    split = split.withColumn("role", F.explode(F.when(F.col("_a").isNull(), F.array("role")).otherwise(apart)))
    a, b, seeks = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1)), F.col("role") == SEEKER
    own = F.pmod(F.xxhash64("id"), F.when(seeks, a).otherwise(b)).cast("int")
    other = F.sequence(F.lit(0), F.when(seeks, b).otherwise(a) - 1)
    blocks = F.transform(other, lambda o: F.when(seeks, own * b + o).otherwise(o * b + own))
    return split.withColumn("block", F.explode(F.when(F.col("_a").isNull(), F.array(F.lit(0))).otherwise(blocks))).select(*rows.columns, "block")


def within_reach(seekers: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``i, id, sx, sy, sr, x, y, r``: pairs of ``seekers`` (i, sx, sy, reach sr in metres) and places ``held`` (id, x, y).

    Every pair within the seeker's reach comes once, and others at most 1 % beyond it; distances are for the caller.
    Without ``held`` the seekers are the places too (each finds itself as well), r is then the reach of the place, else
    null. ``i`` and ``id`` must be of one type, positions usable, reaches positive. Counts of places by tile are read
    before the join is planned, so what is costly to compute should be written first.
    """
    wanted = _seeking(seekers)
    places = (seekers.select(F.col("i").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y")) if held is None else held.select("id", "x", "y")).withColumn("key", _own_key(0))
    rows = _placed(wanted, places, 0, held is None)
    if not _full(rows).isEmpty():
        rows = _split(_cut(wanted, places, held is None))
    else:
        rows = rows.withColumn("block", F.lit(0))
    kind = dict(rows.dtypes)["id"]
    placed = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return placed.mapInPandas(_joined, f"i {kind}, id {kind}, sx double, sy double, sr double, x double, y double, r double")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _joined(batches: Iterator[pd.DataFrame], least_rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Hands whole blocks on, many at a time; the last block of what has come waits for the next batch."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < least_rows:
            continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        key, block = rows["key"].to_numpy(), rows["block"].to_numpy()
        same = (key == key[-1]) & (block == block[-1])
        tail = 0 if same.all() else len(rows) - int(np.argmin(same[::-1]))
        if tail:
            yield from _pairs(rows.iloc[:tail])
        held, size = [rows.iloc[tail:]], len(rows) - tail
        if not tail:
            size = min(size, least_rows - 1)  # one block only so far
    if held:
        yield from _pairs(pd.concat(held, ignore_index=True))


def _cells(strip: np.ndarray, height: float) -> np.ndarray:
    furthest = np.minimum(np.maximum(np.abs(strip * height - 90), np.abs((strip + 1) * height - 90)), 90.0)
    return np.maximum(1, np.floor(360.0 * np.cos(np.radians(furthest)) / height)).astype(np.int64)


def _code(strip: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """One number for a cell: the smallest cells make up less than 2**31 strips of less than 2**32 cells."""
    return (strip << 32) + cell


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] of them, for each k, end to end."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs within the blocks of ``rows``."""
    key, block = rows["key"].to_numpy(), rows["block"].to_numpy()
    group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(block) != 0)])).astype(np.int64)
    ids, x, y, r = rows["id"].to_numpy(), rows["x"].to_numpy(float), rows["y"].to_numpy(float), rows["r"].to_numpy(float)
    role = rows["role"].to_numpy()
    seekers, places = np.flatnonzero(role & SEEKER), np.flatnonzero(role & PLACE)
    if not len(seekers) or not len(places):
        return
    power = np.clip(np.ceil(np.log2(r[seekers] / LEAST_M)), 0, 40).astype(int)
    for p in np.unique(power).tolist():
        who = seekers[power == p]
        present = np.zeros(group[-1] + 1, bool)
        present[group[who]] = True
        near = places[present[group[places]]]
        height = min(LEAST_M * 2.0**p * 1.01 / DEGREE_M, 180.0)
        strip = np.floor((y[near] + 90) / height).astype(np.int64)
        around = _cells(strip, height)
        code = _code(strip, np.mod(np.floor((x[near] + 180) / 360.0 * around).astype(np.int64), around))
        order = np.argsort(code, kind="stable")
        near, code = near[order], code[order]
        reach = r[who] / DEGREE_M * 1.01
        first = np.maximum(np.floor((y[who] - reach + 90) / height), 0).astype(np.int64)
        last = np.minimum(np.floor((y[who] + reach + 90) / height), np.floor(180 / height)).astype(np.int64)
        k = np.repeat(np.arange(len(who)), last - first + 1)
        strip = _ranges(first, last - first + 1)
        around = _cells(strip, height)
        ratio = np.sin(np.radians(np.minimum(reach, 89.0))) / np.maximum(np.cos(np.radians(y[who])), 1e-12)
        wide = (ratio >= 1.0) | (np.abs(y[who]) + reach >= 90) | (reach >= 89.0)
        spread = np.where(wide, 180.0, np.degrees(np.arcsin(np.minimum(ratio, 1.0))) * 1.001)
        lo = np.floor((x[who][k] - spread[k] + 180) / 360.0 * around).astype(np.int64)
        hi = np.minimum(np.floor((x[who][k] + spread[k] + 180) / 360.0 * around).astype(np.int64), lo + around - 1)
        cells = hi - lo + 1
        for a, b in _portions(cells):
            at = np.repeat(np.arange(a, b), cells[a:b])
            cell = np.mod(_ranges(lo[a:b], cells[a:b]), around[at])
            wanted = _code(strip[at], cell)
            left = np.searchsorted(code, wanted, "left")
            count = np.searchsorted(code, wanted, "right") - left
            some = np.flatnonzero(count)
            for c, d in _portions(count[some]):
                part = some[c:d]
                s = np.repeat(who[k[at[part]]], count[part])
                h = near[_ranges(left[part], count[part])]
                u = np.sin(np.radians(y[h] - y[s]) / 2) ** 2 + np.cos(np.radians(y[s])) * np.cos(np.radians(y[h])) * np.sin(np.radians(x[h] - x[s]) / 2) ** 2
                good = np.flatnonzero((2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(u, 1.0))) <= r[s] * 1.01) & (group[h] == group[s]))
                if len(good):
                    s, h = s[good], h[good]
                    yield pd.DataFrame({"i": ids[s], "id": ids[h], "sx": x[s], "sy": y[s], "sr": r[s], "x": x[h], "y": y[h], "r": r[h]})


def _portions(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches whose counts make up about PAIRS, a larger one on its own."""
    upto, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        yield lo, hi
        lo = hi
