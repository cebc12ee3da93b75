"""Hexagonal cells of points, their outlines, and coverages of points and polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import hexgrid
from terravane.sources.spatial import RINGS, flat_rings, split_rings, text_map, with_centres
from terravane.stream import Kind

#: Cells that one tile of a polygon may hold, about.
TILE_CELLS = 20_000
DEGREE_M = np.pi * hexgrid.EARTH_M / 180


def _once(udf):  # noqa: ANN001, ANN202 - a pandas UDF
    """The UDF, which the optimiser must not copy: it puts a filter before what is exploded or tested, and would compute it twice."""
    return udf.asNondeterministic()


def cell_column(lat: Column, lon: Column, level: int = 9) -> Column:
    """Hexadecimal cell of a position; null for missing or non-finite ones."""
    if not 0 <= level <= 15:
        raise ValueError("levels are 0 to 15")

    @F.pandas_udf("string")
    def cell(y: pd.Series, x: pd.Series) -> pd.Series:
        found = hexgrid.encode(y.to_numpy(float, na_value=np.nan), x.to_numpy(float, na_value=np.nan), level)
        return pd.Series([format(c, "x") if c else None for c in found.tolist()])

    return cell(lat.cast("double"), lon.cast("double"))


def _parsed(text: str | None) -> int | None:
    try:
        cell = int(text, 16)
    except (TypeError, ValueError):
        return None
    return cell if hexgrid.valid(cell) else None


def cell_polygons(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """POLYGON rows of the outlines of hexadecimal cells, with the columns ``keep`` as properties; others give no row."""

    @F.pandas_udf(RINGS)
    def outline(cells: pd.Series) -> pd.Series:
        out = []
        for cell in map(_parsed, cells):
            if cell is None:
                out.append(None)
                continue
            edge = hexgrid.boundary(cell)
            edge = np.concatenate([edge, edge[:1]])
            out.append([[{"lon": float(x), "lat": float(y)} for y, x in edge]])
        return pd.Series(out)

    rows = df.select(_once(outline)(F.col(f"`{column}`").cast("string")).alias("rings"), text_map(df, keep).alias("props"))
    return with_centres(rows.filter(F.col("rings").isNotNull()))


def _contains(rings: list[np.ndarray], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, planar; points meet edges in blocks."""
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, 0) for r in rings])
    slanted = a[:, 1] != b[:, 1]
    (ax, ay), (bx, by) = a[slanted].T, b[slanted].T
    slope = (bx - ax) / (by - ay)
    out = np.zeros(len(lat), bool)
    for at in range(0, len(lat), block := max(1, 500_000 // max(1, len(ax)))):
        y, x = lat[at : at + block, None], lon[at : at + block, None]
        crosses = ((ay > y) != (by > y)) & (ax + (y - ay) * slope > x)
        out[at : at + block] = crosses.sum(1) % 2 == 1
    return out


def _fill(rings: list[np.ndarray], level: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """Cells whose centres lie in the polygon and in the half-open box (west, south, east, north)."""
    west, south, east, north = box
    # Only the part of the box that the shell reaches is sampled.
    (w, s), (e, n) = rings[0].min(0), rings[0].max(0)
    w, s, e, n = max(w, west), max(s, south), min(e, east), min(n, north)
    if w > e or s > n:
        return np.zeros(0, np.uint64)
    step = 0.7 * hexgrid.edge_m(level) / DEGREE_M
    ys = np.clip(np.arange(s - step, n + 2 * step, step), -90, 90)
    # Each row of samples has the spacing of its latitude.
    apart = step / np.maximum(np.cos(np.radians(ys)), step / 360)
    counts = np.ceil((e - w) / apart).astype(int) + 3
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    cells = np.unique(hexgrid.encode(np.repeat(ys, counts), w + (k - 1) * np.repeat(apart, counts), level))
    lat, lon = hexgrid.centres(cells)
    keep = (lon >= west) & (lon < east) & (lat >= south) & (lat < north)
    cells, lat, lon = cells[keep], lat[keep], lon[keep]
    return cells[_contains(rings, lat, lon)]


def _tiles(polygons: DataFrame, level: int) -> DataFrame:
    """Polygons once for each tile of their extent, so a large one is spread over tasks."""
    cell_m2 = 4 * np.pi * hexgrid.EARTH_M**2 / (2 + 120 * 7**level)
    size = float(min(30.0, max(1e-4, np.sqrt(TILE_CELLS * cell_m2) / DEGREE_M)))
    shell = F.col("rings")[0]
    bound = lambda f, axis: f(F.transform(shell, lambda p: p[axis]))
    number = lambda f, axis: F.floor(bound(f, axis) / size)
    tiled = polygons.withColumn("_tx", F.explode(F.sequence(number(F.array_min, "lon"), number(F.array_max, "lon"))))
    tiled = tiled.withColumn("_ty", F.explode(F.sequence(number(F.array_min, "lat"), number(F.array_max, "lat")))).withColumn("_size", F.lit(size))
    # Little data, much work: spread by number, which adaptive execution does not undo.
    return tiled.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_tx", "_ty", F.xxhash64(F.col("rings")))


def _box(tx: int, ty: int, size: float) -> tuple[float, float, float, float]:
    return tx * size, ty * size, (tx + 1) * size, (ty + 1) * size


def uniform_coverage(df: DataFrame, kind: Kind, level: int = 9) -> DataFrame:
    """``props, _hash``, distinct: cells of one level with their centre in a polygon, or the cell of a point and those
    as many rings around it as its radius has cell edges (one at least, if it has a radius)."""
    keyed = df.withColumn("_p", F.to_json("props"))
    if kind is Kind.POINT:

        @F.pandas_udf("array<string>")
        def around(lat: pd.Series, lon: pd.Series, radius: pd.Series) -> pd.Series:
            cells = hexgrid.encode(lat.to_numpy(float), lon.to_numpy(float), level)
            r = radius.to_numpy(float, na_value=np.nan)
            steps = np.where(np.isnan(r), 0, np.maximum(1, np.nan_to_num(r) // hexgrid.edge_m(level))).astype(int)
            out = pd.Series([[]] * len(cells))
            for k in np.unique(steps):
                rows = np.flatnonzero((steps == k) & (cells > 0))
                for row, near in zip(rows, hexgrid.rings_of(cells[rows], int(k))):
                    out[row] = [format(c, "x") for c in sorted(near)]
            return out

        cells = keyed.withColumn("_cells", _once(around)("lat", "lon", "radius")).select("_p", F.explode("_cells").alias("_hash"))
    else:

        @F.pandas_udf("array<string>")
        def filled(lon: pd.Series, lat: pd.Series, n: pd.Series, tx: pd.Series, ty: pd.Series, size: pd.Series) -> pd.Series:
            rows = zip(map(split_rings, lon, lat, n), map(_box, tx, ty, size))
            return pd.Series([[format(c, "x") for c in _fill(rings, level, box).tolist()] for rings, box in rows])

        cells = _tiles(keyed, level).withColumn("_cells", _once(filled)(*flat_rings(), "_tx", "_ty", "_size")).select("_p", F.explode("_cells").alias("_hash"))
    return cells.distinct().select(F.from_json("_p", "map<string,string>").alias("props"), "_hash")


class _Compact:
    """Which cells of a polygon's coverage are free (not covered yet) and which are kept whole, level by level."""

    def __init__(self, rings: list[np.ndarray], low: int):
        self.rings, self.low = rings, low
        self._free: dict[int, bool] = {}
        self._kept: dict[int, bool] = {}

    def free(self, cells: np.ndarray, level: int) -> np.ndarray:
        """Which cells have their centre in the polygon and in no kept coarser cell."""
        new = np.array([c for c in np.unique(cells).tolist() if c not in self._free], np.uint64)
        if len(new):
            lat, lon = hexgrid.centres(new)
            fine = _contains(self.rings, lat, lon)
            for coarse in range(self.low, level):
                left = np.flatnonzero(fine)
                if len(left):
                    fine[left] = ~self.kept(hexgrid.encode(lat[left], lon[left], coarse), coarse)
            self._free.update(zip(new.tolist(), fine.tolist()))
        return np.array([self._free[c] for c in cells.tolist()], bool)

    def kept(self, cells: np.ndarray, level: int) -> np.ndarray:
        """Which cells are kept: free ones with free neighbours only."""
        new = np.array([c for c in np.unique(cells).tolist() if c not in self._kept], np.uint64)
        if len(new):
            whole = self.free(new, level)
            inner = new[whole]
            if len(inner):
                near = hexgrid.neighbours_of(inner)
                whole[whole] = self.free(near.ravel(), level).reshape(near.shape).all(1)
            self._kept.update(zip(new.tolist(), whole.tolist()))
        return np.array([self._kept[c] for c in cells.tolist()], bool)

    def _covered(self, box: tuple[float, float, float, float], level: int) -> bool:
        """Whether one kept coarser cell holds the box with some margin around; a cell is convex, so its rim tells."""
        west, south, east, north = box
        dx, dy = 0.05 * (east - west), 0.05 * (north - south)
        if max(abs(south), abs(north)) > 80:
            return False
        lon, lat = (np.array(v) for v in zip(*[(x, y) for x in (west - dx, (west + east) / 2, east + dx) for y in (south - dy, (south + north) / 2, north + dy)]))
        for coarse in range(self.low, level):
            cells = hexgrid.encode(lat, lon, coarse)
            if (cells == cells[0]).all() and self.kept(cells[:1], coarse)[0]:
                return True
        return False

    def cells(self, high: int, box: tuple[float, float, float, float]) -> Iterator[tuple[int, int]]:
        """(cell, level) with centres in the box; the last level also covers the rim, one ring beyond.

        From level to level the box is cut into smaller ones, and those that a kept cell holds are left out.
        """
        (w, s), (e, n) = self.rings[0].min(0), self.rings[0].max(0)
        west, south, east, north = max(box[0], w), max(box[1], s), min(box[2], np.nextafter(e, np.inf)), min(box[3], np.nextafter(n, np.inf))
        boxes = [(west, south, east, north)] if west < east and south < north else []
        for level in range(self.low, high + 1):
            size = BOX_CELLS * hexgrid.edge_m(level) / DEGREE_M
            boxes = [part for b in boxes for part in _cut(b, size) if not self._covered(part, level)]
            for part in boxes:
                found = _fill(self.rings, level, part)
                if not len(found):
                    continue
                rest = found[self.free(found, level)]
                kept = rest[self.kept(rest, level)] if level < high else np.unique(np.concatenate([rest, hexgrid.neighbours_of(rest).ravel()]))
                yield from ((c, level) for c in kept.tolist())


#: Edges of cells along a side of the boxes that a coverage is made in.
BOX_CELLS = 32


def _cut(box: tuple[float, float, float, float], size: float) -> Iterator[tuple[float, float, float, float]]:
    """The box in equal parts of about ``size`` degrees; neighbours share their borders exactly."""
    west, south, east, north = box
    xs, ys = (np.linspace(a, b, max(1, int(np.ceil((b - a) / size))) + 1).tolist() for a, b in ((west, east), (south, north)))
    for y0, y1 in zip(ys, ys[1:]):
        for x0, x1 in zip(xs, xs[1:]):
            yield x0, y0, x1, y1


def compact_coverage(polygons: DataFrame, low: int = 1, high: int = 9) -> DataFrame:
    """``props, _hash, _level, _parent``: coarse cells inside a polygon, finer ones towards its rim.

    A cell of a level below ``high`` is kept if it and all its neighbours have their centres in the polygon and in no
    kept coarser cell, so between two kept cells of one level and around each lie finer ones; at ``high`` the rest is
    covered, with one ring around. ``_parent`` tells polygons
    apart: a hash of shape and properties, the same in every run. Equal polygons count once.
    """
    if not 0 <= low <= high <= 15:
        raise ValueError("levels run from 0 to 15, low to high")
    keyed = polygons.select("rings", F.to_json("props").alias("_p"), F.lower(F.hex(F.xxhash64(F.to_json("rings"), F.to_json("props")))).alias("_parent"))

    @F.pandas_udf("array<struct<h:string,l:int>>")
    def covered(lon: pd.Series, lat: pd.Series, n: pd.Series, tx: pd.Series, ty: pd.Series, size: pd.Series) -> pd.Series:
        rows = zip(map(split_rings, lon, lat, n), map(_box, tx, ty, size))
        return pd.Series([[{"h": format(c, "x"), "l": level} for c, level in _Compact(rings, low).cells(high, box)] for rings, box in rows])

    tiled = _tiles(keyed, high).withColumn("_cells", _once(covered)(*flat_rings(), "_tx", "_ty", "_size"))
    cells = tiled.select("_p", "_parent", F.explode("_cells").alias("c"))
    cells = cells.select("_p", "_parent", F.col("c.h").alias("_hash"), F.col("c.l").alias("_level")).distinct()
    return cells.select(F.from_json("_p", "map<string,string>").alias("props"), "_hash", "_level", "_parent")


__all__ = ["cell_column", "cell_polygons", "compact_coverage", "uniform_coverage"]
