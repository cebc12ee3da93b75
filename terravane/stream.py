"""Named datasets: a DataFrame and what its rows are.

Columns by kind. PLAIN: ``value``. CSV and FIXED: the named columns. KV: ``_key`` and the value's columns. POINT: ``lat,
lon, radius, props``. POLYGON: ``rings`` (arrays of struct lon, lat; the first is the shell), ``center_lat, center_lon,
props``. TRACK, one row per point: ``_userid, _trk`` (one user may have several tracks)``, seg_ord, _track_id, pt_ord, _ts, lat, lon, track_props, seg_props, props``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame


class Kind(Enum):
    PLAIN = "Plain"
    CSV = "CSV"
    FIXED = "Fixed"
    KV = "KeyValue"
    POINT = "Point"
    POLYGON = "Polygon"
    TRACK = "Track"
    PASSTHRU = "Passthru"


KEY = "_key"
POINT_COLUMNS = ["lat", "lon", "radius", "props"]
POLYGON_COLUMNS = ["rings", "center_lat", "center_lon", "props"]
TRACK_COLUMNS = ["_userid", "_trk", "seg_ord", "_track_id", "pt_ord", "_ts", "lat", "lon", "track_props", "seg_props", "props"]
COLUMNAR = (Kind.CSV, Kind.FIXED, Kind.KV)


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    kind: Kind = Kind.CSV
    name: str = ""

    def named(self, name: str) -> Stream:
        return replace(self, name=name)

    @property
    def columns(self) -> list[str]:
        """Value columns: those of a pair's value, without its key."""
        return [c for c in self.df.columns if c != KEY] if self.kind is Kind.KV else self.df.columns


def anonymous(names: list[str]) -> list[str]:
    """Names of columns with ``_`` replaced by ``_N_``, N counted from 1."""
    return [f"_{i}_" if n == "_" else n for i, n in enumerate(names, 1)]
