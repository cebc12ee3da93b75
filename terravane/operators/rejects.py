"""Delimited text lines: typed rows on one side, unfit lines with their reason on the other.

Each Arrow batch is indexed structurally with numpy. A mask of the quote bytes and its running count give,
at every delimiter, the parity of quotes since the start of the line; delimiters at even parity are field
ends, so fields of all lines are found without a per-line loop. Checks of types are counts over the same index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"
SPARK_TYPES = {"int64": T.LongType(), "decimal": T.DoubleType(), "uuid": T.StringType(), "text": T.StringType()}


@dataclass(frozen=True)
class Field:
    """A declared column. kind: int64, decimal (finite double), uuid (8-4-4-4-12 hex) or text; ``limit`` bounds |value|.

    Only text may be empty.
    """

    name: str
    kind: str
    limit: float | None = None


@dataclass(frozen=True)
class ParsedLines:
    """``parsed`` has the input's columns, ``_reason`` (null for fitting lines) and ``_fields``, a struct of typed values."""

    parsed: DataFrame
    fields: tuple[Field, ...]

    def rejects(self) -> DataFrame:
        """Unfit lines as they came, with ``_reason``."""
        return self.parsed.filter(F.col("_reason").isNotNull()).drop("_fields")

    def valid(self) -> DataFrame:
        """Fitting lines with typed columns; an input column with the name of a field becomes ``<name>_in``."""
        names = {f.name.lower() for f in self.fields}
        kept = [c for c in self.parsed.columns if c not in ("_reason", "_fields")]
        return self.parsed.filter(F.col("_reason").isNull()).select(
            *[F.col(f"`{c}`").alias(f"{c}_in" if c.lower() in names else c) for c in kept],
            *[F.col("_fields").getField(f.name).alias(f.name) for f in self.fields],
        )


class _Index:
    """Field bounds of all lines of a batch, and which lines break the quoting rules."""

    def __init__(self, lines: pa.LargeStringArray, delimiter: int):
        size = len(lines)
        bounds = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + size + 1]
        raw = lines.buffers()[2]
        self.data = data = np.frombuffer(raw, np.uint8)[: bounds[-1]] if raw and raw.size else np.zeros(0, np.uint8)
        begin, end = bounds[:-1], bounds[1:].copy()
        long = np.flatnonzero(end > begin)
        end[long] -= data[end[long] - 1] == 13
        self.quotes = quotes = np.flatnonzero(data == 34)
        commas = np.flatnonzero(data == delimiter)
        commas = commas[commas >= bounds[0]]
        line = np.searchsorted(begin, commas, "right") - 1
        parity = (np.searchsorted(quotes, commas) - np.searchsorted(quotes, begin)[line]) & 1
        commas, line = commas[parity == 0], line[parity == 0]
        self.count = 1 + np.bincount(line, minlength=size)
        self.start = np.sort(np.concatenate([begin, commas + 1]))
        self.end = np.sort(np.concatenate([end, commas]))
        self.line = np.repeat(np.arange(size), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64) if size else np.zeros(0, np.int64)
        filled = (data != 32) & (data != 9)
        self.filled = np.flatnonzero(filled)
        lo, hi = np.searchsorted(quotes, self.start), np.searchsorted(quotes, self.end)
        self.in_field = hi - lo
        self.quoted = self.in_field > 0
        self.broken = np.zeros(size, bool)
        with_quotes = np.flatnonzero(self.quoted)
        if len(with_quotes):
            q_lo, q_hi, n = lo[with_quotes], hi[with_quotes], self.in_field[with_quotes]
            self.close = np.zeros(len(self.start), np.int64)
            self.close[with_quotes] = quotes[q_hi - 1]
            tail = np.searchsorted(self.filled, self.end[with_quotes]) - np.searchsorted(self.filled, quotes[q_hi - 1] + 1)
            bad = (n & 1 == 1) | (quotes[q_lo] != self.start[with_quotes]) | (tail > 0)
            at = np.repeat(q_lo, n) + (local := np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            inner = np.flatnonzero((local & 1 == 1) & (local < np.repeat(n, n) - 1))
            apart = inner[quotes[at[inner] + 1] != quotes[at[inner]] + 1]
            bad[np.repeat(np.arange(len(n)), n)[apart]] = True
            self.broken[self.line[with_quotes[bad]]] = True

    def content(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the fields' values: without the enclosing quotes, or without the blanks around an unquoted one."""
        start, end = self.start[which].copy(), self.end[which].copy()
        q = self.quoted[which]
        if q.any():
            start[q] += 1
            end[q] = self.close[which][q]
        if len(self.filled):
            s, e = start[~q], end[~q]
            i = np.searchsorted(self.filled, s)
            ahead = np.where(i < len(self.filled), self.filled[np.minimum(i, len(self.filled) - 1)], e)
            j = np.searchsorted(self.filled, e) - 1
            behind = np.where(j >= 0, self.filled[np.maximum(j, 0)] + 1, s)
            start[~q] = np.minimum(ahead, e)
            end[~q] = np.maximum(behind, start[~q])
        else:
            end[~q] = start[~q]
        return start, end


class _Counts:
    """Running counts of digits and of other bytes that numbers may hold."""

    def __init__(self, data: np.ndarray):
        run = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        self.data = np.concatenate([data, [0]]).astype(np.uint8)
        self.digits, self.points = run((data >= 48) & (data <= 57)), run(data == 46)
        self.powers = np.flatnonzero((data == 101) | (data == 69))
        self.hexes = run(((data >= 48) & (data <= 57)) | ((data | 32 >= 97) & (data | 32 <= 102)))

    def sign(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return s + ((e > s) & ((self.data[s] == 43) | (self.data[s] == 45)))

    def whole(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (e > s) & (self.digits[e] - self.digits[s] == e - s)

    def integer(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self.whole(self.sign(s, e), e)

    def decimal(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        s = self.sign(s, e)
        lo, hi = np.searchsorted(self.powers, s), np.searchsorted(self.powers, e)
        power = hi - lo == 1
        stop = e.copy()
        if len(self.powers):
            stop[power] = self.powers[lo[power]]
        digits, points = self.digits[stop] - self.digits[s], self.points[stop] - self.points[s]
        fine = (hi - lo <= 1) & (points <= 1) & (digits >= 1) & (digits + points == stop - s)
        after = np.minimum(stop + 1, e)
        return fine & (~power | self.whole(self.sign(after, e), e))

    def uuid(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        fine = e - s == 36
        at = s[fine]
        dashes = np.ones(len(at), bool)
        for k in (8, 13, 18, 23):
            dashes &= self.data[at + k] == 45
        fine[fine] = dashes & (self.hexes[at + 36] - self.hexes[at] == 32)
        return fine


def _typed(field: Field, index: _Index, counts: _Counts, which: np.ndarray) -> tuple[np.ndarray, list]:
    """Which of the fields are fit, and the values of those (None elsewhere)."""
    start, end = index.content(which)
    raw = index.data.tobytes()
    if field.kind == "text":
        doubled = index.in_field[which] > 2
        values = [raw[a:b].replace(b'""', b'"') if d else raw[a:b] for a, b, d in zip(start, end, doubled)]
        return np.ones(len(which), bool), [v.decode("utf-8") for v in values]
    fit = {"int64": counts.integer, "decimal": counts.decimal, "uuid": counts.uuid}[field.kind](start, end)
    values: list = [None] * len(which)
    for k in np.flatnonzero(fit):
        piece = raw[start[k] : end[k]]
        if field.kind == "uuid":
            values[k] = piece.decode("ascii")
            continue
        if field.kind == "int64":
            # 19 digits hold every 64-bit value; zeros in front do not count.
            value = int(piece) if len(piece.lstrip(b"+-").lstrip(b"0")) <= 19 else 1 << 64
            fine = -(1 << 63) <= value < 1 << 63
        else:
            value = float(piece)
            fine = abs(value) != float("inf")
        if fine and (field.limit is None or abs(value) <= field.limit):
            values[k] = value
        else:
            fit[k] = False
    return fit, values


def _split_batch(lines: pa.Array, fields: tuple[Field, ...], delimiter: int) -> tuple[pa.Array, pa.Array]:
    lines = lines.cast(pa.large_string()).fill_null("")
    index = _Index(lines, delimiter)
    counts = _Counts(index.data)
    reason = np.full(len(lines), None, object)
    reason[index.count != len(fields)] = COLUMN_COUNT
    reason[index.broken] = QUOTING
    good = np.flatnonzero(reason == None)  # noqa: E711
    fit, columns = np.ones(len(good), bool), []
    for k, field in enumerate(fields):
        fine, values = _typed(field, index, counts, index.first[good] + k)
        fit &= fine
        columns.append(values)
    reason[good[~fit]] = INVALID_VALUE
    arrays = []
    row = np.full(len(lines), -1)
    row[good[fit]] = np.flatnonzero(fit)
    take = pa.array(np.maximum(row, 0), mask=row < 0)
    kinds = {"int64": pa.int64(), "decimal": pa.float64()}
    for field, values in zip(fields, columns):
        source = pa.array(values, kinds.get(field.kind, pa.string()))
        arrays.append(source.take(take) if len(values) else pa.nulls(len(lines), source.type))
    nothing = pa.array(row < 0)
    return pa.array(reason.tolist(), pa.string()), pa.StructArray.from_arrays(arrays, [f.name for f in fields], mask=nothing)


def parse_lines(df: DataFrame, column: str, fields: list[Field], delimiter: str = ",") -> ParsedLines:
    """Parse each line in ``column`` against ``fields``; nothing is lost and nothing shuffles.

    Reasons, the first that applies: ``quoting`` (a quote left open, text after a closing quote, a quote within
    an unquoted field, blanks before an opening quote included), ``column_count``, ``invalid_value``.
    A null line counts as an empty one and has one field. One final carriage return is not data. Repeated rows are
    kept as they are: de-duplicate ``valid()`` or ``rejects()`` by key, whichever is needed. An empty input gives
    empty outputs. ``_reason`` and ``_fields`` of the input, if any, are replaced.
    """
    declared = tuple(fields)
    byte = ord(delimiter)
    source = df.drop("_reason", "_fields")
    schema = T.StructType(
        [
            *source.schema.fields,
            T.StructField("_reason", T.StringType()),
            T.StructField("_fields", T.StructType([T.StructField(f.name, SPARK_TYPES[f.kind]) for f in declared])),
        ]
    )
    position = source.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reason, struct = _split_batch(batch.column(position), declared, byte)
            yield pa.RecordBatch.from_arrays([*batch.columns, reason, struct], [*batch.schema.names, "_reason", "_fields"])

    return ParsedLines(source.mapInArrow(run, schema), declared)
