"""Evaluation items that leak into documents: hash anchors of the items, a scan of all windows, exact verification.

Texts are reduced to their letters and digits (markup read as in ``markup``). Any run of ``run`` characters of an item
holds, whole, one of the item's n-grams that start at multiples of ``run - gram + 1``; the hashes of those n-grams are
the broadcast set. Documents are scanned with a rolling hash over all windows of a batch at once. Hits are gathered by
item and diagonal (place in the document less place in the item) and each diagonal is compared once along its run, for
all diagonals of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.markup import letters_only, readable, traced_letters
from terravane.session import spread

#: Characters of items that one broadcast may hold (some 5 bytes each); larger sets are scanned in blocks.
BLOCK_CHARS = 32_000_000
#: Pairs of a window and an item's n-gram that are held at a time, and characters compared at a time.
PAIRS, STRIDE = 1_000_000, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def _mix(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def window_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every window of ``gram`` codes."""
    n = len(codes)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(n)
    total = np.cumsum(_mix(codes) * up, dtype=np.uint64)
    total[gram:] -= total[:-gram].copy()
    x = total[gram - 1 :] * down[: n - gram + 1]
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Anchors:
    """The items' texts, end to end, and the hashes of their n-grams at every ``run - gram + 1`` characters, sorted."""

    def __init__(self, items: list[tuple[int, str]], run: int, gram: int):
        self.run, self.gram = run, gram
        texts, hashes, places, owners = [np.zeros(1, np.uint32)], [], [], []
        self.ids: list[int] = []
        size = 1
        for number, text in items:
            codes = letters_only(readable(text or ""))
            if len(codes) < run:
                continue
            own = window_hashes(codes, gram)[:: run - gram + 1]
            hashes.append(own)
            places.append(size + np.arange(len(own)) * (run - gram + 1))
            owners.append(np.full(len(own), len(self.ids), np.int32))
            self.ids.append(number)
            texts += [codes, np.zeros(1, np.uint32)]
            size += len(codes) + 1
        # A gap between items differs from the gap between documents.
        self.text = np.concatenate(texts).astype(np.uint32)
        joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes, starts = np.unique(joined[order], return_index=True)
        self.starts = np.append(starts, len(joined)).astype(np.int64)
        self.places = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int32))[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def runs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows (text number, item number, start, end in the text) of all shared runs of ``run`` characters or more."""
        if not texts or not len(self.hashes):
            return np.zeros((0, 4), np.int64)
        gap = np.full(1, 0x110000, np.uint32)
        joined = np.concatenate([p for t in texts for p in (t, gap)])
        ends = np.cumsum([len(t) + 1 for t in texts])
        hashes = window_hashes(joined, self.gram)
        hits = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[hits]), len(self.hashes) - 1)
        real = self.hashes[at] == hashes[hits]
        hits, at = hits[real], at[real]
        wide = self.starts[at + 1] - self.starts[at]
        # Pairs are laid out for as many hits at a time as make up PAIRS, a hit with more on its own.
        found, lo, upto = [], 0, np.cumsum(wide)
        while lo < len(hits):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            n = wide[lo:hi]
            anchor = np.repeat(self.starts[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(self._verified(joined, np.repeat(hits[lo:hi], n), self.places[anchor], self.owners[anchor]))
            lo = hi
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        # A run is known by its item and start; pairs that were laid out apart may have found it twice.
        rows = rows[np.unique(rows[:, 0] * len(joined) + rows[:, 1], return_index=True)[1]]
        number = np.searchsorted(ends, rows[:, 1], "right")
        begin = np.concatenate([[0], ends[:-1]])[number] if len(rows) else np.zeros(0, np.int64)
        return np.column_stack([number, rows[:, 0], rows[:, 1] - begin, rows[:, 2] - begin])

    def _verified(self, joined: np.ndarray, p: np.ndarray, q: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows (item number, start, end) of the runs through pairs of places, each run once."""
        order = np.lexsort((p, p - q))
        p, q, owner = p[order], q[order], owner[order]
        line = np.cumsum(np.concatenate([[0], np.diff(p - q) != 0]))  # places of all items differ, so a diagonal has one item
        out = []
        while len(p):
            first = np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])
            a, b = p[first], q[first]
            start = a - self._reach(joined, a - 1, b - 1, -1)
            end = a + self._reach(joined, a, b, 1)
            long = end - start >= self.run
            out.append(np.column_stack([owner[first][long], start[long], end[long]]).astype(np.int64))
            # Later pairs of the diagonal within the run are of the same run.
            rest = ~first & (p >= np.maximum(end, a + 1)[np.cumsum(first) - 1])
            p, q, owner, line = p[rest], q[rest], owner[rest], line[rest]
        return np.concatenate(out)

    def _reach(self, joined: np.ndarray, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many characters from each pair of places on, in one direction, are equal."""
        size = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        # Signs that equal nothing stand around both texts, so that no step leaves them.
        left, right = (np.concatenate([np.full(STRIDE + 1, edge, np.uint32), t, np.full(STRIDE + 1, edge, np.uint32)]) for t, edge in ((joined, 0x110001), (self.text, 0x110002)))
        step = (np.arange(STRIDE) * way).astype(np.int32) + STRIDE + 1
        a, b = a.astype(np.int32), b.astype(np.int32)
        while len(alive):
            moved = (way * size[alive]).astype(np.int32)
            differs = left.take((a[alive] + moved)[:, None] + step) != right.take((b[alive] + moved)[:, None] + step)
            stops = differs.any(axis=1)
            size[alive] += np.where(stops, differs.argmax(axis=1), STRIDE)
            alive = alive[~stops]
        return size

    def scan(self, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text number, item, longest shared run) for all texts of a batch, runs of ``run`` characters or more only."""
        rows = self.runs(texts)
        if not len(rows):
            return []
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)]))
        longest = np.maximum.reduceat(rows[:, 3] - rows[:, 2], first)
        best: dict[tuple[int, int], int] = {}  # an id may belong to several texts
        for n, item, size in zip(rows[first, 0].tolist(), rows[first, 1].tolist(), longest.tolist()):
            key = (n, self.ids[item])
            best[key] = max(best.get(key, 0), size)
        return [(n, i, size) for (n, i), size in best.items()]


def _blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> list[DataFrame]:
    """The items in blocks of about ``block_chars`` characters, one for sets up to that."""
    clean = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).dropna()
    blocks = max(1, -(-(clean.select(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    return [clean.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else clean for b in range(blocks)]


def leaked_items(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 60, gram: int = 30, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``item_id bigint, doc_id bigint, shared``: documents that show ``run`` letters and digits in a row of an item.

    ``shared`` is the longest such run. Items shorter than ``run`` letters and digits, null texts and null ids give no
    rows; empty texts neither. Items given twice with different texts each count under their id. A document that comes
    twice gives its rows twice. Items of more than ``block_chars`` characters in all go in several broadcasts, each with
    a scan of its own, so what is broadcast is bounded whatever their number.
    """
    if not 0 < gram <= run:
        raise ValueError("gram must be between 1 and run")
    rows = spread(documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).dropna())
    context = documents.sparkSession.sparkContext
    out = None
    for part in _blocks(items, item_id, item_text, block_chars):
        anchors = context.broadcast(Anchors([(r["i"], r["t"]) for r in part.toLocalIterator()], run, gram))

        def scan(batches: Iterator[pd.DataFrame], anchors=anchors) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch["d"].to_numpy()
                for lo, texts in _letters(batch["t"]):
                    hits = anchors.value.scan(texts)
                    if hits:
                        yield pd.DataFrame([(i, ids[lo + n], size) for n, i, size in hits], columns=["item_id", "doc_id", "shared"])

        found = rows.mapInPandas(scan, "item_id bigint, doc_id bigint, shared int")
        out = found if out is None else out.unionByName(found)
    return out


#: Characters of documents that are scanned at a time (a longer document on its own).
AT_ONCE = 1_000_000


def _letters(texts: pd.Series) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Letters of the texts in parts of about AT_ONCE characters, each with the number of its first text."""
    lo, part, size = 0, [], 0
    for n, text in enumerate(texts):
        part.append(letters_only(readable(text)) if text else np.zeros(0, np.uint32))
        size += len(part[-1])
        if size >= AT_ONCE:
            yield lo, part
            lo, part, size = n + 1, [], 0
    if part:
        yield lo, part


def without_spans(documents: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 60, gram: int = 30, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with leaked spans cut out of ``text``, and ``_cut_letters``, how many letters and digits these held.

    A span is what an item shares in ``run`` letters and digits or more, from the first of them to the last with what
    stands between; overlapping spans are cut together. A command that stands for a span's text goes with it, its
    definition stays. Null and empty texts stay as they are (0 cut), as do texts without leaks, other columns pass
    through. Should letters of a text not be traceable to places in it, the whole text is cut.
    """
    if not 0 < gram <= run:
        raise ValueError("gram must be between 1 and run")
    context = documents.sparkSession.sparkContext
    if "_cut_letters" in documents.columns:
        documents = documents.drop("_cut_letters")
    out = documents.withColumn("_cut_letters", F.lit(0).cast("bigint"))
    for part in _blocks(items, item_id, item_text, block_chars):
        anchors = context.broadcast(Anchors([(r["i"], r["t"]) for r in part.toLocalIterator()], run, gram))
        inner = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("row"), F.col(f"`{text}`").alias("t"))

        def cut(batches: Iterator[pd.DataFrame], anchors=anchors) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, counts = batch["t"].to_numpy(object, copy=True), np.zeros(len(batch), np.int64)
                for lo, letters in _letters(batch["t"]):
                    found = anchors.value.runs(letters)
                    for n in np.unique(found[:, 0]).tolist():
                        spans = _united(found[found[:, 0] == n][:, 2:])
                        texts[lo + n] = _without(texts[lo + n], letters[n], spans)
                        counts[lo + n] = sum(b - a for a, b in spans)
                yield pd.DataFrame({"row": batch["row"], "t": texts, "n": counts})

        kinds = inner.schema["row"].dataType.simpleString()
        done = spread(inner).mapInPandas(cut, f"row {kinds}, t string, n bigint")
        out = done.select(
            *[F.col("t").alias(c) if c == text else (F.col("row._cut_letters") + F.col("n")).alias(c) if c == "_cut_letters" else F.col("row").getField(c).alias(c) for c in out.columns]
        )
    return out


def _united(spans: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: str, letters: np.ndarray, spans: list[tuple[int, int]]) -> str:
    codes, first, last = traced_letters(text)
    if len(codes) != len(letters) or (codes != letters).any():
        return ""
    pieces, at = [], 0
    for a, b in spans:
        start, stop = int(first[a:b].min()), int(last[a:b].max())
        pieces.append(text[at : max(at, start)])
        at = max(at, stop)
    return "".join(pieces) + text[at:]


def without_leaks(documents: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The documents that leak no item; those with a null id stay."""
    return documents.join(leaks.select(F.col("doc_id").alias("_leaky")).distinct(), F.col(f"`{doc_id}`") == F.col("_leaky"), "left_anti")
