"""Mixing sources to target weights: token counts, per-source budgets, exact filling of the rest by dynamic programming.

Documents are counted by source and exact token length. From this histogram, whose size is bounded by the number of
different lengths, each source's budget is split into whole passes over the source and a remainder; the remainder is
filled by a bounded knapsack over lengths (subset sums). Only then are documents picked, by seeded hash within a length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terravane.session import spread

#: Fixed value: the split pattern that belongs to the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def _encoding(path: str):  # noqa: ANN202 - tiktoken is imported where it runs
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(documents: DataFrame, keep: list[str], text: str, vocabulary: str) -> DataFrame:
    """Columns ``keep`` and ``_tokens``, the number of tokens of the whole text (0 for null and empty texts).

    ``vocabulary`` is a tiktoken file of ranks where the driver runs; executors get it from there.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.pop("_text")]
            batch["_tokens"] = np.array(sizes, np.int64)
            yield batch

    source = spread(documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")))
    schema = ", ".join(f"`{n}` {t}" for n, t in source.drop("_text").dtypes)
    return source.mapInPandas(run, f"{schema}, _tokens bigint" if keep else "_tokens bigint")


def length_histogram(counted: DataFrame, source: str) -> DataFrame:
    """``_source, _tokens, _docs``: documents by source and exact length; null sources are no source."""
    return (
        counted.filter(F.col(f"`{source}`").isNotNull())
        .groupBy(F.col(f"`{source}`").alias("_source"), "_tokens")
        .agg(F.count(F.lit(1)).alias("_docs"))
    )


def supply(histogram: DataFrame, targets: DataFrame, source: str, weight: str, repeats: str) -> DataFrame:
    """Per target source: ``source, weight, max_repeats, docs, tokens, budget, reachable``.

    ``budget`` is the weight's share of all tokens of sources with a target; a source is unreachable if its tokens times
    ``max_repeats`` are less. A target without documents has 0 tokens; a null weight counts as 0, null or smaller than 1
    repeats as 1; a source with several rows has their weights summed and the greatest repeats. Null sources are none.
    """
    wanted = (
        targets.filter(F.col(f"`{source}`").isNotNull())
        .groupBy(F.col(f"`{source}`").alias("source"))
        .agg(
            F.sum(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0))).alias("weight"),
            F.greatest(F.max(F.coalesce(F.col(f"`{repeats}`").cast("bigint"), F.lit(1))), F.lit(1)).alias("max_repeats"),
        )
    )
    held = histogram.groupBy("_source").agg(F.sum("_docs").alias("docs"), F.sum(F.col("_docs") * F.col("_tokens")).alias("tokens"))
    # As many rows as there are targets, so one window over all of them is small.
    joined = wanted.join(held, F.col("source") == F.col("_source"), "left").select(
        "source", "weight", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
    budget = F.col("weight") * F.sum("tokens").over(W.partitionBy(F.lit(0)))
    return joined.withColumn("budget", budget).withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= F.col("budget"))


def fill(lengths: np.ndarray, counts: np.ndarray, room: int, seed: int = 0, window: int = 1 << 17) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as close to ``room`` as can be, not above.

    Most of the room is filled in proportion to the histogram; what is left, at most ``window`` tokens or the longest
    document, is filled by a bounded knapsack over lengths whose reachable sums are kept with the piece that reached
    them first.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if room >= total:
        return counts.astype(np.int64)
    useful = (lengths > 0) & (counts > 0)
    if total and room > window:
        taken = np.where(useful, np.floor(counts * ((room - window / 2) / total)).astype(np.int64), 0)
    left = room - int((taken * lengths).sum())
    spare = np.where(useful, counts - taken, 0)
    order = np.random.default_rng(seed).permutation(np.flatnonzero(spare))
    for k in order:  # one of each length, in random order, while more is left than the window
        if left <= window:
            break
        n = min(int(spare[k]), max(1, (left - window) // int(lengths[k])))
        if n * int(lengths[k]) <= left:
            taken[k] += n
            spare[k] -= n
            left -= n * int(lengths[k])
    if left <= 0 or not spare.any():
        return taken
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    came = np.full(left + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    for k in order:
        size, n = int(lengths[k]), min(int(spare[k]), left // max(int(lengths[k]), 1))
        part = 1
        while n > 0 and not reach[left]:
            use = min(part, n)
            step = use * size
            fresh = np.flatnonzero(reach[: left + 1 - step] & ~reach[step:]) + step
            reach[fresh] = True
            came[fresh] = len(pieces)
            pieces.append((int(k), use))
            n -= use
            part *= 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, use = pieces[came[at]]
        taken[k] += use
        at -= use * int(lengths[k])
    return taken


def plan_mixture(histogram: DataFrame, supplied: DataFrame, seed: int = 0) -> DataFrame:
    """``_source, _tokens, _docs, _full, _extra``: every document of a length ``_full`` times, ``_extra`` of them once more."""
    joined = histogram.join(supplied.select(F.col("source").alias("_source"), "max_repeats", "tokens", "budget"), "_source")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_tokens")
        lengths, counts = pdf["_tokens"].to_numpy(np.int64), pdf["_docs"].to_numpy(np.int64)
        repeats, tokens, budget = int(pdf["max_repeats"].iloc[0]), int(pdf["tokens"].iloc[0]), int(round(pdf["budget"].iloc[0]))
        full = min(repeats, budget // tokens) if tokens else 0
        extra = fill(lengths, counts, budget - full * tokens, seed) if full < repeats else np.zeros(len(lengths), np.int64)
        return pd.DataFrame({"_source": key[0], "_tokens": lengths, "_docs": counts, "_full": full, "_extra": extra})

    return joined.groupBy("_source").applyInPandas(run, "_source string, _tokens bigint, _docs bigint, _full bigint, _extra bigint")


def mixture_report(plan: DataFrame, supplied: DataFrame) -> DataFrame:
    """Per target source: weight, budget, tokens reached, ``share`` of the mixture, ``repeats`` per document at most.

    ``residual_tokens`` is what the mixture holds less than the budget: of a reachable source what no choice of the
    knapsack filled, of another one what its documents lack even if all come as often as they may.
    """
    reached = plan.groupBy("_source").agg(
        F.sum(F.col("_tokens") * (F.col("_docs") * F.col("_full") + F.col("_extra"))).alias("mixed"),
        F.max(F.col("_full") + (F.col("_extra") > 0).cast("bigint")).alias("repeats"),
    )
    rows = supplied.join(reached, F.col("source") == F.col("_source"), "left").drop("_source")
    mixed = F.coalesce("mixed", F.lit(0))
    every = F.sum(mixed).over(W.partitionBy(F.lit(0)))
    return rows.select(
        "source", "weight", "max_repeats", "docs", "tokens", F.round("budget", 3).alias("budget"), "reachable",
        mixed.alias("mixed_tokens"), F.round(F.col("budget") - mixed, 3).alias("residual_tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
        F.round(F.when(every > 0, mixed / every).otherwise(0.0), 9).alias("share"),
    )


def select_documents(counted: DataFrame, doc_id: str, source: str, plan: DataFrame, seed: int = 0, buckets: int = 256) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the documents in the mixture (copies of at least 1).

    Within a length the extra documents are those with the smallest seeded hashes of their ids. Counts by hash bucket
    tell which buckets are taken whole, so ranks are needed in one bucket of each length only and no task sees all
    documents of a length, however many share it.
    """
    docs = counted.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("_source"), "_tokens", F.xxhash64(F.col(f"`{doc_id}`"), F.lit(seed)).alias("_h")
    ).withColumn("_bucket", F.pmod(F.shiftright("_h", 17), F.lit(buckets)))
    by_bucket = docs.filter(F.col("_source").isNotNull()).groupBy("_source", "_tokens", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy("_source", "_tokens").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    share = (
        by_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        .join(plan.select("_source", "_tokens", "_full", "_extra"), ["_source", "_tokens"])
        .select("_source", "_tokens", "_bucket", "_full", F.greatest(F.lit(0), F.least("_n", F.col("_extra") - F.col("_before"))).alias("_take"), "_n")
    )
    joined = docs.join(share, ["_source", "_tokens", "_bucket"])
    whole = joined.filter((F.col("_take") == F.col("_n")) | (F.col("_take") == 0)).withColumn("_one", (F.col("_take") > 0).cast("bigint"))
    rank = F.row_number().over(W.partitionBy("_source", "_tokens", "_bucket").orderBy("_h", "doc_id"))
    part = joined.filter((F.col("_take") < F.col("_n")) & (F.col("_take") > 0)).withColumn("_one", (rank <= F.col("_take")).cast("bigint"))
    return (
        whole.unionByName(part)
        .select("doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), (F.col("_full") + F.col("_one")).alias("copies"))
        .filter(F.col("copies") > 0)
    )
