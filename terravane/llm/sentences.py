"""Sentence ends in documents of many scripts: prose found in the markup, tags decoded by a trained linear-chain model.

``prose`` masks what is not prose and finds paragraphs; ``tagger`` tags their characters boundary or inside and learns its
weights. Nothing is labelled by hand and there are no word lists: the ends of paragraphs, read on into the next one, are
the known boundaries, and what they have in common tells boundaries from other marks. For scripts without end marks the
same is learned from letters alone, marks stripped. The model is learned from all texts: words are counted over all of them, and
weights are learned in shards of a bounded size and mixed.
"""

from __future__ import annotations

import gc
import itertools
import marshal
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.prose import masked, units
from terravane.llm.tagger import Learned, Lexicon, Model, Shard, kept, read
from terravane.session import cut_lineage, spread

#: Characters of a shard, in the mean: what one task learns from at a time.
SHARD_CHARS = 10_000_000
#: Words that a task counts before it sends the counts.
WORDS = 500_000
#: Documents of one text that share a row.
COPIES = 10_000
#: Weights are added up as whole numbers, so that the order does not count.
_UNIT = 1e6


def sentence_ends(text: str, model: Model) -> list[int]:
    """Code points up to and including the last character of each sentence of the text's prose."""
    body, begin = masked(text)
    return [begin + a + e for a, b in units(body) for e in model.ends(body[a:b])]


def sample_texts(documents: DataFrame, text: str, sample_docs: int) -> list[str]:
    """The different non-empty texts with the smallest hashes, ``sample_docs`` at most, whatever their order and layout.

    For a look at some texts of a corpus; ``train`` learns from all.

    A share of the hashes is kept that should hold one and a half times the sample (all, if there are few documents);
    should it hold too few, which only many equal or empty texts bring about, a share four times as large is read.
    Equal texts count once, each partition's before they are sent.
    """
    source = documents.select(F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)
    share = min(1.0, 1.5 * sample_docs / max(documents.count(), 1) + 1e-9)
    while True:
        bound = int(share * 2**64) - 2**63
        hashed = source.select(F.xxhash64("t").alias("h"), "t")
        part = hashed.filter(F.col("h") < F.lit(bound)) if share < 1.0 else hashed
        kept = part.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(sample_docs).collect()
        if len(kept) == sample_docs or share >= 1.0:
            return [row["t"] for row in kept]
        share = min(1.0, 4 * share)


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the collector of cycles, which would walk millions of tuples again and again; nothing here is in a cycle."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


_COLUMNS = ["word", "n", "closing", "h", "size", "chains", "units", "ids"]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a text with its chains, its units and its documents, and rows of words with how often they stand at all and at ends of paragraphs.

    Equal texts come one after the other and are read once; of more than ``COPIES`` documents the others have rows without chains.
    """
    words, closing = Counter(), Counter()

    def counted() -> pd.DataFrame:
        out = pd.DataFrame({"word": list(words), "n": list(words.values()), "closing": [closing[w] for w in words], "h": None, "size": None, "chains": None, "units": None, "ids": None})
        words.clear()
        closing.clear()
        return out

    def packed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None, *row) for row in rows], columns=_COLUMNS, dtype=object)

    rows: list[tuple] = []
    text, units, ids = None, None, []
    for batch in batches:
        for h, t, d in zip(batch["h"], batch["t"], batch["d"]):
            if t != text:
                text, ids = t, []
                with _uncollected():
                    found, chains, paragraphs = read(t)
                    units = marshal.dumps(found) if found else None
                    Lexicon.count(paragraphs, words, closing)
                if units:
                    rows.append((h, len(t), marshal.dumps(chains), units, ids) if chains else (None, None, None, units, ids))
                if len(words) >= WORDS:
                    yield counted()
            elif units and len(ids) == COPIES:
                ids = []
                rows.append((None, None, None, units, ids))
            ids.append(d)
        if len(rows) > 1:  # the last one may go on
            yield packed(rows[:-1])
            del rows[:-1]
    if rows:
        yield packed(rows)
    if words:
        yield counted()


def _prepared(documents: DataFrame, text: str, doc_id: str | None = None) -> DataFrame:
    """What is learned from and tagged: all texts, each read once, written to the checkpoint folder."""
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), documents.sparkSession.sparkContext.defaultParallelism)
    d = (F.col(f"`{doc_id}`").cast("bigint") if doc_id else F.lit(None)).cast("string")  # as numbers, ids beside nulls would lose digits
    texts = documents.select(d.alias("d"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0).withColumn("h", F.xxhash64("t"))
    texts = texts.repartition(parts, "h").sortWithinPartitions("h", "t")
    return cut_lineage(texts.mapInPandas(_read, "word string, n bigint, closing bigint, h bigint, size bigint, chains binary, units binary, ids array<string>"))


def _lexicon(prepared: DataFrame) -> Lexicon:
    """The words of all texts; only those that stand before full stops come to the driver."""
    dot = F.col("word").endswith(".")
    counts = [F.sum(F.when(dot, F.col("n")).otherwise(0)), F.sum(F.when(dot, 0).otherwise(F.col("n"))), F.sum("closing")]
    words = prepared.filter("word IS NOT NULL").groupBy(F.when(dot, F.expr("left(word, length(word) - 1)")).otherwise(F.col("word")).alias("token"))
    tokens = words.agg(*(c.alias(name) for c, name in zip(counts, ("dots", "bare", "closed"))))
    totals = tokens.agg(*(F.coalesce(F.sum(name), F.lit(0)) for name in ("dots", "bare", "closed"))).first()
    return Lexicon.of((tuple(r) for r in tokens.filter("dots > 0 AND dots + bare >= 3").toLocalIterator()), tuple(totals))


def _mixed(prepared: DataFrame, shards: int, step: Callable[[Shard], Learned], lexicon: Lexicon, paired: bool) -> dict[str, float]:
    """What ``step`` learns from every shard: the mean by feature, weighted by how often each shard saw it."""
    shared = prepared.sparkSession.sparkContext.broadcast(vars(lexicon))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(batch["shard"], batch["chains"]))
        for _, own in itertools.groupby(rows, key=lambda row: row[0]):
            with _uncollected():
                shard = Shard(Lexicon(**shared.value), paired)
                for _, packed in own:
                    shard.add(marshal.loads(packed))
                learned = step(shard)
                del shard
            if learned:
                whole = [round(w * n * _UNIT) for w, n in learned.values()]
                yield pd.DataFrame({"name": list(learned), "w": whole, "n": [n for _, n in learned.values()]})

    placed = prepared.filter("chains IS NOT NULL").select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "size", "chains")
    placed = placed.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "size")
    learned = placed.select("shard", "chains").mapInPandas(run, "name string, w bigint, n bigint")
    mean = learned.groupBy("name").agg((F.sum("w") / F.sum("n") / F.lit(_UNIT)).alias("w"))
    return {name: w for name, w in mean.collect()}


def train(documents: DataFrame, text: str, shard_chars: int = SHARD_CHARS) -> Model:
    """A model learned from all texts of the documents.

    Null and empty texts do not count, equal texts count once. Words are counted over all texts. Weights are learned in
    shards by the texts' hashes, of some ``shard_chars`` characters each, and mixed: first those that label, then, with
    the mixed ones, those of the model. So a task holds one shard, the driver what is learned, and the model does not
    depend on the order or layout of the documents. Without any paragraph that is followed by another, nothing is
    learned, and only ends of paragraphs are boundaries.
    """
    return _learned(_prepared(documents, text), shard_chars)


def _learned(prepared: DataFrame, shard_chars: int = SHARD_CHARS) -> Model:
    lexicon = _lexicon(prepared)
    size = prepared.filter("chains IS NOT NULL").agg(F.sum("size")).first()[0] or 0
    shards = -(-size // shard_chars) or 1
    labeller = _mixed(prepared, shards, Shard.labeller, lexicon, paired=False)
    if not labeller:
        return Model({}, lexicon)
    shared = prepared.sparkSession.sparkContext.broadcast(labeller)
    return Model(kept(_mixed(prepared, shards, lambda shard: shard.fitted(shared.value), lexicon, paired=True)), lexicon)


def split_sentences(documents: DataFrame, doc_id: str, text: str, model: Model | None = None) -> DataFrame:
    """``doc_id, sent_no, sent_end``: the sentences of every document, numbered from 1, ends in code points of the text.

    Null and empty texts, and documents without prose, have no sentences; whole texts are read whatever their length.
    A document that comes twice gives its sentences twice; a null id stays null. Without ``model`` one is trained on
    all the documents; each text is then read once, to learn and to tag.
    """
    prepared = None if model else _prepared(documents, text, doc_id)
    model = model or _learned(prepared)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, vars(model.lexicon)))
    if prepared is None:
        rows = spread(documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0))

    else:
        rows = prepared.filter("units IS NOT NULL").select("units", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, lexicon = shared.value
        decoder = Model(weights, Lexicon(**lexicon))
        for batch in batches:
            ids, numbers, ends = [], [], []
            if "t" in batch:
                tagged = (([d], sentence_ends(t, decoder)) for d, t in zip(batch["d"], batch["t"]))
            else:
                tagged = ((own, [unit[0] + e for unit in marshal.loads(units) for e in decoder.cuts(unit)]) for units, own in zip(batch["units"], batch["ids"]))
            for own, found in tagged:
                for d in own:
                    ids += [int(d) if isinstance(d, str) else d] * len(found)
                    numbers += range(1, len(found) + 1)
                    ends += found
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "sent_no": numbers, "sent_end": ends})

    return rows.mapInPandas(run, "doc_id bigint, sent_no bigint, sent_end bigint")
