"""Queries p6 to p8 over documents, eval_items and mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import leaks, mixture, sentences
from terravane.session import cut_lineage, table

#: The public vocabulary that sizes are counted with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the longest run of letters and digits that the document shows of the item."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return leaks.leaked_items(documents, "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_leaks(spark, sf).select("item_id", "doc_id").distinct()


def p6_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return leaks.without_leaks(documents, "doc_id", p6_found(spark, sf))


def p6_cut_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, the leaked spans cut out of their texts."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return leaks.without_spans(documents, "text", table(spark, sf, "eval_items"), "item_id", "text")


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mix_targets")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shares asked and reached by source."""
    counted = mixture.count_tokens(table(spark, sf, "documents"), ["source"], "text", VOCABULARY)
    histogram = cut_lineage(mixture.length_histogram(counted, "source"))
    supplied = mixture.supply(histogram, _targets(spark, sf), "source", "weight", "max_repeats")
    return mixture.mixture_report(mixture.plan_mixture(histogram, supplied), supplied)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose share of the planned mixture stays below their budget with all documents repeated as often as may be."""
    spent = F.col("mixed_tokens") == F.col("tokens") * F.col("max_repeats")
    return p7_report(spark, sf).filter(spent & (F.col("mixed_tokens") < F.col("budget"))).select("source")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture and how often each occurs."""
    counted = cut_lineage(mixture.count_tokens(table(spark, sf, "documents"), ["doc_id", "source"], "text", VOCABULARY))
    histogram = mixture.length_histogram(counted, "source")
    supplied = mixture.supply(histogram, _targets(spark, sf), "source", "weight", "max_repeats")
    return mixture.select_documents(counted, "doc_id", "source", mixture.plan_mixture(histogram, supplied))


def p8_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_sentences(spark, sf).select("doc_id", "sent_end")


QUERIES = {f.__name__: f for f in (p6_found, p6_leaks, p6_clean_documents, p6_cut_documents, p7_found, p7_report, p7_mixture, p8_found, p8_sentences)}
#: Reading markup, tokenising and decoding cannot be said in SQL; tests compare with brute force and hand-made cases.
ORACLES: dict[str, str] = {}
