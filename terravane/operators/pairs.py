"""Pairs, distinct rows, set differences and digests."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.md2 import md2
from terravane.stream import KEY


def csv_field(column: Column, delimiter: str) -> Column:
    """Text quoted where a delimited line needs it; null is an empty field."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    special = text.contains(delimiter) | text.contains('"') | text.contains("\n")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[str], delimiter: str) -> Column:
    return F.concat_ws(delimiter, *[csv_field(F.col(f"`{c}`"), delimiter) for c in columns])


def map_to_pair(
    df: DataFrame, key: list[str], value: list[str] | None = None, delimiter: str = ",", length: int = -1, digest_with: str | None = None
) -> DataFrame:
    """``_key`` (the key columns as one line, cut to ``length`` or digested) and the value columns (all, if None)."""
    line = F.col(f"`{key[0]}`").cast("string") if len(key) == 1 else csv_line(key, delimiter)
    line = F.coalesce(line, F.lit(""))
    if digest_with:
        line = digest(line, digest_with)
    elif length >= 0:
        line = F.substring(line, 1, length)
    kept = [c for c in (value or df.columns) if c != KEY]
    return df.select(line.alias(KEY), *[F.col(f"`{c}`") for c in kept])


def collapse_pair(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without keys: the named value columns, or the key and all of them."""
    return df.select(*[F.col(f"`{c}`") for c in (columns or [KEY, *[c for c in df.columns if c != KEY]])])


def count_by_key(df: DataFrame) -> DataFrame:
    """``_key, _count``."""
    return df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_count"))


def distinct_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    """Distinct values of a column, or distinct rows."""
    return (df.select(F.col(f"`{column}`")) if column else df).distinct()


def subtract(minuend: DataFrame, subtrahend: DataFrame, left: list[str] | None = None, right: list[str] | None = None) -> DataFrame:
    """Rows of ``minuend`` whose columns ``left`` (all, if None) do not occur as ``right`` in ``subtrahend``, repeats kept.

    Null equals null.
    """
    left = left or minuend.columns
    right = right or (subtrahend.columns if left == minuend.columns else left)
    other = subtrahend.select(*[F.col(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(right)])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(left)]
    return minuend.join(other, same, "left_anti")


# Digest algorithms, in upper case without dashes.
ALGORITHMS = (
    "MD2", "MD5", "SHA", "SHA1", "SHA224", "SHA256", "SHA384", "SHA512", "SHA512224", "SHA512256", "SHA3224", "SHA3256", "SHA3384", "SHA3512",
)


def _algorithm(name: str) -> str:
    """The algorithm of ``_PROVIDER_ALGORITHM_``, with or without provider and underscores."""
    bare = name.strip("_").upper()
    for part in (bare, bare.partition("_")[2]):
        plain = part.replace("-", "").replace("_", "").replace("/", "")
        if plain in ALGORITHMS:
            return plain
    raise ValueError(f"no digest algorithm {name}")


def digest(text: Column, algorithm: str) -> Column:
    """Upper-case hexadecimal digest of the UTF-8 text; null stays null."""
    name = _algorithm(algorithm)
    built_in = {"MD5": lambda: F.md5(text), "SHA": lambda: F.sha1(text), "SHA1": lambda: F.sha1(text)}
    built_in |= {f"SHA{n}": (lambda n=n: F.sha2(text, n)) for n in (224, 256, 384, 512)}
    if name in built_in:
        return F.upper(built_in[name]())
    other = {f"SHA3{n}": getattr(hashlib, f"sha3_{n}") for n in (224, 256, 384, 512)}
    other |= {"SHA512224": lambda b: hashlib.new("sha512_224", b), "SHA512256": lambda b: hashlib.new("sha512_256", b)}

    @F.pandas_udf("string")
    def slow(s: pd.Series) -> pd.Series:
        make = (lambda b: md2(b).hex()) if name == "MD2" else (lambda b: other[name](b).hexdigest())
        return s.map(lambda v: None if v is None else make(v.encode("utf-8")).upper())

    return slow(text)


def digest_columns(columns: list[str], algorithm: str) -> Column:
    """Digest of the columns' text joined by NUL; a null column counts as empty."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return digest(parts[0] if len(parts) == 1 else F.concat_ws("\0", *parts), algorithm)
