"""Reading and writing streams: delimited text, plain lines, Parquet, ORC, JSON, JDBC, object stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators.pairs import csv_line
from terravane.stream import KEY, Kind, Stream

_COLUMNAR = (".parquet", ".orc")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str = "\t", only: list[str] | None = None) -> Stream:
    """A stream of a file, a folder (with all below it) or a comma-separated list of them.

    Parquet and ORC bring their columns (renamed by position if ``columns`` are given); text with ``columns`` is split at
    the delimiter, values unquoted and untyped, missing trailing columns null; text without is PLAIN. ``only`` keeps some
    columns, so others are not read from columnar files. Compressed text is read by its extension (gz, bz2, zst, lz4...).
    """
    paths = [p for p in path.split(",") if p]
    kind = next((e for e in _COLUMNAR if all(p.rstrip("/*").endswith(e) for p in paths)), None)
    reader = spark.read.option("recursiveFileLookup", "true")
    if kind:
        df = reader.format(kind[1:]).load(paths)
        df = df.toDF(*columns) if columns and len(columns) == len(df.columns) else df
        return Stream(df.select(*only) if only else df, Kind.CSV)
    if not columns:
        return Stream(reader.text(paths), Kind.PLAIN)
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = reader.csv(paths, schema=schema, sep=delimiter, quote='"', escape='"', mode="PERMISSIVE", emptyValue="", nullValue="\0", enforceSchema=True)
    return Stream(df.select(*only) if only else df, Kind.CSV)


def split_lines(lines: DataFrame, columns: list[str], delimiter: str) -> DataFrame:
    """Columns of plain lines."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return lines.select(F.from_csv(F.col(f"`{lines.columns[0]}`"), schema, options).alias("r")).select("r.*")


def write(stream: Stream, path: str, delimiter: str = "\t", compression: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet or ORC by the path's ending, else delimited text (pairs as key, delimiter, value) or plain lines."""
    df = stream.df
    kind = next((e for e in _COLUMNAR if path.rstrip("/").endswith(e)), None)
    writer = df.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if kind:
        writer.format(kind[1:]).save(path)
        return
    if stream.kind in (Kind.POINT, Kind.POLYGON, Kind.TRACK):
        lines = df.select(F.to_json(F.struct("*")).alias("value"))
    elif stream.kind is Kind.PLAIN and len(df.columns) == 1:
        lines = df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value"))
    else:
        rest = [c for c in df.columns if c != KEY]
        line = csv_line(rest, delimiter) if rest else F.lit("")
        lines = df.select((F.concat(F.col(KEY), F.lit(delimiter), line) if KEY in df.columns else line).alias("value"))
    text = lines.write.mode(mode)
    (text.option("compression", compression) if compression else text).text(path)


def write_manifest(spark: SparkSession, streams: list[tuple[str, DataFrame]], path: str) -> None:
    """Names of streams and their numbers of partitions, one row each."""
    rows = [(name, df.rdd.getNumPartitions()) for name, df in streams]
    spark.createDataFrame(rows, "name string, partitions int").coalesce(1).write.mode("overwrite").csv(path)


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None, driver: str | None = None, batch: int = 500) -> dict[str, str]:
    given = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver, "batchsize": str(batch), "fetchsize": "10000"}
    return {k: v for k, v in given.items() if v is not None}


def read_jdbc(spark: SparkSession, options: dict[str, str], partition: tuple[str, int, int, int] | None = None) -> Stream:
    """A table over JDBC; ``partition`` = (numeric column, lower, upper, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return Stream(reader.load(), Kind.CSV)


def write_jdbc(stream: Stream, options: dict[str, str], mode: str = "append") -> None:
    stream.df.write.format("jdbc").options(**options).mode(mode).save()


def object_store_options(key: str | None = None, secret: str | None = None, endpoint: str | None = None, region: str | None = None) -> dict[str, str]:
    """Session settings (prefixed ``spark.hadoop.``) to read and write ``s3a://`` paths."""
    given = {"access.key": key, "secret.key": secret, "endpoint": endpoint, "endpoint.region": region}
    out = {f"spark.hadoop.fs.s3a.{k}": v for k, v in given.items() if v}
    if endpoint:
        out["spark.hadoop.fs.s3a.path.style.access"] = "true"
    return out
