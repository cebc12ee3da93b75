"""Queries for the operators on columns: the SELECT dialect, pairs, math, populations, filters, dates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.dialect.planner import select
from terravane.operators import dates, filters, maths, pairs, populations
from terravane.session import table
from terravane.stream import Kind, Stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _dialect(name: str, query: str, sql: str, *, pairs_by: dict[str, list[str]] | None = None, **sources: str) -> None:
    """A query in the dialect over tables; ``pairs_by`` makes pairs of them, keyed by the columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        streams = {}
        for alias, source in sources.items():
            df = table(spark, sf, source)
            if pairs_by and alias in pairs_by:
                streams[alias] = Stream(pairs.map_to_pair(df, pairs_by[alias]), Kind.KV, alias)
            else:
                streams[alias] = Stream(df, Kind.CSV, alias)
        return select(query, streams).df

    QUERIES[name], ORACLES[name] = run, sql


_dialect(
    "select_filter_project",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'",
    lineitem="lineitem",
)
_dialect("select_star", "SELECT * FROM nation", "SELECT * FROM nation", nation="nation")
_dialect(
    "select_regex_match", "SELECT p_partkey, p_type FROM part WHERE p_type MATCH '/.*brass.*/i' OR p_brand LIKE 'Brand#1[1-3]'",
    "SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '.*brass.*', 'i') OR regexp_full_match(p_brand, 'Brand#1[1-3]')", part="part",
)
_dialect(
    "select_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3)",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3)", orders="orders",
)
_dialect(
    "select_between", "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 200000",
    "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 200000", orders="orders",
)
_dialect(
    "select_is_null", "SELECT point_id FROM points WHERE category IS NULL OR c2 IS NOT NULL AND c2 < 50",
    "SELECT point_id FROM points WHERE c2 IS NOT NULL AND (category IS NULL OR c2 < 50)", points="points",
)  # fmt: skip - an operator with a null argument is null, OR too
_dialect(
    "select_ternary", "SELECT l_orderkey, l_linenumber, (l_quantity > 25 ? 'many' : 'few') AS size FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size FROM lineitem", lineitem="lineitem",
)
_dialect(
    "select_bitwise",
    "SELECT o_orderkey, o_custkey & 255 AS low, o_custkey | 1 AS odd, o_custkey # 85 AS flipped, o_custkey << 2 AS up, o_custkey >> 1 AS down, ~ o_custkey AS inverse FROM orders",
    "SELECT o_orderkey, o_custkey & 255 AS low, o_custkey | 1 AS odd, xor(o_custkey, 85) AS flipped, o_custkey << 2 AS up, o_custkey >> 1 AS down, ~o_custkey AS inverse FROM orders",
    orders="orders",
)
_dialect(
    "select_concat", "SELECT n_name || '/' || n_name AS twice FROM nation WHERE n_name != 'FRANCE'",
    "SELECT n_name || '/' || n_name AS twice FROM nation WHERE n_name <> 'FRANCE'", nation="nation",
)
_dialect(
    "select_arithmetic", "SELECT l_orderkey, l_linenumber, -l_quantity + 2 ^ 3 AS a, l_extendedprice % 7 AS b, @@ (l_tax - 0.05) AS c, l_quantity / (l_linenumber - 1) AS d FROM lineitem",
    """SELECT l_orderkey, l_linenumber, -l_quantity + 8 AS a, fmod(l_extendedprice, 7) AS b, abs(l_tax - 0.05) AS c,
       CASE WHEN l_linenumber = 1 THEN 'Infinity'::DOUBLE ELSE l_quantity / (l_linenumber - 1) END AS d FROM lineitem""", lineitem="lineitem",
)
_dialect(
    "select_boolean", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_linestatus = 'F') XOR l_quantity >= 30",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (NOT (l_returnflag = 'R' OR l_linestatus = 'F')) <> (l_quantity >= 30)", lineitem="lineitem",
)
_dialect(
    "in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", orders="orders", customer="customer",
)
_dialect(
    "not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey = o_custkey)", orders="orders", customer="customer",
)
_dialect(
    "or_in_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", orders="orders", customer="customer",
)
def _joined(how: str) -> Callable[[SparkSession, str], DataFrame]:
    """Orders above 250,000 and customers with a positive balance: both sides have rows without a partner."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        o = pairs.map_to_pair(table(spark, sf, "orders").filter("o_totalprice > 250000"), ["o_custkey"])
        c = pairs.map_to_pair(table(spark, sf, "customer").filter("c_acctbal > 0"), ["c_custkey"])
        query = f"SELECT c.c_custkey AS custkey, o.o_orderkey AS orderkey FROM {how} JOIN o, c"
        return select(query, {"o": Stream(o, Kind.KV, "o"), "c": Stream(c, Kind.KV, "c")}).df.drop("_key")

    return run


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    QUERIES[f"join_{_how}"] = _joined(_how.upper())
    ORACLES[f"join_{_how}"] = f"""SELECT c_custkey AS custkey, o_orderkey AS orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) {_sql}
        (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"""


@_query("SELECT 1000 AS n, true AS all_rows")
def select_limit(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a limit keeps, and that all are rows of the table."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    kept = select("SELECT * FROM lineitem LIMIT 1000", {"lineitem": Stream(lines, Kind.CSV, "lineitem")}).df
    found = kept.join(lines.withColumn("_in", F.lit(True)).distinct(), ["l_orderkey", "l_linenumber"], "left")
    return found.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("_in", F.lit(False))).alias("all_rows"))


@_query("SELECT true AS near_share, true AS all_rows")
def select_limit_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a sample of 10 % has a tenth of the rows, six standard deviations at most off, and only rows of the table."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    kept = select("SELECT * FROM lineitem LIMIT 10%", {"lineitem": Stream(lines, Kind.CSV, "lineitem")}).df
    both = lines.withColumn("_all", F.lit(1)).unionByName(kept.withColumn("_all", F.lit(0)))
    keys = both.groupBy("l_orderkey", "l_linenumber").agg(F.sum("_all").alias("_all"), F.sum(1 - F.col("_all")).alias("_kept"))
    sums = keys.agg(F.sum("_all").alias("n"), F.sum("_kept").alias("k"), F.min(F.col("_kept") <= F.col("_all")).alias("all_rows"))
    return sums.select((F.abs(F.col("k") - F.col("n") * 0.1) <= 6 * F.sqrt(F.col("n") * 0.09)).alias("near_share"), "all_rows")


def _column(spark: SparkSession, sf: str, name: str, column: str, as_: str = "k") -> Stream:
    return Stream(table(spark, sf, name).select(F.col(column).alias(as_)), Kind.CSV, name)


def _union(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        streams = {n: _column(spark, sf, n, c) for n, c in (("nation", "n_nationkey"), ("supplier", "s_nationkey"), ("customer", "c_nationkey"))}
        return select(f"SELECT * FROM UNION {mode} nation, supplier, customer", streams).df

    return run


QUERIES |= {"union_concat": _union("CAT"), "union_and": _union("AND")}
ORACLES["union_concat"] = "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer"
ORACLES["union_and"] = "SELECT n_nationkey AS k FROM nation INTERSECT ALL SELECT s_nationkey FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer"


@_query("""WITH t AS (SELECT o_custkey AS k, 0 AS p FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal > 5000),
    once AS (SELECT k, count(*) AS n FROM t GROUP BY k HAVING count(DISTINCT p) = 1) SELECT k FROM (SELECT k, unnest(range(n)) AS i FROM once)""")
def union_xor(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of dear orders, as often as they have some, or rich ones, not both."""
    dear = table(spark, sf, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("k"))
    rich = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return select("SELECT * FROM UNION XOR dear, rich", {"dear": Stream(dear, Kind.CSV, "dear"), "rich": Stream(rich, Kind.CSV, "rich")}).df


@_query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 250000 AND o_custkey = c_custkey)")
def subtract_column(spark: SparkSession, sf: str) -> DataFrame:
    dear = table(spark, sf, "orders").filter("o_totalprice > 250000")
    return pairs.subtract(table(spark, sf, "customer").select("c_custkey", "c_name"), dear, ["c_custkey"], ["o_custkey"])


@_query("SELECT l_suppkey AS k FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def subtract_row(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    return pairs.subtract(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")), rich)


@_query("SELECT l_returnflag || '|' || l_linestatus AS _key, count(*) AS _count FROM lineitem GROUP BY 1")
def count_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.count_by_key(pairs.map_to_pair(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [], "|"))


@_query("SELECT DISTINCT l_shipdate FROM lineitem")
def distinct_column(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.distinct_rows(table(spark, sf, "lineitem"), "l_shipdate")


@_query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_row(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.distinct_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag"))


@_query("SELECT upper(md5(o_orderkey::VARCHAR)) AS _key, o_totalprice FROM orders")
def map_to_pair_digest(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.map_to_pair(table(spark, sf, "orders"), ["o_orderkey"], ["o_totalprice"], digest_with="_SUN_MD5_")


@_query("SELECT left(o_orderstatus || ',' || o_custkey, 4) AS _key, o_orderkey FROM orders")
def map_to_pair_length(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.map_to_pair(table(spark, sf, "orders"), ["o_orderstatus", "o_custkey"], ["o_orderkey"], length=4)


@_query("SELECT s_nationkey::VARCHAR AS _key, s_name, s_acctbal FROM supplier")
def collapse_pair(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.collapse_pair(pairs.map_to_pair(table(spark, sf, "supplier"), ["s_nationkey"], ["s_name", "s_acctbal"]))


@_query("SELECT c_custkey, upper(md5(c_name || chr(0) || c_mktsegment)) AS md5, upper(sha1(c_name)) AS sha1, upper(sha256(c_name || chr(0) || c_mktsegment)) AS sha256 FROM customer")
def digest_md5_sha(spark: SparkSession, sf: str) -> DataFrame:
    two = ["c_name", "c_mktsegment"]
    digests = {"md5": (two, "_SUN_MD5_"), "sha1": (["c_name"], "SHA"), "sha256": (two, "_SUN_SHA-256_")}
    return table(spark, sf, "customer").select("c_custkey", *[pairs.digest_columns(c, a).alias(n) for n, (c, a) in digests.items()])


def _keyed(function: str, sql: str, const: float | None = None, digits: int = 6) -> None:
    name = f"keyed_{function.lower()}"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        out = maths.keyed_math(pairs.map_to_pair(df, ["l_orderkey"], ["l_linenumber", "l_quantity"]), function, "l_quantity", const)
        return out.withColumn("_result", F.round("_result", digits))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT l_orderkey::VARCHAR AS _key, round({sql}, {digits}) AS _result FROM lineitem GROUP BY 1"


_keyed("SUM", "sum(l_quantity) - 15", -15.0)
_keyed("AVERAGE", "avg(l_quantity)")
_keyed("RMS", "sqrt(avg(l_quantity * l_quantity))")
_keyed("POWERMEAN", "pow(avg(pow(l_quantity, 3)), 1 / 3.0::DOUBLE)", 3.0)
_keyed("MIN", "greatest(min(l_quantity), 5)", 5.0)
_keyed("MAX", "least(max(l_quantity), 40)", 40.0)
_keyed("MUL", "product(l_quantity)", digits=0)
_keyed("MEDIAN", "median(l_quantity)")
_keyed("EQUALITY", "CASE WHEN min(l_quantity) = max(l_quantity) THEN 1.0::DOUBLE ELSE 0 END")
QUERIES["keyed_max_full"] = lambda spark, sf: maths.keyed_math(
    pairs.map_to_pair(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey", "o_totalprice"]), "MAX", "o_totalprice", full=True
)
ORACLES["keyed_max_full"] = """SELECT o_custkey::VARCHAR AS _key, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"""


def _ordered(name: str, function: str, sql: str, const: float | None = None, unit: int = 1) -> None:
    """Functions of encounter order: prices (in ``unit``) of each customer's orders, by order key."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / unit).alias("v"))
        out = maths.keyed_math(pairs.map_to_pair(df, ["o_custkey"], ["o_orderkey", "v"]), function, "v", const, order="o_orderkey")
        return out.withColumn("_result", F.round("_result", 6 if unit > 1 else 2))

    QUERIES[name] = run
    ORACLES[name] = f"""WITH t AS (SELECT o_custkey::VARCHAR AS _key, o_orderkey AS o, o_totalprice / {unit} AS v,
        abs(v - lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS step FROM orders) SELECT _key, round({sql}, {6 if unit > 1 else 2}) AS _result FROM t GROUP BY 1"""


_ordered("keyed_subtract", "SUBTRACT", "2 * arg_min(v, o) - sum(v)")
_ordered("keyed_div", "DIV", "arg_min(v, o) / (product(v) / arg_min(v, o))", unit=100000)
_ordered("keyed_equality_const", "EQUALITY", "CASE WHEN coalesce(max(step), 0) < 150000 THEN 1.0::DOUBLE ELSE 0 END", 150000.0)


def _by_row(function: str, sql: str, const: float | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
        out = maths.columns_math(df, function, ["l_quantity", "l_discount", "l_tax"], const)
        return out.select("l_orderkey", "l_linenumber", F.round("_result", 9).alias("_result"))

    QUERIES[f"columns_{function.lower()}"] = run
    ORACLES[f"columns_{function.lower()}"] = f"SELECT l_orderkey, l_linenumber, round({sql}, 9) AS _result FROM lineitem"


_by_row("AVERAGE", "(l_quantity + l_discount + l_tax + 2) / 3", 2.0)
_by_row("RMS", "sqrt((l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) / 3)")
_by_row("POWERMEAN", "pow((pow(l_quantity, 3) + pow(l_discount, 3) + pow(l_tax, 3)) / 3, 1 / 3.0::DOUBLE)", 3.0)
_by_row("MIN", "greatest(least(l_quantity, l_discount, l_tax), 0.02)", 0.02)
_by_row("MAX", "least(greatest(l_quantity, l_discount, l_tax), 40)", 40.0)
_by_row("MEDIAN", "list_median([l_quantity, l_discount, l_tax])")
ORACLES["columns_median"] = "SELECT l_orderkey, l_linenumber, round(list_sort([l_quantity, l_discount, l_tax])[2], 9) AS _result FROM lineitem"


@_query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) AS _result FROM lineitem")
def series_stddev(spark: SparkSession, sf: str) -> DataFrame:
    out = maths.series_math(table(spark, sf, "lineitem"), "STDDEV", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", F.round("_result", 6).alias("_result"))


@_query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) * 100, 6) AS _result FROM lineitem")
def series_normalize(spark: SparkSession, sf: str) -> DataFrame:
    out = maths.series_math(table(spark, sf, "lineitem"), "NORMALIZE", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", F.round("_result", 6).alias("_result"))


@_query("""WITH t AS (SELECT l_returnflag AS f, l_linenumber::BIGINT AS n, l_quantity AS v FROM lineitem UNION ALL SELECT o_orderstatus, 1, o_totalprice FROM orders)
    SELECT f AS _payload_f, sum(n)::BIGINT AS _total_count, round(sum(n * v), 2) AS _total_value, round(sum(n * v) / sum(n), 6) AS _weighted_sum FROM t GROUP BY 1""")
def weighted_sum(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("v"))
    b = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("f"), F.lit(1).alias("n"), F.col("o_totalprice").alias("v"))
    out = maths.weighted_sum([a, b], ["f"], "n", "v")
    return out.withColumns({"_total_value": F.round("_total_value", 2), "_weighted_sum": F.round("_weighted_sum", 6)})


@_query("SELECT event_type, count(DISTINCT user_id) AS _uniques FROM events GROUP BY 1")
def count_uniques(spark: SparkSession, sf: str) -> DataFrame:
    return populations.count_uniques(table(spark, sf, "events"), "event_type", "user_id")


@_query("SELECT event_type AS _group, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events)::DOUBLE, 9) AS _reach FROM events WHERE value > 50 GROUP BY 1")
def reach(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "value")
    out = populations.reach(events, "user_id", events.filter("value > 50"), "user_id", "event_type")
    return out.withColumn("_reach", F.round("_reach", 9))


@_query("""WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2)
    SELECT event_type AS _group, round(avg(t.n / a.n::DOUBLE), 9) AS _dwell_time FROM t JOIN a USING (user_id) GROUP BY 1""")
def dwell_time(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "value")
    out = populations.dwell_time(events, "user_id", events.filter("value > 50"), "user_id", "event_type")
    return out.withColumn("_dwell_time", F.round("_dwell_time", 9))


@_query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n / (sum(n) OVER (PARTITION BY user_id))::DOUBLE AS share FROM p)
    SELECT event_type, round(median(share), 9) AS _frequency FROM s GROUP BY 1""")
def frequency(spark: SparkSession, sf: str) -> DataFrame:
    return populations.frequency(table(spark, sf, "events"), "user_id", "event_type").withColumn("_frequency", F.round("_frequency", 9))


@_query("SELECT o_totalprice AS _value, round(percent_rank() OVER (ORDER BY o_totalprice), 9) AS _rank FROM orders")
def percent_rank_global(spark: SparkSession, sf: str) -> DataFrame:
    return populations.percent_rank(table(spark, sf, "orders"), "o_totalprice").withColumn("_rank", F.round("_rank", 9))


@_query("SELECT l_returnflag AS _key, l_quantity AS _value, round(percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS _rank FROM lineitem")
def percent_rank_keyed(spark: SparkSession, sf: str) -> DataFrame:
    pair = pairs.map_to_pair(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity"])
    return populations.percent_rank(pair, "l_quantity", by_key=True).withColumn("_rank", F.round("_rank", 9))


@_query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_totalprice FROM r WHERE o_totalprice >= (SELECT o_totalprice FROM r WHERE i = floor(n * 20 / 100))
    AND o_totalprice <= (SELECT o_totalprice FROM r WHERE i = floor(n * 90 / 100))""")
def percentile_filter(spark: SparkSession, sf: str) -> DataFrame:
    return populations.percentile_filter(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 90, 20)


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rich = table(spark, sf, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    return tuple(df.withColumnRenamed("values.c_mktsegment", "segment") for df in filters.split_match(orders, "o_custkey", rich, "c_custkey", ["c_mktsegment"]))


@_query("SELECT o_orderkey, o_custkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def split_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)[0]


@_query("""SELECT s_suppkey, s_nationkey, m AS segment FROM supplier JOIN (SELECT c_nationkey, max(c_mktsegment) AS m FROM customer WHERE c_acctbal > 9500 GROUP BY 1) ON s_nationkey = c_nationkey""")
def split_match_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Values with repeated keys: the greatest row of a key counts."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rich = table(spark, sf, "customer").filter("c_acctbal > 9500").select("c_nationkey", "c_mktsegment")
    return filters.split_match(suppliers, "s_nationkey", rich, "c_nationkey", ["c_mktsegment"])[0].withColumnRenamed("values.c_mktsegment", "segment")


@_query("SELECT o_orderkey, o_custkey, NULL::VARCHAR AS segment FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def split_match_evicted(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)[1]


@_query("SELECT DISTINCT event_type AS kind, 'out/' || event_type AS name FROM events")
def split_by_column_distinct(spark: SparkSession, sf: str) -> DataFrame:
    kinds = filters.distinct_splits(table(spark, sf, "events"), ["event_type"])
    return kinds.select(F.col("event_type").alias("kind"), filters.split_name("out/{event_type}", ["event_type"]).alias("name"))


@_query("SELECT event_id, 'out/' || event_type AS name FROM events")
def split_by_column(spark: SparkSession, sf: str) -> DataFrame:
    parts = filters.split(table(spark, sf, "events").select("event_id", "event_type"), ["event_type"], "out/{events.event_type}")
    return reduce(DataFrame.unionAll, [df.select("event_id", F.lit(name).alias("name")) for name, df in parts.items()])


_EXPLODED = {"year": "_output_year_int", "month": "_output_month_int", "date": "_output_day_int", "dow": "_output_dow_int", "hour": "_output_hour_int", "minute": "_output_minute_int"}


def _exploded(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    return dates.explode_zones(events, "epoch", "Europe/Samara", "America/New_York")


def _iso_sql(wall: str, offset: str, zone: str) -> str:
    """Text of a wall clock and its offset in seconds."""
    clock = f"strftime({wall}, '%Y-%m-%dT%H:%M') || CASE WHEN second({wall}) = 0 THEN '' ELSE strftime({wall}, ':%S') END"
    return f"{clock} || CASE WHEN {offset} < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', (abs({offset}) // 3600)::INT, (abs({offset}) % 3600 // 60)::INT) || '[{zone}]'"


_PARTS = {"dow": "isodow", "day": "day", "month": "month", "year": "year", "hour": "hour", "minute": "minute"}


@_query(f"""WITH t AS (SELECT event_id, date_trunc('second', ts) AS i, epoch(i)::BIGINT AS e, (i AT TIME ZONE 'Europe/Samara') AS u, u AT TIME ZONE 'America/New_York' AS o,
    (epoch(i) - epoch(u))::BIGINT AS io, (epoch(o) - epoch(u))::BIGINT AS oo FROM events)
    SELECT event_id, e AS epoch, e AS _epoch_time, {_iso_sql("i", "io", "Europe/Samara")} AS _input_date, {_iso_sql("o", "oo", "America/New_York")} AS _output_date,
    {", ".join(f"{f}({side}) AS _{name}_{part}_int" for side, name in (("i", "input"), ("o", "output")) for part, f in _PARTS.items())} FROM t""")
def timezone_explode(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(spark, sf)


@_query("""WITH t AS (SELECT event_id, (date_trunc('second', ts) AT TIME ZONE 'Europe/Samara') AT TIME ZONE 'America/New_York' AS o FROM events)
    SELECT event_id FROM t WHERE isodow(o) IN (6, 7) AND hour(o) IN (1, 2, 3, 22)""")
def filter_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_by_date(_exploded(spark, sf), _EXPLODED, allowed={"dow": ["6", "7", "9"], "hour": ["1", "2", "3", "22"], "month": ["13"]}).select("event_id")


@_query("""WITH t AS (SELECT event_id, date_trunc('minute', (date_trunc('second', ts) AT TIME ZONE 'Europe/Samara') AT TIME ZONE 'America/New_York') AS o FROM events)
    SELECT event_id FROM t WHERE o > TIMESTAMP '2024-01-10 00:00:00' AND o < TIMESTAMP '2024-01-20 12:00:00'""")
def filter_by_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_by_date(_exploded(spark, sf), _EXPLODED, "2024-01-10T00:00:00", "1705752000").select("event_id")


@_query("""WITH t AS (SELECT event_id, (date_trunc('second', ts) AT TIME ZONE 'Europe/Samara') AT TIME ZONE 'America/New_York' AS o FROM events)
    SELECT event_id FROM t WHERE hour(o) * 100 + minute(o) > 2230 OR hour(o) * 100 + minute(o) <= 115""")
def filter_by_hhmm_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_by_date(_exploded(spark, sf), _EXPLODED, hhmm_start=2230, hhmm_end=115).select("event_id")


@_query("""WITH t AS (SELECT (date_trunc('second', ts) AT TIME ZONE 'Europe/Samara') AT TIME ZONE 'America/New_York' AS o FROM events)
    SELECT DISTINCT year(o) AS y, month(o) AS m, year(o) || '/' || month(o) AS name FROM t""")
def split_by_date_distinct(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["_output_year_int", "_output_month_int"]
    found = filters.distinct_splits(_exploded(spark, sf), columns)
    return found.select(F.col(columns[0]).alias("y"), F.col(columns[1]).alias("m"), filters.split_name("{_output_year_int}/{_output_month_int}", columns).alias("name"))


@_query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT 'events' AS "_streamName", 'event_type' AS "_counterColumn", sum(n)::BIGINT AS "_totalCount", count(*) AS "_uniqueCounters", round(avg(n), 6) AS "_counterAverage", median(n) AS "_counterMedian" FROM c""")
def metrics_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return populations.metrics(table(spark, sf, "events"), "events", "event_type").withColumn("_counterAverage", F.round("_counterAverage", 6))
