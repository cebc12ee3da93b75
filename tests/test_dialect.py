from __future__ import annotations

import pytest

from terravane.dialect.parser import DialectError, parse
from terravane.dialect.planner import select
from terravane.stream import KEY, Kind, Stream

ROWS = [("a", "1", 2.0, None), ("b", "2.5", 0.0, "x"), ("c", None, -3.0, "y'z"), ("d", "no", 4.0, "line\nbreak"), (None, "10", 6.0, "")]


@pytest.fixture(scope="module")
def rows(spark):
    return {"t": Stream(spark.createDataFrame(ROWS, "k string, s string, n double, o string"), Kind.CSV, "t")}


def keys(rows, where):
    return sorted(str(r[0]) for r in select(f"SELECT k FROM t WHERE {where}", rows).df.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("s = 2.5", "b"), ("2.5 = s", "b"), ("s == '1'", "a"), ("n <> 2", "None b c d"), ("s > 1", "None b"), ("s BETWEEN 1 AND 3", "a b"),
        ("s NOT BETWEEN 1 AND 3", "None"), ("k IN ('a', 'c')", "a c"), ("k NOT IN ('a', 'c')", "None b d"), ("s IN (1, 10)", "None a"),
        ("s NOT IN (1, 10)", "b"), ("o IS NULL", "a"), ("o IS NOT NULL", "None b c d"), ("o = ''", "None"), ("o LIKE 'y''z'", "c"),
        ("o MATCH 'line.break'", ""), ("o MATCH '/line.break/'", "d"), ("o REGEX '/LINE.BREAK/i'", "d"), ("o regexp '/line.break/s'", ""), ("o LIKE 'x|y'", "b"),
        ("k = 'a' AND (n = 2 OR n = 4)", "a"), ("NOT (k = 'a' AND n = 2)", "b c d"), ("k = 'a' OR s > 0", "a b"), ("n = 2 XOR k = 'b'", "a b"),
        ("missing IS NULL", "None a b c d"), ("n + 1 * 2 = 4", "a"), ("(n + 1) * 2 = 6", "a"), ("2 ^ 3 ^ 1 = 8 AND n = 2", "a"), ("-n = 3", "c"), ("n = -3", "c"),
        ("n % 4 = 2", "None a"), ("n / 0 > 1", "None a d"), ("n / 0 NOT BETWEEN 0 AND 1", "None a c d"), ("n / 0 = n / 0", "None a c d"), ("1 < n / 0", "None a d"), ("n & 6 = 4", "c d"), ("~n = 2", "c"), ("@@ n = 3", "c"), ("k || s = 'a1'", "a"), ("n << 1 = 4", "a"), ("n # 3 = 1", "a"),
        ("(n > 3 ? 'big' : 'small') = 'big'", "None d"), ("(s : 'none') = 'none'", "c"), ('"k" = \'a\'', "a"), ("t.k = 'a'", "a"), ("0x10 = 16 AND 3L = 3 AND k = 'a'", "a"),
        ("k LIKE 'a' AND n IN (2) AND NOT o IS NOT NULL", "a"),
    ],
)
def test_where(rows, where, want):
    assert keys(rows, where) == sorted(want.split())


def test_items(rows):
    out = select("SELECT k, n * 2, s || '!' AS t2, TRUE, NULL FROM t WHERE k = 'a'", rows).df
    assert out.columns == ["k", "_2_", "t2", "_4_", "_5_"] and tuple(out.first()) == ("a", 4.0, "1!", True, None)
    assert select("SELECT * FROM t LIMIT 2", rows).df.count() == 2
    assert select("SELECT * FROM t LIMIT 100%", rows).df.count() == 5


def test_subqueries(rows, spark):
    streams = rows | {"u": Stream(spark.createDataFrame([("a", 1), (None, 2), ("d", 3), ("a", 4)], "x string, y int"), Kind.CSV, "u")}
    ask = lambda where: sorted(str(r[0]) for r in select(f"SELECT k FROM t WHERE {where}", streams).df.collect())
    assert ask("k IN (SELECT x FROM u)") == ["a", "d"]
    assert ask("k NOT IN (SELECT x FROM u WHERE y > 1)") == ["None", "b", "c"]
    assert ask("n < 0 OR k IN (SELECT x FROM u)") == ["a", "c", "d"]
    assert ask("NOT k IN (SELECT x FROM u) AND n > 0") == ["None"]
    other = select("SELECT k FROM t WHERE k IN (SELECT x FROM elsewhere)", streams, ["t", "u"]).df
    assert other.count() == 2  # by order of inputs


def test_pairs(spark):
    pair = lambda name, rows: Stream(spark.createDataFrame(rows, f"{KEY} string, v int"), Kind.KV, name)
    streams = {"a": pair("a", [("x", 1), ("y", 2), ("y", 3)]), "b": pair("b", [("y", 4), ("z", 5)])}
    run = lambda q: sorted(map(str, (tuple(r) for r in select(q, streams).df.collect())))
    assert run("SELECT a.v, b.v AS w FROM INNER JOIN a, b") == ["('y', 2, 4)", "('y', 3, 4)"]
    assert len(run("SELECT * FROM LEFT JOIN a, b")) == 3 and len(run("SELECT * FROM RIGHT JOIN a, b")) == 3 and len(run("SELECT * FROM OUTER JOIN a, b")) == 4
    assert select("SELECT * FROM JOIN a, b", streams).df.columns == [KEY, "a.v", "b.v"]
    assert len(run("SELECT * FROM UNION a, b")) == 5
    assert select("SELECT v FROM a WHERE v > 1", streams).kind is Kind.KV


def test_unions(spark):
    part = lambda name, values: Stream(spark.createDataFrame([(v,) for v in values], "v int"), Kind.CSV, name)
    streams = {"p1": part("p1", [1, 1, 2, 3]), "p2": part("p2", [1, 1, 1, 4, 4])}
    run = lambda q: sorted(r[0] for r in select(q, streams).df.collect())
    assert run("SELECT * FROM UNION XOR p1, p2") == [2, 3, 4, 4]
    assert run("SELECT * FROM UNION AND p1, p2") == [1, 1]
    assert len(run("SELECT * FROM UNION CONCAT p *")) == 9


@pytest.mark.parametrize("query", ["SELECT", "SELECT a FROM", "SELECT a WHERE (b", "SELECT a FROM t WHERE k IN (1, 'a')", "SELECT a ; b", "SELECT a FROM t GROUP BY a"])
def test_errors(query):
    with pytest.raises(DialectError):
        parse(query)
