from __future__ import annotations

import math

import pytest

from terravane.operators import dates, filters, maths, pairs, populations
from terravane.stream import KEY


def values(df, column="_result"):
    return {r[KEY]: r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def series(spark):
    rows = [("a", 1, "4"), ("a", 2, "2"), ("a", 3, None), ("a", 4, "no"), ("a", 5, "-1"), ("b", 1, "7"), ("c", 1, None), ("d", 1, "0"), ("d", 2, "3")]
    return spark.createDataFrame(rows, f"{KEY} string, o int, v string")


@pytest.mark.parametrize(
    ("function", "const", "want"),
    [
        ("SUM", 1.0, {"a": 6.0, "b": 8.0, "d": 4.0}), ("AVERAGE", None, {"a": 5 / 3, "b": 7.0, "d": 1.5}), ("MIN", 0.5, {"a": 0.5, "b": 7.0, "d": 0.5}),
        ("MAX", 5.0, {"a": 4.0, "b": 5.0, "d": 3.0}), ("MUL", 2.0, {"a": -16.0, "b": 14.0, "d": 0.0}), ("MEDIAN", None, {"a": 2.0, "b": 7.0, "d": 1.5}),
        ("RMS", None, {"a": math.sqrt(7), "b": 7.0, "d": math.sqrt(4.5)}), ("SUBTRACT", 1.0, {"a": 2.0, "b": 6.0, "d": -4.0}), ("DIV", None, {"a": -2.0, "b": 7.0, "d": 0.0}),
        ("EQUALITY", None, {"a": 0.0, "b": 1.0, "d": 0.0}), ("EQUALITY", 3.5, {"a": 1.0, "b": 1.0, "d": 1.0}),
    ],
)
def test_keyed_math(series, function, const, want):
    found = values(maths.keyed_math(series, function, "v", const, order="o"))
    assert {k: v for k, v in found.items() if k != "c"} == pytest.approx(want) and found.get("c") is None


def test_keyed_extremes_keep_their_rows(series):
    found = maths.keyed_math(series, "MAX", "v", full=True)
    assert {(r[KEY], r["o"], r["v"]) for r in found.collect()} == {("a", 1, "4"), ("b", 1, "7"), ("d", 2, "3")}


def test_row_math(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, None, None), (3.0, -4.0, 5.0)], "x1 double, x2 double, y double")
    run = lambda f, c=None, cols=("x1", "x2", "y"): [r["_result"] for r in maths.columns_math(df, f, list(cols), c).collect()]
    assert run("AVERAGE") == [1.5, None, pytest.approx(4 / 3)] and run("MEDIAN") == [1.5, None, 3.0] and run("MIN", 0.0) == [1.0, None, 0.0]
    assert run("MAX", None, ["x*"]) == [2.0, None, 3.0] and run("RMS", None, ["x1"]) == [1.0, None, 3.0]


def test_series(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    assert [r["_result"] for r in maths.series_math(df, "STDDEV", "v").collect()] == [-1.0, 1.0, None]
    assert [r["_result"] for r in maths.series_math(df, "NORMALIZE", "v", 30.0).collect()] == [10.0, 30.0, None]
    assert maths.series_math(df.limit(0), "STDDEV", "v").count() == 0


def test_populations(spark):
    signals = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("u2",), ("u3",), (None,)], "u string")
    target = spark.createDataFrame([("g", "u1"), ("g", "u2"), ("h", "u2"), ("h", "u2"), ("h", "u9"), ("i", None)], "g string, u string")
    assert {r["_group"]: r["_reach"] for r in populations.reach(signals, "u", target, "u", "g").collect()} == pytest.approx({"g": 2 / 3, "h": 2 / 3, "i": 0.0})
    assert {r["_group"]: r["_dwell_time"] for r in populations.dwell_time(signals, "u", target, "u", "g").collect()} == {"g": 0.5, "h": 1.0}
    assert {r["g"]: r["_uniques"] for r in populations.count_uniques(target, "g", "u").collect()} == {"g": 2, "h": 2, "i": 0}
    assert {r["g"]: r["_frequency"] for r in populations.frequency(target.dropna(), "u", "g").collect()} == pytest.approx({"g": 2 / 3, "h": 5 / 6})


def test_ranks(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "3"), ("b", "5"), ("b", None), ("b", "x")], f"{KEY} string, v string")
    found = sorted((r[KEY], r["_value"], r["_rank"]) for r in populations.percent_rank(df, "v", by_key=True).collect())
    assert found[:3] == [("a", 1.0, 0.0), ("a", 1.0, 0.0), ("a", 3.0, 1.0)] and math.isnan(found[3][2])
    assert [r["v"] for r in populations.percentile_filter(df, "v", 50, 20).orderBy("v").collect()] == ["1", "1", "3"]
    assert populations.percentile_filter(df, "v", 100).count() == 4 and populations.percentile_filter(df.limit(0), "v", 50).count() == 0
    with pytest.raises(ValueError):
        populations.percentile_filter(df, "v", 10, 20)


def test_pairs_and_sets(spark):
    df = spark.createDataFrame([("x,1", 'q"', 1), ("y", None, 2), ("y", None, 2)], "a string, b string, c int")
    assert [r[KEY] for r in pairs.map_to_pair(df, ["a", "b"]).collect()] == ['"x,1","q"""', "y,", "y,"]
    assert pairs.map_to_pair(df, ["a"], ["c"], length=1).columns == [KEY, "c"]
    other = spark.createDataFrame([(None,)], "k string")
    assert pairs.subtract(df, other, ["b"], ["k"]).count() == 1 and pairs.subtract(df, df.limit(0)).count() == 3
    assert pairs.distinct_rows(df).count() == 2
    got = df.select(pairs.digest_columns(["a"], "_X_MD2_"), pairs.digest_columns(["a"], "SHA3-256"), pairs.digest_columns(["a", "b"], "MD5")).first()
    assert [len(v) for v in got] == [32, 64, 32]
    with pytest.raises(ValueError):
        pairs.digest_columns(["a"], "NONE")


def test_dates(spark):
    df = spark.createDataFrame([("1469583507",), ("1469583507000",), ("2016-07-27T01:38:27Z",), ("never",), (None,)], "t string")
    out = dates.explode_zones(df, "t", "Europe/Samara", "GMT").collect()
    for row in out[:3]:
        assert row["_input_date"] == "2016-07-27T01:38:27+04:00[Europe/Samara]" and row["_output_date"] == "2016-07-26T21:38:27Z[GMT]"
        assert [row[f"_{s}_{p}_int"] for s in ("input", "output") for p in ("dow", "day", "month", "year", "hour", "minute")] == [3, 27, 7, 2016, 1, 38, 2, 26, 7, 2016, 21, 38]
        assert row["_epoch_time"] == 1469583507
    assert out[3]["_input_date"] is None and out[4]["_epoch_time"] is None
    own = spark.createDataFrame([("2019-03-24 20:48:25",)], "t string")
    assert dates.explode_zones(own, "t", "GMT", "Europe/Samara", "yyyy'-'MM'-'dd' 'HH':'mm':'ss", "yyyy-MM-dd HH:mm:ss").first()["_output_date"] == "2019-03-25 00:48:25"
    parts = spark.createDataFrame([(2020, 5, 1, 23, 30), (2020, 5, 2, 1, 0), (2020, 5, 2, 12, 0), (None, 5, 2, 12, 0)], "y int, m int, d int, h int, n int")
    columns = {"year": "y", "month": "m", "date": "d", "hour": "h", "minute": "n"}
    count = lambda **k: filters.filter_by_date(parts, columns, **k).count()
    assert count(hhmm_start=2300, hhmm_end=100) == 2 and count(hhmm_start=100, hhmm_end=1200) == 2 and count(start="2020-05-01T23:30:00") == 2
    assert count(allowed={"month": ["13"]}) == 4 and count(allowed={"date": ["1", "99"]}) == 1 and count() == 4


def test_equality_with_a_constant_across_parts(spark):
    """Steps between successive values also where a key's rows lie in many parts."""
    from terravane.operators.maths import keyed_math

    rows = [("small", i, float(i % 5)) for i in range(400)] + [("jump", i, 0.0 if i < 200 else 50.0) for i in range(400)] + [("one", 1, 7.0), (None, 1, 1.0), (None, 2, 9.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "_key string, o int, v double")
    for shuffled in (df.repartition(13), df.coalesce(1)):
        out = {r["_key"]: r["_result"] for r in keyed_math(shuffled, "EQUALITY", "v", 5.0, order="o").collect()}
        assert out == {"small": 1.0, "jump": 0.0, "one": 1.0, None: 0.0}
    assert keyed_math(df.limit(0), "EQUALITY", "v", 5.0, order="o").count() == 0
