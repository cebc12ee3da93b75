from __future__ import annotations

import random
from collections import Counter

from terravane.operators import hotkeys

ROWS = "g string, v string, h int, extra int"


def scores(spark, rows, top=1):
    df = spark.createDataFrame(rows, ROWS)
    mult = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, None), (None, 9.0)], "h int, mult double")
    return {r["_group"]: r for r in hotkeys.parametric_score(df, mult, "g", "v", "h", "h", "mult", top).collect()}


def test_scores_ties_nulls_and_repeats(spark):
    rows = [("a", "x", 1, 0), ("a", "y", 2, 0), ("a", "y", 2, 1), ("a", "Z", 1, 0)]  # all score 0.5: bytes decide
    rows += [(None, "x", 1, 0), ("a", None, 1, 0), ("a", "", 1, 0), ("b", "x", 3, 0), ("c", "x", None, 0), ("d", "x", 7, 0)]
    found = scores(spark, rows, 4)
    assert list(found) == ["a"]
    assert [found["a"][f"_value_{i}"] for i in (1, 2, 3, 4)] == ["Z", "x", "y", None]
    assert found["a"]["_score_1"] == 0.5
    assert scores(spark, [], 1) == {}


def test_weighted_values_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(40)) for _ in range(4000)] + [("hot", None), (None, 3)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r["k"]: r for r in hotkeys.percentiles(df, "k", "v", [0.0, 0.5, 0.99, 1.0]).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        want = [values[max(1, -(-int(p * 1000) * len(values) // 1000)) - 1] for p in (0.0, 0.5, 0.99, 1.0)]
        assert [got[key][f"_p{i}"] for i in (1, 2, 3, 4)] == want
    modes = {r["k"]: (r["_mode"], r["_n"]) for r in hotkeys.modes(df, "k", "v").collect()}
    counts = Counter(v for k, v in rows if k == "hot" and v is not None)
    assert modes["hot"] == min(((v, n) for v, n in counts.items()), key=lambda e: (-e[1], e[0]))
    distinct = {r["k"]: (r["_rows"], r["_values"]) for r in hotkeys.distinct_counts(df, "k", "v").collect()}
    assert distinct["hot"] == (sum(k == "hot" for k, _ in rows), len(counts)) and distinct[None] == (1, 1)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert hotkeys.percentiles(df, "k", "v", [0.5]).count() == hotkeys.modes(df, "k", "v").count() == 0


def test_salted_join_loses_nothing(spark):
    from terravane.plans.salting import salted_join

    left = spark.createDataFrame([(1 if i < 90 else i, i) for i in range(100)] + [(None, 5)], "k int, a int")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (95, "z"), (None, "n")], "k int, b string")
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert sorted(map(tuple, salted_join(left, right, ["k"], 10).select("k", "a", "b").collect())) == want
