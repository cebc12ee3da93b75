from __future__ import annotations

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terravane.operators.rejects import COLUMN_COUNT, INVALID_VALUE, QUOTING, Field, parse_lines

FIELDS = [Field("n", "int64"), Field("x", "decimal", 90), Field("id", "uuid"), Field("t", "text")]
ID = "02564271-6e20-49bf-A089-ff4440d59bf1"

CASES = [
    (f"1,2.5,{ID},a", None),
    (f'"1" , -.5 ,"{ID}","a, ""b"""', None),
    (f"+7,1e1,{ID},\r", None),
    (f"1,2,{ID},\r\r", None),  # one carriage return is not data, another is text
    (None, COLUMN_COUNT),
    ("", COLUMN_COUNT),
    (f"1,2,{ID}", COLUMN_COUNT),
    (f"1,2,{ID},a,b", COLUMN_COUNT),
    (f'1,2,{ID},"a', QUOTING),
    (f'1,2,{ID},"a"b', QUOTING),
    (f'1,2,{ID},a"b', QUOTING),
    (f'1,2,{ID}, "a"', QUOTING),
    (f'1,2,{ID},"a" "b"', QUOTING),
    (f'"1,2,{ID},a', QUOTING),
    (f"l,2,{ID},a", INVALID_VALUE),
    (f",2,{ID},a", INVALID_VALUE),
    (f'" 1",2,{ID},a', INVALID_VALUE),
    (f"9223372036854775807,2,{ID},a", None),
    (f"9223372036854775808,2,{ID},a", INVALID_VALUE),
    (f"0000000000000000000000001,2,{ID},a", None),
    (f"1,91,{ID},a", INVALID_VALUE),
    (f"1,1e999,{ID},a", INVALID_VALUE),
    (f"1,NaN,{ID},a", INVALID_VALUE),
    (f"1,.,{ID},a", INVALID_VALUE),
    (f"1,1e,{ID},a", INVALID_VALUE),
    (f"1,1.2.3,{ID},a", INVALID_VALUE),
    (f"1,5.,{ID[:-1]}g,a", INVALID_VALUE),
    (f"１,2,{ID},a", INVALID_VALUE),
    (f"1 ,2,{ID},a", INVALID_VALUE),
    (f"1,2,{ID}," + "é" * 100_000, None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "k int, line string").repartition(3)
    found = {r["k"]: r["_reason"] for r in parse_lines(df, "line", FIELDS).parsed.select("k", "_reason").collect()}
    assert found == {i: c[1] for i, c in enumerate(CASES)}


def test_values_and_clashing_names(spark):
    df = spark.createDataFrame([(5, f'3,-.5,{ID},"a, ""b"""', "x"), (5, "bad", "x")], "n int, line string, _reason string")
    parsed = parse_lines(df, "line", FIELDS)
    row = parsed.valid().collect()[0]
    assert (row["n_in"], row["n"], row["x"], row["id"], row["t"]) == (5, 3, -0.5, ID, 'a, "b"')
    assert parsed.rejects().collect()[0]["_reason"] == COLUMN_COUNT


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([("x",)] * 3, "line string")
    assert parse_lines(df, "line", FIELDS).rejects().count() == 3
    empty = parse_lines(df.limit(0), "line", FIELDS)
    assert empty.valid().count() == 0 and empty.rejects().count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(st.characters(exclude_characters="\r\n\0", exclude_categories=["Cs"]), max_size=8), min_size=2, max_size=2), min_size=1, max_size=20))
def test_round_trip(spark, rows):
    """What a writer quotes comes back as it was."""
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    df = spark.createDataFrame([(i, line) for i, line in enumerate(out.getvalue().split("\n")[:-1])], "k int, line string")
    valid = parse_lines(df, "line", [Field("a", "text"), Field("b", "text")]).valid().orderBy("k").collect()
    assert [[r["a"], r["b"]] for r in valid] == rows


@pytest.mark.parametrize("delimiter", ["\t", ";"])
def test_other_delimiters(spark, delimiter):
    df = spark.createDataFrame([(f"1{delimiter}2",)], "line string")
    assert parse_lines(df, "line", [Field("a", "int64"), Field("b", "int64")], delimiter).valid().count() == 1
