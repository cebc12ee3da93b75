from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terravane.llm import mixture, queries


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 4), min_size=1, max_size=8), st.integers(0, 400))
def test_fill_is_exact(histogram, room):
    """As close to the room as any choice can be."""
    lengths, counts = (np.array(v, np.int64) for v in (list(histogram), list(histogram.values())))
    sums = {0}
    for size, n in histogram.items():
        sums = {s + k * size for s in sums for k in range(n + 1)}
    taken = mixture.fill(lengths, counts, room)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert int((taken * lengths).sum()) == max(s for s in sums if s <= room)


def test_fill_large():
    rng = np.random.default_rng(0)
    lengths, counts = np.arange(1, 3000), rng.integers(1, 400, 2999)
    room = int((lengths * counts).sum() * 0.371)
    assert int((mixture.fill(lengths, counts, room) * lengths).sum()) == room


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "word " * 50_000), (5, "a" * 200_000)], "d long, text string")
    found = {r["d"]: r["_tokens"] for r in mixture.count_tokens(df, ["d"], "text", queries.VOCABULARY).collect()}
    assert found[1] == 2 and found[2] == found[3] == 0 and found[4] >= 50_000 and found[5] > 1000
    assert mixture.count_tokens(df.limit(0), ["d"], "text", queries.VOCABULARY).count() == 0


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "z"]), 7 if rng.random() < 0.5 else rng.randrange(200)) for i in range(3000)]
    rows += [(5000, "c", 50), (5001, "c", 30)]
    counted = spark.createDataFrame(rows, "doc long, src string, _tokens long").cache()
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 3), ("c", 0.2, 4), ("d", 0.1, 9), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    histogram = mixture.length_histogram(counted, "src")
    supplied = mixture.supply(histogram, targets, "source", "weight", "max_repeats")
    plan = mixture.plan_mixture(histogram, supplied).cache()
    report = {r["source"]: r for r in mixture.mixture_report(plan, supplied).collect()}
    tokens = {s: sum(t for _, x, t in rows if x == s) for s in "abcd"}
    total = sum(tokens.values())
    assert {s: r["tokens"] for s, r in report.items()} == tokens
    assert {s for s, r in report.items() if not r["reachable"]} == {"c", "d"}
    assert report["c"]["mixed_tokens"] == 4 * tokens["c"] and report["d"]["mixed_tokens"] == 0
    assert report["c"]["residual_tokens"] == round(0.2 * total - 4 * tokens["c"], 3)
    for s, w in (("a", 0.3), ("b", 0.4)):
        assert 0 <= report[s]["residual_tokens"] + 0.5 < 1.5
        assert abs(report[s]["mixed_tokens"] - w * total) <= 1
    chosen = mixture.select_documents(counted, "doc", "src", plan, buckets=8).collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    for s, r in report.items():
        own = [c for c in chosen if c["source"] == s]
        assert sum(c["tokens"] * c["copies"] for c in own) == r["mixed_tokens"]
        assert max([c["copies"] for c in own], default=0) <= r["max_repeats"]


def test_empty(spark):
    counted = spark.createDataFrame([], "doc long, src string, _tokens long")
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, weight double, max_repeats int")
    histogram = mixture.length_histogram(counted, "src")
    supplied = mixture.supply(histogram, targets, "source", "weight", "max_repeats")
    assert mixture.mixture_report(mixture.plan_mixture(histogram, supplied), supplied).collect()[0]["share"] == 0.0
    assert mixture.supply(histogram, targets.limit(0), "source", "weight", "max_repeats").count() == 0


def test_found_comes_from_the_mixture(spark, tmp_path, monkeypatch):
    """A source short of its budget is one whose planned mixture is, all repeats used; others fill theirs by the knapsack."""
    docs = [(i, "word " * (5 + i % 7), "a") for i in range(60)] + [(100 + i, "word " * 4, "b") for i in range(3)] + [(200, "x", None), (201, "y", "z")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 5)]
    spark.createDataFrame(targets, "source string, weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    planned, plan = [], mixture.plan_mixture
    monkeypatch.setattr(mixture, "plan_mixture", lambda *a, **k: planned.append(1) or plan(*a, **k))
    assert sorted(r["source"] for r in queries.p7_found(spark, str(tmp_path)).collect()) == ["b", "c"]
    assert planned
    # without a plan for b nothing shows that its repeats were used
    monkeypatch.setattr(mixture, "plan_mixture", lambda *a, **k: plan(*a, **k).filter("_source <> 'b'"))
    assert [r["source"] for r in queries.p7_found(spark, str(tmp_path)).collect()] == ["c"]


def test_report_and_mixture_of_the_tables(spark):
    """Shares, caps and residuals of the whole tables against plain counts."""
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").toPandas()
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet").toPandas().set_index("source")
    encode = mixture._encoding(queries.VOCABULARY).encode_ordinary
    documents["n"] = [len(encode(t)) for t in documents["text"]]
    tokens = documents[documents["source"].isin(targets.index)].groupby("source")["n"].sum()
    report = queries.p7_report(spark, sf).toPandas().set_index("source")
    assert set(report.index) == set(targets.index) and abs(report["share"].sum() - 1) < 1e-6
    for s, r in report.iterrows():
        held, budget, most = int(tokens.get(s, 0)), float(targets["weight"][s] * tokens.sum()), int(targets["max_repeats"][s])
        assert r["tokens"] == held and abs(r["budget"] - budget) < 0.01 and r["repeats"] <= most
        if held * most < budget:
            assert r["mixed_tokens"] == held * most
        else:  # as near to the budget as any choice of documents comes: sums of subsets as bits of a number
            room = round(budget) - held * min(most, round(budget) // held)
            sums = 1
            for n in documents.loc[documents["source"] == s, "n"]:
                sums = (sums | sums << int(n)) & ((1 << room + 1) - 1)
            assert r["mixed_tokens"] == round(budget) - room + sums.bit_length() - 1
        assert abs(r["residual_tokens"] - (budget - r["mixed_tokens"])) < 0.01
    chosen = queries.p7_mixture(spark, sf).toPandas()
    assert chosen["doc_id"].is_unique and (chosen["copies"] <= chosen["source"].map(targets["max_repeats"])).all()
    sizes = chosen.merge(documents[["doc_id", "n"]], on="doc_id")
    mixed = (sizes["n"] * sizes["copies"]).groupby(sizes["source"]).sum()
    assert mixed.to_dict() == {s: n for s, n in report["mixed_tokens"].items() if n}
