from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators.pairs import map_to_pair
from terravane.stream import Kind, Stream
from terravane.streaming.stateless import count_by_key, read_lines, run_batches, select_stream


def test_filter_and_counts_go_on_where_they_ended(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.csv").write_text("a,2020-01-01 00:00:01,5\nb,2020-01-01 00:00:02,1\na,2020-01-01 00:20:00,7\n")
    source = read_lines(spark, str(inbox), ["k", "at", "v"], ",").named("s")
    wanted = Stream(spark.createDataFrame([("a",)], "k string"), Kind.CSV, "wanted")
    kept = select_stream("SELECT k, at, v FROM s WHERE v > 2 AND k IN (SELECT k FROM wanted)", source, {"wanted": wanted})
    pair = Stream(map_to_pair(kept.df.withColumn("at", F.to_timestamp("at")), ["k"]), Kind.KV, "p")
    out = count_by_key(pair, "at", "10 minutes", "5 minutes")
    rows = []
    take = lambda df, _: rows.extend(map(tuple, df.select("_key", "_count").collect()))
    run_batches(out, str(tmp_path / "state"), take)
    (inbox / "2.csv").write_text("a,2020-01-01 01:00:00,9\n")
    run_batches(out, str(tmp_path / "state"), take)
    assert sorted(rows) == [("a", 1), ("a", 1)]
