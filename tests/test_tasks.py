from __future__ import annotations

import pytest

from terravane.registry import VERBS, OperationError, describe
from terravane.tdl.composer import compose
from terravane.tdl.config import ConfigError, from_json, from_properties, parse_properties, substitute, to_json, to_properties
from terravane.tdl.interpreter import Interpreter, run_task
from terravane.tdl.run import main

NOP = "op.operation.{0}=nop\nop.inputs.{0}=signals\nop.outputs.{0}={1}\n"


def names(spark, operations, ops, **variables):
    """Streams that a task of nops makes."""
    text = f"task.input=signals\ntask.operations={operations}\n" + "".join(NOP.format(*o) for o in ops.items())
    df = spark.createDataFrame([("a,b",)], "v string")
    return set(run_task(text, spark, variables, {"signals": df})) - {"signals"}


@pytest.mark.parametrize(
    ("operations", "variables", "want"),
    [
        ("$IF{YES},a,$ELSE,b,$END", {"YES": "1"}, {"A"}),
        ("$IF{NO},a,$ELSE,b,$END", {}, {"B"}),
        ("$IF{NO:set},a,$END", {}, {"A"}),
        ("$IF{NO},a,$END,b", {}, {"B"}),
        ("$IF{BLANK},a,$ELSE,b,$END", {"BLANK": " "}, {"B"}),
        ("$ITER{L:1,2},c,$END", {}, {"C1", "C2"}),
        ("$ITER{L},c,$ELSE,b,$END", {}, {"B"}),
        ("$ITER{M:x,y},$IF{NO},a,$END,d,$END,b", {}, {"Dx", "Dy", "B"}),  # a block that does not run ends where it ends
        ("$IF{NO},$IF{YES},a,$END,$ELSE,$ITER{L:1},c,$END,$END", {"YES": "1"}, {"C1"}),
        ("$LET{L:signals},$ITER{L},c,$END", {}, {"Ca", "Cb"}),
        ("$LET{L:nothing},$ITER{L},c,$ELSE,b,$END", {"L": "z"}, {"B"}),
    ],
)
def test_control_flow(spark, operations, variables, want):
    ops = {k: v for k, v in {"a": "A", "b": "B", "c": "C{L}", "d": "D{M}"}.items() if k in operations.split(",")}
    assert names(spark, operations, ops, **variables) == want


def test_loops_restore_their_variable_and_number_rounds(spark):
    assert names(spark, "$ITER{L:1,2},c,$END,d", {"c": "C{ITER}", "d": "D{L}"}, L="7,8") >= {"D7,8"}
    found = names(spark, "$ITER{L:1,2},c,$END", {"c": "C{ITER}"})
    assert len(found) == 2


@pytest.mark.parametrize("operations", ["a,$END", "$IF{X},a", "$WHAT{X},a,$END", "a,a", "", "$IF,a,$END", "missing"])
def test_bad_tasks(spark, operations):
    with pytest.raises(ConfigError):
        names(spark, operations, {"a": "A"})


def test_formats_round_trip():
    text = "\n".join(
        [
            "# a comment", "task.input=s", "task.operations=$ITER{L:a,b},one,$END,two", "task.output=out*,x", "op.operation.one=columnarToolbox", "op.inputs.one=s",
            "op.definition.one.query=SELECT a, \\", "   b FROM s WHERE c = '{L}'", "op.outputs.one=out/{L}", "op.operation.two=splitMatch", "op.input.two.source=s",
            "op.input.two.values=s", "op.definition.two.source.match.column=s.a", "op.definition.two.values.match.column=s.b", "op.output.two.matched=x",
            "ds.input.columns.s=a,b,_", "ds.input.delimiter.s==", "ds.output.columns.out/{L}=s.a,s.b", "input.path.s=/data/s", "output.path=/out",
        ]
    )
    task = from_properties(text)
    assert task.streams["s"].input.delimiter == "=" and task.items[1].definitions["query"] == "SELECT a, b FROM s WHERE c = '{L}'"
    assert from_properties(to_properties(task)) == task == from_json(to_json(task))
    assert from_properties(to_properties(task, "some.prefix"), "some.prefix").items == task.items
    assert parse_properties("a\\=b : c\\td\n!x\nk\n") == {"a=b": "c\td", "k": ""}
    assert substitute("{A:x}{B}{C:}{A}", {"A": "1"}) == "1{B}1"


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "1.csv").write_text('u1,"a,b",5\nu2,c,7\n')
    (tmp_path / "in" / "deep" / "2.csv").write_text("u1,,9\n")
    (tmp_path / "task.ini").write_text(
        f"""task.input=rows
task.operations=map,count,$METRICS{{rows}},pick
task.output=counts,picked
input.path.rows={tmp_path}/in
ds.input.columns.rows=user,_,n
ds.input.delimiter.rows=,
op.operation.map=mapToPair
op.inputs.map=rows
op.definition.map.key.columns=rows.user
op.outputs.map=pairs
op.operation.count=countByKey
op.inputs.count=pairs
op.outputs.count=counts
op.operation.pick=columnarToolbox
op.inputs.pick=rows
op.definition.pick.query=SELECT n, _2_ FROM rows WHERE n > {{MIN:100}}
op.outputs.pick=picked
ds.output.delimiter.picked=;
ds.output.part_count.picked=1
output.path={tmp_path}/out
"""
    )
    assert main([str(tmp_path / "task.ini"), "--local", "4", "--var", "MIN=5", "--metrics", "--manifest", f"{tmp_path}/manifest"]) == ["counts", "picked"]
    lines = lambda p: sorted(line for f in (tmp_path / p).rglob("part-*") for line in f.read_text().splitlines())
    assert lines("out/counts") == ["u1\t2", "u2\t1"] and lines("out/picked") == ["7;c", "9;"] and len(lines("manifest")) == 2


def test_compose(spark):
    first = from_properties("task.input=s\ntask.operations=p\ntask.output=o\nop.operation.p=columnarToolbox\nop.inputs.p=s\nop.definition.p.query=SELECT a FROM s WHERE s.a > 1\nop.outputs.p=o")
    second = from_properties("task.input=i\ntask.operations=p\ntask.output=r\nop.operation.p=mapToPair\nop.inputs.p=i\nop.definition.p.key.columns=i.a\nop.outputs.p=r")
    task = compose({"x": first, "y": second}, {"y.i": "x.o"})
    assert task.inputs == ["x_s"] and task.outputs == ["y_r"] and [i.name for i in task.items] == ["x_p", "y_p"] and task.items[1].verb == "mapToPair"
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert [tuple(r) for r in run_task(task, spark, streams={"x_s": df})["y_r"].df.collect()] == [("2", 2)]
    assert compose({"x": first, "y": second}, {"y.i": "x.o"}, full=True).outputs == ["x_o", "y_r"]


def test_first_writer_wins_unless_strict(spark):
    text = "task.input=signals\ntask.operations=a,b\n" + NOP.format("a", "x") + NOP.format("b", "x")
    streams = {"signals": spark.createDataFrame([("v",)], "v string")}
    assert "x" in run_task(text, spark, streams=streams)
    with pytest.raises(ConfigError):
        run_task(text, spark, streams=streams, strict=True)
    assert Interpreter  # the engine behind run_task


def test_verbs_and_their_parameters(spark):
    assert len(VERBS) == 46 and "percentRankInc" in describe()
    with pytest.raises(OperationError):
        VERBS["h3"].typed({"lat.column": "a", "lon.column": "b", "hash.level": "deep"})
    with pytest.raises(OperationError):
        VERBS["h3"].typed({"lat.column": "a"})
    with pytest.raises(OperationError):
        VERBS["nop"].typed({"what": "x"})


def test_split_match_and_split_by_column(spark):
    text = """task.input=s,v
task.operations=m,p
op.operation.m=splitMatch
op.input.m.source=s
op.input.m.values=v
op.definition.m.source.match.column=s.id
op.definition.m.values.match.column=v.key
op.output.m.matched=hit
op.output.m.evicted=miss
ds.output.columns.hit=s.id,v.name
ds.output.columns.miss=s.id,v.name
op.operation.p=splitByColumn
op.inputs.p=s
op.definition.p.split.column=s.kind
op.definition.p.split.template={s.kind}
op.output.p.template=by/*
op.output.p.distinct_splits=kinds
"""
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (None, None)], "id int, kind string")
    v = spark.createDataFrame([(1, "one"), (1, "uno"), (None, "none")], "key int, name string")
    out = run_task(text, spark, streams={"s": s, "v": v})
    assert [tuple(r) for r in out["hit"].df.collect()] == [(1, "uno")]
    assert sorted(map(str, out["miss"].df.collect())) == ["Row(id=2, name=None)", "Row(id=3, name=None)", "Row(id=None, name=None)"]
    assert {n for n in out if n.startswith("by/")} == {"by/", "by/a", "by/b"} and out["by/a"].df.count() == 2 and out["kinds"].df.count() == 3
