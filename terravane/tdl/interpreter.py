"""Runs tasks: sources, operations with variables, conditions and loops, sinks."""

from __future__ import annotations

from dataclasses import dataclass, field
from uuid import NAMESPACE_OID, uuid5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import terravane.verbs  # noqa: F401 - registers the verbs
from terravane.operators.pairs import csv_line
from terravane.operators.populations import metrics
from terravane.registry import VERBS, Call, bare
from terravane.sources import storage
from terravane.stream import KEY, Kind, Stream, anonymous
from terravane.tdl.config import ConfigError, Directive, Operation, Task, from_properties, split_list, substitute

DEFAULT_DELIMITER = "\t"
METRICS = "_metrics"


@dataclass
class Block:
    """A condition or a loop: the items to run, and those to run instead."""

    kind: str
    argument: str
    body: list = field(default_factory=list)
    otherwise: list = field(default_factory=list)


def blocks(items: list[Operation | Directive]) -> list:
    """Items nested by their $IF, $ITER, $ELSE and $END."""
    root: list = []
    stack: list[tuple[Block, list]] = []
    into = root
    for item in items:
        if not isinstance(item, Directive) or item.kind in ("LET", "METRICS"):
            into.append(item)
        elif item.kind in ("IF", "ITER"):
            block = Block(item.kind, item.argument)
            into.append(block)
            stack.append((block, into))
            into = block.body
        elif not stack:
            raise ConfigError(f"${item.kind} outside of a block")
        elif item.kind == "ELSE":
            into = stack[-1][0].otherwise
        else:
            into = stack.pop()[1]
    if stack:
        raise ConfigError(f"${stack[-1][0].kind} without $END")
    return root


class Interpreter:
    """Streams by name; the first writer of a name wins unless ``strict``, which makes a second one an error."""

    def __init__(self, spark: SparkSession, task: Task, strict: bool = False, streams: dict[str, Stream] | None = None):
        self.spark, self.task, self.strict = spark, task, strict
        self.variables = dict(task.variables)
        self.streams: dict[str, Stream] = dict(streams or {})
        self._loops = 0

    def run(self) -> dict[str, Stream]:
        for name in self.task.inputs:
            name = self._text(name)
            if name not in self.streams:
                self.streams[name] = self._source(name)
        self._run(blocks(self.task.items))
        return self.streams

    def _text(self, text: str) -> str:
        return substitute(text, self.variables)

    def _run(self, items: list) -> None:
        for item in items:
            if isinstance(item, Operation):
                self._operation(item)
            elif isinstance(item, Directive):
                self._let(item.argument) if item.kind == "LET" else self._metrics(item.argument)
            elif item.kind == "IF":
                self._run(item.body if self._value(item.argument).strip() else item.otherwise)
            else:
                self._loop(item)

    def _value(self, argument: str) -> str:
        """A control variable's value, its default, or nothing."""
        name, _, default = argument.partition(":")
        return self.variables.get(name) or default

    def _loop(self, block: Block) -> None:
        name = block.argument.partition(":")[0]
        values = split_list(self._value(block.argument))
        if not values:
            self._run(block.otherwise)
            return
        kept = {n: self.variables.get(n) for n in (name, "ITER")}
        for value in values:
            self._loops += 1
            self.variables[name] = value
            self.variables["ITER"] = uuid5(NAMESPACE_OID, f"{id(self)}/{self._loops}").hex[:16]
            self._run(block.body)
        for n, old in kept.items():
            if old is None:
                self.variables.pop(n, None)
            else:
                self.variables[n] = old

    def _let(self, argument: str) -> None:
        """A variable from the rows (of pairs: the keys) of a stream, as a list; meant for short streams."""
        variable, _, name = argument.partition(":")
        stream = self.streams.get(self._text(name))
        if stream is None:
            self.variables.pop(variable, None)
            return
        df = stream.df.select(KEY) if stream.kind is Kind.KV else stream.df
        line = csv_line(df.columns, ",") if len(df.columns) > 1 else F.col(f"`{df.columns[0]}`").cast("string")
        values = [r[0] for r in df.select(line.alias("v")).toLocalIterator() if r[0] is not None]
        if values:
            self.variables[variable] = ",".join(values)
        else:
            self.variables.pop(variable, None)

    def _metrics(self, argument: str) -> None:
        """Counts by key of the named streams (``:input`` and ``:output`` mean the task's), added to ``_metrics``."""
        names = {":input": self.task.inputs, ":output": self.task.outputs}.get(argument, split_list(argument))
        rows = None
        for name in self._matching([self._text(n) for n in names]):
            stream = self.streams[name]
            column = self.task.foreign.get("metrics", {}).get(f"counter.column.{name}") or self.task.foreign.get("metrics", {}).get(f"count.column.{name}")
            df, key = stream.df, None
            if stream.kind is Kind.KV:
                key = KEY
            elif column and stream.kind in (Kind.CSV, Kind.FIXED):
                key = bare(column, stream.named(name))
            elif column:
                props = {Kind.TRACK: "track_props"}.get(stream.kind, "props")
                df, key = df.select(F.col(props)[bare(column, stream.named(name))].alias("_counter")), "_counter"
            elif stream.kind not in (Kind.CSV, Kind.FIXED, Kind.PLAIN):
                df = df.select(F.to_json(F.struct("*")).alias("_object"))
            one = metrics(df, name, key)
            rows = one if rows is None else rows.unionByName(one)
        if rows is not None:
            old = self.streams.get(METRICS)
            self.streams[METRICS] = Stream(rows if old is None else old.df.unionByName(rows), Kind.FIXED, METRICS)

    def _matching(self, names: list[str]) -> list[str]:
        out: list[str] = []
        for name in names:
            out += sorted(n for n in self.streams if n.startswith(name[:-1])) if name.endswith("*") else [name] if name in self.streams else []
        return list(dict.fromkeys(out))

    def _spec(self, name: str, side: str, what: str) -> str | None:
        """A stream's setting; its name in the configuration may hold variables."""
        ds = self.task.streams.get(name)
        if ds is None or getattr(getattr(ds, side), what) is None:
            for pattern, other in self.task.streams.items():
                if "{" in pattern and self._text(pattern) == name and getattr(getattr(other, side), what) is not None:
                    ds = other
                    break
        value = getattr(getattr(ds, side), what) if ds else None
        return self._text(value) if value is not None else None

    def _delimiter(self, name: str, side: str) -> str:
        return self._spec(name, side, "delimiter") or self.task.foreign.get(side, {}).get("delimiter") or DEFAULT_DELIMITER

    def _source(self, name: str) -> Stream:
        layer = self.task.foreign.get("input", {})
        path = layer.get(f"path.{name}") or (f"{layer['path'].rstrip('/')}/{name}" if "path" in layer else name)
        columns = split_list(self._spec(name, "input", "columns"))
        return storage.read(self.spark, self._text(path), anonymous(columns), self._delimiter(name, "input")).named(name)

    def _consumed(self, name: str) -> Stream:
        """A stream as an operation sees it: repartitioned and with the columns declared for consumers."""
        if name not in self.streams:
            raise ConfigError(f"no such stream: {name}")
        stream = self.streams[name].named(name)
        df = stream.df
        columns = anonymous(split_list(self._spec(name, "input", "columns")))
        if columns and stream.kind in (Kind.CSV, Kind.FIXED, Kind.KV):
            have = stream.columns
            renamed = dict(zip(have, columns))
            df = df.select(*([KEY] if stream.kind is Kind.KV else []), *[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in have])
        elif columns and stream.kind is Kind.PLAIN:
            df = df.toDF(*columns[:1]) if len(columns) == 1 else storage.split_lines(df, columns, self._delimiter(name, "input"))
        parts = self._spec(name, "input", "part_count")
        if parts:
            df = df.repartition(int(parts))
        return Stream(df, Kind.CSV if columns and stream.kind is Kind.PLAIN else stream.kind, name)

    def _operation(self, op: Operation) -> None:
        verb = VERBS.get(op.verb)
        if verb is None:
            raise ConfigError(f"no such verb: {op.verb}")
        inputs = [self._consumed(n) for n in self._expanded(op.inputs)]
        slots = {slot: self._consumed(self._text(n)) for slot, n in op.input.items()}
        outputs = [self._text(n) for n in op.outputs]
        output_slots = {slot: self._text(n) for slot, n in op.output.items()}
        names = [*outputs, *output_slots.values()]
        call = Call(
            inputs, slots, verb.typed({k: self._text(v) for k, v in op.definitions.items()}), outputs, output_slots,
            {n: split_list(self._spec(n, "output", "columns")) for n in names}, {n: self._delimiter(n, "output") for n in names},
        )
        every = [*inputs, *slots.values()]
        for key, stream in verb.run(call).items():
            if isinstance(key, str) and key.startswith("="):
                name, pattern = key[1:], output_slots.get("template", key[1:])
            elif isinstance(key, int):
                name = pattern = outputs[key] if key < len(outputs) else next(iter(output_slots.values()), None)
            else:
                name = pattern = output_slots.get(key) or (outputs[list(verb.outputs).index(key)] if key in verb.outputs and list(verb.outputs).index(key) < len(outputs) else None)
            if name is None:
                continue
            self._publish(name, self._shaped(stream, split_list(self._spec(pattern, "output", "columns")), every, name))

    def _expanded(self, names: list[str]) -> list[str]:
        out: list[str] = []
        for name in map(self._text, names):
            out += self._matching([name]) if name.endswith("*") else [name]
        return out

    def _shaped(self, stream: Stream, references: list[str], inputs: list[Stream], name: str) -> Stream:
        """The columns declared for an output, each an input's column or a generated one; unknown ones are null."""
        df = stream.df
        if references and stream.kind in (Kind.CSV, Kind.FIXED, Kind.KV):
            columns = []
            for i, reference in enumerate(references, 1):
                candidates = [reference, *[bare(reference, s) for s in inputs]]
                found = next((c for c in candidates if c in df.columns), None)
                if found is None and len(references) == len(stream.columns):
                    found = stream.columns[i - 1]
                short = reference.rsplit(".", 1)[-1] if found is None or found == reference and "." in reference else found
                columns.append((F.col(f"`{found}`") if found else F.lit(None).cast("string"), short))
            shorts = [s for _, s in columns]
            final = [s if shorts.count(s) == 1 else f"{s}_{i}" for i, s in enumerate(shorts, 1)]
            df = df.select(*([KEY] if stream.kind is Kind.KV else []), *[c.alias(n) for (c, _), n in zip(columns, final)])
        parts = self._spec(name, "output", "part_count")
        return Stream(df.repartition(int(parts)) if parts else df, stream.kind, name)

    def _publish(self, name: str, stream: Stream) -> None:
        if name in self.streams and self.strict:
            raise ConfigError(f"stream {name} is made twice")
        self.streams.setdefault(name, stream.named(name))

    def save(self) -> list[str]:
        """Writes the task's outputs (``prefix*`` for several) and returns their names."""
        layer = self.task.foreign.get("output", {})
        names = self._matching([self._text(n) for n in self.task.outputs])
        for name in names:
            path = layer.get(f"path.{name}") or f"{layer.get('path', '.').rstrip('/')}/{name}"
            storage.write(self.streams[name], self._text(path), self._delimiter(name, "output"))
        return names


def run_task(
    config: str | Task, spark: SparkSession, variables: dict[str, str] | None = None, streams: dict[str, Stream | DataFrame] | None = None, strict: bool = False
) -> dict[str, Stream]:
    """All streams of a task given as properties text or Task; ``streams`` may stand in for its sources."""
    task = from_properties(config) if isinstance(config, str) else config
    task.variables |= variables or {}
    given = {n: s if isinstance(s, Stream) else Stream(s, Kind.CSV, n) for n, s in (streams or {}).items()}
    return Interpreter(spark, task, strict, given).run()


__all__ = ["Block", "Interpreter", "blocks", "run_task"]
