"""Task configurations: a model, properties and JSON readers and writers, variables."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field


class ConfigError(ValueError):
    """A configuration that does not describe a task."""


@dataclass
class Operation:
    name: str
    verb: str
    definitions: dict[str, str] = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)  # by position
    outputs: list[str] = field(default_factory=list)
    input: dict[str, str] = field(default_factory=dict)  # by slot
    output: dict[str, str] = field(default_factory=dict)


@dataclass
class Directive:
    """$IF, $ITER, $ELSE, $END, $LET or $METRICS with its argument."""

    kind: str
    argument: str = ""


@dataclass
class StreamSpec:
    columns: str | None = None
    delimiter: str | None = None
    part_count: str | None = None


@dataclass
class DataStream:
    input: StreamSpec = field(default_factory=StreamSpec)
    output: StreamSpec = field(default_factory=StreamSpec)


@dataclass
class Task:
    items: list[Operation | Directive] = field(default_factory=list)
    streams: dict[str, DataStream] = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    prefix: str = ""
    variables: dict[str, str] = field(default_factory=dict)
    foreign: dict[str, dict[str, str]] = field(default_factory=dict)  # input, output, dist, metrics

    def stream(self, name: str) -> DataStream:
        return self.streams.setdefault(name, DataStream())


_VARIABLE = re.compile(r"\{([^{}:]+)(?::([^{}]*))?\}")
_FOREIGN = ("input", "output", "dist", "metrics")
_ITEM = re.compile(r"\$(IF|ITER|LET|METRICS|ELSE|END)(?:\{([^{}]*)\})?|[^,\s][^,]*")


def substitute(text: str | None, variables: dict[str, str]) -> str | None:
    """``{NAME:default}`` replaced once; an unset variable without default stays as it is, a blank value counts as unset."""
    if text is None:
        return None

    def value(m: re.Match) -> str:
        known = variables.get(m.group(1))
        if known is not None and known != "":
            return known
        return m.group(2) if m.group(2) is not None else m.group(0)

    return _VARIABLE.sub(value, text)


def split_list(text: str | None) -> list[str]:
    """Comma-separated names; commas within braces belong to defaults."""
    if not text:
        return []
    return [p.strip() for p in re.findall(r"(?:\{[^{}]*\}|[^,{}]|[{}])+", text) if p.strip()]


def parse_properties(text: str) -> dict[str, str]:
    """Lines of ``key=value`` (or ``:``), comments of # and !, continued lines, escapes."""
    out: dict[str, str] = {}
    lines = iter(text.splitlines())
    for line in lines:
        line = line.lstrip()
        if not line or line[0] in "#!":
            continue
        while (len(line) - len(line.rstrip("\\"))) % 2:
            line = line[:-1] + next(lines, "").lstrip()
        m = re.match(r"((?:\\.|[^\s=:\\])*)\s*[=:]?\s*(.*)$", line, re.S)
        out[_unescaped(m.group(1))] = _unescaped(m.group(2))
    return out


def _unescaped(text: str) -> str:
    special = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m.group(1)[1:], 16)) if m.group(1)[0] == "u" and len(m.group(1)) == 5 else special.get(m.group(1), m.group(1)), text)


def from_properties(properties: dict[str, str] | str, prefix: str = "", variables: dict[str, str] | None = None) -> Task:
    """A task from properties; with ``prefix``, only keys under it count."""
    given = parse_properties(properties) if isinstance(properties, str) else dict(properties)
    if prefix:
        given = {k[len(prefix) :].lstrip("."): v for k, v in given.items() if k.startswith(prefix)}
    task = Task(prefix=prefix, variables=dict(variables or {}))
    task.inputs, task.outputs = split_list(given.get("task.input")), split_list(given.get("task.output"))
    for layer in _FOREIGN:
        task.foreign[layer] = {k[len(layer) + 1 :]: v for k, v in given.items() if k.startswith(f"{layer}.")}
    listed = [m for m in _ITEM.finditer(given.get("task.operations", ""))]
    if not listed:
        raise ConfigError("task.operations lists no operation")
    seen: set[str] = set()
    for m in listed:
        if m.group(1):
            if m.group(1) in ("IF", "ITER", "LET", "METRICS") and not m.group(2):
                raise ConfigError(f"${m.group(1)} needs an argument in braces")
            task.items.append(Directive(m.group(1), m.group(2) or ""))
            continue
        name = m.group(0).strip()
        if name.startswith("$"):
            raise ConfigError(f"no such directive: {name}")
        if name in seen:
            raise ConfigError(f"operation {name} is listed twice")
        seen.add(name)
        task.items.append(_operation(name, given))
    for key, value in given.items():
        m = re.match(r"ds\.(input|output)\.(columns|delimiter|part_count)\.(.+)$", key)
        if m:
            setattr(getattr(task.stream(m.group(3)), m.group(1)), m.group(2), value)
    return task


def _operation(name: str, given: dict[str, str]) -> Operation:
    verb = given.get(f"op.operation.{name}")
    if not verb:
        raise ConfigError(f"operation {name} has no verb")
    under = lambda head: {k[len(head) :]: v for k, v in given.items() if k.startswith(head)}
    op = Operation(name, verb, under(f"op.definition.{name}."), split_list(given.get(f"op.inputs.{name}")), split_list(given.get(f"op.outputs.{name}")))
    op.input, op.output = under(f"op.input.{name}."), under(f"op.output.{name}.")
    if op.inputs and op.input or op.outputs and op.output:
        raise ConfigError(f"operation {name} has streams both by position and by name")
    return op


def to_properties(task: Task, prefix: str = "") -> str:
    """Properties that read as the same task."""
    escape = lambda v: v.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t")
    names = [f"${i.kind}" + (f"{{{i.argument}}}" if i.argument else "") if isinstance(i, Directive) else i.name for i in task.items]
    lines = {"task.input": ",".join(task.inputs), "task.operations": ",".join(names), "task.output": ",".join(task.outputs)}
    for layer, values in task.foreign.items():
        lines |= {f"{layer}.{k}": v for k, v in values.items()}
    for op in (i for i in task.items if isinstance(i, Operation)):
        lines[f"op.operation.{op.name}"] = op.verb
        lines |= {f"op.definition.{op.name}.{k}": v for k, v in op.definitions.items()}
        lines |= {f"op.input.{op.name}.{k}": v for k, v in op.input.items()} | {f"op.output.{op.name}.{k}": v for k, v in op.output.items()}
        lines |= {f"op.inputs.{op.name}": ",".join(op.inputs)} if op.inputs else {}
        lines |= {f"op.outputs.{op.name}": ",".join(op.outputs)} if op.outputs else {}
    for name, ds in task.streams.items():
        for side in ("input", "output"):
            lines |= {f"ds.{side}.{k}.{name}": v for k, v in asdict(getattr(ds, side)).items() if v is not None}
    dot = f"{prefix}." if prefix and not prefix.endswith(".") else prefix
    # A space, = or : within a key would end it.
    key = lambda k: re.sub(r"([ =:])", r"\\\1", k)
    return "".join(f"{dot}{key(k)}={escape(v)}\n" for k, v in lines.items() if v)


def to_json(task: Task) -> str:
    items = [{"directive": i.kind, "argument": i.argument} if isinstance(i, Directive) else asdict(i) for i in task.items]
    streams = {n: asdict(s) for n, s in task.streams.items()}
    return json.dumps({"items": items, "streams": streams, "inputs": task.inputs, "outputs": task.outputs, "prefix": task.prefix, "variables": task.variables, "foreign": task.foreign}, ensure_ascii=False, indent=2)


def from_json(text: str) -> Task:
    data = json.loads(text)
    items = [Directive(i["directive"], i.get("argument", "")) if "directive" in i else Operation(**i) for i in data["items"]]
    streams = {n: DataStream(StreamSpec(**s["input"]), StreamSpec(**s["output"])) for n, s in data.get("streams", {}).items()}
    return Task(items, streams, data.get("inputs", []), data.get("outputs", []), data.get("prefix", ""), data.get("variables", {}), data.get("foreign", {}))
