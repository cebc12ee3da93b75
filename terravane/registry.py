"""Verbs: named operations with typed parameters that turn streams into streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from terravane.stream import Stream


class OperationError(ValueError):
    """A verb called with inputs or parameters that it does not take."""


@dataclass(frozen=True)
class Param:
    """kind: str, int, float, bool, list (comma-separated), column or columns. A name that ends in ``.`` takes any ending."""

    name: str
    kind: str = "str"
    default: object = None
    required: bool = False
    choices: tuple[str, ...] = ()
    doc: str = ""

    def parse(self, text: str) -> object:
        try:
            if self.kind == "int":
                return int(float(text))
            if self.kind == "float":
                return float(text)
        except ValueError:
            raise OperationError(f"{self.name} needs a number, not {text!r}") from None
        if self.kind == "bool":
            return text.strip().lower() == "true"
        if self.kind in ("list", "columns"):
            return [v.strip() for v in text.split(",") if v.strip()]
        if self.choices and text.upper() not in self.choices:
            raise OperationError(f"{self.name} is one of {', '.join(self.choices)}, not {text!r}")
        return text.upper() if self.choices else text


@dataclass
class Call:
    """One use of a verb: its inputs (by position or slot), parameters and the names its outputs will have."""

    inputs: list[Stream]
    slots: dict[str, Stream]
    values: dict[str, object]
    outputs: list[str] = field(default_factory=list)
    output_slots: dict[str, str] = field(default_factory=dict)
    output_columns: dict[str, list[str]] = field(default_factory=dict)
    delimiters: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> object:
        return self.values.get(name)

    def any(self, prefix: str) -> dict[str, object]:
        """Values of a parameter with a free ending, by ending."""
        return {k[len(prefix) :]: v for k, v in self.values.items() if k.startswith(prefix)}

    def stream(self, slot: str | None = None) -> Stream:
        if slot is not None and slot in self.slots:
            return self.slots[slot]
        if slot is None and self.inputs:
            return self.inputs[0]
        raise OperationError(f"input {slot or 0} is missing")

    def column(self, name: str, stream: Stream | None = None) -> str | None:
        value = self.values.get(name)
        return None if value is None else bare(str(value), stream or self.stream())

    def columns(self, name: str, stream: Stream | None = None) -> list[str] | None:
        value = self.values.get(name)
        return None if value is None else [bare(v, stream or self.stream()) for v in value]


def bare(reference: str, stream: Stream) -> str:
    """``ds.column`` without the name of the stream."""
    return reference[len(stream.name) + 1 :] if stream.name and reference.startswith(f"{stream.name}.") else reference


@dataclass(frozen=True)
class Verb:
    name: str
    run: Callable[[Call], dict[str | int, Stream]]
    params: tuple[Param, ...]
    inputs: tuple[str, ...]  # slots; empty: by position
    outputs: tuple[str, ...]
    doc: str

    def typed(self, given: dict[str, str]) -> dict[str, object]:
        """Parameters by name, defaults filled in; unknown and missing ones are errors."""
        exact = {p.name: p for p in self.params}
        free = [p for p in self.params if p.name.endswith(".")]
        out: dict[str, object] = {}
        for name, text in given.items():
            param = exact.get(name) or next((p for p in free if name.startswith(p.name)), None)
            if param is None:
                raise OperationError(f"{self.name} has no parameter {name}")
            out[name] = param.parse(text) if isinstance(text, str) else text
        for param in self.params:
            if param.name.endswith(".") or param.name in out:
                continue
            if param.required:
                raise OperationError(f"{self.name} needs {param.name}")
            out[param.name] = param.default
        return out


VERBS: dict[str, Verb] = {}


def operation(name: str, *params: Param, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = ()) -> Callable:
    """Registers a function of a Call as a verb; it returns streams by output slot, or by position from 0."""

    def add(run: Callable[[Call], dict[str | int, Stream]]) -> Callable:
        VERBS[name] = Verb(name, run, params, inputs, outputs, (run.__doc__ or "").strip())
        return run

    return add


def describe(name: str | None = None) -> str:
    """Markdown of one verb, or of all: what it does, its inputs, outputs and parameters."""
    import terravane.verbs  # noqa: F401, PLC0415 - registers the verbs

    lines = []
    for verb in [VERBS[name]] if name else [VERBS[n] for n in sorted(VERBS)]:
        lines += [f"## {verb.name}", "", verb.doc, ""]
        lines += [f"Inputs: {', '.join(verb.inputs) or 'by position'}. Outputs: {', '.join(verb.outputs) or 'by position'}.", ""]
        for p in verb.params:
            kind = p.kind if not p.choices else " or ".join(p.choices)
            rest = "required" if p.required else f"default {p.default}"
            lines.append(f"- `{p.name}{'*' if p.name.endswith('.') else ''}` ({kind}, {rest}) {p.doc}".rstrip())
        lines.append("")
    return "\n".join(lines)
