"""Several tasks as one: names get the task's alias, shared streams are mapped to each other."""

from __future__ import annotations

import re
from copy import deepcopy

from terravane.tdl.config import ConfigError, Directive, Operation, Task


def compose(tasks: dict[str, Task], mapping: dict[str, str] | None = None, full: bool = False) -> Task:
    """One task that runs ``tasks`` in order.

    Streams and operations are called ``<alias>_<name>``. ``mapping`` names an earlier output (``alias.stream``) as the
    source of a later input (``alias.stream``). Outputs are those of the last task, or of all tasks if ``full``.
    """
    links: dict[str, str] = {}
    for later, earlier in (mapping or {}).items():
        (a, x), (b, y) = later.split(".", 1), earlier.split(".", 1)
        for alias, _ in ((a, x), (b, y)):
            if alias not in tasks:
                raise ConfigError(f"no task called {alias}")
        links[f"{a}_{x}"] = f"{b}_{y}"
    out = Task()
    for alias, given in tasks.items():
        task = deepcopy(given)
        streams = {*task.streams, *task.inputs, *[o.rstrip("*") for o in task.outputs]}
        for op in (i for i in task.items if isinstance(i, Operation)):
            streams |= {n.rstrip("*") for n in (*op.inputs, *op.outputs, *op.input.values(), *op.output.values())}

        def renamed(name: str, alias: str = alias) -> str:
            new = f"{alias}_{name}"
            return links.get(new, new)

        def in_text(text: str, streams: set[str] = streams) -> str:
            known = sorted((re.escape(s) for s in streams if s), key=len, reverse=True)
            pattern = rf"(?<![\w.\"'])({'|'.join(known)})(?=\.[\w\"]|\b(?![\w(]))" if known else r"(?!)"
            return re.sub(pattern, lambda m: renamed(m.group(1)), text)

        out.inputs += [n for i in task.inputs if (n := f"{alias}_{i}") not in links]
        outputs = [renamed(o) for o in task.outputs]
        out.outputs = out.outputs + outputs if full else outputs
        for name, spec in task.streams.items():
            spec = deepcopy(spec)
            if spec.output.columns:
                spec.output.columns = ",".join(in_text(c) for c in spec.output.columns.split(","))
            held = out.stream(renamed(name))
            for side in ("input", "output"):
                for what, value in vars(getattr(spec, side)).items():
                    if value is not None and getattr(getattr(held, side), what) is None:
                        setattr(getattr(held, side), what, value)
        for layer, values in task.foreign.items():
            held = out.foreign.setdefault(layer, {})
            for key, value in values.items():
                head, dot, name = key.partition(".")
                held[f"{head}.{renamed(name)}" if dot and name in streams else key] = value
        for item in task.items:
            if isinstance(item, Directive):
                variable, colon, rest = item.argument.partition(":")
                if item.kind == "LET":
                    out.items.append(Directive(item.kind, f"{variable}:{renamed(rest)}"))
                elif item.kind == "METRICS" and not item.argument.startswith(":"):
                    out.items.append(Directive(item.kind, renamed(item.argument)))
                else:
                    out.items.append(Directive(item.kind, f"{variable}{colon}{rest}"))
                continue
            op = deepcopy(item)
            op.name = f"{alias}_{item.name}"
            op.inputs, op.outputs = [renamed(n) for n in op.inputs], [renamed(n) for n in op.outputs]
            op.input, op.output = {s: renamed(n) for s, n in op.input.items()}, {s: renamed(n) for s, n in op.output.items()}
            op.definitions = {k: in_text(v) for k, v in op.definitions.items()}
            out.items.append(op)
        out.variables |= task.variables
    return out
