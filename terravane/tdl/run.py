"""python -m terravane.tdl.run CONFIG [--variables FILE | --var NAME=VALUE] [--local N] [--prefix P] [--metrics] [--wrap nop|to|from|both]"""

from __future__ import annotations

import argparse
import base64
from pathlib import Path

from pyspark.sql import SparkSession

from terravane.session import SETTINGS
from terravane.sources.storage import write_manifest
from terravane.tdl.config import Directive, Task, from_json, from_properties, parse_properties
from terravane.tdl.interpreter import Interpreter

DIRECTIONS = ("nop", "to", "from", "both")


def load(path: str, prefix: str = "", variables: dict[str, str] | None = None) -> Task:
    text = Path(path).read_text(encoding="utf-8")
    task = from_json(text) if path.endswith(".json") else from_properties(text, prefix)
    task.variables |= variables or {}
    return task


def variables_of(file: str | None, pairs: list[str], encoded: str | None = None) -> dict[str, str]:
    """Variables of a properties file, of NAME=VALUE pairs, and of Base64 properties; later ones win."""
    out = parse_properties(Path(file).read_text(encoding="utf-8")) if file else {}
    if encoded:
        out |= parse_properties(base64.b64decode(encoded).decode("utf-8"))
    return out | dict(p.split("=", 1) for p in pairs)


def with_metrics(task: Task) -> Task:
    """The task with metrics of its inputs before, and of its outputs after, all operations."""
    task.items = [Directive("METRICS", ":input"), *task.items, Directive("METRICS", ":output")]
    return task


def direction(task: Task, given: str | None) -> str:
    """Where data would be copied; data are read in place here, so it only has to be a known word."""
    word = (given or task.foreign.get("dist", {}).get("wrap") or "nop").lower()
    if word not in DIRECTIONS:
        raise ValueError(f"wrap is one of {', '.join(DIRECTIONS)}")
    return word


def main(args: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    parser.add_argument("--variables")
    parser.add_argument("--encoded")
    parser.add_argument("--var", action="append", default=[])
    parser.add_argument("--local", type=int)
    parser.add_argument("--prefix", default="")
    parser.add_argument("--metrics", action="store_true")
    parser.add_argument("--wrap")
    parser.add_argument("--manifest")
    given = parser.parse_args(args)
    builder = SparkSession.builder.appName("terravane")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if given.local:
        builder = builder.master(f"local[{given.local}]")
    spark = builder.getOrCreate()
    task = load(given.config, given.prefix, variables_of(given.variables, given.var, given.encoded))
    direction(task, given.wrap)
    interpreter = Interpreter(spark, with_metrics(task) if given.metrics else task)
    interpreter.run()
    names = interpreter.save()
    if given.manifest:
        write_manifest(spark, [(n, interpreter.streams[n].df) for n in names], given.manifest)
    if given.metrics and "_metrics" in interpreter.streams:
        interpreter.streams["_metrics"].df.show(truncate=False)
    return names


if __name__ == "__main__":
    main()
