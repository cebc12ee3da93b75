"""Syntax trees to Columns, with the dialect's rules for nulls and types.

Values are loosely typed: text counts as a number where a number is asked for, and is null if it is none. An operator
with a null argument gives null (also OR), except ``:``; a null condition is false. Equality compares numbers if either
side is one. NOT IN a list of strings holds for null, IN and BETWEEN never do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.dialect.parser import Between, Binary, DialectError, InList, InQuery, IsNull, Literal, Name, Unary

NUMBER, TEXT, TRUTH, NOTHING = "number", "text", "truth", "nothing"


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    nan: bool = True  # whether its number may be NaN, which no comparison holds for

    def number(self) -> Column:
        if self.kind == NUMBER:
            return self.column.cast("double")
        return self.column.cast("string").try_cast("double")

    def long(self) -> Column:
        return F.when(~F.isnan(self.number()), self.number()).cast("bigint")

    def text(self) -> Column:
        return self.column.cast("string")

    def truth(self) -> Column:
        return self.column if self.kind == TRUTH else F.lower(self.text()) == "true"


def kind_of(spark_type: str) -> str:
    base = spark_type.split("(")[0]
    if base in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return NUMBER
    return TRUTH if base == "boolean" else TEXT


def pattern(text: str) -> str:
    """The dialect's patterns match whole values; ``/pattern/flags``: i any case, s the dot stops at line ends."""
    flags = "m"
    if text.startswith("/") and "/" in text[1:]:
        text, _, given = text[1:].rpartition("/")
        flags += ("i" if "i" in given else "") + ("" if "s" in given else "s")
    return rf"(?{flags})\A(?:{text})\z"


class Compiler:
    """``resolve`` gives a Typed for a Name (nothing for unknown ones), ``member`` a Column that tells if a row is in a subquery."""

    def __init__(self, resolve: Callable[[Name], Typed], member: Callable[[InQuery, Typed], Column]):
        self.resolve, self.member = resolve, member

    def truth(self, node: object) -> Column:
        """A condition that is never null."""
        if isinstance(node, Binary) and node.op == "AND":
            return self.truth(node.left) & self.truth(node.right)
        if isinstance(node, Binary) and node.op == "OR":
            a, b = self.value(node.left).truth(), self.value(node.right).truth()
            return F.coalesce((a | b) & a.isNotNull() & b.isNotNull(), F.lit(False))
        return F.coalesce(self.value(node).truth(), F.lit(False))

    def value(self, node: object) -> Typed:
        if isinstance(node, Literal):
            kinds = {float: NUMBER, str: TEXT, bool: TRUTH, type(None): NOTHING}
            return Typed(F.lit(node.value), kinds[type(node.value)], nan=False)
        if isinstance(node, Name):
            return self.resolve(node)
        if isinstance(node, Unary):
            return self._unary(node.op, self.value(node.arg))
        if isinstance(node, Binary) and node.op in ("LIKE", "MATCH", "REGEX"):
            if not (isinstance(node.right, Literal) and isinstance(node.right.value, str)):
                raise DialectError("a pattern must be a literal string")
            return Typed(self.value(node.left).text().rlike(pattern(node.right.value)), TRUTH)
        if isinstance(node, Binary):
            return self._binary(node.op, self.value(node.left), self.value(node.right))
        if isinstance(node, IsNull):
            column = self.value(node.arg).column
            return Typed(column.isNotNull() if node.negated else column.isNull(), TRUTH)
        if isinstance(node, Between):
            arg = self.value(node.arg)
            number = arg.number()
            within = (number < node.low) | _ordered(number > node.high, arg) if node.negated else number.between(node.low, node.high)
            return Typed(F.coalesce(within, F.lit(False)), TRUTH)
        if isinstance(node, InList):
            arg = self.value(node.arg)
            if isinstance(node.values[0], str):
                inside = F.coalesce(arg.text().isin(*node.values), F.lit(False))
                return Typed(~inside if node.negated else inside, TRUTH)
            inside = arg.number().isin(*node.values)
            return Typed(F.coalesce(~inside if node.negated else inside, F.lit(False)), TRUTH)
        if isinstance(node, InQuery):
            inside = self.member(node, self.value(node.arg))
            return Typed(~inside if node.negated else inside, TRUTH)
        raise DialectError(f"cannot evaluate {node}")

    def _unary(self, op: str, a: Typed) -> Typed:
        if op == "NOT":
            return Typed(~a.truth(), TRUTH)
        if op == "~":
            return Typed(F.bitwise_not(a.long()), NUMBER)
        return Typed(-a.number() if op == "-" else F.abs(a.number()), NUMBER)

    def _binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op == ":":
            same = a.kind == b.kind or NOTHING in (a.kind, b.kind)
            kind = b.kind if a.kind == NOTHING else a.kind
            return Typed(F.coalesce(a.column, b.column) if same else F.coalesce(a.text(), b.text()), kind if same else TEXT)
        if op == "?":
            return Typed(F.when(a.truth(), b.column), b.kind)
        if op in ("AND", "OR", "XOR"):
            p, q = a.truth(), b.truth()
            both = {"AND": p & q, "OR": p | q, "XOR": p != q}[op]
            return Typed(F.when(p.isNotNull() & q.isNotNull(), both), TRUTH)
        if op in ("=", "==", "!=", "<>"):
            if NUMBER in (a.kind, b.kind):
                equal = a.number() == b.number()
                if a.nan and b.nan:
                    equal = equal & ~F.isnan(a.number())
            elif TRUTH in (a.kind, b.kind):
                equal = a.truth() == b.truth()
            else:
                equal = a.text() == b.text()
            return Typed(~equal if op in ("!=", "<>") else equal, TRUTH)
        if op in (">", ">=", "<", "<="):
            x, y = a.number(), b.number()
            return Typed(_ordered({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op], a if op in (">", ">=") else b), TRUTH)
        if op == "||":
            return Typed(F.concat(a.text(), b.text()), TEXT)
        if op in ("|", "#", "&", "<<", ">>"):
            return Typed(self._bits(op, a.long(), b.long()), NUMBER)
        return Typed(_arithmetic(op, a.number(), b.number()), NUMBER)

    @staticmethod
    def _bits(op: str, a: Column, b: Column) -> Column:
        if op == "<<":
            return F.call_function("shiftleft", a, b.cast("int"))
        if op == ">>":
            return F.call_function("shiftright", a, b.cast("int"))
        return {"|": a.bitwiseOR, "#": a.bitwiseXOR, "&": a.bitwiseAND}[op](b)


def _ordered(comparison: Column, greater: Typed) -> Column:
    """Spark sorts NaN above all numbers; here it is above none."""
    return comparison & ~F.isnan(greater.number()) if greater.nan else comparison


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    """Arithmetic of doubles; division by zero gives infinities and NaN instead of null or an error."""
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "^":
        return F.pow(a, b)
    nan = F.lit(float("nan"))
    if op == "%":
        return F.when(b == 0, F.when(a.isNotNull(), nan)).otherwise(F.try_mod(a, b))
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), nan)
    by_zero = F.when(F.isnan(a), nan).otherwise(by_zero)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def conjuncts(node: object) -> list:
    """The parts of a condition that must all hold."""
    if isinstance(node, Binary) and node.op == "AND":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
