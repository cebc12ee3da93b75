"""Queries of the dialect to plans over named streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.dialect.compiler import NOTHING, NUMBER, TEXT, Compiler, Typed, conjuncts, kind_of
from terravane.dialect.parser import DialectError, InQuery, Name, Query, parse
from terravane.plans.ranks import repeated
from terravane.stream import KEY, Kind, Stream

_HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "OUTER": "full"}
_SHAPES = {"Point": Kind.POINT, "Polygon": Kind.POLYGON, "TrackSegment": Kind.TRACK, "SegmentedTrack": Kind.TRACK}
SAMPLE_SEED = 20_210_101


def select(query: str, streams: dict[str, Stream], inputs: list[str] | None = None) -> Stream:
    """Run a query over ``streams``; subqueries may name any of them, or take ``inputs`` after the main ones in order.

    Unknown columns are null. Columns of the result are called as their alias, else as the column they show, else
    ``_N_``. LIMIT n keeps n rows, LIMIT p% a seeded sample of about p percent.
    """
    tree = parse(query)
    if tree.shape:
        return _spatial(tree, streams, inputs)
    return _Plan(tree, streams, inputs).run()


class _Plan:
    def __init__(self, tree: Query, streams: dict[str, Stream], inputs: list[str] | None):
        self.tree, self.streams = tree, streams
        self.inputs = inputs or list(streams)
        names = tree.sources or self.inputs[:1]
        if names and names[0].endswith("*"):
            names = sorted(n for n in streams if n.startswith(names[0][:-1]))
        missing = [n for n in names if n not in streams]
        if missing:
            raise DialectError(f"no such stream: {', '.join(missing)}")
        self.sources = [streams[n].named(n) for n in names]
        self.marks: dict[int, Column] = {}

    def run(self) -> Stream:
        df, found, kind = self._from()
        self.df, self.found = df, found
        compiler = Compiler(self._resolve, self._member)
        if self.tree.where is not None:
            for part in conjuncts(self.tree.where):
                if isinstance(part, InQuery):
                    self.df = self._semi(part, compiler)
                else:
                    condition = compiler.truth(part)
                    self.df = self.df.filter(condition)
        key = [KEY] if kind is Kind.KV and KEY in self.df.columns else []
        if self.tree.items is None:
            columns = [F.col(f"`{internal}`").alias(shown) for internal, shown in self._all()]
        else:
            columns = []
            for i, (item, alias) in enumerate(zip(self.tree.items, self.tree.aliases), 1):
                name = alias or (item.name if isinstance(item, Name) else f"_{i}_")
                columns.append(compiler.value(item).column.alias(name))
        out = self.df.select(*key, *columns)
        return Stream(_limited(out, self.tree), kind)

    def _from(self) -> tuple[DataFrame, dict[tuple[str | None, str], tuple[str, str]], Kind]:
        """The source rows; names to (column, type); the kind."""
        combine, sources = self.tree.combine, self.sources
        if combine in _HOW:
            return self._join()
        first = sources[0]
        df = first.df
        if combine:
            if len({s.kind is Kind.KV for s in sources}) > 1:
                raise DialectError("a union is of pairs or of rows without keys")
            aligned = [s.df.toDF(*df.columns) if s.df.columns != df.columns else s.df for s in sources]
            df = {"UNION": _union, "UNION XOR": union_xor, "UNION AND": union_and}[combine](aligned)
        types = dict(df.dtypes)
        found: dict[tuple[str | None, str], tuple[str, str]] = {}
        for c in df.columns:
            if c == KEY and first.kind is Kind.KV:
                continue
            for source in (None, *[s.name for s in sources]):
                found[source, c] = (c, types[c])
        return df, found, first.kind

    def _join(self) -> tuple[DataFrame, dict, Kind]:
        if any(s.kind is not Kind.KV for s in self.sources):
            raise DialectError("only pairs can be joined")
        found: dict[tuple[str | None, str], tuple[str, str]] = {}
        parts = []
        for s in self.sources:
            parts.append(s.df.select(KEY, *[F.col(f"`{c}`").alias(f"{s.name}.{c}") for c in s.columns]))
            for c in s.columns:
                place = (f"{s.name}.{c}", dict(s.df.dtypes)[c])
                found[s.name, c] = place
                found.setdefault((None, c), place)
        df = reduce(lambda a, b: a.join(b, KEY, _HOW[self.tree.combine]), parts)
        return df, found, Kind.KV

    def _all(self) -> list[tuple[str, str]]:
        if self.tree.combine not in _HOW:
            return [(c, c) for c in self.df.columns if (None, c) in self.found]
        names = [c for s in self.sources for c in s.columns]
        return [(f"{s.name}.{c}", c if names.count(c) == 1 else f"{s.name}.{c}") for s in self.sources for c in s.columns]

    def _resolve(self, name: Name) -> Typed:
        place = self.found.get((name.source, name.name)) or self.found.get((None, f"{name.source}.{name.name}"))
        if place is None:
            return Typed(F.lit(None).cast("string"), NOTHING)
        return Typed(F.col(f"`{place[0]}`"), kind_of(place[1]), nan=place[1] in ("float", "double", "string"))

    def _subset(self, node: InQuery, left: Typed) -> tuple[DataFrame, Column]:
        """Distinct non-null members as column ``_m``, and the left value to compare."""
        if node.source in self.streams:
            source = self.streams[node.source].named(node.source)
        else:
            rest = self.inputs[len(self.sources) :]
            if node.number >= len(rest):
                raise DialectError(f"no such stream: {node.source}")
            source = self.streams[rest[node.number]].named(node.source)
        inner = _Plan(Query(items=[node.column], aliases=[None], sources=[source.name], where=node.where), {source.name: source}, [source.name])
        df = inner.run().df
        column = df.columns[-1]
        numeric = left.kind == NUMBER or kind_of(dict(df.dtypes)[column]) == NUMBER
        member = F.col(f"`{column}`").cast("string")
        members = df.select((member.try_cast("double") if numeric else member).alias("_m")).filter(F.col("_m").isNotNull())
        return members, left.number() if numeric else left.text()

    def _semi(self, node: InQuery, compiler: Compiler) -> DataFrame:
        members, value = self._subset(node, compiler.value(node.arg))
        return self.df.join(members, value == F.col("_m"), "left_anti" if node.negated else "left_semi")

    def _member(self, node: InQuery, left: Typed) -> Column:
        members, value = self._subset(node, left)
        mark = f"_in_{node.number}"
        marked = members.distinct().withColumnRenamed("_m", f"{mark}_m").withColumn(mark, F.lit(True))
        self.df = self.df.join(marked, value == F.col(f"{mark}_m"), "left").drop(f"{mark}_m")
        return F.col(mark).isNotNull()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def union_and(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, as often as where they are rarest."""
    return reduce(DataFrame.intersectAll, parts)


def union_xor(parts: list[DataFrame]) -> DataFrame:
    """Rows of exactly one part, as often as there; counted by (row, part) before, so repeats shuffle once."""
    columns = parts[0].columns
    tagged = _union([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    counted = tagged.groupBy(*columns, "_part").agg(F.count(F.lit(1)).alias("_n"))
    single = counted.groupBy(*columns).agg(F.count(F.lit(1)).alias("_parts"), F.sum("_n").alias("_n")).filter(F.col("_parts") == 1)
    return repeated(single.select(*columns, "_n"), "_n")


def _limited(df: DataFrame, tree: Query) -> DataFrame:
    if tree.limit is None:
        return df
    if tree.percent:
        return df.sample(fraction=min(1.0, max(0.0, tree.limit / 100)), seed=SAMPLE_SEED)
    return df.limit(int(tree.limit))


def _spatial(tree: Query, streams: dict[str, Stream], inputs: list[str] | None) -> Stream:
    """Filters objects by their properties; on tracks, Point and TrackSegment prune within and keep the rest of the track."""
    name = tree.sources[0] if tree.sources else (inputs or list(streams))[0]
    source = streams[name]
    wanted = _SHAPES[tree.shape]
    if source.kind is not Kind.TRACK and source.kind is not wanted:
        raise DialectError(f"{name} has no {tree.shape}")
    df = source.df
    if tree.where is not None:
        props = _properties(source, tree.shape)

        def resolve(n: Name) -> Typed:
            key = n.name if n.source in (None, name) else f"{n.source}.{n.name}"
            return Typed(props[key], TEXT)

        def member(node: InQuery, left: Typed) -> Column:
            raise DialectError("subqueries are for columns")

        df = df.filter(Compiler(resolve, member).truth(tree.where))
    return Stream(_limited(df, tree), source.kind)


def _properties(source: Stream, shape: str) -> Column:
    """Properties that a predicate sees: those of the object and of what it belongs to, the inner ones first."""
    if source.kind is not Kind.TRACK:
        made = {"_center_lat": "lat", "_center_lon": "lon", "_radius": "radius"} if source.kind is Kind.POINT else {"_center_lat": "center_lat", "_center_lon": "center_lon"}
        return _overlaid(_generated(made), F.col("props"))
    levels = {"SegmentedTrack": ["track_props"], "TrackSegment": ["seg_props", "track_props"], "Point": ["props", "seg_props", "track_props"]}[shape]
    return reduce(_overlaid, [*([_generated({"_ts": "_ts"})] if shape == "Point" else []), *[F.col(c) for c in levels]])


def _generated(columns: dict[str, str]) -> Column:
    """Properties that every object has of itself, from its own columns; nulls are left out."""
    full = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), F.col(c).cast("string"))])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def _overlaid(inner: Column, outer: Column) -> Column:
    """One map; entries of ``inner`` win."""
    extra = F.map_filter(outer, lambda k, _: ~F.map_contains_key(inner, k))
    return F.map_concat(inner, extra)
