"""Timestamps in many formats and zones to one UTC instant, and zones estimated where none is given.

``normalise_instants`` reads the text by its form (a few characters decide, one regular expression splits it), takes the zone from
the text, the zone column or an estimated offset history, and converts with the zone's rules. Everything is a Column
expression; the only join is with the JVM's list of region names, which has some 600 rows and is broadcast.

``offset_histories`` estimates zones for devices whose local clocks have none: local minus ingestion time, rounded to
quarter hours and counted per device and hour of the local clock, is aligned by dynamic programming over candidate
offsets. An offset violates a record if the record would have been ingested before it happened or later than the allowed
delay; the history with the fewest violations, each change of offset costing a penalty, is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.clock import DAY, SECOND, civil_days, in_zone, month_number, offset_micros, wall_micros, zone_names
from terravane.session import fresh

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?)?\s*(?:\[([A-Za-z0-9_+/-]+)\])?"
#: Form name, pattern, replacement to year|month|day|day of year|hour|minute|second|fraction|half|offset|region.
FORMS = {
    "ordinal": (rf"^(\d{{4}})-(\d{{3}})(?:[Tt]|\s+){_TIME}{_ZONE}$", "$1|||$2|$3|$4|$5|$6||$7|$8"),
    "iso": (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[Tt]|\s+){_TIME}{_ZONE}$", "$1|$2|$3||$4|$5|$6|$7||$8|$9"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "$1|$2|$3||$4|$5|$6|$7||$8|$9"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3||$4|$5|$6||||"),
    "half_day": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_TIME}\s*([AaPp])[Mm]{_ZONE}$", "$3|$1|$2||$4|$5|$6|$7|$8|$9|$10"),
    "day_first": (rf"^(\d{{1,2}})[./](\d{{1,2}})[./](\d{{4}})\s+{_TIME}{_ZONE}$", "$3|$2|$1||$4|$5|$6|$7||$8|$9"),
    "named": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})(?:-|\s+)([A-Za-z]{{3}})[a-z]*(?:[-,]\s*|\s+)(\d{{4}}),?\s+{_TIME}(?:\s*([AaPp])[Mm])?{_ZONE}$", "$3|$2|$1||$4|$5|$6|$7|$8|$9|$10"),
}
_FOUND = "\x01"


def _split(text: Column) -> Column:
    """The parts of a date and time after a mark; anything else comes out without it.

    A few characters tell which form a text can only have, so that one pattern is matched for each.
    """
    at = lambda i: F.substring(text, i, 1)
    digit = lambda i: at(i).between("0", "9")
    match = lambda form: F.regexp_replace(text, FORMS[form][0], _FOUND + FORMS[form][1])
    year_first = at(5).isin("-", "/") & digit(2) & digit(3) & digit(4)
    slashed = at(2).isin("/", ".") | at(3).isin("/", ".")
    return (
        F.when(year_first & at(9).isin("T", "t", " ") & digit(8), match("ordinal"))
        .when(year_first, match("iso"))
        .when(digit(5) & at(9).isin("T", "t"), match("basic"))
        .when(digit(5) & (F.length(text) == 14), match("compact"))
        .when(slashed & (F.instr(text, "/") > 0) & text.rlike("[AaPp][Mm]"), match("half_day"))
        .when(slashed, match("day_first"))
        .when(F.instr(text, ":") > 0, match("named"))
    )


def epoch_micros(value: Column, number: bool = False) -> Column:
    """Epoch in seconds (10 digits, as text perhaps with decimals), milli- (13) or microseconds (16), text or whole number."""
    if number:
        v = value.cast("bigint")
        return F.when(v.between(10**9, 10**10 - 1), v * SECOND).when(v.between(10**12, 10**13 - 1), v * 1000).when(v.between(10**15, 10**16 - 1), v)
    size, plain = F.length(value), F.instr(value, ".") == 0
    seconds = F.substring(value, 1, 10).try_cast("bigint") * SECOND + F.rpad(F.substring(value, 12, 6), 6, "0").try_cast("bigint")
    known = F.when(plain & (size == 13), value.try_cast("bigint") * 1000).when(plain & (size == 16), value.try_cast("bigint")).otherwise(seconds)
    # Only what is made of digits is matched at all.
    return F.when((size >= 10) & F.substring(value, 5, 1).between("0", "9") & value.rlike(r"^(?:\d{10}(?:\.\d+)?|\d{13}|\d{16})$"), known)


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    """One projection; each step refers to names of the step before, so the optimiser keeps them apart."""
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def _read(df: DataFrame, text: Column, side: str) -> DataFrame:
    """Adds ``<side>epoch``, ``<side>wall`` (microseconds as if UTC), ``<side>off`` and ``<side>reg``: what the text says.

    All are null for a text that is no date and time.
    """
    n = lambda name: f"{side}{name}"
    c = lambda name: F.col(n(name))
    df = _add(df, **{n("text"): F.trim(F.translate(text, "\t\n\r\f\v", "     "))})
    df = _add(df, **{n("split"): _split(c("text")), n("epoch"): epoch_micros(c("text"))})
    parts = F.when(c("split").startswith(_FOUND), F.split(F.substring(c("split"), 2, 1000), r"\|", -1))
    df = _add(df, **{n("p"): F.transform(parts, lambda v: F.nullif(v, F.lit("")))})
    names = ["y", "mo", "d", "doy", "h", "mi", "s", "frac", "half", "off", "reg"]
    df = _add(df, **{n(k): F.get(c("p"), F.lit(i)) for i, k in enumerate(names)})
    number = lambda k: c(k).try_cast("int")
    month = F.coalesce(number("mo"), month_number(c("mo")))
    hour = F.when(c("half").isNull(), number("h")).when(
        number("h").between(1, 12), number("h") % 12 + F.when(F.lower(c("half")) == "p", 12).otherwise(0)
    )
    df = _add(
        df,
        **{n("yi"): number("y"), n("moi"): month, n("di"): number("d"), n("doyi"): number("doy"), n("hi"): hour},
        **{n("mii"): number("mi"), n("si"): F.coalesce(number("s"), F.lit(0))},
        **{n("us"): F.coalesce(F.rpad(F.substring(c("frac"), 1, 6), 6, "0").cast("bigint"), F.lit(0))},
    )
    first = civil_days(c("yi"), F.lit(1), F.lit(1))
    leap = ((c("yi") % 4 == 0) & (c("yi") % 100 != 0)) | (c("yi") % 400 == 0)
    by_day = F.when((c("doyi") >= 1) & (c("doyi") <= F.when(leap, 366).otherwise(365)), first + c("doyi") - 1)
    df = _add(df, **{n("days"): F.when(c("doyi").isNotNull(), by_day).otherwise(civil_days(c("yi"), c("moi"), c("di")))})
    df = _add(df, **{n("wall"): wall_micros(c("days"), c("hi"), c("mii"), c("si"), c("us"))})
    passing = ["text", "split", "p", "y", "mo", "d", "doy", "h", "mi", "s", "frac", "half", "yi", "moi", "di", "doyi", "hi", "mii", "si", "us", "days"]
    return df.drop(*[n(k) for k in passing])


def _candidates(df: DataFrame, side: str, zones: DataFrame, zone: Column, guess: Column) -> DataFrame:
    """Adds ``<side>cand``, the instants a text may mean: null if it is no date and time or has neither zone nor ``guess``,
    empty if no instant shows it."""
    n = lambda name: f"{side}{name}"
    c = lambda name: F.col(n(name))
    given = F.coalesce(c("off"), c("reg"), zone)
    df = _add(df, **{n("key"): F.lower(given), n("num"): offset_micros(given)})
    df = df.join(
        zones.select(F.col("_zone_key").alias(n("key")), F.col("_zone_name").alias(n("name")), F.col("_zone_fixed").alias(n("fix"))), n("key"), "left"
    )
    unknown = c("off").isNull() & c("reg").isNull() & c("name").isNull()
    fixed = F.coalesce(c("num"), c("fix"), F.when(unknown, guess))
    around = [in_zone(c("wall") + d * DAY, c("name")) - (c("wall") + d * DAY) for d in (-1, 1)]
    df = _add(df, **{n("fixed"): fixed, n("o1"): around[0], n("o2"): around[1]})
    shown = lambda o: F.when(in_zone(c("wall") - o, c("name")) == c("wall"), c("wall") - o)
    df = _add(df, **{n("c1"): shown(c("o1")), n("c2"): F.when(c("o1") != c("o2"), shown(c("o2")))})
    found = (
        F.when(c("epoch").isNotNull(), F.array(c("epoch")))
        .when(c("wall").isNull() | (given.isNull() & guess.isNull()), F.lit(None).cast("array<bigint>"))
        .when(c("fixed").isNotNull(), F.array(c("wall") - c("fixed")))
        .otherwise(F.array_compact(F.array(c("c1"), c("c2"))))
    )
    return _add(df, **{n("cand"): found}).drop(*[n(k) for k in ("key", "num", "fix", "name", "fixed", "o1", "o2", "c1", "c2", "epoch", "wall", "off", "reg")])


def normalise_instants(
    df: DataFrame,
    text: str,
    zone: str,
    epoch: str,
    converted: str,
    converted_zone: str,
    estimated_offset: str | None = None,
    tolerance_us: int = 60 * SECOND,
) -> DataFrame:
    """Adds ``_utc_us`` (microseconds, null if undetermined) and ``_decided_by`` (text, epoch or converted).

    ``text`` decides if it is a real date and time: with an offset, abbreviation or region of its own, else in ``zone``
    (region in any case, or offset; null or blank: ``estimated_offset`` in microseconds if given, else GMT). A wall
    clock shown twice is settled by the candidate that lies within ``tolerance_us`` of ``epoch`` or else of
    ``converted``, if just one does; one that is never shown, or whose zone is unknown, is undetermined. Otherwise
    ``epoch`` decides (0, -1, null and other lengths are missing), then ``converted``, read in ``converted_zone``
    unless it has an offset; so too for a text without any zone whose ``estimated_offset`` is null. Nulls in any column count as missing; repeated rows are kept; columns of the input named
    ``_utc_us`` or ``_decided_by`` are replaced. Extra columns pass through.
    """
    zones = F.broadcast(zone_names(df.sparkSession))
    whole = dict(df.dtypes)[epoch] in ("bigint", "int", "smallint", "tinyint")
    original = [c for c in df.columns if c not in ("_utc_us", "_decided_by")]
    given = lambda name: F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
    state = df.select(
        F.struct(*[F.col(f"`{c}`") for c in original]).alias("_row"),
        F.col(f"`{text}`").alias("_a"),
        F.col(f"`{converted}`").alias("_b"),
        (given(zone) if estimated_offset else F.coalesce(given(zone), F.lit("GMT"))).alias("_az"),
        F.coalesce(given(converted_zone), F.lit("GMT")).alias("_bz"),
        (F.col(f"`{estimated_offset}`") if estimated_offset else F.lit(None)).cast("bigint").alias("_guess"),
        (epoch_micros(F.col(f"`{epoch}`"), True) if whole else epoch_micros(F.trim(F.col(f"`{epoch}`").cast("string")))).alias("_ce"),
    )
    state = _candidates(_read(state, F.col("_a"), "_a"), "_a", zones, F.col("_az"), F.when(F.col("_az").isNull(), F.col("_guess")))
    # The converted text is read only where it has a say: nothing else does, or the first one may mean two instants.
    asked = (F.col("_acand").isNull() & F.col("_ce").isNull()) | (F.size("_acand") > 1)
    state = _candidates(_read(state, F.when(asked, F.col("_b")), "_b"), "_b", zones, F.col("_bz"), F.lit(None).cast("bigint"))
    near = lambda c, others: F.exists(others, lambda o: F.abs(o - c) < tolerance_us)
    state = _add(
        state,
        _near_e=F.filter("_acand", lambda c: F.abs(c - F.col("_ce")) < tolerance_us),
        _near_b=F.filter("_acand", lambda c: near(c, F.col("_bcand"))),
    )
    sole = lambda name: F.when(F.size(name) == 1, F.get(F.col(name), F.lit(0)))
    text_says = F.col("_acand").isNotNull()
    state = state.select(
        "_row",
        F.when(text_says, F.coalesce(sole("_acand"), sole("_near_e"), sole("_near_b")))
        .when(F.col("_ce").isNotNull(), F.col("_ce"))
        .otherwise(sole("_bcand"))
        .alias("_utc_us"),
        F.when(text_says, "text").when(F.col("_ce").isNotNull(), "epoch").otherwise("converted").alias("_by"),
    )
    return state.select(
        *[F.col("_row").getField(c).alias(c) for c in original],
        "_utc_us",
        F.when(F.col("_utc_us").isNotNull(), F.col("_by")).alias("_decided_by"),
    )


QUARTER = 900 * SECOND
#: The offsets that zones have, in quarter hours.
LEAST, MOST = -12 * 4, 14 * 4


def _history(counts: pd.DataFrame, penalty: float, delay_us: int) -> pd.DataFrame:
    """Offsets by hour of one device, by dynamic programming over the candidates that occur; null if none does."""
    days, at = np.unique(counts["_hour"].to_numpy(), return_inverse=True)
    late, n = counts["_lag"].to_numpy(np.int64) * QUARTER, counts["_n"].to_numpy(float)
    offsets = np.unique(np.concatenate([np.unique(-late), np.unique(-late) + QUARTER]))
    offsets = offsets[(offsets >= LEAST * QUARTER) & (offsets <= MOST * QUARTER)]
    if not len(offsets):
        return pd.DataFrame({"_hour": days, "_offset_us": pd.array([None] * len(days), dtype="Int64")})
    # ingestion minus instant, were the offset right; _lag is ingestion minus wall clock in whole quarters, rounded down
    waits = late[:, None] + offsets[None, :]
    wrong = ((waits < 0) | (waits > delay_us)) * 1.0 + np.clip(waits, 0, delay_us) / (20.0 * max(delay_us, 1))
    # what a row costs under every offset decides nothing; hours of such rows alone then cost exactly nothing
    wrong -= wrong.min(axis=1, keepdims=True)
    cost = np.zeros((len(days), len(offsets)))
    np.add.at(cost, at, wrong * n[:, None])
    back = np.zeros(cost.shape, np.int64)
    total = cost[0]
    for d in range(1, len(days)):
        best = int(total.argmin())
        stay = total <= total[best] + penalty
        back[d] = np.where(stay, np.arange(len(offsets)), best)
        total = np.where(stay, total, total[best] + penalty) + cost[d]
    state, path = int(total.argmin()), np.zeros(len(days), np.int64)
    for d in range(len(days) - 1, -1, -1):
        path[d] = state
        state = back[d, state]
    return pd.DataFrame({"_hour": days, "_offset_us": pd.array(offsets[path], dtype="Int64")})


def _clock_hour(wall: str) -> Column:
    return F.floor(F.col(wall) / F.lit(3600 * SECOND)).cast("bigint")


def offset_histories(df: DataFrame, device: str, wall: str, ingested: str, penalty: float = 3.0, delay_us: int = 20 * 60 * SECOND) -> DataFrame:
    """``device, _hour, _offset_us``: the offset of each device's local clock by hour of that clock (hours since 1970-01-01).

    ``wall`` is the local clock in microseconds as if UTC, ``ingested`` a timestamp; ``delay_us`` must be shorter than the
    changes of offset to be told apart. A change lies between two hours, so only the hour that a clock shows twice is
    partly wrong. What reaches a task is one row for each device, hour and quarter hour of lag, so a device with a third
    of all records is no larger than others.
    Rows with a null ``device`` or ``wall`` do not count. A row so late or so far ahead that no offset explains it violates
    all alike, and one with null ``ingested`` says nothing: their hours have the offset of the part of the history they
    lie in, between two parts that of the later. A device none of whose rows fits an offset has null for all its hours.
    """
    lag = F.floor((F.unix_micros(F.col(ingested).cast("timestamp")) - F.col(wall)) / F.lit(QUARTER)).cast("bigint")
    # Beyond these bounds a row violates every offset, however far.
    ahead, behind = F.lit(-MOST - 2), F.lit(-LEAST + 2 - -delay_us // QUARTER)
    # Rows without device or wall clock are grouped too and left out by the task: a filter here would lead the optimiser
    # to carry its constraint through every step of the reading of the text, which takes it longer than all of the rest.
    used = F.col(device).isNotNull() & F.col(wall).isNotNull()
    counts = (
        df.select(
            F.when(used, F.col(device)).alias("_device"),
            F.when(used, _clock_hour(wall)).alias("_hour"),
            F.when(used, F.least(F.greatest(F.coalesce(lag, behind), ahead), behind).cast("bigint")).alias("_lag"),
        )
        .groupBy("_device", "_hour", "_lag")
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] is None:
            return pd.DataFrame({"_device": np.array([], object), "_hour": np.array([], np.int64), "_offset_us": pd.array([], dtype="Int64")})
        out = _history(pdf, penalty, delay_us)
        out.insert(0, "_device", key[0])
        return out

    return counts.groupBy("_device").applyInPandas(run, "_device string, _hour bigint, _offset_us bigint").withColumnRenamed("_device", device)


def with_zoneless_wall(df: DataFrame, text: Column, out: str = "_wall_us") -> DataFrame:
    """Adds ``out``, the wall clock in microseconds of a text without offset, abbreviation or region; null for anything else."""
    read = _read(df, text, "_w_")
    bare = F.col("_w_off").isNull() & F.col("_w_reg").isNull() & F.col("_w_epoch").isNull()
    return read.withColumn(out, F.when(bare, F.col("_w_wall"))).drop("_w_wall", "_w_off", "_w_reg", "_w_epoch")


def with_estimated_offsets(df: DataFrame, device: str, text: str, ingested: str, out: str = "_estimated_us") -> DataFrame:
    """Adds ``out``: the offset that the device's history has in the hour of the local clock.

    Null where the text has a zone of its own or is no date and time, the device is null or none of its rows fits an offset.
    """
    wall = fresh(df.columns, "_wall_us")
    walls = with_zoneless_wall(df, F.when(F.col(device).isNotNull(), F.col(text)), wall)
    history = offset_histories(walls, device, wall, ingested).select(F.col(device).alias("_d"), F.col("_hour").alias("_on"), F.col("_offset_us").alias(out))
    # Rows without a wall clock match nothing; each has an hour of its own before all times, so they do not gather in one task.
    hour = F.when(F.col(wall).isNotNull(), _clock_hour(wall)).otherwise(-(F.lit(1 << 40) + F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))))
    return walls.withColumn("_at", hour).join(history, (F.coalesce(F.col(device), F.lit("")) == F.col("_d")) & (F.col("_at") == F.col("_on")), "left").drop("_d", "_on", "_at", wall)
