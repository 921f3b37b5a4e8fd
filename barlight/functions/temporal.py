"""Times and dates written as text: one cascade of anchored patterns with strict parsing.

Everything is a column expression, so it stays in generated code, and all arithmetic is on
microseconds since 1970 and day numbers, so no result depends on the session's time zone.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: English month names by their first three letters, and zone abbreviations with the
#: minutes they lie ahead of UTC (American, British, European, Japanese and Australian usage).
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "JST": 540, "AEST": 600, "AEDT": 660,
}

_MON = r"([A-Za-z]{3,9})\.?"
_WEEKDAY = r"(?:([A-Za-z]{3,9}),? +)?"
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?"
_AMPM = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: ?([A-Za-z]{1,4}|[+-][0-9]{2}(?::?[0-9]{2})?))?"
_TIME = rf"(?:(?:[Tt]|,? +){_CLOCK}{_AMPM}{_ZONE})?"

#: (name, pattern, groups): groups lists the fields that the pattern's groups hold, in order. The
#: first pattern that matches decides; y/m/d are year, month and day, p and q two numbers whose
#: order depends on the source.
_T = ["hour", "minute", "second", "fraction", "half", "zone"]
PATTERNS = [
    ("epoch", r"^([0-9]{10}|[0-9]{13}|[0-9]{16}|[0-9]{19})$", ["epoch"]),
    ("iso", rf"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){_TIME}$", ["y", "m", "d", *_T]),
    ("compact", r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[Tt]([0-9]{2})([0-9]{2})(?:([0-9]{2}))?" + _ZONE + ")?$", ["y", "m", "d", "hour", "minute", "second", "zone"]),
    ("year_first", rf"^([0-9]{{4}})[/.]([0-9]{{1,2}})[/.]([0-9]{{1,2}}){_TIME}$", ["y", "m", "d", *_T]),
    ("digits", rf"^([0-9]{{1,2}})[/.-]([0-9]{{1,2}})[/.-]([0-9]{{4}}|[0-9]{{2}}){_TIME}$", ["p", "q", "y", *_T]),
    ("day_month", rf"^{_WEEKDAY}([0-9]{{1,2}})[ -]{_MON},?[ -]([0-9]{{4}}|[0-9]{{2}}){_TIME}$", ["weekday", "d", "mon", "y", *_T]),
    ("month_day", rf"^{_WEEKDAY}{_MON} +([0-9]{{1,2}}),? +([0-9]{{4}}){_TIME}$", ["weekday", "mon", "d", "y", *_T]),
]
_FIELDS = ["form", "epoch", "y", "m", "d", "p", "q", "mon", "weekday", *_T]


def _fields(text: Column) -> Column:
    """The matching pattern's groups as one text of ``_FIELDS`` split by bars; null if none matches.

    One replacement yields all groups; a value that matches holds no bar, the patterns allow none.
    """
    out = None
    for name, pattern, groups in PATTERNS:
        row = "|".join(name if f == "form" else f"${groups.index(f) + 1}" if f in groups else "" for f in _FIELDS)
        got = F.regexp_replace(text, F.lit(pattern), F.lit(row))
        out = F.when(text.rlike(pattern), got) if out is None else out.when(text.rlike(pattern), got)
    return out


def once(value: Column) -> Column:
    """``value``, kept from being copied into filters further up.

    A filter on the result would else be pushed below all steps that make it, with every step
    written out at each of its uses. The id is never negative, so the condition always holds.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _num(c: Column) -> Column:
    return F.when(c != "", c.try_cast("int"))


def with_parts(df: DataFrame, text: str, day_first: Column, into: str) -> DataFrame:
    """``df`` with what the text column fixes, in three columns; all null if it is no full, real value.

    ``{into}_instant`` (bigint microseconds; set only if the text names its zone or is a bare long
    number), ``{into}_local`` (bigint microseconds of the wall clock as written; null for a bare
    number) and ``{into}_has_time`` (whether a time of day is written). ``day_first`` decides the
    order of day and month in all-digit dates; where it is null only dates with a single reading
    count. The steps are separate projections, so each value is computed once.
    """
    start = df.columns
    c = lambda n: F.col(f"_{into}_{n}")
    put = lambda frame, /, **kw: frame.withColumns({f"_{into}_{k}": v for k, v in kw.items()})
    df = put(df, s=F.regexp_replace(F.col(text), r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", ""), df=day_first)
    df = put(df, a=F.split(_fields(c("s")), r"\|"))
    df = put(df, **{f: c("a")[i] for i, f in enumerate(_FIELDS)})
    df = put(df, p=_num(c("p")), q=_num(c("q")), half=F.lower(c("half")), zone=F.upper(c("zone")))
    swap = F.coalesce(c("df"), F.when(c("p") == c("q"), False).when(c("p") > 12, True).when(c("q") > 12, False))
    months = F.create_map(*chain.from_iterable((F.lit(m), F.lit(i)) for i, m in enumerate(MONTHS, 1)))
    digits = c("form") == "digits"
    df = put(df, swap=swap, off_h=F.substring(c("zone"), 2, 2).try_cast("int"), hour=_num(c("hour")), minute=_num(c("minute")), second=F.coalesce(_num(c("second")), F.lit(0)), has=c("hour") != "")
    df = put(
        df,
        month=F.when(digits, F.when(c("swap"), c("q")).when(~c("swap"), c("p"))).when(c("mon") != "", F.try_element_at(months, F.lower(F.substring(c("mon"), 1, 3)))).otherwise(_num(c("m"))),
        dom=F.when(digits, F.when(c("swap"), c("p")).when(~c("swap"), c("q"))).otherwise(_num(c("d"))),
        year=F.when(F.length(c("y")) == 2, F.concat(F.lit("20"), c("y"))).otherwise(c("y")),
        hour=F.when(c("half") == "", F.when(c("hour") < 24, c("hour"))).when(c("hour").between(1, 12), c("hour") % 12 + F.when(c("half") == "p", 12).otherwise(0)),
    )
    written = F.concat_ws("-", c("year"), F.lpad(c("month").cast("string"), 2, "0"), F.lpad(c("dom").cast("string"), 2, "0"))
    zones = F.create_map(*chain.from_iterable((F.lit(z), F.lit(v)) for z, v in ZONES.items()))
    off_m = F.when(F.length(c("zone")) > 3, F.substring(c("zone"), -2, 2).try_cast("int")).otherwise(0)
    number = c("epoch").try_cast("decimal(19,0)")
    size = F.length(c("epoch"))
    df = put(
        df,
        day=F.when(c("month").isNotNull() & c("dom").isNotNull(), F.try_to_date(written, "yyyy-MM-dd")),
        clock=F.when((c("minute") < 60) & (c("second") < 60), (c("hour") * 3600 + c("minute") * 60 + c("second")).cast("bigint") * 1_000_000 + F.coalesce(F.rpad(F.substring(c("fraction"), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))),
        off_m=off_m,
        epoch=F.when(c("form") == "epoch", F.when(size == 10, number * 1_000_000).when(size == 13, number * 1000).when(size == 16, number).otherwise(F.floor(number / 1000)).try_cast("bigint")),
    )
    numeric = F.when((c("off_h") <= 18) & (c("off_m") < 60), (c("off_h") * 60 + c("off_m")) * F.when(c("zone").startswith("-"), -1).otherwise(1))
    df = put(
        df,
        day=F.when((c("weekday") == "") | (F.lower(F.date_format(c("day"), "E")) == F.lower(F.substring(c("weekday"), 1, 3))), c("day")),
        offset=F.when(c("zone").rlike("^[+-]"), numeric).otherwise(F.try_element_at(zones, c("zone"))),
    )
    df = put(df, local=F.unix_date(c("day")).cast("bigint") * F.lit(DAY) + F.when(c("has"), c("clock")).otherwise(F.lit(0)))
    # an unknown zone name makes the value unusable, it doesn't make it local
    df = put(df, local=F.when((c("zone") == "") | c("offset").isNotNull(), c("local")))
    instant = F.coalesce(c("epoch"), F.when(c("zone") != "", c("local") - c("offset").cast("bigint") * 60_000_000))
    done = {f"{into}_instant": instant, f"{into}_local": c("local"), f"{into}_has_time": F.when(c("local").isNotNull(), c("has"))}
    return df.select(*[F.col(f"`{x}`") for x in start if x not in done], *[once(v).alias(k) for k, v in done.items()])


def valid_zone(zone: Column) -> Column:
    """The zone name if the engine knows it, else null."""
    return F.when(F.concat(F.lit("2000-01-01 00:00:00 "), zone).try_cast("timestamp").isNotNull(), zone)


def with_utc(df: DataFrame, local: str, zone: Column, into: str, ambiguous: str = "reject", nonexistent: str = "reject") -> DataFrame:
    """``df`` with column ``into``: UTC microseconds of the wall clock readings in column ``local``.

    ``zone`` gives IANA names. ``ambiguous`` says what a time that occurs twice becomes: "reject"
    (null), "earlier" or "later". ``nonexistent`` says it for a time skipped by the clock: "reject"
    or "shift" (forward by the size of the gap). Both offsets in force around the reading are tried;
    a reading is plain if just one of them reproduces it. Null if either input is null.
    """
    if ambiguous not in ("reject", "earlier", "later") or nonexistent not in ("reject", "shift"):
        raise ValueError("unknown policy for ambiguous or nonexistent local times")
    start = [x for x in df.columns if x != into]

    def wall(utc: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), F.col("_z")))

    at, day = F.col(f"`{local}`"), F.lit(DAY)
    df = df.withColumns({"_z": valid_zone(zone)})
    df = df.withColumns({"_b": at - (wall(at - day) - (at - day)), "_a": at - (wall(at + day) - (at + day))})
    df = df.withColumns({"_ok_b": wall(F.col("_b")) == at, "_ok_a": wall(F.col("_a")) == at})
    b, a = F.col("_b"), F.col("_a")
    none = F.lit(None).cast("bigint")
    twice = {"reject": none, "earlier": F.least(b, a), "later": F.greatest(b, a)}[ambiguous]
    never = {"reject": none, "shift": b}[nonexistent]
    out = F.when(F.col("_ok_b") & F.col("_ok_a"), F.when(b == a, b).otherwise(twice)).when(F.col("_ok_b"), b).when(F.col("_ok_a"), a).otherwise(never)
    return df.select(*[F.col(f"`{x}`") for x in start], once(out).alias(into))


def iso_micros(instant: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of UTC microseconds, whatever the session's zone is."""
    days = F.floor(instant / F.lit(DAY)).cast("int")
    rest = F.pmod(instant, F.lit(DAY))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    seconds = F.floor(rest / F.lit(1_000_000))
    return F.concat(F.date_from_unix_date(days).cast("string"), F.lit("T"), two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def date_in(instant: Column, zone: str) -> Column:
    """Calendar date of UTC microseconds in a zone."""
    wall = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone))
    return F.date_from_unix_date(F.floor(wall / F.lit(DAY)).cast("int"))
