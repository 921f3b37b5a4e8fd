"""Linking events to the items published in the window before each event's cutoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.ids import row_key

HOUR = 3_600_000_000
DAY = 24 * HOUR


def membership(published: Column, cutoff: Column, start: Column) -> dict[str, Column]:
    """How an item lies in an event's window; all times are microseconds.

    The windows of 24 and 72 elapsed hours and of the whole lookback are closed at their start and
    open at the cutoff.
    """
    before = cutoff - published
    inside = (published >= start) & (published < cutoff)
    return {
        "inside": inside,
        "hours_before_cutoff": before / F.lit(float(HOUR)),
        "in_24h": (inside & (before <= 24 * HOUR)).cast("int"),
        "in_72h": (inside & (before <= 72 * HOUR)).cast("int"),
        "in_7d": inside.cast("int"),
        "lookback_bucket": F.when(before <= 24 * HOUR, "0-24h").when(before <= 72 * HOUR, "24-72h").otherwise("72h-7d"),
    }


def lookback_match(events: DataFrame, items: DataFrame, at: str, cutoff: str = "cutoff_utc", start: str = "lookback_start_utc", on: dict[str, str] | None = None) -> DataFrame:
    """All (event, item) pairs with start <= item time < cutoff, one item possibly in many events.

    ``at`` holds the items' UTC microseconds, ``cutoff`` and ``start`` the events' timestamps; ``on``
    maps event columns to item columns that must be equal as well. Items without a time and events
    without bounds match nothing.

    A range condition alone would compare everything with everything. Each event is spread over the
    UTC days its window touches (nine at most for a week) and joined to items on the day; the exact
    bounds decide afterwards. Events are few, so the copies are on the small side, which Spark
    broadcasts below its size threshold; beyond it both sides are hashed by day (and ``on``).
    """
    e = events.where(F.col(cutoff).isNotNull() & F.col(start).isNotNull()).withColumns({"_hi": F.unix_micros(cutoff), "_lo": F.unix_micros(start)})
    day = lambda c: F.floor(c / F.lit(DAY)).cast("int")
    e = e.withColumn("_day", F.explode(F.sequence(day(F.col("_lo")), day(F.col("_hi") - 1))))
    i = items.where(F.col(at).isNotNull()).withColumn("_at_day", day(F.col(at)))
    keys = [F.col("_day") == F.col("_at_day"), *[e[a] == i[b] for a, b in (on or {}).items()]]
    got = membership(F.col(at), F.col("_hi"), F.col("_lo"))
    pairs = e.join(i, reduce(lambda x, y: x & y, keys)).where(got["inside"])
    return pairs.withColumns({k: v for k, v in got.items() if k != "inside"}).drop("_hi", "_lo", "_day", "_at_day")


def event_summary(events: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Every event with its number of items per window, events without items included as zeros."""
    counts = pairs.groupBy(*keys).agg(*[F.sum(f"in_{w}").alias(f"article_count_{w}") for w in ("24h", "72h", "7d")])
    out = events.join(counts, keys, "left")
    return out.withColumns({f"article_count_{w}": F.coalesce(f"article_count_{w}", F.lit(0)) for w in ("24h", "72h", "7d")})


def never_linked(items: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Items that lie in no event's window."""
    return items.join(pairs.select(key).distinct(), key, "left_anti")


def revision_gate(stamps: list[str], cutoff: str) -> Column:
    """Why a pair must go, null if it may stay: the first stamp, in the given order, that is unusable
    or not before the cutoff. Stamps are pairs of columns ``{s}`` (text) and ``{s}_micros``.
    """
    first = "first_available_at_utc"
    cases = []
    for s in stamps:
        filled = F.coalesce(F.col(s), F.lit("")) != ""
        late = "not_available_before_cutoff" if s == first else "revised_after_cutoff"
        cases.append(F.when(filled & F.col(f"{s}_micros").isNull(), f"ambiguous_{s}").when(filled & (F.col(f"{s}_micros") >= F.unix_micros(cutoff)), late))
    return F.coalesce(*cases)


def pair_uncertainty(retrieved: Column, cutoff: Column, variants: Column) -> Column:
    """Whether it is uncertain that an item's text was available as it is: no snapshot time, one not
    before the cutoff, or several versions of the content."""
    return retrieved.isNull() | (retrieved >= cutoff) | (F.coalesce(variants, F.lit(1)) > 1)


def content_variants(observations: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, variants): how many different contents were seen under a key; null keys are left out."""
    rows = observations.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return rows.groupBy(key).agg(F.count_distinct(F.md5(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))).alias("variants"))


def with_variants(items: DataFrame, by_id: DataFrame, by_url: DataFrame) -> DataFrame:
    """Items with the larger of both counts of variants, at least 1."""
    a = by_id.withColumnRenamed("variants", "_by_id")
    b = by_url.withColumnRenamed("variants", "_by_url")
    out = items.join(a, "article_id", "left").join(b, "normalized_url", "left")
    return out.withColumn("content_variants", F.greatest(F.lit(1).cast("bigint"), F.coalesce("_by_id", F.lit(1)), F.coalesce("_by_url", F.lit(1)))).drop("_by_id", "_by_url")


def prepared_items(articles: DataFrame, gate: Column) -> DataFrame:
    """Articles split by what becomes of them: ``status`` is kept, not_relevant, exact_duplicate or
    the reason of the timestamp gate; with match key and missing-field marks.

    Of identical rows the one with the smallest id stays, so the choice doesn't depend on order.
    """
    columns = [c for c in articles.columns if c not in ("article_id",)]
    keyed = articles.withColumn("article_match_key", row_key(articles.columns)).withColumn("_same", row_key(columns))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("_same").orderBy("article_id"))
    relevant = F.col("relevance_type").isin("direct", "indirect")
    status = F.when(~F.coalesce(relevant, F.lit(False)), "not_relevant").when(F.col("_rank") > 1, "exact_duplicate").when(gate.isNotNull(), gate).otherwise("kept")
    marks = {f"missing_{c}": (F.coalesce(F.col(c), F.lit("")) == "").cast("int") for c in ("headline", "summary", "source", "url")}
    return keyed.withColumn("_rank", first).withColumn("status", status).withColumns(marks).drop("_same", "_rank")


def pair_violations(pairs: DataFrame, summary: DataFrame, keys: list[str], item: str, at: str) -> DataFrame:
    """(rule, violations) of the promises a set of pairs makes."""
    cut = F.unix_micros("cutoff_utc")
    nested = (F.col("in_24h") <= F.col("in_72h")) & (F.col("in_72h") <= F.col("in_7d"))
    one = pairs.groupBy(*keys, item).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col(at) >= cut) | (F.col(at) < F.unix_micros("lookback_start_utc"))).alias("outside"),
        F.count_if(~nested).alias("not_nested"),
    ).agg(F.count_if(F.col("n") > 1).alias("pair_repeated"), F.coalesce(F.sum("outside"), F.lit(0)).alias("outside_window"), F.coalesce(F.sum("not_nested"), F.lit(0)).alias("windows_not_nested"))
    again = event_summary(summary.drop(*[f"article_count_{w}" for w in ("24h", "72h", "7d")]), pairs, keys)
    differs = again.select(*keys, *[F.col(f"article_count_{w}").alias(f"_{w}") for w in ("24h", "72h", "7d")]).join(summary, keys).where((F.col("_24h") != F.col("article_count_24h")) | (F.col("_72h") != F.col("article_count_72h")) | (F.col("_7d") != F.col("article_count_7d")))
    rest = differs.agg(F.count(F.lit(1)).alias("counts_differ"))
    return one.unpivot([], one.columns, "rule", "violations").unionByName(rest.unpivot([], rest.columns, "rule", "violations"))
