"""Pairing records with the nearest record in time of the same entity, within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.operators.timestamps import article_instants
from barlight.sources.tables import current_bars

HOUR = 3_600_000_000


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, at: str, key: str, tolerance: int) -> DataFrame:
    """``left`` rows with ``key`` and ``{at}`` of the nearest ``right`` row: (left.*, key, right_at).

    Both sides hold ``entity`` and microseconds ``at``; right holds at most a few rows of an entity
    per tolerance. A pair lies at most ``tolerance`` microseconds apart, inclusive; on a tie the
    earlier right row wins, then the smaller key. Left rows with a null entity or time, and those
    without a partner, are left out; left columns named like a result column are replaced. Repeated
    rows each get their partner.

    Time is cut into buckets as wide as the tolerance. A partner lies in the same or an adjacent
    bucket; right rows are therefore put into three buckets each and gathered per entity and bucket
    before the join, so each left row meets all its candidates in one equi-join and none of its rows
    is multiplied or shuffled again. A hot entity is spread over its buckets, and adaptive execution
    splits a bucket that is still too large.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    right = right.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    near = right.select(F.col(entity).alias("_e"), F.explode(F.array(*[bucket(at) + F.lit(i) for i in (-1, 0, 1)])).alias("_b"), F.struct(F.col(at).alias("at"), F.col(key).alias("key")).alias("_c"))
    near = near.groupBy("_e", "_b").agg(F.array_sort(F.collect_list("_c")).alias("_near"))
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns if c not in (key, "right_at")]).alias("_row"), F.col(entity).alias("_entity"), F.col(at).alias("_at"))
    rows = rows.where(F.col("_entity").isNotNull() & F.col("_at").isNotNull())
    met = rows.join(near, (F.col("_entity") == F.col("_e")) & (bucket("_at") == F.col("_b")))
    gap = lambda c: F.abs(c.getField("at") - F.col("_at"))
    ranked = F.transform(F.filter("_near", lambda c: gap(c) <= tolerance), lambda c: F.struct(gap(c).alias("gap"), c.getField("at").alias("at"), c.getField("key").alias("key")))
    best = met.withColumn("_best", F.array_min(ranked)).where(F.col("_best").isNotNull())
    return best.select("_row.*", F.col("_best.key").alias(key), F.col("_best.at").alias("right_at"))


def article_bars(articles: DataFrame, bars: DataFrame, calendar: DataFrame, feeds: DataFrame, tolerance: int = 20 * HOUR) -> DataFrame:
    """(article_id, bar_id, seconds_after) of each article and the nearest current bar's close.

    Articles need a p3 instant and a ``provider_related`` ticker; bars on dates outside the calendar
    have no close. A ticker has one current bar per date and the calendar one close per date, so an
    entity and bucket gather four bars at most.
    """
    closes = calendar.select(F.col("session_date").alias("trading_date"), F.unix_micros("market_close_utc").alias("at"))
    right = current_bars(bars, ["bar_id"]).join(closes, "trading_date").select("ticker", "at", "bar_id")
    left = article_instants(articles.select("article_id", "source", "published_at_utc", "provider_related"), feeds)
    left = left.select("article_id", F.col("provider_related").alias("ticker"), F.col("published_micros").alias("at"))
    pairs = nearest_in_time(left, right, "ticker", "at", "bar_id", tolerance)
    return pairs.select("article_id", "bar_id", ((F.col("at") - F.col("right_at")) / 1e6).alias("seconds_after"))
