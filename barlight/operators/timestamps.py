"""Normalising the timestamp columns of the tables: source zone from a lookup, explicit policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.temporal import DAY, date_in, iso_micros, with_parts, with_utc

SESSION_ZONE = "America/New_York"


def with_feed(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """``df`` with the ``feed_zone``, ``day_first`` and ``trust_rank`` of its source.

    feeds is a dimension with one row per source; Spark broadcasts it while its size stays under the
    session's threshold and joins by shuffle beyond. Names that ``df`` already has are replaced.
    """
    extra = ["feed_zone", "day_first", "trust_rank"]
    look = feeds.select(F.col("source").alias("_feed"), *extra)
    return df.drop(*extra).join(look, F.col("source") == F.col("_feed"), "left").drop("_feed")


def with_instant(df: DataFrame, text: str, zone: Column, into: str, ambiguous: str = "reject", nonexistent: str = "reject") -> DataFrame:
    """``df`` with UTC microseconds fixed by a text column, null if there are none.

    A time without zone is local to ``zone`` (unknown zone: null); a date alone fixes no instant.
    ``df`` has the feed's ``day_first``.
    """
    df = with_parts(df.withColumn("_zone", zone), text, F.col("day_first"), "_t")
    df = df.withColumn("_t_local", F.when(F.col("_t_has_time") & F.col("_t_instant").isNull(), F.col("_t_local")))
    df = with_utc(df, "_t_local", F.col("_zone"), "_t_utc", ambiguous, nonexistent)
    keep = [c for c in df.columns if c not in ("_t_instant", "_t_local", "_t_has_time", "_t_utc", "_zone", into)]
    # through a generator: the optimizer would else trace join keys made from the instant back through
    # every step, writing each step out at each of its uses (seconds of planning per join)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(F.coalesce("_t_instant", "_t_utc"))).alias(into))


def with_session_date(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the session date of a text column: as written without a zone, else New York's."""
    df = with_parts(df, text, F.col("day_first"), "_t")
    as_written = F.date_from_unix_date(F.floor(F.col("_t_local") / F.lit(DAY)).cast("int"))
    day = F.when(F.col("_t_instant").isNotNull(), date_in(F.col("_t_instant"), SESSION_ZONE)).otherwise(as_written)
    return df.withColumn(into, day).drop("_t_instant", "_t_local", "_t_has_time")


def article_instants(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """articles with ``published_micros`` (UTC; null where the text fixes none) and feed columns."""
    return with_instant(with_feed(articles, feeds), "published_at_utc", F.lit("UTC"), "published_micros")


def normalised_times(raw_articles: DataFrame, articles: DataFrame, bar_feed: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row (src_table, rec_id, norm) per value of the three tables that fixes one result.

    Null, empty, partial, impossible, ambiguous and zoneless values give no row; repeated rows keep
    their own ids. Nothing is shuffled: feeds is a broadcast lookup and the rest is expressions.
    """
    raw = with_feed(raw_articles.select("obs_id", "source", F.col("datetime").alias("_text")), feeds)
    raw = with_instant(raw, "_text", F.col("feed_zone"), "_at").select(F.lit("raw_articles").alias("src_table"), F.col("obs_id").alias("rec_id"), iso_micros(F.col("_at")).alias("norm"))
    art = article_instants(articles.select("article_id", "source", "published_at_utc"), feeds)
    art = art.select(F.lit("articles").alias("src_table"), F.col("article_id").alias("rec_id"), iso_micros(F.col("published_micros")).alias("norm"))
    bar = with_feed(bar_feed.select("feed_row_id", "source", F.col("trading_date").alias("_text")), feeds)
    bar = with_session_date(bar, "_text", "_day").select(F.lit("bar_feed").alias("src_table"), F.col("feed_row_id").alias("rec_id"), F.col("_day").cast("string").alias("norm"))
    return raw.unionByName(art).unionByName(bar).where(F.col("norm").isNotNull())
