"""Word frequencies overall and by day, set against the next session's move."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.text import RANKING_STOPWORDS, word_tokens


def word_rows(items: DataFrame, text, keep: list[str]) -> DataFrame:
    """One row per occurrence of a word, with the columns of its item; an item is a row.

    ``first_in_item`` is 1 for one occurrence of each word in its item: words are sorted within the
    row and compared with the one before, so counts of items need neither a set nor a shuffle by item.
    """
    rows = items.select(*keep, F.array_sort(word_tokens(text)).alias("_words"))
    before = F.slice(F.concat(F.array(F.lit("")), "_words"), F.lit(1), F.size("_words"))
    rows = rows.select(*keep, F.explode(F.arrays_zip(F.col("_words").alias("word"), before.alias("before"))).alias("_w"))
    return rows.select(*keep, F.col("_w.word").alias("word"), (F.col("_w.word") != F.col("_w.before")).cast("int").alias("first_in_item"))


def _counted(words: DataFrame, by: list[str], relevance: str, *more) -> DataFrame:
    """Counts that add up, so that a task sends one row per word and group only."""
    kind = F.col(relevance)
    return words.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("first_in_item").alias("items"), F.count_if(kind == "direct").alias("direct"), F.count_if(kind == "indirect").alias("indirect"), *more,
    )


def _leading(category: str, n: str = "n"):
    """The category with most occurrences, ties by name."""
    return F.min_by(F.col(category), F.struct((-F.col(n)).alias("n"), F.coalesce(F.col(category), F.lit("")).alias("c"))).alias("top_event_category")


def overall_words(words: DataFrame, relevance: str, day: str, category: str) -> DataFrame:
    """Per word: occurrences, items, direct and indirect occurrences, first and last day, and the
    category with most occurrences (ties by name)."""
    by_category = _counted(words, ["word", category], relevance, F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return by_category.groupBy("word").agg(
        F.sum("n").alias("total_occurrences"), F.sum("items").alias("article_count"), F.sum("direct").alias("direct_occurrences"), F.sum("indirect").alias("indirect_occurrences"),
        F.min("first_day").alias("first_utc_date"), F.max("last_day").alias("last_utc_date"),
        _leading(category),
    )


def daily_words(words: DataFrame, utc_day: str, local_day: str, relevance: str, category: str) -> DataFrame:
    """(utc_date, local_date, word, occurrences, articles, direct and indirect occurrences, and the
    category with most occurrences) per word and pair of dates."""
    each = _counted(words, ["word", utc_day, local_day, category], relevance)
    return each.groupBy(F.col(utc_day).alias("utc_date"), F.col(local_day).alias("local_date"), "word").agg(
        F.sum("n").alias("occurrences"), F.sum("items").alias("articles"), F.sum("direct").alias("direct_occurrences"), F.sum("indirect").alias("indirect_occurrences"), _leading(category),
    )


def with_day_context(daily: DataFrame, items: DataFrame, utc_day: str, local_day: str, features: DataFrame) -> DataFrame:
    """Daily words with the number of items of their dates, and the movement flags of the bar on the
    UTC date (null where there is none); ``features`` has one row per trading_date."""
    counts = items.groupBy(F.col(utc_day).alias("utc_date"), F.col(local_day).alias("local_date")).agg(F.count(F.lit(1)).alias("articles_that_day"))
    moves = features.select(F.col("trading_date").alias("utc_date"), F.col("price_move_1pct").alias("same_date_move_1pct"), F.col("price_move_5pct").alias("same_date_move_5pct"))
    return daily.join(counts, ["utc_date", "local_date"]).join(moves, "utc_date", "left")


def by_local_day(daily: DataFrame) -> DataFrame:
    """Daily counts added up by local date, with the UTC dates that went into each, and the leading
    category of the daily rows, weighted by their occurrences (ties by name).

    A local date holds two UTC dates at most, so no group is large.
    """
    by_category = daily.groupBy("local_date", "word", "top_event_category").agg(F.sum("occurrences").alias("n"), F.sum("articles").alias("articles"), F.collect_set(F.col("utc_date").cast("string")).alias("days"))
    return by_category.groupBy("local_date", "word").agg(
        F.sum("n").alias("occurrences"), F.sum("articles").alias("articles"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))), "|").alias("utc_dates"), _leading("top_event_category"),
    )


def top_words(overall: DataFrame, count: int = 12) -> DataFrame:
    """The most frequent words of two or more letters that aren't stop words."""
    kept = overall.where(~F.col("word").isin(RANKING_STOPWORDS) & (F.length("word") > 1))
    return kept.orderBy(F.desc("total_occurrences"), F.asc("word")).limit(count)


def next_session(days: DataFrame, day: str, sessions: DataFrame, session: str) -> DataFrame:
    """``days`` with ``next_session``, the first session after the day; null if none follows.

    Each session stands for the days from the session before it up to the day before itself, which
    makes the strict forward lookup an equality. Days earlier than the first session get that one.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(session)
    listed = sessions.select(session).where(F.col(session).isNotNull()).distinct()
    first = listed.agg(F.min(session).alias("x")).scalar()
    spans = listed.withColumn("_prev", F.lag(session).over(order)).where(F.col("_prev").isNotNull())
    lookup = spans.select(F.col(session).alias("next_session"), F.explode(F.sequence("_prev", F.date_sub(session, 1))).alias("_d"))
    out = days.join(lookup, F.col(day) == F.col("_d"), "left").drop("_d")
    return out.withColumn("next_session", F.when(F.col(day) < first, first).otherwise(F.col("next_session")))


def lagged_words(local: DataFrame, sessions: DataFrame, features: DataFrame) -> DataFrame:
    """Word counts of a local day beside the moves of the next session."""
    joined = next_session(local, "local_date", sessions, "session_date").withColumnRenamed("next_session", "next_trading_date")
    move = features.select(
        F.col("trading_date").alias("next_trading_date"), F.col("adjusted_close_return_1d").alias("next_day_close_to_close_return"),
        F.col("adjusted_open_to_close_return").alias("next_day_open_to_close_return"), F.col("price_move_1pct").alias("next_day_price_move_1pct"), F.col("price_move_5pct").alias("next_day_price_move_5pct"),
    )
    return joined.join(move, "next_trading_date", "left")


def daily_mean(lagged: DataFrame, value: str) -> DataFrame:
    """Mean of a value per local day over all its words."""
    return lagged.groupBy("local_date").agg(F.avg(value).alias("mean_value"))


def word_fits(lagged: DataFrame, words: DataFrame | None = None, value: str = "next_day_close_to_close_return") -> DataFrame:
    """Per word (of ``words``, if given): correlation and straight line of the value over the daily
    count, null unless there are two or more days with different counts."""
    some = lagged if words is None else lagged.join(words.select("word"), "word", "left_semi")
    rows = some.where(F.col(value).isNotNull()).select("word", F.col("occurrences").cast("double").alias("x"), F.col(value).alias("y"))
    ok = (F.count("x") > 1) & (F.min("x") < F.max("x"))
    # corr() and regr_slope() raise on a constant side under ANSI rules
    slope = F.try_divide(F.covar_pop("x", "y"), F.var_pop("x"))
    fit = rows.groupBy("word").agg(
        F.count("x").alias("days"), F.when(ok, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("correlation"),
        F.when(ok, slope).alias("slope"), F.avg("x").alias("_x"), F.avg("y").alias("_y"),
    )
    return fit.select("word", "days", "correlation", "slope", (F.col("_y") - F.col("slope") * F.col("_x")).alias("intercept"))
