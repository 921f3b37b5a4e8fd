"""Which days and tickers a collection covers, and what is known about the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_states(windows: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """(ticker, day, states): the distinct states of the request windows that touch a day.

    Windows that were split say nothing themselves. With ``landed`` (column raw_file) a successful
    window whose file is absent counts as missing_raw_response_file.
    """
    rows = windows.where(~F.col("status").startswith("split_"))
    state = F.col("status")
    if landed is not None:
        rows = rows.join(landed.select("raw_file").distinct().withColumn("_there", F.lit(True)), "raw_file", "left")
        state = F.when(state.startswith("success") & F.col("_there").isNull(), "missing_raw_response_file").otherwise(state)
    days = rows.select("ticker", state.alias("state"), F.explode(F.sequence("from_date", "to_date")).alias("day"))
    return days.groupBy("ticker", "day").agg(F.array_sort(F.collect_set("state")).alias("states"))


def day_spine(spark, tickers: list[str], first: str, last: str) -> DataFrame:
    """Every configured ticker and day; both lists are configuration, not data."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, tickers))).alias("ticker"), F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")).alias("_days")).select("ticker", F.explode("_days").alias("day"))


def coverage_days(windows: DataFrame, tickers: list[str], first: str, last: str, landed: DataFrame | None = None, lead_days: int = 10) -> DataFrame:
    """(ticker, day, coverage_state) of every configured ticker from ``lead_days`` before ``first``.

    The state is the problems joined by bars, else success, no_terminal_request or
    outside_collected_date_range.
    """
    spark = windows.sparkSession
    start = F.date_sub(F.lit(first).cast("date"), lead_days)
    spine = spark.range(1).select(F.explode(F.array(*map(F.lit, tickers))).alias("ticker"), F.sequence(start, F.lit(last).cast("date")).alias("_d")).select("ticker", F.explode("_d").alias("day"))
    found = spine.join(day_states(windows, landed), ["ticker", "day"], "left")
    problems = F.filter("states", lambda s: s != "success")
    state = (
        F.when(F.col("day") < F.lit(first).cast("date"), "outside_collected_date_range")
        .when(F.col("states").isNull(), "no_terminal_request")
        .when(F.size(problems) > 0, F.array_join(problems, "|"))
        .otherwise("success")
    )
    return found.select("ticker", "day", state.alias("coverage_state"))


def reported_days(windows: DataFrame, order: list[str]) -> DataFrame:
    """(ticker, day, coverage_state): the state of the last window that touches a day.

    Windows that were split or are to be tried again say nothing. ``order`` ranks windows and should
    end in a unique column. One aggregation with partial maxima; days are few per window.
    """
    rows = windows.where(~F.col("status").startswith("split_") & (F.col("status") != "transient_retry"))
    days = rows.select("ticker", "status", *order, F.explode(F.sequence("from_date", "to_date")).alias("day"))
    return days.groupBy("ticker", "day").agg(F.max_by("status", F.struct(*order)).alias("coverage_state"))


def coverage_periods(days: DataFrame, good: str = "success") -> DataFrame:
    """(ticker, state, from_day, to_day, days): runs of neighbouring days in one state but ``good``.

    Days of a run less their rank in it are one constant, which groups them without a loop.
    """
    rows = days.where(F.col("coverage_state") != good).select("ticker", F.col("coverage_state").alias("state"), "day").distinct()
    rank = F.row_number().over(Window.partitionBy("ticker", "state").orderBy("day"))
    runs = rows.withColumn("_run", F.date_sub("day", rank))
    return runs.groupBy("ticker", "state", "_run").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count(F.lit(1)).alias("days")).drop("_run")


def window_verdicts(events: DataFrame, days: DataFrame, counts: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Every event with what is known about the collection over its lookback windows of 24 and 72
    hours and of seven days, and whether these reach beyond the collected dates ``first`` to ``last``.

    Each event is spread over the UTC days from the start of its window to the microsecond before its
    cutoff and joined on the day. ``coverage_issues`` is JSON: per day and state the tickers. A state
    that joins several names by bars counts as a known gap only by its failed and unavailable parts.
    """
    micro = F.expr("INTERVAL 1 MICROSECOND")
    bounded = events.where(F.col("cutoff_utc").isNotNull())
    inside = [(F.col("day") >= F.to_date(F.col("cutoff_utc") - F.expr(f"INTERVAL {h} HOURS"))).alias(f"_{h}h") for h in (24, 72)]
    spread = bounded.select(*keys, "cutoff_utc", F.explode(F.sequence(F.to_date("lookback_start_utc"), F.to_date(F.col("cutoff_utc") - micro))).alias("day")).select(*keys, "day", *inside)
    issues = spread.join(days.where(F.col("coverage_state") != "success").withColumnRenamed("ticker", "_ticker"), "day")
    by_state = issues.groupBy(*keys, "day", "_24h", "_72h", F.col("coverage_state").alias("state")).agg(F.array_sort(F.collect_set("_ticker")).alias("tickers"))
    s = F.col("state")
    gap = s.isin("no_terminal_request", "missing_raw_response_file", "outside_collected_date_range") | s.contains("failed") | s.contains("unavailable")
    verdict = by_state.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col("day").cast("string").alias("date_utc"), "state", "tickers")))).alias("coverage_issues"),
        F.max(gap.cast("int")).alias("known_collection_gap"),
        F.max(s.contains("truncation").cast("int")).alias("potential_truncation"),
        *[F.max(F.col(f"_{w}").cast("int")).alias(f"_{w}") for w in ("24h", "72h")],
    )
    out = events.join(counts, keys, "left").join(verdict, keys, "left")
    n = F.coalesce("article_count_7d", F.lit(0))
    gaps = F.coalesce("known_collection_gap", F.lit(0))
    meaning = F.when(n > 0, "has_matches").when(F.col("coverage_issues").isNotNull(), "zero_matches_with_coverage_gap").otherwise("zero_matches_in_verified_windows")
    return out.select(
        *keys, n.alias("article_count_7d"), F.coalesce("coverage_issues", F.lit("[]")).alias("coverage_issues"),
        *[(F.coalesce(f"_{w}", F.lit(0)) == 0).cast("int").alias(f"collection_window_verified_{w}") for w in ("24h", "72h")],
        F.col("coverage_issues").isNull().cast("int").alias("collection_window_verified_7d"),
        F.coalesce((F.col("lookback_start_utc") < F.lit(first).cast("timestamp")).cast("int"), F.lit(0)).alias("incomplete_lookback_at_news_start"),
        F.coalesce((F.col("cutoff_utc") > F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")).cast("int"), F.lit(0)).alias("extends_past_news_collection_end"),
        gaps.alias("known_collection_gap"), F.coalesce("potential_truncation", F.lit(0)).alias("potential_truncation"), meaning.alias("zero_match_interpretation"),
    )
