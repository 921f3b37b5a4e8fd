"""Sessions, flagged events and the window that closes before each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
HOUR = 3_600_000_000
#: The views of the two signed flags.
VIEWS = {"1pct_up": ("price_move_1pct", 1), "1pct_down": ("price_move_1pct", -1), "5pct_up": ("price_move_5pct", 1), "5pct_down": ("price_move_5pct", -1)}


def previous_sessions(calendar: DataFrame) -> DataFrame:
    """(session_date, previous_session_date, cutoff_utc): the close of the session before.

    The calendar is a dimension of one row per session, so a window over all of it is small.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("session_date")
    return calendar.select("session_date", F.lag("session_date").over(order).alias("previous_session_date"), F.lag("market_close_utc").over(order).alias("cutoff_utc"), F.col("market_close_utc").alias("interval_end_utc"))


def lookback_start(cutoff: Column, days: int, zone: str = ZONE) -> Column:
    """The same wall clock ``days`` calendar days earlier in ``zone``; correct across clock changes.

    The session's time zone must be UTC.
    """
    return F.to_utc_timestamp(F.from_utc_timestamp(cutoff, zone) - F.expr(f"INTERVAL {int(days)} DAYS"), zone)


def flagged_events(features: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per ticker and flagged session, with its views and its lookback bounds.

    A session without a predecessor in the calendar has no cutoff and can match nothing; days that
    are no session are left out here and reported by ``session_gaps``.
    """
    shifts = {f"shift_{k}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for k, (c, v) in VIEWS.items()}
    rows = features.select("ticker", F.col("trading_date").alias("event_date"), "price_move_1pct", "price_move_5pct").withColumns(shifts)
    rows = rows.where(F.greatest(*shifts) == 1)
    label = F.concat_ws("|", *[F.when(F.col(f"shift_{k}") == 1, k) for k in VIEWS])
    placed = rows.withColumn("shift_categories", label).join(previous_sessions(calendar), F.col("event_date") == F.col("session_date")).drop("session_date")
    return placed.withColumn("lookback_start_utc", lookback_start(F.col("cutoff_utc"), 7))


def flag_problems(features: DataFrame) -> DataFrame:
    """(problem, rows): encodings other than -1, 0, 1 and repeated ticker dates."""
    odd = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(0)).isin(-1, 0, 1)).alias(f"unexpected_{c}")
    per_day = features.groupBy("ticker", "trading_date").agg(odd("price_move_1pct"), odd("price_move_5pct"), F.count(F.lit(1)).alias("n"))
    names = ["unexpected_price_move_1pct", "unexpected_price_move_5pct", "repeated_dates"]
    out = per_day.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names[:2]], F.count_if(F.col("n") > 1).alias("repeated_dates"))
    return out.unpivot([], names, "problem", "rows")


def view_totals(events: DataFrame) -> DataFrame:
    """(ticker, view, events): how many events each view holds; views overlap, so never add them."""
    each = events.groupBy("ticker").agg(*[F.sum(f"shift_{k}").alias(k) for k in VIEWS], F.sum(F.col("shift_1pct_up") * F.col("shift_5pct_up")).alias("both_up"), F.sum(F.col("shift_1pct_down") * F.col("shift_5pct_down")).alias("both_down"))
    return each.unpivot("ticker", [*VIEWS, "both_up", "both_down"], "view", "events")
