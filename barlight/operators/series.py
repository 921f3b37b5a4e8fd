"""Features of daily series: returns, rolling statistics, movement flags, lags and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open_price", "high_price", "low_price", "close_price", "adjusted_close"]
FEATURES = [
    "adjusted_close_return_1d", "adjusted_open_to_close_return", "adjusted_close_return_5d", "daily_return_volatility_20d",
    "average_volume_20d", "price_move_5pct", "price_move_1pct",
]


def full_window(value: Column, statistic, window, rows: int) -> Column:
    """A rolling statistic that is null unless all rows of the window hold a value."""
    return F.when(F.count(value).over(window) == rows, statistic(value).over(window))


def move_flag(now: Column, before: Column, share: float) -> Column:
    """1 for a rise and -1 for a fall by at least ``share``, else 0; null if a side is missing.

    Prices are compared, not returns, so a move of exactly the share counts.
    """
    known = now.isNotNull() & before.isNotNull() & ~F.isnan(now) & ~F.isnan(before)
    return F.when(known, F.when(now >= before * (1 + share), 1).when(now <= before * (1 - share), -1).otherwise(0))


def with_features(bars: DataFrame) -> DataFrame:
    """Bars (one per ticker and date) with seven features and each one's value of the row before.

    One shuffle by ticker and one sort serve all windows. Lags go by rows, so gaps must have been
    ruled out before (see ``validate_bars``).
    """
    order = Window.partitionBy("ticker").orderBy("trading_date")
    last20 = order.rowsBetween(-19, 0)
    a, c, o = F.col("adjusted_close"), F.col("close_price"), F.col("open_price")
    ratio = lambda x, y: F.try_divide(x, y) - 1
    step = bars.withColumns({
        "adjusted_close_return_1d": ratio(a, F.lag(a, 1).over(order)),
        "adjusted_open_to_close_return": ratio(a, F.try_divide(o * a, c)),
        "adjusted_close_return_5d": ratio(a, F.lag(a, 5).over(order)),
        "average_volume_20d": full_window(F.col("volume").cast("double"), F.avg, last20, 20),
        "price_move_5pct": move_flag(a, F.lag(a, 1).over(order), 0.05),
        "price_move_1pct": move_flag(a, F.lag(a, 1).over(order), 0.01),
    })
    step = step.withColumn("daily_return_volatility_20d", full_window(F.col("adjusted_close_return_1d"), F.stddev_samp, last20, 20))
    return step.withColumns({f"{f}_lag1_session": F.lag(f, 1).over(order) for f in FEATURES})


def trimmed(features: DataFrame, first: str, last: str) -> DataFrame:
    """The rows between two dates, taken after the windows have seen the warm-up."""
    return features.where(F.col("trading_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def bar_violations(bars: DataFrame) -> DataFrame:
    """(rule, violations): how many rows break each rule of a bar."""
    order = Window.partitionBy("ticker").orderBy("trading_date", "bar_id")
    o, h, lo, c, a = (F.col(p) for p in PRICES)
    rows = bars.withColumns({"_before": F.lag("trading_date").over(order)})
    rules = {
        "date_repeated": F.col("_before") == F.col("trading_date"),
        "price_missing": reduce(lambda x, y: x | y, [~finite(F.col(p)) for p in PRICES]),
        "price_not_positive": reduce(lambda x, y: x | y, [F.col(p) <= 0 for p in PRICES]),
        "high_below_others": h < F.greatest(o, lo, c),
        "low_above_others": lo > F.least(o, h, c),
        "volume_missing": F.col("volume").isNull(),
        "volume_negative": F.col("volume") < 0,
        "volume_zero": F.col("volume") == 0,
        "split": F.col("stock_splits") != 0,
        "dividend": F.col("dividends") != 0,
    }
    counts = rows.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def session_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ticker, trading_date, problem): sessions without a bar, between a ticker's first and last
    bar, and bars on days that are no session."""
    days = bars.select("ticker", "trading_date").where(F.col("ticker").isNotNull() & F.col("trading_date").isNotNull()).distinct()
    sessions = calendar.select(F.col("session_date").alias("trading_date"))
    span = days.groupBy("ticker").agg(F.min("trading_date").alias("lo"), F.max("trading_date").alias("hi"))
    # each ticker's span is spread over its days, which are then looked up: no join on a range
    spread = span.select("ticker", F.explode(F.sequence("lo", "hi")).alias("trading_date")).join(sessions, "trading_date", "left_semi")
    missing = spread.select("ticker", "trading_date").join(days, ["ticker", "trading_date"], "left_anti").withColumn("problem", F.lit("missing"))
    odd = days.join(sessions, "trading_date", "left_anti").select("ticker", "trading_date").withColumn("problem", F.lit("not_a_session"))
    return missing.unionByName(odd)


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing): nulls and NaNs of each numeric column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "missing")


def unusual_rows(features: DataFrame, share: float = 0.10) -> DataFrame:
    """Rows to review by hand: corporate actions and large one-day returns."""
    why = F.concat_ws("|", F.when(F.col("dividends") != 0, "dividend"), F.when(F.col("stock_splits") != 0, "split"), F.when(F.abs("adjusted_close_return_1d") >= share, "large_return"))
    return features.withColumn("review_reason", why).where(F.col("review_reason") != "")
