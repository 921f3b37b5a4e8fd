"""Scans of the Parquet tables and the views shared by several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_bars(spark: SparkSession, folder: str) -> DataFrame:
    """core_bars and daily_bars together; their tickers and ids are disjoint."""
    return table(spark, folder, "core_bars").unionByName(table(spark, folder, "daily_bars"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row with the greatest ``order`` values of each key; a null in ``order`` ranks lowest.

    A single ``max_by`` aggregation: it combines before the shuffle, so a key that holds a third of
    all rows sends one row per input partition. ``order`` should end in a unique column, else ties
    are resolved by the greatest ``keep`` values. Rows whose keys are null form a key of their own.
    """
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in keep if c not in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in keep]), rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep])


def checked_bars(bars: DataFrame, required: list[str], at: str = "loaded_at") -> DataFrame:
    """``bars`` as scanned, refused (ValueError) if columns are missing, if ``at`` has no zone, or if there is no row."""
    missing = [c for c in required if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack the columns {', '.join(missing)}")
    if at in bars.columns and bars.schema[at].dataType.typeName() != "timestamp":
        raise ValueError(f"{at} has no time zone")
    if bars.isEmpty():
        raise ValueError("no bars")
    return bars


def current_bars(bars: DataFrame, columns: list[str]) -> DataFrame:
    """The current bar of each ticker and date: latest ``loaded_at``, then largest ``bar_id``.

    ``columns`` names what to carry besides the two keys. Nulls of the chosen row stay null. Rows
    without ticker or date have no place in a series and are left out.
    """
    rows = bars.where(F.col("ticker").isNotNull() & F.col("trading_date").isNotNull())
    keep = [c for c in columns if c not in ("ticker", "trading_date")]
    return latest_per_key(rows, ["ticker", "trading_date"], ["loaded_at", "bar_id"], keep)
