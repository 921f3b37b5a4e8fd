"""Queries of the general data problems, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.operators.packed import split_packed
from barlight.operators.timestamps import normalised_times
from barlight.operators.trailing import mean, trailing_totals
from barlight.plans.sql_times import P3
from barlight.sources.tables import all_bars, current_bars, table

PACKED = ["queried_tickers", "companies_discussed", "exclusion_reason"]


def _trailing(spark: SparkSession, folder: str) -> DataFrame:
    bars = current_bars(all_bars(spark, folder), ["volume", "adjusted_close"])
    return trailing_totals(bars, "ticker", "trading_date", {"volume": 0, "adjusted_close": 8}, (7, 30))


def p1_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing 7- and 30-day volume totals and price averages for every ticker and calendar day."""
    t = _trailing(spark, folder)
    return t.select(
        "ticker", F.col("trading_date").cast("string").alias("cal_day"),
        *[F.col(f"volume_total_{w}").cast("bigint").alias(f"volume_total_{w}") for w in (7, 30)],
        *[F.round(mean("adjusted_close", w), 9).alias(f"adjusted_close_avg_{w}") for w in (7, 30)],
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose trailing week stands out against the trailing 30 days."""
    t = _trailing(spark, folder).where(F.col("trading_date") >= F.date_add("first_day", 29))
    volume = F.col("volume_total_7") * 2 > F.col("volume_total_30")
    price = mean("adjusted_close", 7) > mean("adjusted_close", 30) * 1.1
    hits = F.filter(F.array(F.when(volume, "volume"), F.when(price, "adjusted_close")), lambda x: x.isNotNull())
    return t.select("ticker", F.col("trading_date").cast("string").alias("cal_day"), F.explode(hits).alias("measure"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The one instant or session date of every usable timestamp text."""
    return normalised_times(*[table(spark, folder, t) for t in ("raw_articles", "articles", "bar_feed", "feeds")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the packed fields of articles with its position."""
    return split_packed(table(spark, folder, "articles"), "article_id", PACKED)


QUERIES = {"p1_found": p1_found, "p1_totals": p1_totals, "p3_found": p3_found, "p6_found": p6_found}

_TRAILING_SQL = """
WITH bars AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, trading_date ORDER BY loaded_at DESC NULLS LAST, bar_id DESC) AS rn
    FROM (SELECT * FROM core_bars UNION ALL SELECT * FROM daily_bars)
    WHERE ticker IS NOT NULL AND trading_date IS NOT NULL) WHERE rn = 1),
spans AS (SELECT ticker, min(trading_date) AS lo, max(trading_date) AS hi FROM bars GROUP BY ticker),
days AS (SELECT ticker, lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM spans),
filled AS (SELECT days.ticker, days.lo, days.d, b.volume, CAST(b.adjusted_close AS DECIMAL(28,8)) AS px
  FROM days LEFT JOIN bars AS b ON b.ticker = days.ticker AND b.trading_date = days.d),
trail AS (SELECT ticker, lo, d,
    sum(volume) OVER w7 AS v7, sum(volume) OVER w30 AS v30,
    CAST(sum(px) OVER w7 AS DOUBLE) / nullif(count(px) OVER w7, 0) AS a7,
    CAST(sum(px) OVER w30 AS DOUBLE) / nullif(count(px) OVER w30, 0) AS a30
  FROM filled
  WINDOW w7 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

#: Items by one regular expression outside lists, by the JSON reader inside them.
_PACKED_SQL = """
WITH long AS (SELECT article_id, unnest(['queried_tickers', 'companies_discussed', 'exclusion_reason']) AS field_name, unnest([queried_tickers, companies_discussed, exclusion_reason]) AS v FROM articles),
cut AS (SELECT article_id, field_name, CASE WHEN v LIKE '["%"]' THEN from_json(v, '["VARCHAR"]')
  ELSE regexp_extract_all(v, '[ ]*("(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^|;；,/+\\t\\n\\r]*?)[ ]*(?:[|;；,/+\\t\\n\\r]|$)', 1) END AS items FROM long WHERE v IS NOT NULL),
bare AS (SELECT article_id, field_name, list_filter(list_transform(items, lambda x: trim(CASE
  WHEN length(x) > 1 AND x[1] = '"' AND x[-1] = '"' THEN replace(x[2:-2], '""', '"')
  WHEN length(x) > 1 AND x[1] = '''' AND x[-1] = '''' THEN x[2:-2] ELSE x END)), lambda x: x <> '') AS items FROM cut),
placed AS (SELECT article_id, field_name, unnest(items) AS item, CAST(generate_subscripts(items, 1) AS INT) AS item_pos FROM bare)
"""

SQL = {
    "p1_totals": _TRAILING_SQL + """
SELECT ticker, CAST(d AS VARCHAR) AS cal_day, CAST(v7 AS BIGINT) AS volume_total_7, CAST(v30 AS BIGINT) AS volume_total_30,
  round(a7, 9) AS adjusted_close_avg_7, round(a30, 9) AS adjusted_close_avg_30 FROM trail""",
    "p1_found": _TRAILING_SQL + """
SELECT ticker, CAST(d AS VARCHAR) AS cal_day, 'volume' AS measure FROM trail WHERE d >= lo + 29 AND 2 * v7 > v30
UNION ALL
SELECT ticker, CAST(d AS VARCHAR), 'adjusted_close' FROM trail WHERE d >= lo + 29 AND a7 > a30 * 1.1""",
    "p3_found": P3,
    "p6_found": _PACKED_SQL + " SELECT article_id, field_name, item_pos, item FROM placed",
}
