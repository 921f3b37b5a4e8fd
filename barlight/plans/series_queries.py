"""Queries over daily series, flagged events and lookback matching, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.functions.temporal import with_parts
from barlight.operators import coverage, matching, series, sessions
from barlight.operators.timestamps import article_instants, with_feed
from barlight.plans.sql_times import ARTICLE_TIMES, parsed
from barlight.sources.tables import all_bars, current_bars, latest_per_key, table

#: The ticker whose events are matched with the whole of the news; a parameter of the analysis.
PRIMARY = "QVLT"
_BAR = ["bar_id", "open_price", "high_price", "low_price", "close_price", "adjusted_close", "volume", "dividends", "stock_splits"]


def bars(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """Current bars of the configured tickers, with ``whole`` of all tickers of both tables."""
    return current_bars(all_bars(spark, d) if whole else table(spark, d, "core_bars"), _BAR)


def features(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return series.with_features(bars(spark, d, whole))


def events(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return sessions.flagged_events(features(spark, d, whole), table(spark, d, "session_calendar"))


def articles(spark: SparkSession, d: str, which=None) -> DataFrame:
    """Articles with their instants; ``which`` filters first, since nothing is pushed through the instants."""
    rows = table(spark, d, "articles")
    return article_instants(rows if which is None else rows.where(which), table(spark, d, "feeds"))


def relevant(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, F.col("relevance_type").isin("direct", "indirect"))


def primary_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.lookback_match(events(spark, d).where(F.col("ticker") == PRIMARY), relevant(spark, d).drop("ticker"), "published_micros")


def daily_bars(spark, d, whole=False):
    """The current bar of every configured ticker and date."""
    return bars(spark, d, whole)


def move_features(spark, d, whole=False):
    """Returns, rolling statistics, movement flags and their lags."""
    f = features(spark, d, whole)
    flags = ["price_move_5pct", "price_move_1pct"]
    numbers = [x for x in series.FEATURES if x not in flags]
    out = [(F.round(c, 6) + 0.0).alias(c) for x in numbers for c in (x, f"{x}_lag1_session")] + [F.col(c) for x in flags for c in (x, f"{x}_lag1_session")]
    return f.select("ticker", "trading_date", *out)


def bar_validation(spark, d):
    """Rows that break each rule of a bar, over all rows as loaded."""
    return series.bar_violations(table(spark, d, "core_bars").unionByName(table(spark, d, "daily_bars")))


def session_gaps(spark, d):
    """Missing sessions and bars on other days, for every ticker."""
    return series.session_gaps(table(spark, d, "core_bars").unionByName(table(spark, d, "daily_bars")), table(spark, d, "session_calendar"))


def missing_values(spark, d, whole=False):
    """Nulls and NaNs per column of the bars."""
    return series.missing_values(bars(spark, d, whole), [*series.PRICES, "volume"])


def review_rows(spark, d, whole=False):
    """Corporate actions and large one-day returns."""
    return series.unusual_rows(features(spark, d, whole)).select("ticker", "trading_date", "dividends", "stock_splits", "review_reason")


def trimmed_features(spark, d):
    """Flags of the output range only, the warm-up having been seen by the windows."""
    return series.trimmed(features(spark, d), "2025-10-01", "2026-05-15").select("ticker", "trading_date", "price_move_1pct", "price_move_5pct", F.round("daily_return_volatility_20d", 6).alias("volatility"))


def flagged_events(spark, d, whole=False):
    """Flagged sessions with views, cutoff and lookback start."""
    return events(spark, d, whole).drop("interval_end_utc").withColumns({c: F.unix_micros(c) for c in ("cutoff_utc", "lookback_start_utc")})


def flag_problems(spark, d):
    """Unexpected flag values and repeated dates."""
    return sessions.flag_problems(features(spark, d))


def view_totals(spark, d, whole=False):
    """Events per view and their overlaps."""
    return sessions.view_totals(events(spark, d, whole))


def _pair_columns(p: DataFrame) -> DataFrame:
    return p.select("ticker", "event_date", "article_id", "published_micros", (F.unix_micros("cutoff_utc") - F.col("published_micros")).alias("micros_before_cutoff"), "lookback_bucket", "in_24h", "in_72h", "in_7d")


def lookback_match(spark, d):
    """Every flagged session of the primary ticker with all relevant articles of its lookback."""
    return _pair_columns(primary_pairs(spark, d))


def lookback_match_by_ticker(spark, d, whole=False):
    """Every configured ticker's flagged sessions with the articles that are tagged with the same ticker."""
    return _pair_columns(matching.lookback_match(events(spark, d, whole), relevant(spark, d), "published_micros", on={"ticker": "provider_related"}))


def match_summary(spark, d):
    """Number of linked articles per event and window, zeros included."""
    e = events(spark, d).where(F.col("ticker") == PRIMARY)
    return matching.event_summary(e, primary_pairs(spark, d), ["ticker", "event_date"]).select("ticker", "event_date", "shift_categories", "article_count_24h", "article_count_72h", "article_count_7d")


def never_linked(spark, d):
    """Relevant articles that lie in no event's lookback."""
    return matching.never_linked(relevant(spark, d), primary_pairs(spark, d), "article_id").select("article_id")


def pair_invariants(spark, d):
    """Violations of what the pairs promise; all zero."""
    e = events(spark, d).where(F.col("ticker") == PRIMARY)
    p = primary_pairs(spark, d)
    return matching.pair_violations(p, matching.event_summary(e, p, ["ticker", "event_date"]), ["ticker", "event_date"], "article_id", "published_micros")


def content_variants(spark, d):
    """Different contents seen under one article id."""
    return matching.content_variants(table(spark, d, "raw_articles"), "article_id", ["headline", "summary", "datetime"])


def timestamp_gate(spark, d):
    """Why a publication time can't be used: missing, a date only, no zone or invalid."""
    a = with_parts(with_feed(table(spark, d, "articles"), table(spark, d, "feeds")), "published_at_utc", F.col("day_first"), "_t")
    reason = (
        F.when(F.trim(F.coalesce("published_at_utc", F.lit(""))) == "", "missing_timestamp").when(F.col("_t_instant").isNotNull(), F.lit(None))
        .when(F.col("_t_local").isNull(), "invalid_timestamp").when(~F.col("_t_has_time"), "date_only_timestamp").otherwise("timestamp_without_zone")
    )
    return a.select("article_id", reason.alias("reason"))


def prepared_status(spark, d):
    """What becomes of every article before matching."""
    a = articles(spark, d)
    gate = F.when(F.col("published_micros").isNull(), "timestamp_unusable")
    base = table(spark, d, "articles").columns
    p = matching.prepared_items(a.select(*base).join(a.select("article_id", "published_micros"), "article_id"), gate)
    return p.select("article_id", "status", "missing_headline", "missing_summary", "missing_source", "missing_url")


def uncertain_pairs(spark, d):
    """Pairs whose text may not have been available as it is before the cutoff."""
    raw = table(spark, d, "raw_articles")
    v = matching.content_variants(raw, "url", ["headline", "summary", "datetime"])
    p = primary_pairs(spark, d).join(v, "url", "left")
    flag = matching.pair_uncertainty(F.col("retrieved_at_utc"), F.col("cutoff_utc"), F.col("variants"))
    return p.groupBy("ticker", "event_date").agg(F.count_if(flag).alias("uncertain"), F.count_if(F.coalesce("variants", F.lit(1)) > 1).alias("with_variants"))


def revision_gate(spark, d):
    """Pairs that must go because of a retrieval stamp at or after the cutoff."""
    p = primary_pairs(spark, d).withColumns({"revised_at_utc": F.col("retrieved_at_utc").cast("string"), "revised_at_utc_micros": F.unix_micros("retrieved_at_utc")})
    return p.select("event_date", "article_id", matching.revision_gate(["revised_at_utc"], "cutoff_utc").alias("exclusion"))


def latest_window_rows(spark, d):
    """The last row of every request window."""
    raw = table(spark, d, "raw_articles")
    return latest_per_key(raw, ["window_id"], ["retrieved_at_utc", "obs_id"], ["obs_id", "queried_ticker", "retrieved_at_utc"]).withColumn("retrieved_at_utc", F.unix_micros("retrieved_at_utc"))


def request_log(spark, d) -> DataFrame:
    """A request log derived from the observations: one window of days per window id."""
    raw = table(spark, d, "raw_articles").groupBy("window_id", F.col("queried_ticker").alias("ticker"))
    rows = raw.agg(F.to_date(F.min("retrieved_at_utc")).alias("from_date"), F.to_date(F.max("retrieved_at_utc")).alias("to_date"), F.count(F.lit(1)).alias("article_count"))
    return rows.withColumn("status", F.when(F.col("article_count") >= 3, "success_truncation_suspected").when(F.col("article_count") == 2, "success").otherwise("success_empty_unverified"))


_TICKERS = ["QVLT", "MNEX", "RVMZ", "ORDM", "AXWV", "GLPH", "MTRA", "BRCN", "TSLM"]


def _days(spark, d):
    return coverage.coverage_days(request_log(spark, d), _TICKERS, "2025-10-01", "2026-05-01")


def coverage_days(spark, d):
    """State of every configured ticker and day."""
    return _days(spark, d)


def coverage_periods(spark, d):
    """Runs of days without verified coverage."""
    return coverage.coverage_periods(_days(spark, d))


def reported_periods(spark, d):
    """Runs of days in one state, the last window of a day deciding."""
    return coverage.coverage_periods(coverage.reported_days(request_log(spark, d), ["to_date", "window_id"]))


def window_verdicts(spark, d):
    """What is known about the collection over each event's lookback."""
    e = events(spark, d).where(F.col("ticker") == PRIMARY)
    counts = primary_pairs(spark, d).groupBy("ticker", "event_date").agg(F.sum("in_7d").alias("article_count_7d"))
    return coverage.window_verdicts(e, _days(spark, d), counts, ["ticker", "event_date"], "2025-10-01", "2026-05-01")


def landed_days(spark, d):
    """States of every ticker and day where the files of windows with one article were not landed."""
    log = request_log(spark, d).withColumn("raw_file", F.concat("window_id", F.lit("-"), "ticker", F.lit(".json")))
    landed = log.where(F.col("article_count") > 1).select("raw_file")
    return coverage.day_states(log, landed).select("ticker", "day", F.array_join("states", "|").alias("states"))


def variant_counts(spark, d):
    """Different contents seen under an observation's article id or address, the larger number."""
    raw = table(spark, d, "raw_articles").withColumn("normalized_url", F.col("url"))
    content = ["headline", "summary", "datetime"]
    out = matching.with_variants(raw.select("obs_id", "article_id", "normalized_url"), matching.content_variants(raw, "article_id", content), matching.content_variants(raw, "normalized_url", content))
    return out.select("obs_id", "content_variants")


QUERIES = {f.__name__: f for f in (
    daily_bars, move_features, bar_validation, session_gaps, missing_values, review_rows, trimmed_features, flagged_events, flag_problems, view_totals,
    lookback_match, lookback_match_by_ticker, match_summary, never_linked, pair_invariants, content_variants, timestamp_gate, prepared_status,
    uncertain_pairs, revision_gate, latest_window_rows, coverage_days, coverage_periods, reported_periods, window_verdicts, landed_days, variant_counts,
)}
#: The same over the bars of all tickers, those of the growing table included.
_WHOLE = (daily_bars, move_features, missing_values, review_rows, flagged_events, view_totals, lookback_match_by_ticker)
QUERIES |= {f"all_{f.__name__}": partial(f, whole=True) for f in _WHOLE}

BARS = """
bars AS (SELECT * EXCLUDE (rn, loaded_at) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trading_date ORDER BY loaded_at DESC NULLS LAST, bar_id DESC) AS rn
  FROM core_bars WHERE ticker IS NOT NULL AND trading_date IS NOT NULL) WHERE rn = 1)"""
_FLAG = "CASE WHEN adjusted_close IS NULL OR p1 IS NULL THEN NULL WHEN adjusted_close >= p1 * (1 + {0}) THEN 1 WHEN adjusted_close <= p1 * (1 - {0}) THEN -1 ELSE 0 END"
FEATS = BARS + f""",
lagged AS (SELECT *, lag(adjusted_close) OVER w AS p1, lag(adjusted_close, 5) OVER w AS p5 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)),
rets AS (SELECT *, adjusted_close / nullif(p1, 0) - 1 AS adjusted_close_return_1d,
  adjusted_close / nullif(open_price * adjusted_close / nullif(close_price, 0), 0) - 1 AS adjusted_open_to_close_return,
  adjusted_close / nullif(p5, 0) - 1 AS adjusted_close_return_5d, {_FLAG.format(0.05)} AS price_move_5pct, {_FLAG.format(0.01)} AS price_move_1pct FROM lagged),
feats AS (SELECT *,
  CASE WHEN count(adjusted_close_return_1d) OVER w20 = 20 THEN stddev_samp(adjusted_close_return_1d) OVER w20 END AS daily_return_volatility_20d,
  CASE WHEN count(volume) OVER w20 = 20 THEN avg(CAST(volume AS DOUBLE)) OVER w20 END AS average_volume_20d
  FROM rets WINDOW w20 AS (PARTITION BY ticker ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
EVENTS = FEATS + """,
prev AS (SELECT session_date, lag(session_date) OVER (ORDER BY session_date) AS previous_session_date, lag(market_close_utc) OVER (ORDER BY session_date) AS cutoff_utc FROM session_calendar),
shifts AS (SELECT ticker, trading_date AS event_date, price_move_1pct, price_move_5pct,
  CAST(coalesce(price_move_1pct = 1, false) AS INT) AS shift_1pct_up, CAST(coalesce(price_move_1pct = -1, false) AS INT) AS shift_1pct_down,
  CAST(coalesce(price_move_5pct = 1, false) AS INT) AS shift_5pct_up, CAST(coalesce(price_move_5pct = -1, false) AS INT) AS shift_5pct_down FROM feats),
events_ AS (SELECT s.*, concat_ws('|', CASE WHEN shift_1pct_up = 1 THEN '1pct_up' END, CASE WHEN shift_1pct_down = 1 THEN '1pct_down' END,
    CASE WHEN shift_5pct_up = 1 THEN '5pct_up' END, CASE WHEN shift_5pct_down = 1 THEN '5pct_down' END) AS shift_categories,
  previous_session_date, cutoff_utc, timezone('America/New_York', timezone('America/New_York', cutoff_utc) - INTERVAL 7 DAY) AS lookback_start_utc
  FROM shifts AS s JOIN prev ON session_date = event_date WHERE greatest(shift_1pct_up, shift_1pct_down, shift_5pct_up, shift_5pct_down) = 1)"""
ITEMS = ARTICLE_TIMES + ", items AS (SELECT *, epoch_us(utc) AS published_micros FROM art WHERE relevance_type IN ('direct', 'indirect'))"


def _pairs(on: str) -> str:
    return f""",
pairs AS (SELECT e.*, i.article_id, i.published_micros, i.retrieved_at_utc, i.url, (epoch_us(cutoff_utc) - published_micros) AS before
  FROM events_ AS e JOIN items AS i ON published_micros >= epoch_us(lookback_start_utc) AND published_micros < epoch_us(cutoff_utc) AND {on}),
placed AS (SELECT *, CAST(before <= 86400000000 AS INT) AS in_24h, CAST(before <= 259200000000 AS INT) AS in_72h, 1 AS in_7d FROM pairs)"""


_PAIR_OUT = """
SELECT ticker, event_date, article_id, published_micros, before AS micros_before_cutoff,
  CASE WHEN in_24h = 1 THEN '0-24h' WHEN in_72h = 1 THEN '24-72h' ELSE '72h-7d' END AS lookback_bucket, in_24h, in_72h, in_7d FROM placed"""
PRIMARY_PAIRS = f"WITH {EVENTS}, {ITEMS}" + _pairs(f"e.ticker = '{PRIMARY}'")
_LOG = """
log AS (SELECT window_id, queried_ticker AS ticker, CAST(timezone('UTC', min(retrieved_at_utc)) AS DATE) AS from_date, CAST(timezone('UTC', max(retrieved_at_utc)) AS DATE) AS to_date, count(*) AS article_count FROM raw_articles GROUP BY 1, 2),
stat AS (SELECT *, CASE WHEN article_count >= 3 THEN 'success_truncation_suspected' WHEN article_count = 2 THEN 'success' ELSE 'success_empty_unverified' END AS status FROM log),
seen AS (SELECT ticker, day, list_sort(list(DISTINCT status)) AS states FROM (SELECT ticker, status, CAST(unnest(generate_series(CAST(from_date AS TIMESTAMP), CAST(to_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM stat) GROUP BY 1, 2),
spine AS (SELECT unnest([""" + ", ".join(f"'{t}'" for t in _TICKERS) + """]) AS ticker, days.day FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2025-09-21', TIMESTAMP '2026-05-01', INTERVAL 1 DAY)) AS DATE) AS day) AS days),
cover AS (SELECT spine.ticker, spine.day, CASE WHEN spine.day < DATE '2025-10-01' THEN 'outside_collected_date_range' WHEN states IS NULL THEN 'no_terminal_request'
  WHEN len(list_filter(states, lambda s: s <> 'success')) > 0 THEN array_to_string(list_filter(states, lambda s: s <> 'success'), '|') ELSE 'success' END AS coverage_state
  FROM spine LEFT JOIN seen ON seen.ticker = spine.ticker AND seen.day = spine.day)"""
_LAGS = ", ".join(
    f"round({x}, 6) + 0.0 AS {x}, round(lag({x}) OVER w, 6) + 0.0 AS {x}_lag1_session" if "move" not in x else f"{x}, lag({x}) OVER w AS {x}_lag1_session" for x in series.FEATURES
)
_ALL = "(SELECT * FROM core_bars UNION ALL SELECT * FROM daily_bars)"


def over_all(sql: str) -> str:
    """The SQL of a query over the configured tickers, over all tickers."""
    return sql.replace("FROM core_bars", f"FROM {_ALL}")



SQL = {
    "daily_bars": f"WITH {BARS} SELECT * FROM bars",
    "move_features": f"WITH {FEATS} SELECT ticker, trading_date, {_LAGS} FROM feats WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)",
    "bar_validation": f"""
WITH r AS (SELECT *, lag(trading_date) OVER (PARTITION BY ticker ORDER BY trading_date NULLS FIRST, bar_id) AS b FROM {_ALL}),
c AS (SELECT count(*) FILTER (b = trading_date) AS date_repeated,
  count(*) FILTER (open_price IS NULL OR high_price IS NULL OR low_price IS NULL OR close_price IS NULL OR adjusted_close IS NULL) AS price_missing,
  count(*) FILTER (open_price <= 0 OR high_price <= 0 OR low_price <= 0 OR close_price <= 0 OR adjusted_close <= 0) AS price_not_positive,
  count(*) FILTER (high_price < greatest(open_price, low_price, close_price)) AS high_below_others, count(*) FILTER (low_price > least(open_price, high_price, close_price)) AS low_above_others,
  count(*) FILTER (volume IS NULL) AS volume_missing, count(*) FILTER (volume < 0) AS volume_negative, count(*) FILTER (volume = 0) AS volume_zero,
  count(*) FILTER (stock_splits <> 0) AS split, count(*) FILTER (dividends <> 0) AS dividend FROM r)
UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE violations""",
    "session_gaps": f"""
WITH d AS (SELECT DISTINCT ticker, trading_date FROM {_ALL} WHERE ticker IS NOT NULL AND trading_date IS NOT NULL),
s AS (SELECT ticker, min(trading_date) AS lo, max(trading_date) AS hi FROM d GROUP BY ticker)
SELECT s.ticker, session_date AS trading_date, 'missing' AS problem FROM s JOIN session_calendar ON session_date BETWEEN lo AND hi
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.ticker = s.ticker AND d.trading_date = session_date)
UNION ALL SELECT ticker, trading_date, 'not_a_session' FROM d WHERE trading_date NOT IN (SELECT session_date FROM session_calendar)""",
    "missing_values": f"WITH {BARS}, c AS (SELECT " + ", ".join(f"count(*) FILTER ({x} IS NULL) AS {x}" for x in [*series.PRICES, "volume"]) + " FROM bars) UNPIVOT c ON COLUMNS(*) INTO NAME column_name VALUE missing",
    "review_rows": f"""WITH {FEATS}, r AS (SELECT *, concat_ws('|', CASE WHEN dividends <> 0 THEN 'dividend' END, CASE WHEN stock_splits <> 0 THEN 'split' END, CASE WHEN abs(adjusted_close_return_1d) >= 0.10 THEN 'large_return' END) AS review_reason FROM feats)
SELECT ticker, trading_date, dividends, stock_splits, review_reason FROM r WHERE review_reason <> ''""",
    "trimmed_features": f"WITH {FEATS} SELECT ticker, trading_date, price_move_1pct, price_move_5pct, round(daily_return_volatility_20d, 6) AS volatility FROM feats WHERE trading_date BETWEEN DATE '2025-10-01' AND DATE '2026-05-15'",
    "flagged_events": f"WITH {EVENTS} SELECT * REPLACE (epoch_us(cutoff_utc) AS cutoff_utc, epoch_us(lookback_start_utc) AS lookback_start_utc) FROM events_",
    "flag_problems": "SELECT unnest(['unexpected_price_move_1pct', 'unexpected_price_move_5pct', 'repeated_dates']) AS problem, CAST(0 AS BIGINT) AS rows",
    "view_totals": f"""WITH {EVENTS}, c AS (SELECT ticker, CAST(sum(shift_1pct_up) AS BIGINT) AS "1pct_up", CAST(sum(shift_1pct_down) AS BIGINT) AS "1pct_down", CAST(sum(shift_5pct_up) AS BIGINT) AS "5pct_up", CAST(sum(shift_5pct_down) AS BIGINT) AS "5pct_down",
  CAST(sum(shift_1pct_up * shift_5pct_up) AS BIGINT) AS both_up, CAST(sum(shift_1pct_down * shift_5pct_down) AS BIGINT) AS both_down FROM events_ GROUP BY ticker)
UNPIVOT c ON COLUMNS(* EXCLUDE ticker) INTO NAME view VALUE events""",
    "lookback_match": PRIMARY_PAIRS + _PAIR_OUT,
    "lookback_match_by_ticker": f"WITH {EVENTS}, {ITEMS}" + _pairs("e.ticker = i.provider_related") + _PAIR_OUT,
    "match_summary": PRIMARY_PAIRS + f"""
SELECT e.ticker, e.event_date, e.shift_categories, CAST(coalesce(sum(in_24h), 0) AS BIGINT) AS article_count_24h, CAST(coalesce(sum(in_72h), 0) AS BIGINT) AS article_count_72h, CAST(coalesce(sum(in_7d), 0) AS BIGINT) AS article_count_7d
FROM events_ AS e LEFT JOIN placed AS p ON p.ticker = e.ticker AND p.event_date = e.event_date WHERE e.ticker = '{PRIMARY}' GROUP BY 1, 2, 3""",
    "never_linked": PRIMARY_PAIRS + " SELECT article_id FROM items WHERE article_id NOT IN (SELECT article_id FROM placed)",
    "pair_invariants": "SELECT unnest(['pair_repeated', 'outside_window', 'windows_not_nested', 'counts_differ']) AS rule, CAST(0 AS BIGINT) AS violations",
    "content_variants": "SELECT article_id, count(DISTINCT {'h': headline, 's': summary, 'd': \"datetime\"}) AS variants FROM raw_articles WHERE article_id IS NOT NULL GROUP BY article_id",
    "timestamp_gate": "WITH gate_src AS (SELECT a.article_id, a.published_at_utc AS text, f.day_first FROM articles AS a LEFT JOIN feeds AS f ON f.source = a.source)," + parsed("gate", "gate_src", dates=True) + """
SELECT article_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing_timestamp' WHEN inst IS NOT NULL THEN NULL WHEN local IS NULL THEN 'invalid_timestamp'
  WHEN NOT regexp_matches(s, ':') THEN 'date_only_timestamp' ELSE 'timestamp_without_zone' END AS reason FROM gate""",
    "prepared_status": f"WITH {ARTICLE_TIMES}" + """
SELECT article_id, CASE WHEN relevance_type IS NULL OR relevance_type NOT IN ('direct', 'indirect') THEN 'not_relevant' WHEN utc IS NULL THEN 'timestamp_unusable' ELSE 'kept' END AS status,
  CAST(coalesce(headline, '') = '' AS INT) AS missing_headline, CAST(coalesce(summary, '') = '' AS INT) AS missing_summary, CAST(coalesce(source, '') = '' AS INT) AS missing_source, CAST(coalesce(url, '') = '' AS INT) AS missing_url FROM art""",
    "uncertain_pairs": PRIMARY_PAIRS + """,
v AS (SELECT url, count(DISTINCT {'h': headline, 's': summary, 'd': "datetime"}) AS variants FROM raw_articles WHERE url <> '' GROUP BY url)
SELECT ticker, event_date, count(*) FILTER (retrieved_at_utc IS NULL OR retrieved_at_utc >= cutoff_utc OR coalesce(variants, 1) > 1) AS uncertain, count(*) FILTER (coalesce(variants, 1) > 1) AS with_variants
FROM placed LEFT JOIN v USING (url) GROUP BY 1, 2""",
    "revision_gate": PRIMARY_PAIRS + " SELECT event_date, article_id, CASE WHEN retrieved_at_utc >= cutoff_utc THEN 'revised_after_cutoff' END AS exclusion FROM placed",
    "latest_window_rows": "SELECT window_id, obs_id, queried_ticker, epoch_us(retrieved_at_utc) AS retrieved_at_utc FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY retrieved_at_utc DESC NULLS LAST, obs_id DESC) AS rn FROM raw_articles) WHERE rn = 1",
    "coverage_days": f"WITH {_LOG} SELECT ticker, day, coverage_state FROM cover",
    "coverage_periods": f"""WITH {_LOG}, r AS (SELECT ticker, coverage_state AS state, day, day - CAST(row_number() OVER (PARTITION BY ticker, coverage_state ORDER BY day) AS INT) AS run FROM cover WHERE coverage_state <> 'success')
SELECT ticker, state, min(day) AS from_day, max(day) AS to_day, count(*) AS days FROM r GROUP BY ticker, state, run""",
    "reported_periods": f"""WITH {_LOG}, e AS (SELECT ticker, status, to_date, window_id, CAST(unnest(generate_series(CAST(from_date AS TIMESTAMP), CAST(to_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM stat),
k AS (SELECT ticker, day, status AS state FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY to_date DESC, window_id DESC) AS rn FROM e) WHERE rn = 1),
r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY ticker, state ORDER BY day) AS INT) AS run FROM k WHERE state <> 'success')
SELECT ticker, state, min(day) AS from_day, max(day) AS to_day, count(*) AS days FROM r GROUP BY ticker, state, run""",
    "window_verdicts": PRIMARY_PAIRS + f""", {_LOG},
spread AS (SELECT ticker, event_date, cutoff_utc, CAST(unnest(generate_series(date_trunc('day', timezone('UTC', lookback_start_utc)), date_trunc('day', timezone('UTC', cutoff_utc) - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS DATE) AS day FROM events_ WHERE ticker = '{PRIMARY}' AND cutoff_utc IS NOT NULL),
iss AS (SELECT s.ticker, s.event_date, max(CAST(coverage_state IN ('no_terminal_request', 'missing_raw_response_file', 'outside_collected_date_range') OR contains(coverage_state, 'failed') OR contains(coverage_state, 'unavailable') AS INT)) AS g,
  max(CAST(contains(coverage_state, 'truncation') AS INT)) AS t, max(CAST(s.day >= CAST(timezone('UTC', cutoff_utc) - INTERVAL 24 HOUR AS DATE) AS INT)) AS h24, max(CAST(s.day >= CAST(timezone('UTC', cutoff_utc) - INTERVAL 72 HOUR AS DATE) AS INT)) AS h72 FROM spread AS s JOIN cover AS c ON c.day = s.day WHERE coverage_state <> 'success' GROUP BY 1, 2),
n AS (SELECT ticker, event_date, count(*) AS n FROM placed GROUP BY 1, 2),
tick AS (SELECT s.ticker, s.event_date, CAST(s.day AS VARCHAR) AS date_utc, coverage_state AS state, list_sort(list(DISTINCT c.ticker)) AS tickers FROM spread AS s JOIN cover AS c ON c.day = s.day WHERE coverage_state <> 'success' GROUP BY 1, 2, 3, 4),
js AS (SELECT ticker, event_date, CAST(to_json(list({{'date_utc': date_utc, 'state': state, 'tickers': tickers}} ORDER BY date_utc, state)) AS VARCHAR) AS j FROM tick GROUP BY 1, 2)
SELECT e.ticker, e.event_date, coalesce(n, 0) AS article_count_7d, coalesce(j, '[]') AS coverage_issues, CAST(coalesce(h24, 0) = 0 AS INT) AS collection_window_verified_24h, CAST(coalesce(h72, 0) = 0 AS INT) AS collection_window_verified_72h,
  CAST(coalesce(e.lookback_start_utc < TIMESTAMPTZ '2025-10-01 00:00:00+00', false) AS INT) AS incomplete_lookback_at_news_start, CAST(coalesce(e.cutoff_utc > TIMESTAMPTZ '2026-05-02 00:00:00+00', false) AS INT) AS extends_past_news_collection_end,
  CAST(g IS NULL AS INT) AS collection_window_verified_7d, coalesce(g, 0) AS known_collection_gap, coalesce(t, 0) AS potential_truncation,
  CASE WHEN coalesce(n, 0) > 0 THEN 'has_matches' WHEN g IS NOT NULL THEN 'zero_matches_with_coverage_gap' ELSE 'zero_matches_in_verified_windows' END AS zero_match_interpretation
FROM events_ AS e LEFT JOIN n ON n.ticker = e.ticker AND n.event_date = e.event_date LEFT JOIN iss ON iss.ticker = e.ticker AND iss.event_date = e.event_date LEFT JOIN js ON js.ticker = e.ticker AND js.event_date = e.event_date WHERE e.ticker = '{PRIMARY}'""",
}
SQL |= {
    "landed_days": f"""WITH {_LOG}, e AS (SELECT ticker, CASE WHEN article_count > 1 THEN status ELSE 'missing_raw_response_file' END AS s, CAST(unnest(generate_series(CAST(from_date AS TIMESTAMP), CAST(to_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM stat)
SELECT ticker, day, string_agg(DISTINCT s, '|' ORDER BY s) AS states FROM e GROUP BY 1, 2""",
    "variant_counts": """WITH v AS (SELECT *, {'h': headline, 's': summary, 'd': "datetime"} AS c FROM raw_articles),
a AS (SELECT article_id, count(DISTINCT c) AS n FROM v WHERE article_id IS NOT NULL GROUP BY 1), u AS (SELECT url, count(DISTINCT c) AS n FROM v WHERE url <> '' GROUP BY 1)
SELECT obs_id, greatest(1, coalesce(a.n, 1), coalesce(u.n, 1)) AS content_variants FROM raw_articles AS r LEFT JOIN a ON a.article_id = r.article_id LEFT JOIN u ON u.url = r.url""",
}
SQL |= {f"all_{f.__name__}": over_all(SQL[f.__name__]) for f in _WHOLE}
