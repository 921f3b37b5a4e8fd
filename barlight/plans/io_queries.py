"""Queries through landed files, sinks, streams and set operations, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.functions import ids, text
from barlight.operators import grouping
from barlight.operators.timestamps import with_feed, with_instant
from barlight.plans import series_queries as sq
from barlight.plans.sql_times import RAW_TIMES
from barlight.session import shared_folder
from barlight.sources import landing, sinks
from barlight.sources.tables import table
from barlight.streaming import feeds


#: Retrievals from here on make the second batch of the request log.
_SECOND = "2025-12-01 00:00:00"


def _place(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def envelope_articles(spark, d):
    """Observations landed as response envelopes, one document per line, and read back: those of the
    collected dates, and those whose time is unknown."""
    raw = with_instant(with_feed(table(spark, d, "raw_articles"), table(spark, d, "feeds")), "datetime", F.col("feed_zone"), "_at")
    seconds = F.floor(F.col("_at") / F.lit(1_000_000)).cast("bigint")
    article = F.struct("category", seconds.alias("datetime"), "headline", F.col("obs_id").alias("id"), "image", "related", "source", "summary", "url")
    env = raw.select(
        F.lit(1).alias("schema_version"), F.struct(F.lit("news").alias("endpoint"), F.col("queried_ticker").alias("symbol")).alias("request"), F.col("retrieved_at_utc").cast("string").alias("retrieved_at_utc"),
        F.lit(200).alias("http_status"), F.lit("success").alias("collection_status"), F.lit(True).alias("terminal_window"), F.array(article).alias("response"),
    )
    path = _place(spark, "envelopes")
    env.write.json(path)
    landed = spark.read.schema(landing.ENVELOPE).json(path, mode="FAILFAST").withColumn("raw_file", F.lit(""))
    return landing.envelope_articles(landed, "2025-11-01", "2026-03-31").select("id", "queried_ticker", "headline", "summary", "url", F.col("datetime").alias("published_seconds"))


def request_log_latest(spark, d):
    """A request log of two batches, the second larger; the last line of each window wins."""
    raw = table(spark, d, "raw_articles")
    late = F.coalesce(F.col("retrieved_at_utc") >= F.lit(_SECOND).cast("timestamp"), F.lit(True))
    # numbers fall in the second batch where they grow in the first, so the largest isn't the last
    log = raw.select(F.lit("request_window").alias("record_type"), "window_id", F.col("queried_ticker").alias("ticker"), F.col("obs_id").cast("int").alias("attempt"), late.alias("_late"))
    path = _place(spark, "log")
    sinks.append_log(log.where(~F.col("_late")).drop("_late").orderBy("attempt"), path)
    sinks.append_log(log.where("_late").drop("_late").orderBy(F.desc("attempt")), path)
    return landing.latest_requests(landing.read_jsonl(spark, path, landing.MANIFEST)).select("window_id", "ticker", "attempt")


def text_table(spark, d):
    """Articles written as CSV and read back as text, quotes and line breaks included."""
    path = _place(spark, "csv")
    columns = ["article_id", "queried_tickers", "companies_discussed", "headline"]
    a = table(spark, d, "articles").select("article_id", *[F.regexp_replace(F.coalesce(c, F.lit("")), "^\\s+|\\s+$", "").alias(c) for c in columns[1:]])
    sinks.write_table(a, path, columns)
    got = landing.read_text_table(spark, path, columns)
    return got.select("article_id", *[F.coalesce(c, F.lit("")).alias(c) for c in columns[1:]])


def view_files(spark, d):
    """Flagged sessions written as overlapping views; rows per view."""
    path = _place(spark, "views")
    views = {k: f"shift_{k}" for k in ("1pct_up", "1pct_down", "5pct_up", "5pct_down")}
    sinks.write_views(sq.events(spark, d), path, views)
    out = None
    for v in views:
        n = spark.read.parquet(f"{path}/{v}").agg(F.lit(v).alias("view"), F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


def _streamed(spark, stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Run a stream over all there is and return what it holds at the end."""
    path = _place(spark, label)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", _place(spark, f"{label}-state")).trigger(availableNow=True)
    query.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark, d) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source watches a folder; the pattern keeps to this one table
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_totals(spark, d):
    """Events per type and tumbling day, from a stream."""
    s = feeds.windowed_totals(_event_stream(spark, d), "ts", "event_type", "value", "1 day")
    return _streamed(spark, s, "totals", "complete").select(F.col("window_start").cast("date").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))


def stream_sessions(spark, d):
    """Runs of a user's events without a pause of six hours, from a stream."""
    s = feeds.sessions(_event_stream(spark, d), "ts", "user_id", "6 hours")
    return _streamed(spark, s, "sessions", "complete").select("user_id", F.unix_micros("session_start").alias("session_start"), "events")


def stream_distinct(spark, d):
    """Event ids once each, from a stream."""
    s = feeds.distinct_items(_event_stream(spark, d).select("event_id", "ts"), "event_id", "ts")
    return _streamed(spark, s, "distinct", "append").select("event_id")


def ticker_sets(spark, d):
    """Tickers of the two bar tables and the feed: only here, in both, only there."""
    bars = sq.table(spark, d, "core_bars").select("ticker").union(table(spark, d, "daily_bars").select("ticker")).distinct()
    feed = table(spark, d, "bar_feed").select("ticker").distinct()
    tag = lambda df, s: df.where(F.col("ticker").isNotNull()).withColumn("side", F.lit(s))
    return tag(bars.exceptAll(feed), "bars").unionByName(tag(bars.intersect(feed), "both")).unionByName(tag(feed.exceptAll(bars), "feed"))


def ticker_subset(spark, d):
    """Articles whose tags name tickers outside the configured list."""
    known = F.array(*map(F.lit, sq._TICKERS))
    a = table(spark, d, "articles").withColumn("t", text.split_tags(F.regexp_replace("queried_tickers", "[|]", ";")))
    return a.where(F.size(F.array_except("t", known)) > 0).select("article_id")


def scalar_functions(spark, d):
    """Escaping, link check, number and month parsing on every article."""
    a = table(spark, d, "articles")
    return a.select(
        "article_id", text.escape_html(F.coalesce("headline", F.lit(""))).alias("html"), text.safe_link(F.col("url")).alias("link"), text.to_number(F.col("published_at_utc")).alias("number"),
        ids.first_filled(F.col("url"), F.col("headline")).alias("first"), text.join_distinct(F.array(F.lit("a"), F.coalesce("source", F.lit("?")), F.lit("a"))).alias("joined"),
    )


def state_texts(spark, d):
    """What each coverage state means."""
    return sq.coverage_days(spark, d).select("coverage_state").distinct().withColumn("meaning", text.state_text(F.col("coverage_state")))


def headline_ratios(spark, d):
    """Pairs of headlines that only their characters show to be similar."""
    e = grouping.similar_edges(sq.relevant(spark, d), "article_id", "published_micros", by=("characters",))
    return e.where(F.col("ratio").isNotNull()).select("a", "b", F.round("ratio", 6).alias("ratio"))


def provenance(spark, d):
    """Rows and checksums of the input tables."""
    names = ["core_bars", "daily_bars", "bar_feed", "raw_articles", "articles", "session_calendar", "feeds", "documents", "eval_items"]
    return sinks.provenance(spark, {n: table(spark, d, n) for n in names})


def input_ranges(spark, d):
    """First and last value of a dated column of every input."""
    dated = {"articles": "retrieved_at_utc", "raw_articles": "retrieved_at_utc", "daily_bars": "trading_date", "core_bars": "trading_date", "session_calendar": "session_date"}
    return sinks.input_ranges({t: (table(spark, d, t), c) for t, c in dated.items()}).select("name", "column", F.substring("first", 1, 19).alias("first"), F.substring("last", 1, 19).alias("last"))


def input_rows(spark, d):
    """The row counts of the provenance."""
    return provenance(spark, d).select("name", "rows")


def chart_points(spark, d):
    """Price points of every configured ticker for a chart."""
    return sinks.chart_points(sq.bars(spark, d), "trading_date", "adjusted_close", "ticker")


def all_chart_points(spark, d):
    """Price points of every ticker for a chart."""
    return sinks.chart_points(sq.bars(spark, d, whole=True), "trading_date", "adjusted_close", "ticker")


QUERIES = {f.__name__: f for f in (
    envelope_articles, request_log_latest, text_table, view_files, stream_totals, stream_sessions, stream_distinct, ticker_sets, ticker_subset,
    scalar_functions, state_texts, headline_ratios, provenance, input_rows, input_ranges, chart_points, all_chart_points,
)}

_TRIMMED = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("core_bars", "daily_bars", "bar_feed", "raw_articles", "articles", "session_calendar", "feeds", "documents", "eval_items"))
_STATES = {
    "success": "collected, no known problem", "success_empty_unverified": "the provider returned nothing; whether nothing existed is not verified",
    "no_terminal_request": "no finished request covers the day", "outside_collected_date_range": "outside the range that was collected",
}

SQL = {
    "envelope_articles": f"""WITH {RAW_TIMES} SELECT obs_id AS id, queried_ticker, headline, summary, url, CAST(floor(epoch_us(utc) / 1000000.0) AS BIGINT) AS published_seconds FROM raw JOIN raw_articles USING (obs_id)
WHERE utc IS NULL OR CAST(utc AS DATE) BETWEEN DATE '2025-11-01' AND DATE '2026-03-31'""",
    "input_ranges": " UNION ALL ".join(
        f"SELECT '{t}' AS name, '{c}' AS \"column\", " + ", ".join(f"strftime(timezone('UTC', {f}({c})), '%Y-%m-%d %H:%M:%S') AS \"{n}\"" if c == "retrieved_at_utc" else f"CAST({f}({c}) AS VARCHAR) AS \"{n}\"" for f, n in (("min", "first"), ("max", "last"))) + f" FROM {t}"
        for t, c in (("articles", "retrieved_at_utc"), ("raw_articles", "retrieved_at_utc"), ("daily_bars", "trading_date"), ("core_bars", "trading_date"), ("session_calendar", "session_date"))
    ),
    "request_log_latest": f"""SELECT window_id, ticker, attempt FROM (SELECT window_id, queried_ticker AS ticker, CAST(obs_id AS INT) AS attempt, row_number() OVER (PARTITION BY window_id
  ORDER BY coalesce(retrieved_at_utc >= TIMESTAMPTZ '{_SECOND}+00', true) DESC, CASE WHEN coalesce(retrieved_at_utc >= TIMESTAMPTZ '{_SECOND}+00', true) THEN -obs_id ELSE obs_id END DESC) AS rn FROM raw_articles) WHERE rn = 1""",
    "text_table": "SELECT CAST(article_id AS VARCHAR) AS article_id, " + ", ".join(f"{_TRIMMED.format(c)} AS {c}" for c in ("queried_tickers", "companies_discussed", "headline")) + " FROM articles",
    "view_files": f"WITH {sq.EVENTS} " + " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS rows FROM events_ WHERE shift_{v} = 1" for v in ("1pct_up", "1pct_down", "5pct_up", "5pct_down")),
    "stream_totals": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS events FROM r GROUP BY user_id, run""",
    "stream_distinct": "SELECT DISTINCT event_id FROM events",
    "ticker_sets": """WITH b AS (SELECT ticker FROM core_bars UNION SELECT ticker FROM daily_bars), f AS (SELECT DISTINCT ticker FROM bar_feed)
SELECT ticker, 'bars' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM f) WHERE ticker IS NOT NULL UNION ALL SELECT ticker, 'both' FROM (SELECT * FROM b INTERSECT SELECT * FROM f) WHERE ticker IS NOT NULL
UNION ALL SELECT ticker, 'feed' FROM (SELECT * FROM f EXCEPT SELECT * FROM b) WHERE ticker IS NOT NULL""",
    "ticker_subset": "SELECT article_id FROM articles WHERE len(list_filter(list_transform(string_split_regex(coalesce(queried_tickers, ''), '[|;,]'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT list_contains([" + ", ".join(f"'{t}'" for t in sq._TICKERS) + "], x))) > 0",
    "scalar_functions": """SELECT article_id, replace(replace(replace(replace(replace(coalesce(headline, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
  CASE WHEN regexp_matches(lower(url), '^https?://') THEN url END AS link, TRY_CAST(trim(published_at_utc) AS DOUBLE) AS number, coalesce(nullif(url, ''), nullif(headline, '')) AS first,
  CASE WHEN coalesce(source, '?') = 'a' THEN 'a' ELSE 'a|' || coalesce(source, '?') END AS joined FROM articles""",
    "state_texts": f"WITH {sq._LOG} SELECT DISTINCT coverage_state, CASE " + " ".join(f"WHEN coverage_state = '{k}' THEN '{v}'" for k, v in _STATES.items()) + " WHEN contains(coverage_state, 'truncation') THEN 'the response may be cut off' ELSE 'unknown state' END AS meaning FROM cover",
    "input_rows": _COUNTS,
    "chart_points": f"WITH {sq.BARS} SELECT ticker AS series, trading_date AS x, adjusted_close AS y FROM bars WHERE adjusted_close IS NOT NULL",
}
SQL["all_chart_points"] = sq.over_all(SQL["chart_points"])
