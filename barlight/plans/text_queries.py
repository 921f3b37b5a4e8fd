"""Queries over texts, rules, groups, words, topics and general tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import ids, text, urls
from barlight.operators import grouping, reports, rules, themes, words
from barlight.operators.packed import split_packed
from barlight.plans import general
from barlight.plans import series_queries as sq
from barlight.plans.sql_times import ARTICLE_TIMES
from barlight.sources import landing
from barlight.sources.tables import latest_per_key, table

ZONE = "America/New_York"


def _full_text():
    return F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit("")))


def normalized_texts(spark, d):
    """Articles' headlines normalised, with their tokens."""
    a = table(spark, d, "articles")
    return a.select("article_id", text.normalize_text(F.col("headline")).alias("norm"), F.array_join(F.array_sort(text.headline_tokens(F.col("headline"))), " ").alias("tokens"))


def normalized_documents(spark, d):
    """Whole documents normalised."""
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


def normalized_urls(spark, d):
    """Article addresses in canonical form."""
    return table(spark, d, "raw_articles").select("obs_id", urls.normalize_url(F.col("url")).alias("url"))


def term_hits(spark, d):
    """Which of the rules' direct and trade terms each article holds, in the order of the rules."""
    terms = rules.DEFAULT.direct_terms + rules.DEFAULT.categories["trade"]
    return table(spark, d, "articles").select("article_id", F.array_join(text.matched_terms(text.normalize_text(_full_text()), terms), "|").alias("hits"))


def classify(spark, d):
    """Relevance, category and exclusions of every article by the default rules."""
    c = rules.classified(table(spark, d, "articles"))
    return c.select("article_id", "relevance", "category", F.array_join("exclusion_reasons", ";").alias("reasons"), "is_excluded")


def entity_tags(spark, d):
    """Companies named by tags or aliases."""
    return rules.classified(table(spark, d, "articles")).select("article_id", F.array_join("companies", "|").alias("companies"))


def stable_ids(spark, d):
    """Content-based identifiers."""
    a = table(spark, d, "articles")
    return a.select("article_id", ids.stable_id("item", [F.col("headline"), F.col("source"), F.col("article_id")]).alias("id"), ids.canonical_key(F.lit(None), F.col("normalized_url"), F.col("published_at_utc"), F.col("headline")).alias("key"))


def merged_observations(spark, d):
    """Observations merged by article id or address."""
    raw = table(spark, d, "raw_articles").withColumn("normalized_url", urls.normalize_url(F.col("url")))
    return grouping.merged_observations(raw).withColumn("retrieved_at_utc", F.unix_micros("retrieved_at_utc"))


def exact_group_sizes(spark, d):
    """How many groups of observations have which size."""
    raw = table(spark, d, "raw_articles").withColumn("normalized_url", urls.normalize_url(F.col("url")))
    g = grouping.exact_groups(raw, "obs_id", ["article_id", "normalized_url"]).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


def headline_edges(spark, d):
    """Pairs of headlines of 72 hours that are similar by their words."""
    e = grouping.similar_edges(sq.relevant(spark, d), "article_id", "published_micros", by=("words",))
    return e.where(F.col("jaccard") >= 0.78).select("a", "b", "tokens", F.round("jaccard", 6).alias("jaccard"))


def event_groups(spark, d):
    """Event group, representative and suppression of every article."""
    return grouping.event_groups(sq.articles(spark, d), "article_id", "published_micros")


def word_event_groups(spark, d):
    """The same with headlines alike by their words only, which SQL can check."""
    return grouping.event_groups(sq.articles(spark, d), "article_id", "published_micros", sequence=1.01)


def monthly_counts(spark, d):
    """Articles per month with zero months, by relevance."""
    a = sq.articles(spark, d).withColumn("day", F.to_date(F.timestamp_micros("published_micros")))
    kinds = {k: F.col("relevance_type") == k for k in ("direct", "indirect", "not_relevant")}
    return reports.monthly_counts(a, "day", kinds, "2025-07-01", "2026-06-30")


def reason_counts(spark, d):
    """Exclusion reasons of all articles, most frequent first."""
    long = split_packed(table(spark, d, "articles"), "article_id", ["exclusion_reason"])
    return reports.reason_counts(long.select(F.array("item").alias("r")), "r")


def status_counts(spark, d):
    """Request states, exactly and by prefix."""
    return reports.status_counts(sq.request_log(spark, d), "status", ["success", "failed"])


def large_groups(spark, d):
    """Duplicate groups with several rows."""
    return reports.groups_above_one(table(spark, d, "articles"), "duplicate_group_id")


def article_contract(spark, d):
    """Rows that break the promises of an article table."""
    a = sq.articles(spark, d)
    conditions = {
        "published_known": F.col("published_micros").isNotNull(),
        "published_in_range": F.col("published_micros").between(F.lit(1759276800000000), F.lit(1777680000000000)),
        "zulu_suffix": F.col("published_at_utc").endswith("Z"),
        "excluded_is_boolean_text": F.col("excluded").isin("true", "false"),
        "relevance_known": F.col("relevance_type").isin("direct", "indirect", "not_relevant"),
    }
    return reports.contract_violations(a, conditions, ["article_id", "normalized_url"])


def reconciliation(spark, d):
    """Counts that should agree: groups with their representatives, recorded with counted sizes, ids."""
    a = table(spark, d, "articles")
    grouped = a.where(F.col("duplicate_group_id").isNotNull())
    sizes = grouped.groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("n"))
    return reports.reconciled({
        "representatives": (grouped.where(F.col("event_representative") == "true"), sizes),
        "recorded_sizes": (grouped.join(sizes, "duplicate_group_id").where(F.col("n") == F.col("duplicate_group_size")), grouped),
        "ids": (a.select("article_id").distinct(), a.select("article_id")),
    })


def signals_absent(spark, d):
    """Signal articles whose source the list of feeds does not hold."""
    signals = table(spark, d, "articles").where((F.col("excluded") == "false") & F.col("relevance_type").isin("direct", "indirect")).select("article_id", "source")
    return reports.absent_from(signals, table(spark, d, "feeds"), ["source"]).select("article_id")


def signal_violations(spark, d):
    """Rows marked as not excluded that a table of signals must not hold, by rule."""
    kept = table(spark, d, "articles").where(F.col("excluded") == "false")
    rules = {"relevant": F.col("relevance_type").isin("direct", "indirect"), "representative": F.col("event_representative") == "true", "has_headline": F.coalesce("headline", F.lit("")) != ""}
    return reports.contract_violations(kept, rules, ["article_id", "exact_duplicate_group_id"])


def stratified_sample(spark, d):
    """Ten articles per relevance: best per category, then per month, then overall."""
    a = sq.relevant(spark, d).withColumn("month", reports.month_key(F.to_date(F.timestamp_micros("published_micros"))))
    quality = [(F.coalesce("summary", F.lit("")) != "").cast("int"), F.length(F.coalesce("summary", F.lit(""))), F.col("published_micros")]
    out = reports.stratified_sample(a, "relevance_type", "event_category", ["trade", "deals", "supply", "product", "finance"], "month", quality, "article_id")
    return out.select("relevance_type", "article_id")


def sample_composition(spark, d):
    """Whether the sample has ten articles per relevance."""
    return reports.sample_composition(stratified_sample(spark, d), "relevance_type", 10)


def first_headlines(spark, d):
    """The earliest article of each category, the first five of these."""
    a = sq.articles(spark, d).where(F.col("published_micros").isNotNull() & F.col("event_category").isNotNull())
    return reports.first_per_group(a, ["event_category"], ["published_micros", "article_id"], 5).select("event_category", "article_id")


def evenly_spaced(spark, d):
    """Five articles of each category at even steps in time."""
    a = sq.articles(spark, d).where(F.col("published_micros").isNotNull())
    return reports.evenly_spaced(a, ["event_category"], ["published_micros", "article_id"], 5).select("event_category", "article_id")


def _dated(spark, d) -> DataFrame:
    at = F.timestamp_micros("published_micros")
    a = sq.articles(spark, d).where(F.col("published_micros").isNotNull())
    return a.withColumns({"utc_day": F.to_date(at), "ny_day": F.to_date(F.from_utc_timestamp(at, ZONE))})


def _words(spark, d) -> DataFrame:
    return words.word_rows(_dated(spark, d), _full_text(), ["relevance_type", "event_category", "utc_day", "ny_day"])


def word_freq(spark, d):
    """Per word: counts, days and leading category."""
    return words.overall_words(_words(spark, d), "relevance_type", "utc_day", "event_category")


def _daily(word_rows: DataFrame) -> DataFrame:
    return words.daily_words(word_rows, "utc_day", "ny_day", "relevance_type", "event_category")


def word_freq_daily(spark, d):
    """Per word and day: counts, leading category, articles of the day and the same date's moves."""
    moves = sq.features(spark, d).where(F.col("ticker") == sq.PRIMARY)
    return words.with_day_context(_daily(_words(spark, d)), _dated(spark, d), "utc_day", "ny_day", moves)


def word_freq_local(spark, d):
    """Daily counts by New York date."""
    return words.by_local_day(_daily(_words(spark, d)))


def top_words(spark, d):
    """The twelve leading words."""
    return words.top_words(word_freq(spark, d)).select("word", "total_occurrences")


def _lagged(spark, d, only: list[str] | None = None):
    rows = _words(spark, d)
    if only is not None:  # the few words asked for, before anything is counted
        rows = rows.where(F.col("word").isin(only))
    f = sq.features(spark, d).where(F.col("ticker") == sq.PRIMARY)
    sessions = f.select(F.col("trading_date").alias("session_date"))
    return words.lagged_words(words.by_local_day(_daily(rows)), sessions, f)


def lagged_words(spark, d):
    """Word counts beside the next session's move of the primary ticker."""
    return _lagged(spark, d).select("local_date", "word", "occurrences", "articles", "next_trading_date", (F.round("next_day_close_to_close_return", 6) + 0.0).alias("next_return"), "next_day_price_move_1pct")


def word_fits(spark, d):
    """Correlation and line of the next move over a leading word's daily count."""
    top = [r.word for r in top_words(spark, d).collect()]  # twelve
    fits = words.word_fits(_lagged(spark, d, top))
    return fits.select("word", "days", *[(F.round(c, 6) + 0.0).alias(c) for c in ("correlation", "slope", "intercept")])


def daily_mean_occurrences(spark, d):
    """Mean count per word and local day."""
    return words.daily_mean(word_freq_local(spark, d), "occurrences").select("local_date", F.round("mean_value", 6).alias("mean_value"))


def asof_next_session(spark, d):
    """The first session strictly after each article's New York date."""
    a = sq.articles(spark, d).where(F.col("published_micros").isNotNull())
    a = a.select("article_id", F.to_date(F.from_utc_timestamp(F.timestamp_micros("published_micros"), ZONE)).alias("ny_day"))
    return words.next_session(a, "ny_day", table(spark, d, "session_calendar"), "session_date")


def _doc_weights(spark, d):
    docs = table(spark, d, "articles").select("article_id", _full_text().alias("t"))
    return themes.tfidf(docs, "article_id", F.col("t"))


def tfidf_weights(spark, d):
    """TF-IDF weights of words and pairs in articles."""
    return _doc_weights(spark, d).select("article_id", "term", F.round("weight", 6).alias("weight"))


def topic_words(spark, d):
    """The leading words of each topic."""
    t = themes.Topics(_doc_weights(spark, d), "article_id")
    return spark.createDataFrame(t.top_words(), "topic int, rank int, word string, weight double")


def topic_shares(spark, d):
    """Share of each topic in the events of a direction."""
    t = themes.Topics(_doc_weights(spark, d), "article_id").document_topics().select("article_id", "dominant_topic")
    p = themes.directions(sq.primary_pairs(spark, d).where(F.col("excluded") == "false")).join(t, "article_id")
    return themes.group_shares(p, "dominant_topic").select("direction", "dominant_topic", "events", F.round("mean_article_share", 6).alias("mean_article_share"), "total_article_matches")


def category_shares(spark, d):
    """Share of each category in the events of a direction."""
    p = themes.directions(sq.primary_pairs(spark, d).where(F.col("excluded") == "false"))
    return themes.group_shares(p, "event_category").select("direction", "event_category", "events", F.round("mean_article_share", 6).alias("mean_article_share"), "total_article_matches")


def request_plan(spark, d):
    """Weekly request windows of two of the configured tickers."""
    return landing.request_windows(spark, ["QVLT", "MNEX"], "2025-10-01", "2026-05-01", 7)


def all_request_plan(spark, d):
    """Weekly request windows of all configured tickers."""
    return landing.request_windows(spark, sq._TICKERS, "2025-10-01", "2026-05-01", 7)


def failure_states(spark, d):
    """State recorded for each kind of failed answer."""
    codes = spark.createDataFrame([(401, ""), (403, ""), (429, ""), (500, ""), (404, ""), (None, "timeout"), (None, None)], "http_status int, error_kind string")
    return codes.select("http_status", "error_kind", landing.failure_state(F.col("http_status"), F.col("error_kind")).alias("state"))


def orders_per_customer(spark, d):
    """The latest order of every customer, customers without one included."""
    last = latest_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return table(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


def line_shares(spark, d):
    """Share of each line status within a return flag."""
    n = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 6))


def price_fit(spark, d):
    """Correlation and line of price over quantity per flag."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag")
    return g.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"))


def customers_without_orders(spark, d):
    """Customers without an order since 1998."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def union_of_parties(spark, d):
    """Customers and suppliers in one table, missing columns as nulls."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return c.unionByName(s, allowMissingColumns=True)


def idle_days(spark, d):
    """Runs of days without an event for each user, between the first and last day of all."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    lo, hi = e.agg(F.min("day").alias("x")).scalar(), e.agg(F.max("day").alias("x")).scalar()
    spine = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(lo, hi)).alias("day"))
    gaps = spine.join(e, ["user_id", "day"], "left_anti").withColumn("run", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))))
    return gaps.groupBy("user_id", "run").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count(F.lit(1)).alias("days")).drop("run")


def exact_texts(spark, d):
    """Documents grouped by identical text."""
    g = table(spark, d, "documents").where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("digest"))
    return g.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


QUERIES = {f.__name__: f for f in (
    normalized_texts, normalized_documents, normalized_urls, term_hits, classify, entity_tags, stable_ids, merged_observations, exact_group_sizes, headline_edges,
    event_groups, word_event_groups, monthly_counts, reason_counts, status_counts, large_groups, article_contract, reconciliation, signals_absent, signal_violations, stratified_sample, sample_composition, first_headlines, evenly_spaced,
    word_freq, word_freq_daily, word_freq_local, top_words, lagged_words, word_fits, daily_mean_occurrences, asof_next_session, tfidf_weights, topic_words, topic_shares,
    category_shares, request_plan, all_request_plan, failure_states, orders_per_customer, line_shares, price_fit, customers_without_orders, union_of_parties, idle_days, exact_texts,
)}


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _has(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(' ' || {column} || ' ', ' {t} ')" for t in terms) + ")"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_TOKENS = f"list_filter(list_distinct(string_split({_norm('headline')}, ' ')), lambda w: length(w) > 1 AND NOT list_contains({_list(text.HEADLINE_STOPWORDS)}, w))"
_BOTH = "coalesce(headline, '') || ' ' || coalesce(summary, '')"
_NORMED = f"n AS (SELECT *, {_norm('headline')} AS h, {_norm(_BOTH)} AS t FROM articles)"


def _classify_sql() -> str:
    r = rules.DEFAULT
    hits = {c: " + ".join(f"CAST({_has('t', [x])} AS INT)" for x in terms) for c, terms in r.categories.items()}
    best = "CASE " + " ".join([f"WHEN greatest({', '.join(f'c_{c}' for c in hits)}) = 0 THEN ''"] + [f"WHEN c_{c} = greatest({', '.join(f'c_{x}' for x in hits)}) THEN '{c}'" for c in hits]) + " END"
    rule = "CASE " + " ".join(f"WHEN {' AND '.join(_has('t', g) for g in (x['groups'] if 'groups' in x else [x['topic'], x['connection']]))} THEN {i}" for i, x in enumerate(r.indirect)) + " ELSE -1 END"
    why = [f"CASE WHEN {_has('h', t)} THEN '{k}' END" for k, t in r.exclusions.items()]
    why += [f"CASE WHEN {_has('h', r.price_terms)} AND NOT {_has('t', r.material_terms)} THEN 'past_price_movement' END"]
    why += [f"CASE WHEN d AND NOT {_has('h', r.direct_terms)} AND NOT ({' OR '.join(_has('h', t) for t in r.categories.values())}) THEN 'summary_only_mention' END"]
    why += ["CASE WHEN NOT d AND r < 0 THEN 'insufficient_connection' END"]
    return f"""WITH {_NORMED}, c AS (SELECT *, {_has('t', r.direct_terms)} AS d, {', '.join(f'{v} AS c_{k}' for k, v in hits.items())} FROM n),
b AS (SELECT *, {best} AS cat, CASE WHEN d THEN -1 ELSE {rule} END AS r FROM c),
o AS (SELECT article_id, CASE WHEN d THEN 'direct' WHEN r >= 0 THEN 'indirect' ELSE 'not_relevant' END AS relevance,
  CASE WHEN d AND cat = '' THEN '{r.default_category}' {' '.join(f"WHEN r = {i} THEN '{x['category']}'" for i, x in enumerate(r.indirect))} ELSE cat END AS category,
  concat_ws(';', {', '.join(why)}) AS reasons FROM b)
SELECT *, reasons <> '' AS is_excluded FROM o"""


_WORDS = f"""WITH {ARTICLE_TIMES},
w AS (SELECT article_id, relevance_type, event_category, CAST(utc AS DATE) AS utc_day, CAST(timezone('{ZONE}', timezone('UTC', utc)) AS DATE) AS ny_day,
  unnest(regexp_extract_all(lower({_BOTH}), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS word FROM art WHERE utc IS NOT NULL),
byc AS (SELECT word, event_category, count(*) AS n FROM w GROUP BY 1, 2),
lead AS (SELECT word, event_category AS top_event_category FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, coalesce(event_category, '')) AS rn FROM byc) WHERE rn = 1),
freq AS (SELECT word, count(*) AS total_occurrences, count(DISTINCT article_id) AS article_count, count(*) FILTER (relevance_type = 'direct') AS direct_occurrences, count(*) FILTER (relevance_type = 'indirect') AS indirect_occurrences,
  min(utc_day) AS first_utc_date, max(utc_day) AS last_utc_date FROM w GROUP BY word),
dayc AS (SELECT utc_day, ny_day, word, event_category, row_number() OVER (PARTITION BY utc_day, ny_day, word ORDER BY count(*) DESC, coalesce(event_category, '')) AS rn FROM w GROUP BY 1, 2, 3, 4),
day0 AS (SELECT utc_day, ny_day, word, count(*) AS occurrences, count(DISTINCT article_id) AS articles, count(*) FILTER (relevance_type = 'direct') AS direct_occurrences, count(*) FILTER (relevance_type = 'indirect') AS indirect_occurrences FROM w GROUP BY 1, 2, 3),
daily AS (SELECT d.utc_day AS utc_date, d.ny_day AS local_date, d.word, occurrences, articles, direct_occurrences, indirect_occurrences, event_category AS top_event_category
  FROM day0 AS d JOIN dayc AS c ON c.utc_day = d.utc_day AND c.ny_day = d.ny_day AND c.word = d.word AND rn = 1),
locc AS (SELECT local_date, word, top_event_category, row_number() OVER (PARTITION BY local_date, word ORDER BY sum(occurrences) DESC, coalesce(top_event_category, '')) AS rn FROM daily GROUP BY 1, 2, 3),
loc0 AS (SELECT local_date, word, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(articles) AS BIGINT) AS articles, string_agg(DISTINCT CAST(utc_date AS VARCHAR), '|' ORDER BY CAST(utc_date AS VARCHAR)) AS utc_dates FROM daily GROUP BY 1, 2),
loc AS (SELECT l.*, top_event_category FROM loc0 AS l JOIN locc AS c ON c.local_date = l.local_date AND c.word = l.word AND rn = 1),
top AS (SELECT word, total_occurrences FROM freq WHERE NOT list_contains({_list(text.RANKING_STOPWORDS)}, word) AND length(word) > 1 ORDER BY total_occurrences DESC, word LIMIT 12)"""
_LAG = _WORDS + f""", {sq.FEATS},
mine AS (SELECT * FROM feats WHERE ticker = '{sq.PRIMARY}'),
spans AS (SELECT trading_date, coalesce(lag(trading_date) OVER (ORDER BY trading_date), DATE '0001-01-01') AS prev FROM mine),
lagged_w AS (SELECT loc.*, s.trading_date AS next_trading_date, m.adjusted_close_return_1d AS r, m.price_move_1pct AS f FROM loc LEFT JOIN spans AS s ON local_date >= s.prev AND local_date < s.trading_date LEFT JOIN mine AS m ON m.trading_date = s.trading_date)"""
_GRAMS = f"""WITH d AS (SELECT article_id, list_filter(regexp_extract_all(lower({_BOTH}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_list(text.RANKING_STOPWORDS)}, w)) AS w FROM articles),
g AS (SELECT article_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
c AS (SELECT article_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM articles),
t AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1),
k AS (SELECT term, df FROM t, n WHERE df >= 5 AND df <= 0.9 * n ORDER BY total DESC, term LIMIT 5000),
r AS (SELECT article_id, term, (ln(tf) + 1) * (ln((1.0 + n) / (1.0 + df)) + 1) AS raw FROM c JOIN k USING (term), n)"""

SQL = {
    "normalized_texts": f"SELECT article_id, {_norm('headline')} AS norm, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM articles",
    "normalized_documents": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
    "normalized_urls": f"""WITH a AS (SELECT obs_id, trim(coalesce(url, '')) AS u FROM raw_articles),
b AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch, regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '#.*$', '') AS rest FROM a),
c AS (SELECT *, lower(regexp_extract(rest, '^//([^/?]*)', 1)) AS host, regexp_replace(rest, '^//[^/?]*', '') AS after FROM b),
d AS (SELECT *, regexp_replace(host, ':(80|443)$', '') AS h, regexp_replace(regexp_extract(after, '^([^?]*)', 1), '/+', '/', 'g') AS p0,
  list_sort(list_filter(string_split(regexp_extract(after, '[?](.*)$', 1), '&'), lambda x: contains(x, '=') AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains({_list(urls.TRACKING_KEYS)}, lower(split_part(x, '=', 1))))) AS q FROM c),
e AS (SELECT *, CASE WHEN p0 IN ('', '/') THEN '/' ELSE rtrim(p0, '/') END AS p FROM d)
SELECT obs_id, CASE WHEN u = '' THEN '' ELSE (CASE WHEN sch = '' THEN 'https' ELSE sch END) || (CASE WHEN h = '' AND p[1] <> '/' THEN ':' ELSE '://' END) || h || p || (CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) END AS url FROM e""",
    "term_hits": f"WITH {_NORMED} SELECT article_id, concat_ws('|', {', '.join(f'CASE WHEN {_has("t", [x])} THEN {chr(39)}{x}{chr(39)} END' for x in rules.DEFAULT.direct_terms + rules.DEFAULT.categories['trade'])}) AS hits FROM n",
    "classify": _classify_sql(),
    "entity_tags": f"""WITH {_NORMED} SELECT article_id, array_to_string(list_sort(list_distinct(list_concat(
  list_filter(list_transform(string_split_regex(coalesce(provider_related, ''), '[;,]'), lambda x: upper(trim(x))), lambda x: list_contains({_list(list(rules.DEFAULT.aliases))}, x)),
  list_filter([{', '.join(f"CASE WHEN {_has('t', [a.lower() for a in names])} THEN '{t}' END" for t, names in rules.DEFAULT.aliases.items())}], lambda x: x IS NOT NULL)))), '|') AS companies FROM n""",
    "stable_ids": f"""SELECT article_id, 'item_' || substr(sha256(coalesce(headline, 'None') || chr(31) || coalesce(source, 'None') || chr(31) || article_id), 1, 16) AS id,
  coalesce(nullif(normalized_url, ''), coalesce(published_at_utc, '') || '|' || {_norm('headline')}) AS key FROM articles""",
    "headline_edges": f"""WITH {sq.ITEMS}, tk AS (SELECT article_id, utc, {_TOKENS} AS w FROM items WHERE utc IS NOT NULL),
bl AS (SELECT article_id, utc, unnest(list_filter(w, lambda x: NOT list_contains({_list(text.BLOCKING_STOPWORDS)}, x))) AS x FROM tk),
p AS (SELECT l.article_id AS a, e.article_id AS b, count(*) AS tokens FROM bl AS l JOIN bl AS e ON l.x = e.x AND (l.utc > e.utc OR (l.utc = e.utc AND l.article_id > e.article_id)) AND l.utc - e.utc <= INTERVAL 72 HOUR GROUP BY 1, 2 HAVING count(*) >= 2),
j AS (SELECT a, b, tokens, CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) AS s FROM p JOIN tk AS x ON x.article_id = a JOIN tk AS y ON y.article_id = b)
SELECT a, b, tokens, round(s, 6) AS jaccard FROM j WHERE s >= 0.78""",
    "monthly_counts": f"""WITH {ARTICLE_TIMES}, m AS (SELECT strftime(unnest(generate_series(TIMESTAMP '2025-07-01', TIMESTAMP '2026-06-30', INTERVAL 1 MONTH)), '%Y-%m') AS month)
SELECT m.month, count(article_id) AS rows, count(*) FILTER (relevance_type = 'direct') AS direct, count(*) FILTER (relevance_type = 'indirect') AS indirect, count(*) FILTER (relevance_type = 'not_relevant') AS not_relevant
FROM m LEFT JOIN art ON strftime(utc, '%Y-%m') = m.month GROUP BY m.month""",
    "status_counts": "WITH log AS (SELECT window_id, count(*) AS n FROM raw_articles GROUP BY window_id, queried_ticker), s AS (SELECT CASE WHEN n >= 3 THEN 'success_truncation_suspected' WHEN n = 2 THEN 'success' ELSE 'success_empty_unverified' END AS status FROM log) SELECT status, count(*) AS rows FROM s GROUP BY 1 UNION ALL SELECT 'success*', count(*) FROM s UNION ALL SELECT 'failed*', 0",
    "large_groups": "WITH g AS (SELECT count(*) AS n FROM articles WHERE duplicate_group_id IS NOT NULL GROUP BY duplicate_group_id HAVING count(*) > 1) SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM g",
    "article_contract": f"""WITH {ARTICLE_TIMES}, c AS (SELECT count(*) FILTER (utc IS NULL) AS published_known, count(*) FILTER (NOT coalesce(epoch_us(utc) BETWEEN 1759276800000000 AND 1777680000000000, false)) AS published_in_range,
  count(*) FILTER (NOT coalesce(published_at_utc LIKE '%Z', false)) AS zulu_suffix, count(*) FILTER (NOT coalesce(excluded IN ('true', 'false'), false)) AS excluded_is_boolean_text,
  count(*) FILTER (NOT coalesce(relevance_type IN ('direct', 'indirect', 'not_relevant'), false)) AS relevance_known,
  (SELECT count(*) FROM (SELECT article_id FROM articles GROUP BY 1 HAVING count(*) > 1)) AS article_id_repeated,
  (SELECT count(*) FROM (SELECT normalized_url FROM articles WHERE normalized_url <> '' GROUP BY 1 HAVING count(*) > 1)) AS normalized_url_repeated FROM art)
UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE violations""",
    "reconciliation": """WITH g AS (SELECT *, count(*) OVER (PARTITION BY duplicate_group_id) AS n FROM articles WHERE duplicate_group_id IS NOT NULL),
c AS (SELECT 'representatives' AS "check", count(*) FILTER (event_representative = 'true') AS left_count, count(DISTINCT duplicate_group_id) AS right_count FROM g
UNION ALL SELECT 'recorded_sizes', count(*) FILTER (n = duplicate_group_size), count(*) FROM g UNION ALL SELECT 'ids', count(DISTINCT article_id), count(*) FROM articles)
SELECT *, left_count = right_count AS equal FROM c""",
    "signals_absent": "SELECT article_id FROM articles WHERE excluded = 'false' AND relevance_type IN ('direct', 'indirect') AND (source IS NULL OR source NOT IN (SELECT source FROM feeds))",
    "signal_violations": """WITH k AS (SELECT * FROM articles WHERE excluded = 'false'),
c AS (SELECT count(*) FILTER (relevance_type IS NULL OR relevance_type NOT IN ('direct', 'indirect')) AS relevant, count(*) FILTER (event_representative IS NULL OR event_representative <> 'true') AS representative, count(*) FILTER (coalesce(headline, '') = '') AS has_headline,
  (SELECT count(*) FROM (SELECT article_id FROM k GROUP BY 1 HAVING count(*) > 1)) AS article_id_repeated,
  (SELECT count(*) FROM (SELECT exact_duplicate_group_id FROM k WHERE exact_duplicate_group_id <> '' GROUP BY 1 HAVING count(*) > 1)) AS exact_duplicate_group_id_repeated FROM k)
UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE violations""",
    "evenly_spaced": f"""WITH {ARTICLE_TIMES}, r AS (SELECT event_category, article_id, row_number() OVER (PARTITION BY event_category ORDER BY utc, article_id) - 1 AS i, count(*) OVER (PARTITION BY event_category) AS n FROM art WHERE utc IS NOT NULL)
SELECT event_category, article_id FROM r WHERE n <= 5 OR i IN (0, CAST(round_even((n - 1) / 4.0, 0) AS INT), CAST(round_even(2 * (n - 1) / 4.0, 0) AS INT), CAST(round_even(3 * (n - 1) / 4.0, 0) AS INT), n - 1)""",
    "failure_states": """SELECT * FROM (VALUES (401, '', 'unavailable_auth_or_plan'), (403, '', 'unavailable_auth_or_plan'), (429, '', 'failed_rate_limited'), (500, '', 'failed_server_error'),
  (404, '', 'failed_client_error'), (NULL, 'timeout', 'failed_timeout'), (NULL, NULL, 'failed_unknown')) AS t(http_status, error_kind, state)""",
    "stratified_sample": f"""WITH {ARTICLE_TIMES}, s AS (SELECT relevance_type AS g, article_id AS id, list_position(['trade', 'deals', 'supply', 'product', 'finance'], event_category) AS c, coalesce(strftime(utc, '%Y-%m'), 'unknown') AS m,
  row_number() OVER (ORDER BY CAST(coalesce(summary, '') <> '' AS INT) DESC, length(coalesce(summary, '')) DESC, utc DESC NULLS LAST, article_id) AS q FROM art WHERE relevance_type IN ('direct', 'indirect')),
one AS (SELECT g, id, 1 AS stage, lpad(CAST(c AS VARCHAR), 9, '0') AS at_, q FROM (SELECT *, row_number() OVER (PARTITION BY g, c ORDER BY q) AS r FROM s WHERE c > 0) WHERE r = 1),
two AS (SELECT g, id, 2 AS stage, m AS at_, q FROM (SELECT *, row_number() OVER (PARTITION BY g, m ORDER BY q) AS r FROM s WHERE id NOT IN (SELECT id FROM one)) WHERE r = 1),
three AS (SELECT g, id, 3 AS stage, '' AS at_, q FROM s WHERE id NOT IN (SELECT id FROM one) AND id NOT IN (SELECT id FROM two)),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY stage, at_, q) AS r FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three))
SELECT g AS relevance_type, id AS article_id FROM p WHERE r <= 10""",
    "sample_composition": "SELECT relevance_type, CAST(least(10, count(*)) AS BIGINT) AS rows, count(*) >= 10 AS complete FROM articles WHERE relevance_type IN ('direct', 'indirect') GROUP BY 1",
    "first_headlines": f"""WITH {ARTICLE_TIMES}, f AS (SELECT event_category, article_id, utc, row_number() OVER (PARTITION BY event_category ORDER BY utc, article_id) AS rn FROM art WHERE utc IS NOT NULL AND event_category IS NOT NULL)
SELECT event_category, article_id FROM f WHERE rn = 1 ORDER BY utc, article_id LIMIT 5""",
    "word_freq": _WORDS + " SELECT freq.*, top_event_category FROM freq JOIN lead USING (word)",
    "word_freq_daily": _WORDS + f""", {sq.FEATS}, cnt AS (SELECT CAST(utc AS DATE) AS utc_date, CAST(timezone('{ZONE}', timezone('UTC', utc)) AS DATE) AS local_date, count(*) AS articles_that_day FROM art WHERE utc IS NOT NULL GROUP BY 1, 2)
SELECT daily.*, articles_that_day, m.price_move_1pct AS same_date_move_1pct, m.price_move_5pct AS same_date_move_5pct FROM daily JOIN cnt USING (utc_date, local_date) LEFT JOIN (SELECT * FROM feats WHERE ticker = '{sq.PRIMARY}') AS m ON m.trading_date = utc_date""",
    "word_freq_local": _WORDS + " SELECT * FROM loc",
    "top_words": _WORDS + " SELECT * FROM top",
    "lagged_words": _LAG + " SELECT local_date, word, occurrences, articles, next_trading_date, round(r, 6) + 0.0 AS next_return, f AS next_day_price_move_1pct FROM lagged_w",
    "word_fits": _LAG + """, x AS (SELECT word, CAST(occurrences AS DOUBLE) AS x, r AS y FROM lagged_w WHERE word IN (SELECT word FROM top) AND r IS NOT NULL)
SELECT word, count(*) AS days, CASE WHEN min(x) < max(x) THEN round(corr(x, y), 6) + 0.0 END AS correlation, CASE WHEN min(x) < max(x) THEN round(regr_slope(y, x), 6) + 0.0 END AS slope,
  CASE WHEN min(x) < max(x) THEN round(regr_intercept(y, x), 6) + 0.0 END AS intercept FROM x GROUP BY word""",
    "daily_mean_occurrences": _WORDS + " SELECT local_date, round(avg(occurrences), 6) AS mean_value FROM loc GROUP BY 1",
    "asof_next_session": f"""WITH {ARTICLE_TIMES}, a AS (SELECT article_id, CAST(timezone('{ZONE}', timezone('UTC', utc)) AS DATE) AS ny_day FROM art WHERE utc IS NOT NULL)
SELECT article_id, ny_day, (SELECT min(session_date) FROM session_calendar WHERE session_date > ny_day) AS next_session FROM a""",
    "tfidf_weights": _GRAMS + " SELECT article_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY article_id)), 6) AS weight FROM r",
    "category_shares": sq.PRIMARY_PAIRS + """, q AS (SELECT p.event_date, CASE WHEN shift_1pct_up = 1 THEN 'up' WHEN shift_1pct_down = 1 THEN 'down' END AS direction, a.event_category FROM placed AS p JOIN articles AS a USING (article_id) WHERE a.excluded = 'false'),
s AS (SELECT event_date, direction, event_category, count(*) AS n FROM q WHERE direction IS NOT NULL GROUP BY 1, 2, 3),
h AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY event_date) AS share FROM s)
SELECT direction, event_category, count(DISTINCT event_date) AS events, round(avg(share), 6) AS mean_article_share, CAST(sum(n) AS BIGINT) AS total_article_matches FROM h GROUP BY 1, 2""",
    "request_plan": "SELECT t.ticker, CAST(s AS DATE) AS from_date, least(CAST(s AS DATE) + 6, DATE '2026-05-01') AS to_date FROM (SELECT unnest(['QVLT', 'MNEX']) AS ticker) AS t, (SELECT unnest(generate_series(TIMESTAMP '2025-10-01', TIMESTAMP '2026-05-01', INTERVAL 7 DAY)) AS s) AS x",
    "orders_per_customer": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN o ON o_custkey = c_custkey AND rn = 1""",
    "line_shares": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2",
    "price_fit": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY 1",
    "customers_without_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01')",
    "union_of_parties": "SELECT c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier",
    "idle_days": """WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), s AS (SELECT user_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT user_id FROM e), (SELECT unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM e)),
g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS run FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.day = s.day))
SELECT user_id, min(day) AS from_day, max(day) AS to_day, count(*) AS days FROM g GROUP BY user_id, run""",
    "exact_texts": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "reason_counts": general._PACKED_SQL + " SELECT item AS reason, count(*) AS rows FROM placed WHERE field_name = 'exclusion_reason' GROUP BY item",
    "exact_group_sizes": "WITH l0 AS (SELECT obs_id, coalesce(CAST(article_id AS VARCHAR), 'o' || obs_id) AS a, coalesce(nullif(url, ''), 'o' || obs_id) AS u, obs_id AS l FROM raw_articles), "
    + ", ".join(f"a{i} AS (SELECT obs_id, a, u, min(l) OVER (PARTITION BY a) AS l FROM l{i}), l{i + 1} AS (SELECT obs_id, a, u, min(l) OVER (PARTITION BY u) AS l FROM a{i})" for i in range(4))
    + ", g AS (SELECT l, count(*) AS n FROM l4 GROUP BY l) SELECT n, count(*) AS groups FROM g GROUP BY n",
}
SQL["word_event_groups"] = SQL["headline_edges"].replace(f"WITH {sq.ITEMS}", f"WITH RECURSIVE {sq.ITEMS}").replace("SELECT a, b, tokens, round(s, 6) AS jaccard FROM j WHERE s >= 0.78", """, e AS (SELECT a AS x, b AS y FROM j WHERE s >= 0.78 UNION ALL SELECT b, a FROM j WHERE s >= 0.78),
reach AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y), comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
g AS (SELECT art.*, coalesce(c, article_id) AS grp FROM art LEFT JOIN comp ON x = article_id),
r AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, first_value(article_id) OVER (PARTITION BY grp ORDER BY coalesce(excluded, 'false'), CASE WHEN relevance_type = 'not_relevant' THEN 1 ELSE 0 END, utc NULLS LAST, length(coalesce(summary, '')) DESC, CAST(article_id AS VARCHAR), article_id) AS rep FROM g)
SELECT article_id, 'event_' || substr(sha256(CAST(grp AS VARCHAR)), 1, 16) AS event_group_id, n AS event_group_size, rep AS representative_id, rep = article_id AS is_representative,
  CASE WHEN rep <> article_id AND coalesce(excluded, 'false') <> 'true' THEN 'duplicate_event_coverage' END AS added_exclusion FROM r""")
_FILLED = " + ".join(f"CAST(coalesce(CAST({c} AS VARCHAR), '') <> '' AS INT)" for c in ("window_id", "queried_ticker", "article_id", "category", '"datetime"', "headline", "summary", "source", "related", "url", "image", "retrieved_at_utc", "normalized_url"))
SQL["merged_observations"] = f"""WITH nu AS (SELECT obs_id, url AS normalized_url FROM ({SQL['normalized_urls']})), r AS (SELECT * FROM raw_articles JOIN nu USING (obs_id)),
l0 AS (SELECT obs_id, coalesce(CAST(article_id AS VARCHAR), 'o' || obs_id) AS a, coalesce(nullif(normalized_url, ''), 'o' || obs_id) AS u, obs_id AS l FROM r), """
SQL["merged_observations"] += ", ".join(f"a{i} AS (SELECT obs_id, a, u, min(l) OVER (PARTITION BY a) AS l FROM l{i}), l{i + 1} AS (SELECT obs_id, a, u, min(l) OVER (PARTITION BY u) AS l FROM a{i})" for i in range(4))
SQL["merged_observations"] += f""", j AS (SELECT r.*, l, row_number() OVER (PARTITION BY l ORDER BY {_FILLED} DESC, length(coalesce(summary, '')) DESC, length(coalesce(headline, '')) DESC, obs_id) AS rn FROM r JOIN l4 USING (obs_id)),
tags AS (SELECT l, string_agg(DISTINCT tag, '|' ORDER BY tag) AS related_tags FROM (SELECT l, trim(unnest(string_split_regex(related, '[;,]'))) AS tag FROM j) WHERE tag <> '' GROUP BY l),
g AS (SELECT l, min(CAST(article_id AS VARCHAR)) AS article_key, coalesce(string_agg(DISTINCT nullif(queried_ticker, ''), '|' ORDER BY nullif(queried_ticker, '')), '') AS queried_tickers, epoch_us(min(retrieved_at_utc)) AS retrieved_at_utc, count(*) AS raw_observation_count,
  min(nullif(normalized_url, '')) AS urls FROM j GROUP BY l)
SELECT article_key, queried_tickers, headline, summary, source, url, normalized_url, "datetime", category, image, g.retrieved_at_utc, raw_observation_count, coalesce(related_tags, '') AS related_tags, 'exact_' || substr(sha256(coalesce(article_key, 'None') || chr(31) || coalesce(urls, 'None')), 1, 16) AS exact_duplicate_group_id
FROM g JOIN j ON j.l = g.l AND rn = 1 LEFT JOIN tags ON tags.l = g.l"""
SQL["all_request_plan"] = SQL["request_plan"].replace("['QVLT', 'MNEX']", "[" + ", ".join(f"'{t}'" for t in sq._TICKERS) + "]")
