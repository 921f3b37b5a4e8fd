"""Series features, calendar, lookback matching, coverage and grouping on small fixtures."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from barlight.operators import coverage, grouping, matching, reports, rules, series, sessions, words
from barlight.operators.components import connected_components
from barlight.plans import series_queries

UTC = dt.timezone.utc
HOLIDAY = dt.date(2025, 9, 1)


def _sessions():
    day, out = dt.date(2025, 8, 1), []
    while day <= dt.date(2025, 10, 8):
        if day.weekday() < 5 and day != HOLIDAY:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


BAR = "bar_id bigint, ticker string, trading_date date, open_price double, high_price double, low_price double, close_price double, adjusted_close double, volume bigint, dividends double, stock_splits double"


def _bars(spark, change=None):
    rows = []
    for i, d in enumerate(_sessions()):
        c = 100.0 + i
        rows.append([i, "T", d, c - 1, c + 2, c - 2, c, 0.9 * c, 1000 + i, 0.0, 0.0])
    return spark.createDataFrame(change(rows) if change else rows, BAR)


def test_features_and_lags(spark):
    got = series.with_features(_bars(spark)).orderBy("trading_date").collect()
    a = [0.9 * (100.0 + i) for i in range(len(got))]
    r = [None] + [a[i] / a[i - 1] - 1 for i in range(1, len(a))]
    for i, row in enumerate(got):
        assert row.daily_return_volatility_20d == (pytest.approx(statistics.stdev(r[i - 19 : i + 1])) if i >= 20 else None)
        assert row.average_volume_20d == (pytest.approx(statistics.mean(1000 + k for k in range(i - 19, i + 1))) if i >= 19 else None)
        if i:
            for f in series.FEATURES:
                assert row[f"{f}_lag1_session"] == got[i - 1][f]
        c = 100.0 + i
        assert row.adjusted_open_to_close_return == pytest.approx(c / (c - 1) - 1)


@pytest.mark.parametrize(("share", "prices"), [(0.05, [100, 105, 100, 95, 100, 104.99, 100, 94.99, None]), (0.01, [100, 101, 100, 99, 100, 100.99, 100, 98.99, None])])
def test_movement_flags(spark, share, prices):
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, None if p is None else float(p)) for i, p in enumerate(prices)], "i int, p double")
    w = Window.orderBy("i")
    got = [x[0] for x in df.select(series.move_flag(F.col("p"), F.lag("p").over(w), share).alias("f"), "i").orderBy("i").select("f").collect()]
    fifth = 1 if share == 0.01 else 1
    assert got == [None, 1, 0, -1, fifth, 0, 0, -1, None]
    nan = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert nan.select(series.move_flag(F.col("a"), F.col("b"), share)).first()[0] is None


def test_bar_validation_names_the_rules(spark):
    def spoil(rows):
        del rows[6]
        rows[1][4] = 1.0
        rows[2][8] = None
        return rows

    bad = _bars(spark, spoil)
    got = {r.rule: r.violations for r in series.bar_violations(bad).collect()}
    assert got["high_below_others"] == 1 and got["volume_missing"] == 1 and got["low_above_others"] == 1 and got["date_repeated"] == 0
    calendar = spark.createDataFrame([(d,) for d in _sessions()], "session_date date")
    gaps = [(r.trading_date, r.problem) for r in series.session_gaps(bad, calendar).collect()]
    assert gaps == [(_sessions()[6], "missing")] and HOLIDAY not in [g[0] for g in gaps]


CLOSES = {dt.date(2025, 11, 25): 21, dt.date(2025, 11, 26): 21, dt.date(2025, 11, 28): 18, dt.date(2025, 12, 1): 21, dt.date(2025, 12, 2): 21}


def _calendar(spark):
    rows = [(d, dt.datetime(d.year, d.month, d.day, h, tzinfo=UTC)) for d, h in CLOSES.items()]
    return spark.createDataFrame(rows, "session_date date, market_close_utc timestamp")


def test_cutoff_is_the_close_before(spark):
    got = {r.session_date: r.cutoff for r in sessions.previous_sessions(_calendar(spark)).select("session_date", F.date_format("cutoff_utc", "yyyy-MM-dd HH").alias("cutoff")).collect()}
    assert got[dt.date(2025, 11, 28)] == "2025-11-26 21" and got[dt.date(2025, 12, 1)] == "2025-11-28 18" and got[dt.date(2025, 11, 25)] is None


@pytest.mark.parametrize(("cutoff", "hours"), [("2026-03-09 20:00:00", 167), ("2025-11-03 21:00:00", 169), ("2026-01-15 21:00:00", 168)])
def test_seven_calendar_days_cross_clock_changes(spark, cutoff, hours):
    row = spark.sql(f"SELECT timestamp'{cutoff}' AS c").select(((F.unix_micros("c") - F.unix_micros(sessions.lookback_start(F.col("c"), 7))) / 3.6e9).alias("h")).first()
    assert row.h == hours


def test_window_edges(spark):
    cutoff = dt.datetime(2026, 1, 15, 21, tzinfo=UTC)
    events = spark.createDataFrame([("e", cutoff)], "event string, cutoff_utc timestamp").withColumn("lookback_start_utc", sessions.lookback_start(F.col("cutoff_utc"), 7))
    back = {"at": 0, "after": -1, "24": 24 * 3600, "24+": 24 * 3600 + 3.6, "72": 72 * 3600, "72+": 72 * 3600 + 3.6, "168": 168 * 3600, "168+": 168 * 3600 + 1, "none": None}
    base = int(cutoff.timestamp() * 1e6)
    items = spark.createDataFrame([(k, None if v is None else base - int(v * 1e6)) for k, v in back.items()], "item string, at bigint")
    got = {r.item: (r.in_24h, r.in_72h, r.in_7d, r.lookback_bucket) for r in matching.lookback_match(events, items, "at").collect()}
    assert got == {"24": (1, 1, 1, "0-24h"), "24+": (0, 1, 1, "24-72h"), "72": (0, 1, 1, "24-72h"), "72+": (0, 0, 1, "72h-7d"), "168": (0, 0, 1, "72h-7d")}
    plan = matching.lookback_match(events, items, "at")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_summary_keeps_events_without_items(spark):
    at = lambda *a: dt.datetime(*a, tzinfo=UTC)
    events = spark.createDataFrame([(d, at(2025, 10, d - 1, 20), at(2025, 10, d - 1, 20) - dt.timedelta(days=7)) for d in (7, 8, 20)], "event int, cutoff_utc timestamp, lookback_start_utc timestamp")
    items = spark.createDataFrame([("x", int(at(2025, 10, 6, 12).timestamp() * 1e6))], "article_id string, at bigint")
    pairs = matching.lookback_match(events, items, "at")
    got = {r.event: (r.article_count_24h, r.article_count_7d) for r in matching.event_summary(events, pairs, ["event"]).collect()}
    assert got == {7: (1, 1), 8: (0, 1), 20: (0, 0)}
    bad = {r.rule: r.violations for r in matching.pair_violations(pairs, matching.event_summary(events, pairs, ["event"]), ["event"], "article_id", "at").collect()}
    assert set(bad.values()) == {0} and len(bad) == 4
    assert matching.never_linked(items.withColumn("article_id", F.lit("y")), pairs, "article_id").count() == 1


def test_copies_revisions_and_gates(spark):
    rows = [("1", "direct", "h", "s", "u"), ("2", "direct", "h", "s", "u"), ("3", "indirect", "other", None, ""), ("4", "not_relevant", "h", "s", "u")]
    a = spark.createDataFrame(rows, "article_id string, relevance_type string, headline string, summary string, url string").withColumn("source", F.lit("w"))
    got = {r.article_id: (r.status, r.missing_summary, r.missing_url) for r in matching.prepared_items(a, F.lit(None).cast("string")).collect()}
    assert got == {"1": ("kept", 0, 0), "2": ("exact_duplicate", 0, 0), "3": ("kept", 1, 1), "4": ("not_relevant", 0, 0)}
    p = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS cutoff_utc, '' AS first_available_at_utc, cast(null as bigint) AS first_available_at_utc_micros, 'x' AS revised_at_utc, cast(null as bigint) AS revised_at_utc_micros")
    assert p.select(matching.revision_gate(["first_available_at_utc", "revised_at_utc"], "cutoff_utc")).first()[0] == "ambiguous_revised_at_utc"
    late = p.withColumns({"first_available_at_utc": F.lit("y"), "first_available_at_utc_micros": F.unix_micros("cutoff_utc")})
    assert late.select(matching.revision_gate(["first_available_at_utc", "revised_at_utc"], "cutoff_utc")).first()[0] == "not_available_before_cutoff"


def test_coverage_states_and_periods(spark):
    d = lambda n: dt.date(2025, 10, n)
    rows = [("A", d(1), d(1), "success", "f1"), ("A", d(2), d(2), "success_empty_unverified", "f2"), ("A", d(1), d(7), "split_potential_truncation", None), ("A", d(4), d(5), "success", "gone"), ("A", d(5), d(5), "failed_x", None)]
    windows = spark.createDataFrame(rows, "ticker string, from_date date, to_date date, status string, raw_file string")
    days = coverage.coverage_days(windows, ["A"], "2025-10-01", "2025-10-07", spark.createDataFrame([("f1",), ("f2",)], "raw_file string"), lead_days=1)
    state = {r.day.day: r.coverage_state for r in days.collect() if r.day.month == 10}
    assert state == {1: "success", 2: "success_empty_unverified", 3: "no_terminal_request", 4: "missing_raw_response_file", 5: "failed_x|missing_raw_response_file", 6: "no_terminal_request", 7: "no_terminal_request"}
    periods = [(r.state, r.from_day.day, r.days) for r in coverage.coverage_periods(days).where("from_day >= '2025-10-01'").orderBy("from_day").collect()]
    assert periods == [("success_empty_unverified", 2, 1), ("no_terminal_request", 3, 1), ("missing_raw_response_file", 4, 1), ("failed_x|missing_raw_response_file", 5, 1), ("no_terminal_request", 6, 2)]


def test_components_follow_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (500, 500), (None, 3), (200, 300), (300, 250)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    want = {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 500: 500, 200: 200, 250: 200, 300: 200} | {1000 + i: 1000 for i in range(50)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_merging_by_id_or_address(spark):
    rows = [(1, "9", "A", "h", "s", "w", "u1", "n1", "t", "c", "i", "X;Y", 2), (2, "9", "B", "h longer", "s", "w", "u2", "n2", "t", "c", "i", "X, Z", 1), (3, "8", "A", "h", None, "w", "u2", "n2", "t", "c", "i", "", 3), (4, "7", "A", "h", "s", "w", "", "", "t", "c", "i", "", 4), (5, "6", "A", "h", "s", "w", "", "", "t", "c", "i", "", 5)]
    df = spark.createDataFrame(rows, "obs_id bigint, article_id string, queried_ticker string, headline string, summary string, source string, url string, normalized_url string, datetime string, category string, image string, related string, retrieved_at_utc bigint")
    got = {r.article_key: r for r in grouping.merged_observations(df).collect()}
    assert set(got) == {"8", "7", "6"}
    one = got["8"]
    assert (one.queried_tickers, one.related_tags, one.raw_observation_count, one.retrieved_at_utc, one.headline) == ("A|B", "X|Y|Z", 3, 1, "h longer")


def test_event_groups_pick_one_representative(spark):
    hour = 3_600_000_000
    rows = [(1, "direct", "Maker opens large reactor plant in north", "short", "u1", 10 * hour), (2, "indirect", "Maker opens large reactor plant in the north", "much longer summary", "u2", 11 * hour), (3, "direct", "Maker opens large reactor plant in north", "late", "u3", 100 * hour), (4, "not_relevant", "Maker opens large reactor plant in north", "x", "u4", 10 * hour), (5, "direct", "Bank sues rival over loan", "x", "u5", None)]
    df = spark.createDataFrame(rows, "article_id bigint, relevance_type string, headline string, summary string, normalized_url string, at bigint").withColumns({"excluded": F.lit("false"), "published_at_utc": F.col("at").cast("string")})
    got = {r.article_id: r for r in grouping.event_groups(df, "article_id", "at").collect()}
    assert got[1].event_group_id == got[2].event_group_id and got[1].event_group_size == 2
    assert [got[i].is_representative for i in (1, 2, 3, 4, 5)] == [True, False, True, True, True]
    assert got[2].added_exclusion == "duplicate_event_coverage" and got[2].representative_id == 1 and got[1].added_exclusion is None


def _brute_edges(rows, sequence, token, span):
    import difflib
    import re

    from barlight.functions.text import BLOCKING_STOPWORDS, HEADLINE_STOPWORDS

    norm = [re.sub("[^a-z0-9]+", " ", h.lower()).strip() for _, _, h in rows]
    tokens = [{w for w in n.split(" ") if len(w) > 1} - set(HEADLINE_STOPWORDS) for n in norm]
    out = {}
    for i, (a, t, _) in enumerate(rows):
        for j, (b, u, _) in enumerate(rows):
            shared = len((tokens[i] & tokens[j]) - set(BLOCKING_STOPWORDS))
            if i == j or shared < 2 or not ((0 < t - u <= span) or (t == u and a > b)):
                continue
            alike = len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j])
            ratio = None if alike >= token else difflib.SequenceMatcher(None, norm[i], norm[j]).ratio()
            if ratio is None or ratio >= sequence:
                out[a, b] = (shared, alike, ratio)
    return out


@pytest.mark.parametrize("block", [1 << 15, 9])
def test_similar_edges_match_brute_force(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(grouping, "BLOCK", block, raising=False)
    rng, hour = random.Random(2), 3_600_000_000
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(60)] + ["shares", "news", "the", "at"]
    base = [rng.choices(words, k=rng.randint(2, 13)) for _ in range(40)] + [["filler", "word", *rng.choices(words, k=24), "x" * 60]]
    rows = []
    for i in range(240):
        h = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(h))
            h[k] = rng.choice([rng.choice(words), h[k][:-1] + "q", h[k].upper() + "!"])
        rows.append((f"k{i}", rng.choice([-1, 0, 1, 3, 71, 72, 73, 144, 145, 500]) * hour + rng.choice([0, 0, 1]), " ".join(h)))
    rows[0] = ("k0", rows[0][1], "é \u2014 1 2")
    df = spark.createDataFrame([*rows, ("none", 0, None), ("late", None, rows[1][2])], "id string, at bigint, headline string")
    got = grouping.similar_edges(df, "id", "at").collect()
    want = _brute_edges(rows, 0.86, 0.78, 72 * hour)
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == set(want)
    assert all((r.tokens, r.jaccard, r.ratio) == want[r.a, r.b] for r in got)
    assert any(r.ratio is None for r in got) and any(r.ratio is not None for r in got)


def test_candidate_pairs_of_headlines_are_not_written(spark, monkeypatch):
    """Headlines of one pattern with the same letters: each pair is a candidate, none is similar."""
    import random

    rng, rows = random.Random(8), []
    for i in range(200):
        letters = list("abcdefghijklmnopqrstuvwxyz" * 2)
        rng.shuffle(letters)
        rows.append((i, "direct", "router deal " + "".join(letters), "", f"u{i}", i))
    df = spark.createDataFrame(rows, "article_id bigint, relevance_type string, headline string, summary string, normalized_url string, at bigint").withColumns({"excluded": F.lit("false"), "published_at_utc": F.col("at").cast("string")})
    sizes, plain = [], grouping.written

    def written(table, label="step"):
        out = plain(table, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(grouping, "written", written)
    assert grouping.event_groups(df, "article_id", "at").where("event_group_size = 1").count() == 200
    assert max(sizes) == 200


@pytest.mark.parametrize("sequence", [0.86, 1.01])
@pytest.mark.parametrize("block", [1 << 15, 9])
def test_linked_edges_give_the_groups_of_all_pairs(spark, monkeypatch, block, sequence):
    import random

    monkeypatch.setattr(grouping, "BLOCK", block)
    rng, hour = random.Random(5), 3_600_000_000
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(70)]
    base = [rng.choices(words, k=rng.randint(3, 12)) for _ in range(30)]
    rows = []
    for i in range(260):
        h = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(h))
            h[k] = rng.choice([rng.choice(words), h[k][:-1] + "q"])
        rows.append((f"k{i}", rng.choice([-73, -72, -1, 0, 3, 71, 72, 143, 144, 145, 217, 500]) * hour + rng.choice([0, 0, 1]), " ".join(h)))
    want = {f"k{i}": f"k{i}" for i in range(260)}
    for a, b in _brute_edges(rows, sequence, 0.78, 72 * hour):
        old, new = want[a], want[b]
        want = {k: new if v == old else v for k, v in want.items()}
    df = spark.createDataFrame(rows, "id string, at bigint, headline string")
    edges = grouping.similar_edges(df, "id", "at", sequence=sequence, linked=True)
    got = {f"k{i}": f"k{i}" for i in range(260)} | {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    alike = lambda of: {frozenset(k for k in of if of[k] == v) for v in of.values()}
    assert alike(got) == alike(want) and len(alike(want)) < 200


def test_pairs_of_a_repeated_headline_are_not_written(spark, monkeypatch):
    """Each row is similar to all others: 400 rows have 79,800 pairs but need 399 links."""
    from barlight.operators import components

    rows = [(i, "direct", "router deal doubles licences again" + " twice" * (i % 2), "", f"u{i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "article_id bigint, relevance_type string, headline string, summary string, normalized_url string, at bigint").withColumns({"excluded": F.lit("false"), "published_at_utc": F.col("at").cast("string")})
    sizes, plain = [], components.written

    def written(table, label="step"):
        out = plain(table, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "written", written)
    got = grouping.event_groups(df, "article_id", "at", sequence=1.01)
    assert got.where("event_group_size = 400 and representative_id = 0").count() == 400
    assert max(sizes) < 400


def test_rules(spark):
    r = rules.DEFAULT
    rows = [
        (1, "Quavolt unveils new accelerator and chiplet", "", ""), (2, "Embargo hits accelerator makers", "", "MNEX, zzz"), (3, "Jobs in the sector", "", None), (4, "Quavolt quarterly results", "", ""),
        (5, "Sector diary", "also names Quavolt once", ""), (6, "Shares of Quavolt moved", "", ""), (7, "Shares of Quavolt moved on embargo", "", ""), (8, None, None, None), (9, "quavolts", "Monexa Memory", ""),
    ]
    df = spark.createDataFrame(rows, "article_id bigint, headline string, summary string, provider_related string")
    got = {x.article_id: x for x in rules.classified(df, r).collect()}
    assert (got[1].relevance, got[1].category, got[1].is_excluded) == ("direct", "product", False)
    assert (got[2].relevance, got[2].category, list(got[2].companies)) == ("indirect", "trade", ["MNEX"])
    assert (got[3].relevance, got[3].exclusion_reasons) == ("not_relevant", ["insufficient_connection"])
    assert got[4].exclusion_reasons == ["results_season"] and got[4].category == r.default_category
    assert got[5].exclusion_reasons == ["summary_only_mention"]
    assert got[6].exclusion_reasons == ["past_price_movement"] and got[7].exclusion_reasons == []
    assert got[8].relevance == "not_relevant" and got[9].relevance == "not_relevant" and got[9].companies == ["MNEX"]


def test_monthly_spine_and_samples(spark):
    rows = [(i, dt.date(2025, 10 + i % 2, 5), "a" if i % 3 else "b", "x", i) for i in range(30)] + [(99, dt.date(2024, 1, 1), "a", "x", 0)]
    df = spark.createDataFrame(rows, "id bigint, day date, category string, stratum string, q int")
    m = {r.month: (r.rows, r.b) for r in reports.monthly_counts(df, "day", {"b": F.col("category") == "b"}, "2025-09-15", "2025-12-02").collect()}
    assert m == {"2025-09": (0, 0), "2025-10": (15, 5), "2025-11": (15, 5), "2025-12": (0, 0)}
    s = reports.stratified_sample(df.withColumn("month", reports.month_key(F.col("day"))), "stratum", "category", ["b", "a"], "month", [F.col("q")], "id", 6)
    assert {r.id for r in s.collect()} == {27, 29, 99, 28, 26, 25}  # best of b and a; of each month (2024, 2025-10, 2025-11); best left
    e = reports.evenly_spaced(df.where("id < 30"), ["stratum"], ["id"], 4)
    assert sorted(r.id for r in e.collect()) == [0, 10, 19, 29]


def test_next_session_and_word_fits(spark):
    days = spark.createDataFrame([(dt.date(2025, 11, 26),), (dt.date(2025, 11, 27),), (dt.date(2025, 11, 24),), (dt.date(2025, 12, 2),)], "d date")
    got = {r.d.day: r.next_session for r in words.next_session(days, "d", _calendar(spark), "session_date").collect()}
    assert got == {26: dt.date(2025, 11, 28), 27: dt.date(2025, 11, 28), 24: dt.date(2025, 11, 25), 2: None}
    lagged = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("a", 3, 0.3), ("b", 5, 0.1), ("b", 5, 0.2), ("c", 1, None)], "word string, occurrences bigint, r double")
    fits = {x.word: x for x in words.word_fits(lagged, lagged.select("word").distinct(), "r").collect()}
    assert fits["a"].correlation == pytest.approx(1) and fits["a"].slope == pytest.approx(0.1) and fits["b"].slope is None and "c" not in fits


def test_queries_over_all_tickers_read_the_growing_table(spark, tiny):
    from barlight.plans.catalogue import QUERIES
    from barlight.sources.tables import table

    wide = {r.ticker for r in table(spark, tiny, "daily_bars").where("ticker is not null and trading_date is not null").select("ticker").distinct().collect()}
    core = {r.ticker for r in table(spark, tiny, "core_bars").where("ticker is not null and trading_date is not null").select("ticker").distinct().collect()}
    assert wide and not wide & core
    for name, column in (("all_daily_bars", "ticker"), ("all_move_features", "ticker"), ("all_chart_points", "series")):
        assert {r[0] for r in QUERIES[name](spark, tiny).select(column).distinct().collect()} == wide | core, name
    flagged = {r.ticker for r in QUERIES["all_flagged_events"](spark, tiny).select("ticker").distinct().collect()}
    assert flagged & wide


def test_request_plan_of_all_configured_tickers(spark, tiny):
    from barlight.plans.catalogue import QUERIES
    from barlight.plans.series_queries import _TICKERS

    got = {r["ticker"]: r["count"] for r in QUERIES["all_request_plan"](spark, tiny).groupBy("ticker").count().collect()}
    assert got == dict.fromkeys(_TICKERS, 31)


def test_next_session_long_before_the_first(spark):
    sessions = spark.sql("SELECT explode(array(date'2026-03-02', date'2026-03-04', null)) AS s")
    days = spark.sql("SELECT explode(array(date'2025-08-14', date'2026-03-01', date'2026-03-02', date'2026-03-03', date'2026-03-04', null)) AS d")
    got = {r.d: r.next_session for r in words.next_session(days, "d", sessions, "s").collect()}
    a, b = dt.date(2026, 3, 2), dt.date(2026, 3, 4)
    assert got == {dt.date(2025, 8, 14): a, dt.date(2026, 3, 1): a, a: b, dt.date(2026, 3, 3): b, b: None, None: None}


def test_relevance_reaches_the_scan(spark, tiny):
    plan = series_queries.lookback_match(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "In(relevance_type, [direct,indirect])" in plan
