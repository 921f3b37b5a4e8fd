"""Scalar functions, landed files, sinks, topics and streams."""

import datetime as dt
import difflib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.functions import ids, text, urls
from barlight.functions.similarity import sequence_ratio
from barlight.operators import themes
from barlight.sources import landing, sinks, tables
from barlight.streaming import feeds

URLS = {
    "HTTPS://Example.COM/a/story/?utm_source=x&b=2&a=1#section": "https://example.com/a/story?a=1&b=2",
    "http://example.com:80//a//b/": "http://example.com/a/b", "https://example.com:8443": "https://example.com:8443/", "": "", None: "",
    "https://e.com/p?ref=1&q=a%20b&fbclid=9&empty=": "https://e.com/p?empty=&q=a+b", "//e.com/x": "https://e.com/x", "/x//y/": "https:///x/y", "n/a": "https:n/a", " https://e.com/~a?x=~*": "https://e.com/~a?x=~%2A",
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", urls.normalize_url(F.col("u")).alias("n"))
    assert {r.u: r.n for r in df.collect()} == URLS


def test_texts(spark):
    df = spark.createDataFrame([("The GPU-maker's https://x.y/z?q=1 Sell-off!  in 5 d",), (None,), ("",)], "t string")
    rows = df.select(text.normalize_text(F.col("t")).alias("n"), text.headline_tokens(F.col("t")).alias("h"), text.word_tokens(F.col("t")).alias("w"), text.matched_terms(text.normalize_text(F.col("t")), ["sell-off", "maker", "gpu maker s", "make", "", "off sell"]).alias("m")).collect()
    assert rows[0].n == "the gpu maker s sell off in 5 d" and rows[0].h == ["gpu", "maker", "sell", "off"]
    assert "maker's" in rows[0].w and rows[0].m == ["sell-off", "maker", "gpu maker s"]
    assert rows[1].n == "" and rows[1].h == [] and rows[2].w == []
    pair = spark.createDataFrame([([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1 / 3)]
    one = spark.createDataFrame([("<a href='x'>&\"", "javascript:alert(1)", " a;b , ;c,", "1e3", "x")], "h string, u string, t string, n string, bad string")
    got = one.select(text.escape_html(F.col("h")), text.safe_link(F.col("u")), text.split_tags(F.col("t")), text.to_number(F.col("n")), text.to_number(F.col("bad"))).first()
    assert list(got) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", None, ["a", "b", "c"], 1000.0, None]


def test_ids(spark):
    import hashlib

    row = spark.createDataFrame([("a", None, 5)], "x string, y string, z int").select(ids.stable_id("p", [F.col("x"), F.col("y"), F.col("z")]).alias("i"), ids.first_filled(F.lit(""), F.col("y"), F.col("x")).alias("f")).first()
    assert row.i == "p_" + hashlib.sha256("a\x1fNone\x1f5".encode()).hexdigest()[:16] and row.f == "a"


def test_sequence_ratio(spark):
    pairs = [("abcd efg", "abcd xfg"), ("", ""), (None, "a"), ("same", "same")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(sequence_ratio("a", "b")).collect()]
    assert got == pytest.approx([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs])


def test_ratio_bound_loses_nothing():
    import random

    import pandas as pd

    from barlight.functions.similarity import bounded_ratio

    rng = random.Random(1)
    a = ["".join(rng.choices("abcdé 漢", k=rng.randint(0, 30))) for _ in range(300)]
    b = [x[: len(x) // 2] + rng.choice(["", "z", "q"]) + x[len(x) // 2 :] if i % 2 else rng.choice(a) for i, x in enumerate(a)]
    got = bounded_ratio(pd.Series(a), pd.Series(b), 0.86)
    for x, y, g in zip(a, b, got):
        want = difflib.SequenceMatcher(None, x, y).ratio()
        assert g == pytest.approx(want) if want >= 0.86 else not g >= 0.86
    assert len(bounded_ratio(pd.Series([], dtype=object), pd.Series([], dtype=object), 0.5)) == 0


def test_request_log_and_envelopes(spark, tmp_path):
    log = [{"record_type": "request_window", "window_id": "w1", "status": "failed_x", "article_count": 0}, {"record_type": "note"}, {"record_type": "request_window", "window_id": "w1", "status": "success", "article_count": 2}, {"record_type": "request_window", "window_id": "w2", "status": "success"}]
    (tmp_path / "log.jsonl").write_text("\n\n".join(json.dumps(x) for x in log) + "\n")
    rows = landing.latest_requests(landing.read_jsonl(spark, str(tmp_path / "log.jsonl"), landing.MANIFEST))
    assert {r.window_id: r.status for r in rows.collect()} == {"w1": "success", "w2": "success"}
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        landing.read_jsonl(spark, str(tmp_path / "bad.jsonl"), landing.MANIFEST).collect()
    folder = tmp_path / "raw" / "A"
    folder.mkdir(parents=True)
    art = lambda i, t: {"category": "c", "datetime": t, "headline": f"h{i}", "id": i, "image": "", "related": "A", "source": "s", "summary": "x", "url": "u"}
    env = {"schema_version": 1, "request": {"endpoint": "e", "symbol": "A", "from": "2025-10-01", "to": "2025-10-07"}, "retrieved_at_utc": "t", "http_status": 200, "response_headers": {"a": "b"}, "collection_status": "success", "terminal_window": True, "response": [art(1, 1759320000), art(2, None), art(3, 1700000000)]}
    (folder / "one.json").write_text(json.dumps(env, indent=1))
    (folder / "two.json").write_text(json.dumps(env | {"terminal_window": False}))
    got = landing.envelope_articles(landing.read_envelopes(spark, str(tmp_path / "raw")), "2025-10-01", "2025-10-31").orderBy("position").collect()
    assert [(r.id, r.position, r.queried_ticker) for r in got] == [(1, 0, "A"), (2, 1, "A")]
    assert landing.files_under(spark, str(tmp_path / "raw")).count() == 2


def test_windows_and_configuration(spark):
    w = landing.request_windows(spark, ["A", "B"], "2025-10-01", "2026-05-01", 7)
    assert w.count() == 62 and w.where("ticker = 'A'").agg(F.max("to_date")).first()[0] == dt.date(2026, 5, 1)
    d = dt.date
    assert landing.split_window(d(2025, 1, 1), d(2025, 1, 7)) == [(d(2025, 1, 1), d(2025, 1, 4)), (d(2025, 1, 5), d(2025, 1, 7))]
    assert landing.split_window(d(2025, 1, 1), d(2025, 1, 1)) == [(d(2025, 1, 1), d(2025, 1, 1))]
    done = w.where("ticker = 'A'").withColumns({"status": F.lit("success"), "article_count": F.when(F.col("from_date") == F.lit(d(2025, 10, 1)), 240).otherwise(3)})
    p = landing.pending_windows(w, done)
    assert p.where("split").count() == 1 and p.where("not split").count() == 31
    good = {"start_date": "2025-01-01", "end_date": "2025-02-01", "tickers": ["A"]}
    assert landing.check_config(good) == good
    for bad in ({"tickers": ["A", "A"]}, {"end_date": "2024-01-01"}, {"window_days": 0}, {"delay_seconds": 0.5}):
        with pytest.raises(ValueError):
            landing.check_config(good | bad)


def test_patient_fetching():
    waits, answers = [], iter([(500, None, None), (429, None, 90.0), (200, ["x"], None)])
    assert landing.fetch_patiently(lambda: next(answers), sleep=waits.append) == (200, ["x"])
    assert waits == [1.1, 2.0, 1.1, 60.0, 1.1]
    assert landing.fetch_patiently(lambda: (403, None, None), sleep=waits.append) == (403, None)
    assert [landing.probe_state(*a) for a in ((3, 200), (0, 200), (None, 500))] == ["confirmed_nonempty", "empty_unverified", "probe_failed"]


def answer(ticker, first, last):
    return 200, [{"headline": f"{ticker} {first}"}], None


def test_windowed_source(spark):
    spark.dataSource.register(landing.WindowedApi)
    windows = json.dumps([["A", "2025-01-01", "2025-01-07"], ["B", "2025-01-01", "2025-01-07"]])
    df = spark.read.format("windowed_api").options(fetch="json:loads", windows="[]").load()
    assert df.count() == 0
    assert len(list(landing._WindowReader({"windows": windows, "fetch": f"{__name__}:answer", "pause": "0", "lanes": "2"}).partitions())) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, ["a", "b"], "x<\n|y", "http://e.com"), (2, False, [], None, "javascript:x")], "id int, up boolean, l array<string>, t string, u string")
    sinks.write_table(df, str(tmp_path / "csv"), ["t", "id", "up", "l", "absent"])
    back = landing.read_text_table(spark, str(tmp_path / "csv"), ["t", "id", "up", "l", "absent"]).orderBy("id").collect()
    assert list(back[0]) == ["x<\n|y", "1", "true", "a|b", None]
    sinks.write_views(df.withColumns({"one": F.lit(1), "two": (F.col("id") == 2).cast("int")}), str(tmp_path / "v"), {"all": "one", "some": "two"})
    assert spark.read.parquet(str(tmp_path / "v/all")).count() == 2 and spark.read.parquet(str(tmp_path / "v/some")).count() == 1
    for _ in range(2):
        sinks.append_log(df.select("id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    page = sinks.html_report(df, ["t", "u"], "T", link="u")
    assert "x&lt;" in page and 'href="http://e.com"' in page and 'href="javascript' not in page
    assert "\\|y" in sinks.markdown_report(df, ["t", "id"], "T")
    sinks.write_json(str(tmp_path / "m/x.json"), {"b": 1, "a": dt.date(2025, 1, 1)})
    assert json.loads((tmp_path / "m/x.json").read_text()) == {"a": "2025-01-01", "b": 1}
    before = sinks.source_digests(spark, str(tmp_path / "m"))
    saved = spark.createDataFrame(before.collect(), before.schema)
    assert sinks.changed_sources(saved, before).count() == 0
    (tmp_path / "m/x.json").write_text("{}")
    assert sinks.changed_sources(saved, sinks.source_digests(spark, str(tmp_path / "m"))).count() == 1
    p = sinks.provenance(spark, {"t": df.select("id"), "u": df.select("id").orderBy(F.desc("id"))}, [str(tmp_path / "m/x.json")]).collect()
    assert p[0].rows == 2 and p[0].checksum == p[1].checksum and len(p[2].checksum) == 64
    sinks.failure_document(str(tmp_path / "f.json"), "fetch", ValueError("no"))
    assert json.loads((tmp_path / "f.json").read_text())["error_kind"] == "ValueError"
    assert sinks.chart_points(df, "id", "t", "u").count() == 1


def test_topics(spark):
    rng = np.random.default_rng(0)
    groups = [["reactor", "grid", "turbine", "power"], ["memory", "wafer", "chiplet", "bonder"]]
    rows = [(i, " ".join(rng.choice(groups[i % 2], 12))) for i in range(60)] + [(99, None), (98, "the and of")]
    w = themes.tfidf(spark.createDataFrame(rows, "id bigint, t string"), "id", F.col("t"), min_df=3, max_df=0.9)
    norms = [r.n for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()]
    assert norms == pytest.approx([1.0] * 60)
    t = themes.Topics(w, "id", topics=2, rounds=12)
    assert t.errors[-1] < t.errors[0] and (t.h >= 0).all()
    got = {r.id: r.dominant_topic for r in t.document_topics().collect()}
    assert len({got[i] for i in range(0, 60, 2)}) == 1 and len({got[i] for i in range(1, 60, 2)}) == 1 and got[0] != got[1]
    assert [r[1] for r in t.top_words(3)] == [1, 2, 3, 1, 2, 3]
    assert themes.Topics(w.limit(0), "id").top_words() == []


def test_topic_queries_run_until_the_fit_stands(spark, tiny, monkeypatch):
    from barlight.plans import text_queries as tq

    fits, topics = [], themes.Topics
    monkeypatch.setattr(tq.themes, "Topics", lambda *a, **k: fits.append(topics(*a, **k)) or fits[-1])
    got = {(r.topic, r.word) for r in tq.topic_words(spark, tiny).collect()}
    e = np.array(fits[0].errors)
    assert len(e) == 500 or (np.abs(np.diff(e[-11:])) < 1e-8 * e[-11:-1]).all()
    longer = topics(tq._doc_weights(spark, tiny), "article_id", rounds=len(e) + 100, tolerance=0)
    assert len(longer.errors) == len(e) + 100
    assert len({(t, w) for t, _, w, _ in longer.top_words()} & got) >= 0.95 * len(got)


def _stream(spark, path, df):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(stream, spark, name, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=20 * i), "a" if i % 2 else "b", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, kind string, value double")
    totals = _run(feeds.windowed_totals(_stream(spark, str(tmp_path / "s"), df), "ts", "kind", "value"), spark, "totals", tmp_path, "complete")
    assert {(r.window_start.hour, r.kind): r.total for r in totals.collect() if r.window_start.hour == 0} == {(0, "b"): 2.0, (0, "a"): 1.0}
    runs = _run(feeds.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s")), "ts", "kind", "1 hour"), spark, "runs", tmp_path, "complete")
    assert sorted((r.kind, r.events) for r in runs.collect()) == [("a", 6), ("b", 6)]
    log = spark.createDataFrame([("w1", 1, "failed"), ("w1", 5, "success"), ("w2", 2, "success")], "window_id string, line_no bigint, status string")
    latest = _run(feeds.latest_state(_stream(spark, str(tmp_path / "l"), log), "window_id", "line_no", "status"), spark, "latest", tmp_path, "update")
    assert {r.window_id: r.status for r in latest.collect()} == {"w1": "success", "w2": "success"}
    twice = _run(feeds.distinct_items(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s")), "kind", "ts", "10 days"), spark, "twice", tmp_path, "append")
    assert twice.count() == 2
    items = df.select(F.col("kind"), F.col("ts").alias("item_ts"), "id")
    left = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s")).select("kind", "ts")
    pairs = _run(feeds.preceding_matches(left, _stream(spark, str(tmp_path / "i"), items), "kind", "ts", "item_ts", 1), spark, "pairs", tmp_path, "append")
    assert pairs.count() == 10


def test_request_log_of_several_appends(spark, tmp_path):
    """The order of appends counts, not the size or the part a line lies in."""
    schema = "record_type string, window_id string, status string, attempt int"
    path = str(tmp_path / "log")
    for attempt, count in ((1, 3), (2, 3000), (3, 2)):
        rows = spark.createDataFrame([("request_window", f"w{i}", f"s{attempt}", attempt) for i in range(count)], schema)
        sinks.append_log(rows.repartitionByRange(3, "window_id"), path)
    got = {r.window_id: r.attempt for r in landing.latest_requests(landing.read_jsonl(spark, path, landing.MANIFEST)).collect()}
    assert len(got) == 3000 and got["w0"] == got["w1"] == 3 and got["w2"] == got["w2999"] == 2


def test_lines_of_one_file_in_many_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "log.jsonl").write_text("".join(f'{{"record_type": "request_window", "window_id": "w{i % 7}", "attempt": {i}}}\n' for i in range(5000)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = {r.window_id: r.attempt for r in landing.latest_requests(landing.read_jsonl(spark, str(tmp_path / "log.jsonl"), landing.MANIFEST)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"w{i % 7}": i for i in range(4993, 5000)}


def test_envelopes_that_are_not_final_are_left_out(spark):
    article = ("c", 1767225600, "h", 1, "", "A", "s", "x", "u")
    rows = [(1, ("news", "A", None, None), "", 200, None, status, final, [article]) for status, final in (("success", True), ("success", False), ("failed_x", True))]
    env = spark.createDataFrame(rows, landing.ENVELOPE).withColumn("raw_file", F.lit(""))
    assert landing.envelope_articles(env).count() == 1
    assert landing.envelope_articles(env, "2026-01-01", "2026-01-01").count() == 1 and landing.envelope_articles(env, "2026-01-02", "2026-01-03").count() == 0


def test_bars_are_refused(spark):
    ok = spark.sql("SELECT 'A' AS ticker, timestamp'2026-01-01 00:00:00' AS loaded_at")
    assert tables.checked_bars(ok, ["ticker"]).count() == 1
    for df, columns, why in ((ok, ["volume"], "volume"), (ok.where("false"), ["ticker"], "no bars"), (spark.sql("SELECT 'A' AS ticker, timestamp_ntz'2026-01-01 00:00:00' AS loaded_at"), ["ticker"], "zone")):
        with pytest.raises(ValueError, match=why):
            tables.checked_bars(df, columns)


def test_lanes_share_one_pace():
    reader = landing._WindowReader({"windows": json.dumps([["A", str(i), str(i)] for i in range(7)]), "fetch": "x:y", "pause": "1", "lanes": "3"})
    parts = [p.value for p in reader.partitions()]
    assert [len(p) for p in parts] == [3, 2, 2] and reader.pause == 3.0
    assert landing._WindowReader({"windows": "[]", "fetch": "x:y"}).partitions() == []
    assert landing.probe_windows(dt.date(2025, 10, 1), dt.date(2026, 5, 1)) == [(dt.date(2025, 10, 1), dt.date(2025, 10, 2)), (dt.date(2026, 4, 30), dt.date(2026, 5, 1))]


def test_general_queries_without_optional_libraries(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("barlight.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    names = entry.queries()
    assert "p1_found" in names and "p9_found" not in names
