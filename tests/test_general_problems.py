"""Trailing totals, timestamps and packed fields against brute force and edge cases."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from barlight.functions.temporal import iso_micros, with_parts, with_utc
from barlight.operators.packed import resolve, split_packed
from barlight.operators.timestamps import normalised_times
from barlight.operators.trailing import mean, trailing_totals
from barlight.sources.tables import current_bars

DAY = dt.date(2026, 1, 1)


def test_trailing_totals_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(t, DAY + dt.timedelta(days=d), rng.choice([None, rng.randint(0, 10**6)]), rng.choice([None, float("nan"), round(rng.uniform(1, 500), 4)])) for t in ("A", "B") for d in range(120) if rng.random() < 0.6]
    rows += [(None, DAY, 5, 5.0), ("C", None, 5, 5.0), ("D", DAY, None, None), ("A", rows[0][1], 7, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, day date, volume bigint, price double").withColumns({"_e": F.lit(1), "_at": F.lit("x")})
    got = {(r.ticker, r.day): r for r in trailing_totals(df, "ticker", "day", {"volume": 0, "price": 6}, (7, 30)).withColumn("avg7", mean("price", 7)).collect()}
    want = 0
    for t in ("A", "B", "D"):
        mine = [r for r in rows if r[0] == t]
        lo, hi = min(r[1] for r in mine), max(r[1] for r in mine)
        for k in range((hi - lo).days + 1):
            d = lo + dt.timedelta(days=k)
            want += 1
            for w in (7, 30):
                inside = [r for r in mine if d - dt.timedelta(days=w - 1) <= r[1] <= d]
                volumes = [r[2] for r in inside if r[2] is not None]
                prices = [r[3] for r in inside if r[3] is not None and r[3] == r[3]]
                g = got[(t, d)]
                assert g[f"volume_total_{w}"] == (sum(volumes) if volumes else None)
                assert g[f"volume_count_{w}"] == len(volumes) and g[f"price_count_{w}"] == len(prices)
                assert (g[f"price_total_{w}"] is None) == (not prices)
                if prices:
                    assert float(g[f"price_total_{w}"]) == pytest.approx(sum(prices), abs=1e-6)
    assert len(got) == want


def test_trailing_totals_leave_nothing_behind(spark):
    rows = [("A", DAY, 1, 0.1), ("A", DAY + dt.timedelta(days=1), 1, 1e12), ("A", DAY + dt.timedelta(days=60), 3, 0.3)]
    df = spark.createDataFrame(rows, "ticker string, day date, volume bigint, price double")
    last = trailing_totals(df, "ticker", "day", {"price": 6}, (7,)).where(F.col("day") == F.lit(DAY + dt.timedelta(days=60))).first()
    assert float(last.price_total_7) == 0.3


def test_trailing_totals_of_nothing(spark):
    df = spark.createDataFrame([], "ticker string, day date, volume bigint")
    assert trailing_totals(df, "ticker", "day", {"volume": 0}, (7, 30)).count() == 0


def test_current_bar_is_the_latest_loaded(spark):
    t = dt.datetime(2026, 1, 2)
    rows = [(1, "A", DAY, t, 5), (2, "A", DAY, t, None), (3, "A", DAY, None, 9), (4, "B", DAY, None, 1), (5, None, DAY, t, 1)]
    df = spark.createDataFrame(rows, "bar_id bigint, ticker string, trading_date date, loaded_at timestamp, volume bigint")
    got = {r.ticker: (r.bar_id, r.volume) for r in current_bars(df, ["bar_id", "volume"]).collect()}
    assert got == {"A": (2, None), "B": (4, 1)}


FORMS = {
    "2025-10-20T07:04:50Z": "2025-10-20T07:04:50.000000Z", " 2025-10-20 07:04:50 +0530\t": "2025-10-20T01:34:50.000000Z",
    "1766565928422": "2025-12-24T08:45:28.422000Z", "1759343124231122": "2025-10-01T18:25:24.231122Z", "2025-10-15T13:50:14.821096999Z": "2025-10-15T13:50:14.821096Z",
    "Sun, 21 Dec 2025 14:09:18 +1100": "2025-12-21T03:09:18.000000Z", "Mon, 21 Dec 2025 14:09:18 +1100": None, "Oct 16, 2025 8:34 AM EDT": "2025-10-16T12:34:00.000000Z",
    "12/31/2025 12:30 AM": "2025-12-31T05:30:00.000000Z", "31/12/2025 12:30": None, "2025-11-31 07:15:00+00:00": None, "25:61": None, "": None, None: None, "2025-10-20": None,
    "2025-10-20T24:00:00Z": None, "2025-10-20T10:60:00Z": None, "2025-10-20 10:00 QQT": None, "2025-11-02T01:30:00": None, "2026-03-08T02:30:00": None, "2026-03-08T03:30:00": "2026-03-08T07:30:00.000000Z",
    "x" * 50_000: None, "20251102T114117Z": "2025-11-02T11:41:17.000000Z",
}


def test_instants_of_many_forms(spark):
    rows = [(i, "wire", v) for i, v in enumerate(FORMS)] + [(100, None, "2025-10-20 10:00:00"), (101, "other", "2025-10-20 10:00:00Z"), (101, "other", "2025-10-20 10:00:00Z")]
    raw = spark.createDataFrame(rows, "obs_id bigint, source string, datetime string").withColumn("trust_rank", F.lit("clash"))
    feeds = spark.createDataFrame([("wire", "America/New_York", False, 1), ("bad", "Nowhere/Land", True, 2)], "source string, feed_zone string, day_first boolean, trust_rank int")
    art = spark.createDataFrame([(1, "2025-10-20 10:00:00", None), (2, None, "wire")], "article_id bigint, published_at_utc string, source string")
    bar = spark.createDataFrame([(1, "wire", "03/04/26"), (2, None, "13/04/2026"), (3, None, "03/04/2026"), (4, "wire", "1759291200"), (5, "wire", "2025-11-14T00:00:00Z"), (6, "wire", "2025-11"), (7, "wire", "3-Oct-2025"), (8, "bad", "05/05/2026")], "feed_row_id bigint, source string, trading_date string")
    got = normalised_times(raw, art, bar, feeds).collect()
    mine = {(r.src_table, r.rec_id): r.norm for r in got}
    for i, (v, want) in enumerate(FORMS.items()):
        assert mine.get(("raw_articles", i)) == want, v
    assert ("raw_articles", 100) not in mine and sum(r.rec_id == 101 for r in got) == 2
    assert mine[("articles", 1)] == "2025-10-20T10:00:00.000000Z" and ("articles", 2) not in mine
    assert [mine.get(("bar_feed", i)) for i in range(1, 9)] == ["2026-03-04", "2026-04-13", None, "2025-10-01", "2025-11-13", None, "2025-10-03", "2026-05-05"]
    empty = normalised_times(raw.limit(0), art.limit(0), bar.limit(0), feeds.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata"])
def test_local_times_against_zoneinfo(spark, zone):
    base = dt.datetime(2025, 10, 1)
    rng = random.Random(zone)
    local = [base + dt.timedelta(minutes=30 * k) for k in rng.sample(range(48 * 300), 1500)]
    z, utc = ZoneInfo(zone), dt.timezone.utc
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    df = spark.createDataFrame([(micros(t),) for t in local], "local bigint")
    got = {r.local: r.utc for r in with_utc(df, "local", F.lit(zone), "utc").collect()}
    for t in local:
        found = {u for f in (0, 1) for u in [t.replace(tzinfo=z, fold=f).astimezone(utc)] if u.astimezone(z).replace(tzinfo=None) == t}
        assert got[micros(t)] == (micros(found.pop().replace(tzinfo=None)) if len(found) == 1 else None)


def test_policies_for_odd_local_times(spark):
    m = lambda *a: int((dt.datetime(*a) - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    df = spark.createDataFrame([(m(2025, 11, 2, 1, 30),), (m(2026, 3, 8, 2, 30),)], "local bigint")
    show = lambda **kw: [r[0] for r in with_utc(df, "local", F.lit("America/New_York"), "utc", **kw).select(iso_micros(F.col("utc"))).collect()]
    assert show(ambiguous="earlier", nonexistent="shift") == ["2025-11-02T05:30:00.000000Z", "2026-03-08T07:30:00.000000Z"]
    assert show(ambiguous="later") == ["2025-11-02T06:30:00.000000Z", None]
    with pytest.raises(ValueError):
        with_utc(df, "local", F.lit("UTC"), "utc", ambiguous="guess")


def test_parts_keep_other_columns(spark):
    df = spark.createDataFrame([("2025-10-20", "kept")], "text string, other string")
    row = with_parts(df, "text", F.lit(None).cast("boolean"), "t").first()
    assert row.other == "kept" and row.t_instant is None and row.t_has_time is False


CASES = {
    "A|B": ["A", "B"], "A | B": ["A", "B"], '["A", "B, C"]': ["A", "B, C"], '"B, Inc."; C/D': ["B, Inc.", "C", "D"], '"x ""E"" y"|z': ['x "E" y', "z"],
    '["x \\"E\\" y","z"]': ['x "E" y', "z"], "'B, Ltd.'；C": ["B, Ltd.", "C"], "D'Or, O'Dell Labs": ["D'Or", "O'Dell Labs"], "A||B": ["A", "B"], "|A| |B|": ["A", "B"], "  A\tB\n": ["A", "B"],
    "": [], "  ": [], '""|A': ["A"], '"unclosed, B': ['"unclosed', "B"], "[]": [], "[A]": ["A"], "A + B": ["A", "B"], '"A"': ["A"], "' \"E\" '|B": ['"E"', "B"], '"a/b"x/c': ['"a', 'b"x', "c"], None: [],
}


def test_packed_fields(spark):
    rows = [(i, v, "z") for i, v in enumerate(CASES)] + [(0, "A|B", "z"), (900, "q," * 20_000, None)]
    df = spark.createDataFrame(rows, "id bigint, packed string, _text string").withColumn("_key", F.lit("clash"))
    got = {}
    for r in split_packed(df, "id", ["packed"]).collect():
        got.setdefault(r.id, []).append((r.item_pos, r.item))
    for i, (v, want) in enumerate(CASES.items()):
        expect = [(k + 1, x) for k, x in enumerate(want)]
        assert sorted(got.get(i, [])) == sorted(expect * (2 if i == 0 else 1)), v
    assert len(got[900]) == 20_000
    assert split_packed(df.limit(0), "id", ["packed"]).count() == 0


def test_resolving_a_skeleton_is_linear():
    assert len(resolve("'a," * 20_000)) == 20_000
