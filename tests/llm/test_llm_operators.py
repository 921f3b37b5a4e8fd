"""The training-data operators against brute force, and their edge cases."""

import datetime as dt
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlight.llm import neardups
from barlight.llm.leakage import leaked_items, similarity
from barlight.llm.lookalikes import lookalike_members, lookalike_pairs, shown_text
from barlight.llm.neardups import SimilarSets, VantageForest
from barlight.llm.nearest import HOUR, article_bars, nearest_in_time
from barlight.llm.survivors import best_records, surviving_members, surviving_records
from barlight.llm.terms import term_counts
from barlight.llm.tokens import VOCABULARY, StreamingDecoder, Transducer, decoded, encoded, read_ranks

TERM = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)?")
ARTICLE = "article_id bigint, headline string, summary string"


# --- near duplicates -------------------------------------------------------------------------

def _edited(rng, words, share):
    out = [w for w in words if rng.random() > share / 2] + [f"new{rng.randint(0, 999)}" for _ in range(int(len(words) * share / 2))]
    rng.shuffle(out)
    return out


def _pairs(rows):
    sets = {i: frozenset(TERM.findall(((h or "") + " " + (s or "")).lower())) for i, h, s in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a]) >= 20 and len(sets[b]) >= 20 and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-12}


def _corpus(rng, n, common_only=False):
    words = [f"w{i}" for i in range(60 if common_only else 3000)]
    rows = []
    for i in range(n):
        base = rng.sample(words, 25) if i % 3 == 0 or not rows else _edited(rng, TERM.findall(rng.choice(rows)[2] or "w1"), rng.uniform(0, 0.7))
        rows.append((i, None if i % 7 else "Head line", " ".join(base)))
    return rows


def test_similar_sets_match_brute_force(spark):
    rng = random.Random(3)
    rows = _corpus(rng, 300)
    rows += [(1000 + i, "same", " ".join(f"c{k}" for k in range(30))) for i in range(40)]  # exact copies
    again = [(5, None, rows[5][2]), (1001, "same", " ".join(f"c{k}" for k in range(30)))]  # repeated rows
    rows += [(2000, None, None), (2001, "", ""), (2002, "short text", None), (2003, "long", " ".join(f"q{k}" for k in range(20_000)))]
    df = spark.createDataFrame(rows + again, ARTICLE).withColumns({"key": F.lit(1), "terms": F.lit("x"), "a": F.lit(2)})
    sets = SimilarSets(df, "article_id", ["headline", "summary"])
    want = _pairs(rows)
    got = [(r.a, r.b) for r in sets.pairs().collect()]
    assert set(got) == want and len(got) == len(want)
    assert sets.links.where(F.col("a") >= 1000).count() == 0  # copies are members, not links
    group = {r.key: r.group_id for r in sets.groups().collect()}
    parent = {i: i for i in group}
    for _ in range(20):
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert group == parent


def test_similar_sets_of_common_terms_only(spark):
    """Pairs that share no rare term meet in the shards of common ones."""
    rows = _corpus(random.Random(4), 250, common_only=True)
    df = spark.createDataFrame(rows, ARTICLE)
    assert {(r.a, r.b) for r in SimilarSets(df, "article_id", ["headline", "summary"]).pairs().collect()} == _pairs(rows)


def test_shards_in_passes(spark, monkeypatch):
    """Shards, sets and links come in several passes, and none is lost."""
    monkeypatch.setattr(neardups, "PASS", 8000, raising=False)
    labels, plain = [], neardups.written
    monkeypatch.setattr(neardups, "written", lambda table, label: (labels.append(label), plain(table, label))[1])
    rng = random.Random(7)
    words = [f"b{i}" for i in range(40)]
    rows = [(i, None, " ".join(rng.sample(words, rng.randint(34, 40)) + [f"only{i}"])) for i in range(150)]
    got = [(r.a, r.b) for r in SimilarSets(spark.createDataFrame(rows, ARTICLE), "article_id", ["headline", "summary"]).pairs().collect()]
    want = _pairs(rows)
    assert set(got) == want and len(got) == len(want) and len(want) > 1000
    assert labels.count("found") > 1 and labels.count("sets") > 1


@pytest.mark.parametrize("terms", [1, 2, 4])
def test_shards_too_large(spark, monkeypatch, terms):
    """Records of one boilerplate: shards of further shared terms take over, and blocks where none is left."""
    monkeypatch.setattr(neardups, "SHARD", 70)
    monkeypatch.setattr(neardups, "TERMS", terms)
    rng = random.Random(6)
    words = [f"b{i}" for i in range(40)]
    rows = [(i, None, " ".join(rng.sample(words, rng.randint(30, 40)) + [f"only{i}"])) for i in range(220)]
    df = spark.createDataFrame(rows, ARTICLE)
    got = [(r.a, r.b) for r in SimilarSets(df, "article_id", ["headline", "summary"]).pairs().collect()]
    want = _pairs(rows)
    assert len(want) > 5000 and set(got) == want and len(got) == len(want)


def test_pairs_come_from_the_trees(monkeypatch):
    """All pairs of different sets come out of the trees, which do not compare all of a shard's pairs."""
    rng, words = random.Random(9), [f"w{i}" for i in range(3000)]
    base = [sorted({words[int(600 * rng.random() ** 2)] for _ in range(rng.randint(30, 100))}) for _ in range(1000)]
    texts = [" ".join(w) for w in base] + [" ".join(_edited(rng, w, 0.2)) for w in base[:200]]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    sets = pa.Table.from_batches(list(neardups._sets(iter([batch]), 20))).select(["key", "terms"]).to_batches()
    often = np.bincount((np.concatenate([x[1] for x in neardups._parts(iter(sets))]) >> np.uint64(64 - neardups.COUNTERS)).astype(np.int64), minlength=1 << neardups.COUNTERS)
    order, state = (8 * np.log2(np.maximum(often, 1))).astype(np.uint8), np.ones(1 << neardups.COUNTERS, np.uint8)
    rows = pa.Table.from_batches([b for x in neardups._parts(iter(sets)) for b in neardups.Shards(0.6, order, [state]).rows(*x)]).sort_by("shard").to_batches()
    compared, within, plain = [], [], VantageForest.pairs

    def pairs(self):
        out = plain(self)
        compared.append(self.compared)
        within.append((self.length * (self.length - 1) // 2).sum())
        return out

    monkeypatch.setattr(VantageForest, "pairs", pairs)
    got = {(r["a"], r["b"]) for b in neardups._Search(0.6, 8192)(iter(rows)) for r in b.to_pylist()}
    want = _pairs([(i, None, t) for i, t in enumerate(texts)])
    assert len(want) >= 150 and want <= got and sum(compared) < sum(within)
    monkeypatch.setattr(VantageForest, "pairs", lambda self: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not list(neardups._Search(0.6, 8192)(iter(rows)))


def test_shards_bring_similar_sets_together():
    """Two similar sets share a shard, at every number of shared terms, where the bound lets them through."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 90, np.uint64) * np.uint64(2)
    sets = [rng.choice(words, rng.integers(20, 70), replace=False) for _ in range(120)]
    n = np.array([len(s) for s in sets])
    order = np.zeros(1 << neardups.COUNTERS, np.uint8)
    order[(words >> np.uint64(64 - neardups.COUNTERS)).astype(np.int64)] = rng.integers(0, 30, 90)
    both = [(a, b) for a in range(120) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))]
    assert len(both) > 50
    full = np.full(1 << neardups.COUNTERS, 2, np.uint8)
    for depth in (1, 2, 3):
        shards = neardups.Shards(0.6, order, [full] * (depth - 1) + [np.ones_like(full)])
        rows = pa.Table.from_batches(list(shards.rows(np.arange(120), np.concatenate(sets), n)))
        body = np.frombuffer(b"".join(rows["body"].to_pylist()), neardups._BODY)
        held = {}
        for s, r in zip(rows["shard"].to_pylist(), body):
            held.setdefault(int(r["key"]), {})[s] = r
        for a, b in both:
            ok = [s for s in held[a].keys() & held[b].keys() if np.bitwise_count(held[a][s]["bits"] ^ held[b][s]["bits"]).sum() <= 0.25 * (n[a] + n[b]) - held[a][s]["front"] - held[b][s]["front"] + 1e-9]
            assert ok


def test_similar_sets_of_nothing(spark):
    s = SimilarSets(spark.createDataFrame([], ARTICLE), "article_id", ["headline", "summary"])
    assert s.pairs().count() == 0 and s.groups().count() == 0


def _prints(rng, n, families):
    base = rng.integers(0, 2, (families, neardups.BITS)).astype(np.uint8)
    x = base[rng.integers(0, families, n)].copy()
    for row in x:
        row[rng.integers(0, neardups.BITS, rng.integers(0, 9))] ^= 1
    return np.packbits(x, axis=1).view(np.uint64)


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_vantage_forest_is_exact_and_prunes(least):
    rng = np.random.default_rng(1)
    length = np.array([1500, 2, 3, 1, 400, 17, 16, 90])
    m = length.sum()
    prints, front = _prints(rng, m, 60), rng.integers(0, 9, m)
    n = front + np.bitwise_count(prints).sum(axis=1).astype(np.int64) + 2 * rng.integers(0, 3, m)
    forest = VantageForest(length, prints, n, front, least)
    a, b = forest.pairs()
    got = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    want, at, most = set(), 0, 0
    for k in length:
        p, s, x = prints[at : at + k], ((1 - least) / (1 + least) * n - front)[at : at + k], n[at : at + k]
        d = np.bitwise_count(p[:, None] ^ p[None]).sum(-1)
        # fingerprints no set could have are not told apart by size, so these pairs are left out here
        ok = (d <= s[:, None] + s[None] + 1e-9) & (np.minimum(x[:, None], x[None]) >= least * np.maximum(x[:, None], x[None]) - 1e-9)
        i, j = np.nonzero(np.triu(ok, 1))
        want |= {(u + at, v + at) for u, v in zip(i.tolist(), j.tolist()) if abs((n - front)[u + at] - (n - front)[v + at]) <= (s[u] + s[v])}
        at += k
        most += k * (k - 1) // 2
    assert len(got) == len(a) and want <= got
    assert all(np.bitwise_count(prints[u] ^ prints[v]).sum() <= ((1 - least) / (1 + least) * (n[u] + n[v])) - front[u] - front[v] + 1e-2 for u, v in got)
    assert forest.compared <= most and (least < 0.8 or forest.compared < most)  # a radius this wide prunes nothing here
    empty = np.zeros(0, np.int64)
    assert len(VantageForest(empty, np.zeros((0, 2), np.uint64), empty, empty, 0.6).pairs()[0]) == 0


def test_large_shards_are_handed_on():
    rng = np.random.default_rng(2)

    def batches():
        n = 100 + 60_000 + 1900
        body = np.zeros(n, neardups._BODY)
        body["key"], body["n"], body["bits"] = np.arange(n), 60, _prints(rng, n, 30)
        shard = np.concatenate([np.full(100, 2), np.full(60_000, 5), np.full(1900, 9)])
        for at in range(0, n, 1000):
            yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 1000]), neardups._packed(body[at : at + 1000])], names=["shard", "body"])

    out = pa.Table.from_batches(list(neardups._Search(0.6, 3000)(batches()))).to_pandas()
    assert set(out[out.kind == 1].a) == set(range(100, 60_100))
    pairs = out[out.kind == 0]
    assert len(pairs) and not set(pairs.a) & set(range(100, 60_100)) and set(pairs.a) & set(range(100))


# --- term counts ------------------------------------------------------------------------------

def test_term_counts(spark):
    rows = [(1, "It's the deal", "the DEAL"), (1, "It's the deal", "the DEAL"), (2, None, None), (3, "", "x" * 100_000), (4, "deal ’s", "don't 'quoted' 5")]
    df = spark.createDataFrame(rows, ARTICLE).withColumns({"term": F.lit("clash"), "text": F.lit("clash"), "n": F.lit(0)})
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_counts(df, ["headline", "summary"], rare_below=2, common_above=0.5).collect()}
    occ, rec = Counter(), Counter()
    for _, h, s in rows:
        t = TERM.findall(((h or "") + " " + (s or "")).lower())
        occ.update(t)
        rec.update(set(t))
    assert got == {t: (occ[t], rec[t], "rare" if rec[t] < 2 else "common" if rec[t] > 2.5 else "kept") for t in occ}
    assert term_counts(df.limit(0), ["headline"]).count() == 0


def test_term_counters_may_be_handed_on_early(spark, monkeypatch):
    from barlight.llm import terms

    monkeypatch.setattr(terms, "HELD", 3)
    batches = [pa.record_batch([pa.array(["a b c d e a", "a a f", "b"])], names=["text"])]
    total = Counter()
    for b in terms._count(iter(batches)):
        for t, o, r in zip(*(c.to_pylist() for c in b.columns)):
            total[t] += o * 100 + r
    assert total == {"a": 402, "b": 202, "c": 101, "d": 101, "e": 101, "f": 101}


# --- survivors --------------------------------------------------------------------------------

SURVIVOR = "article_id bigint, duplicate_group_id string, source string, published_at_utc string, headline string, summary string, url string, image_url string"


def test_survivors(spark):
    rows = [
        (1, "g", "low", "2026-01-01T00:00:00Z", "one", None, "n/a", " "), (2, "g", "top", "2026-01-01T00:00:00Z", "N/A", "two", "--", ""),
        (3, "g", "top", "2026-01-02T00:00:00Z", "three", "None", "null", " "), (4, "g", "top", None, "four", "four", "-", None), (5, "g", None, "2027-01-01T00:00:00Z", "five", "", "http://x", None),
        (6, "alone", "top", None, "h", "s", "u", "i"), (7, None, "top", None, "h", "s", "u", "i"), (8, None, "top", None, "h", "s", "u", "i"),
        (9, "tie", "top", "bad", "a", None, None, None), (10, "tie", "top", "bad", "b", None, None, None), (9, "tie", "top", "bad", "a", None, None, None),
    ]
    df = spark.createDataFrame(rows, SURVIVOR).withColumns({"trust_rank": F.lit("x"), "_rank": F.lit(1), "field_name": F.lit(1)})
    feeds = spark.createDataFrame([("top", "UTC", False, 1), ("low", "UTC", False, 5)], "source string, feed_zone string, day_first boolean, trust_rank int")
    got = {(r.duplicate_group_id, r.field_name): r.article_id for r in surviving_members(df, feeds).collect()}
    assert got == {("g", "headline"): 3, ("g", "summary"): 2, ("g", "url"): 5, ("tie", "headline"): 9}
    best = {r.duplicate_group_id: r for r in surviving_records(df, feeds).collect()}
    assert (best["g"].headline, best["g"].summary, best["g"].url, best["g"].image_url) == ("three", "two", "http://x", None)
    assert surviving_members(df.limit(0), feeds.limit(0)).count() == 0


# --- nearest in time --------------------------------------------------------------------------

def test_nearest_matches_brute_force(spark):
    rng = random.Random(9)
    left = [(i, rng.choice(["A", "B", None]), rng.choice([None, rng.randint(-500, 500)])) for i in range(400)] + [(7, "A", 3), (7, "A", 3)]
    right = [(1000 + i, rng.choice("AB"), rng.randint(-500, 500) * 2) for i in range(60)] + [(5000, None, 5), (5001, "A", None)]
    ldf = spark.createDataFrame(left, "id bigint, e string, t bigint").withColumns({"_b": F.lit(1), "_e": F.lit(1), "_near": F.lit(1)})
    rdf = spark.createDataFrame(right, "key bigint, e string, t bigint")
    got = Counter((r.id, r.key) for r in nearest_in_time(ldf, rdf, "e", "t", "key", 20).collect())
    want = Counter()
    for i, e, t in left:
        near = [(abs(t - u), u, k) for k, f, u in right if f == e and u is not None and t is not None and abs(t - u) <= 20 and e]
        if near:
            want[(i, min(near)[2])] += 1
    assert got == want
    assert nearest_in_time(ldf.limit(0), rdf.limit(0), "e", "t", "key", 20).count() == 0


def test_article_bars_bounds_and_ties(spark):
    close = dt.datetime(2026, 1, 6, 21)
    calendar = spark.createDataFrame([(d.date(), d) for d in (close, close + dt.timedelta(hours=24))], "session_date date, market_close_utc timestamp")
    bars = spark.createDataFrame([(1, close.date(), "A", close), (2, (close + dt.timedelta(days=1)).date(), "A", close), (3, close.date(), "A", close - dt.timedelta(days=1)), (4, dt.date(2026, 1, 10), "A", close)], "bar_id bigint, trading_date date, ticker string, loaded_at timestamp")
    at = {1: close - dt.timedelta(hours=20), 2: close - dt.timedelta(hours=20, seconds=1), 3: close + dt.timedelta(hours=12), 4: close + dt.timedelta(hours=44), 5: close + dt.timedelta(hours=12, seconds=1)}
    rows = [(i, "wire", t.strftime("%Y-%m-%dT%H:%M:%SZ"), "A") for i, t in at.items()] + [(6, "wire", "2026-01-06", "A"), (7, "wire", "2026-01-06T21:00:00Z", None), (8, "wire", "2026-01-06T21:00:00Z", "Z")]
    articles = spark.createDataFrame(rows, "article_id bigint, source string, published_at_utc string, provider_related string").withColumn("ticker", F.lit("clash"))
    feeds = spark.createDataFrame([("wire", "UTC", False, 1)], "source string, feed_zone string, day_first boolean, trust_rank int")
    got = {r.article_id: r.bar_id for r in article_bars(articles, bars, calendar, feeds).collect()}
    assert got == {1: 1, 3: 1, 4: 2, 5: 2} and HOUR * 20 == 72_000_000_000


# --- tokens -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    with open(VOCABULARY, "rb") as f:
        return read_ranks(f.read())


def test_transducer_equals_the_public_library(ranks):
    import public_tokenizers
    import tiktoken

    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = Transducer(ranks)
    rng = random.Random(1)
    bits = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "é", "漢", "😀", "0", "12", "'s", "'", "..", "--", "ABC", "xxx", "‍", "א", "Ж", "ion", "<|endoftext|>", "\u0000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(5000)] + [" " * 5000, "a" * 20_000, "=-" * 3000, "", "\n" * 999]
    for x in texts:
        assert t.encode(x) == public.encode_ordinary(x), repr(x[:50])


def test_transducer_tables_may_start_anew(ranks, monkeypatch):
    from barlight.llm import tokens

    a, b = Transducer(ranks), Transducer(ranks)
    monkeypatch.setattr(tokens, "KEPT", 5)
    monkeypatch.setattr(tokens, "PIECES_KEPT", 2)
    texts = ["some words and 12,345 numbers", "other Wörter, naïve", "some words again"] * 3
    small = [b.encode(x) for x in texts]
    monkeypatch.undo()
    assert small == [a.encode(x) for x in texts]


def test_streaming_decoder_waits_for_whole_characters(ranks):
    t = Transducer(ranks)
    ids = t.encode("naïve 漢字 😀!")
    d = StreamingDecoder(t.bytes_of)
    assert "".join(d.feed([i]) for i in ids) + d.end() == "naïve 漢字 😀!"
    cut = StreamingDecoder(t.bytes_of)
    assert cut.feed(t.encode("😀")[:1]) == "" and cut.end() == "�"


def test_encoding_tables(spark, ranks):
    rows = [(1, "plain text"), (2, None), (3, ""), (4, "   "), (4, "   "), (None, "x"), (5, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    out = encoded(df, "doc_id", "text")
    got = [(r.doc_id, r.ids) for r in out.collect()]
    assert len(got) == len(rows) and dict(got)[2] == [] and dict(got)[3] == [] and sum(k == 4 for k, _ in got) == 2
    back = sorted(((r.doc_id, r.text) for r in decoded(out, "doc_id").collect()), key=str)
    assert back == sorted(((k, t or "") for k, t in rows), key=str)
    assert encoded(df.limit(0), "doc_id", "text").count() == 0


# --- leaked passages --------------------------------------------------------------------------

def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 8, 11, 12, 13, 30])))) for i in range(40)] + [(100, None), (101, ""), (102, "!!"), (103, items_text := "Ünï Code 5")]
    docs = []
    for i in range(150):
        body = rng.choices(words, k=rng.randint(0, 80))
        if i % 2:
            src = rng.choice(items[:40])[1].split()
            at = rng.randint(0, max(0, len(src) - 5))
            cut = src[at : at + rng.randint(5, 25)]
            body[len(body) // 2 : len(body) // 2] = [w.upper() if rng.random() < 0.2 else w for w in cut]
        docs.append((i, " ".join(w + rng.choice(["", ",", "."]) for w in body)))
    docs += [(900, None), (901, ""), (902, f"x {items_text.lower()} y"), (903, "w1 " * 30_000 + items[0][1]), (3, "repeat " + items[1][1])]
    find = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    want = set()
    for d, t in docs:
        have = find(t)
        for i, x in items:
            w = find(x)
            n = min(12, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if windows & {tuple(have[k : k + n]) for k in range(len(have) - n + 1)}:
                want.add((d, i))
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "similarity": F.lit(1)})
    idf = spark.createDataFrame(items, "item_id bigint, text string")
    hashed = leaked_items(ddf, idf, "doc_id", "item_id", radius=3).collect()
    got = [(r.doc_id, r.item_id) for r in hashed if r.verbatim]
    assert set(got) == want and len(got) == len(want)
    loose = {(r.doc_id, r.item_id): r.similarity for r in leaked_items(ddf, idf, "doc_id", "item_id").collect()}
    assert want <= set(loose) and all(0.8 <= s <= 1 for s in loose.values())
    # every candidate within the radius is compared: what it yields is among what a search that misses none yields
    assert all(r.similarity <= loose[(r.doc_id, r.item_id)] + 1e-12 and r.similarity >= 0.8 for r in hashed)
    assert leaked_items(ddf.limit(0), idf.limit(0), "doc_id", "item_id").count() == 0


def _brute_similar(docs, items, window, least):
    from barlight.llm.leakage import Words

    words, best = Words(), {}
    for d, t in docs:
        have = words(t)
        for i, x in items:
            w = words(x)
            n = min(window, len(w))
            for a in range(len(have) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    s = similarity(have[a : a + n], w[b : b + n])
                    if s >= least:
                        best[(d, i)] = max(best.get((d, i), 0), s)
    return best


@pytest.mark.parametrize(("least", "window"), [(0.8, 12), (0.5, 12), (0.3, 5), (0.05, 4)])
def test_similar_passages_match_brute_force(spark, monkeypatch, least, window):
    from barlight.llm import leakage

    monkeypatch.setattr(leakage, "BLOCK", 500)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 9, 12, 14, 20])))) for i in range(16)]
    docs = []
    for d in range(40):
        body = rng.choices(words, k=rng.randint(0, 20))
        cut = rng.choice(items)[1].split()[:12]
        edit = rng.choice(["first", "last", "inner", "swap", "none"])
        if edit == "swap":
            cut = cut[len(cut) // 2 :] + cut[: len(cut) // 2]
        elif edit != "none":
            cut[{"first": 0, "last": -1, "inner": len(cut) // 2}[edit]] = "changed"
        docs.append((d, " ".join(body + cut + rng.choices(words, k=rng.randint(0, 9)))))
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = _brute_similar(docs, items, window, least)
    got = {(r.doc_id, r.item_id): r.similarity for r in leaked_items(ddf, idf, "doc_id", "item_id", window=window, least=least).collect()}
    assert got == pytest.approx(want) and set(got) == set(want)


def test_p9_similar_finds_items_with_an_edge_word_changed(spark, tmp_path):
    from barlight.llm.queries import p9_similar

    rng = random.Random(6)
    items = [(i, " ".join(f"i{i}x{rng.randint(0, 10**6)}" for _ in range(12))) for i in range(50)]
    docs = [(i, "lead " + " ".join(["changed", *t.split()[1:]] if i % 2 else [*t.split()[:-1], "changed"]) + " tail") for i, t in items]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = p9_similar(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(50)]
    assert all(r.similarity == pytest.approx(31 / 37) and not r.verbatim for r in got)


def test_candidates_within_the_radius_are_verified():
    """Fingerprints that agree don't make a match: only the shingles of the two windows do."""
    from barlight.llm.leakage import HashedWindows

    rng = np.random.default_rng(3)
    rows = rng.integers(0, 1 << 62, (5, 12), np.uint64)
    ix = HashedWindows(12, rows, np.arange(5), 3)
    h = np.concatenate([rows[2], rng.integers(0, 1 << 62, 30, np.uint64), rows[4][:11], rows[0][:1]])
    prints = np.repeat(ix.prints[2], len(h) - 11)  # every window is a candidate of the third
    found = [tuple(x) for at, win, s in ix.verified(prints, h, np.zeros(len(h), int), 0.8) for x in zip(at.tolist(), win.tolist(), s.tolist())]
    assert found == [(0, 2, 1.0), (1, 2, pytest.approx(31 / 37))]  # the second lacks the first word only


def test_leaks_in_several_passes_and_parts(spark, monkeypatch):
    from barlight.llm import leakage

    items = spark.createDataFrame([(i, f"alpha{i} beta gamma delta") for i in range(30)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"x alpha{i} beta gamma delta y") for i in range(30)], "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "PASS_CHARS", 200)
    for radius in (None, 3):
        assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items, "doc_id", "item_id", radius=radius, least=1.0).collect()} == {(i, i) for i in range(30)}


def test_shingle_similarity():
    a = np.arange(1, 13, dtype=np.uint64)
    b = a.copy()
    b[5] = 99
    assert similarity(a, a) == 1.0 and similarity(a, a[::-1].copy()) < 0.5 and similarity(a, b) == pytest.approx((11 + 18) / (13 + 2 * 13))


# --- look-alikes ------------------------------------------------------------------------------

SAME = ["Café deal", "Café deal", "Café​ deal", "Caﬁ no", "Саfé deal", "Ｃａｆé deal", "Café　deal", "Caf­é deal "]


def test_lookalike_pairs_match_brute_force(spark):
    others = ["Cafe deal", "café deal", "Cafédeal", "CAFÉ DEAL", "", "  ", "​", None, "2", "²", "👩‍🔬", "👩🔬", "ạ́", "ạ́", "K", "K", "x" * 60_000]
    rows = [(i, t) for i, t in enumerate(SAME + others)] + [(100 + i, "Café deal") for i in range(5)] + [(200 + i, "mass copy") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_key": F.lit(1), "canonical": F.lit(1), "_text": F.lit("c")})

    def cls(t):
        return unicodedata.normalize("NFC", shown_text(t)) if t else ""

    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and cls(x) and cls(x) == cls(y)}
    got = [(r.doc_id_a, r.doc_id_b) for r in lookalike_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    members = {r.doc_id: (r.canonical, r.variants) for r in lookalike_members(df, "doc_id", "text").collect()}
    assert members[100] == (0, 7) and 200 not in members
    assert lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0


# --- queries ----------------------------------------------------------------------------------

def test_every_problem_has_its_query_and_sql_agrees(spark):
    import duckdb

    from barlight.llm import queries

    assert {f"p{n}_found" for n in (2, 4, 5, 7, 9, 10)} | {"p8_ids"} <= set(queries.QUERIES)
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("articles", "feeds", "core_bars", "daily_bars", "session_calendar", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name in ("p2_found", "p4_found", "p5_found", "p7_found", "p9_found", "p8_roundtrip"):
        got = queries.QUERIES[name](spark, folder)
        want = con.execute(queries.SQL[name])
        columns = [c[0] for c in want.description]
        assert got.columns == columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name


@pytest.mark.parametrize(("other", "plain"), [
    ("ν", "v"), ("ρ", "p"), ("ѵ", "v"), ("ӏ", "l"), ("օ", "o"), ("ո", "n"), ("ս", "u"), ("հ", "h"), ("Ꭺ", "A"), ("Ꭼ", "E"), ("ꓮ", "A"), ("ɡ", "g"), ("ᴏ", "o"), ("𝐀", "A"), ("𝗮", "a"), ("𝟙", "1"),
    ("𝚨", "A"), ("ℓ", "l"), ("ｱ", "ア"), ("ｶﾞ", "ガ"), ("Ａ", "A"), ("１", "1"), ("￥", "¥"), ("ﬁ", "fi"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ⅷ", "VIII"), ("ǆ", "dž"), ("…", "..."), ("‑", "-"), ("а", "a"), ("ё", "ë"),
])
def test_characters_drawn_alike(other, plain):
    assert shown_text(f"x{other}y") == unicodedata.normalize("NFC", f"x{plain}y")


@pytest.mark.parametrize("other", ["α", "ß", "’", "“", "−", "–", "²", "①", "ı", "æ", "в", "и", "א", "漢"])
def test_characters_of_their_own(other):
    assert shown_text(f"x{other}y") == f"x{other}y"


def test_best_records(spark):
    late, early = "2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z"
    rows = [
        ("complete", 1, "z", early, "h", "s", "u", None), ("complete", 2, "a", late, "h", "s", "n/a", " "),
        ("trust", 4, None, late, "h", None, None, None), ("trust", 3, "a", early, "h", "--", None, None),
        ("recent", 5, "a", early, "h", None, None, None), ("recent", 6, "a", late, "h", None, None, None), ("recent", 7, "a", "no time", "h", None, None, None),
        ("tie", 9, None, None, None, None, None, None), ("tie", 8, None, None, None, None, None, None), ("tie", 8, None, None, None, None, None, None),
        ("alone", 10, "a", late, "h", "s", "u", "i"), (None, 11, "a", late, "h", "s", "u", "i"), (None, 12, "a", late, "h", "s", "u", "i"),
    ]
    a = spark.createDataFrame(rows, "duplicate_group_id string, article_id bigint, source string, published_at_utc string, headline string, summary string, url string, image_url string")
    a = a.withColumns({"filled": F.lit(9), "members": F.lit(9), "trust_rank": F.lit(0)})
    feeds = spark.createDataFrame([("a", "UTC", False, 1), ("z", "UTC", False, 5)], "source string, feed_zone string, day_first boolean, trust_rank int")
    got = {r.duplicate_group_id: (r.article_id, r.filled, r.members) for r in best_records(a, feeds).collect()}
    assert got == {"complete": (1, 3, 2), "trust": (3, 1, 2), "recent": (6, 1, 3), "tie": (8, 0, 3)}
    assert best_records(a.limit(0), feeds).count() == 0
