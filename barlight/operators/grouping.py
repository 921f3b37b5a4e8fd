"""Merging repeated observations, and grouping similar items into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.ids import canonical_key, stable_id
from barlight.functions.text import BLOCKING_STOPWORDS, HEADLINE_STOPWORDS, blocking_tokens, normalize_text, split_tags
from barlight.operators.components import connected_components
from barlight.operators.headlines import Search
from barlight.session import discard, written


def filled_fields(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")
    return total


def exact_groups(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """(row, group): rows that share a value of any key column, directly or through others.

    Empty and null keys never link. Each key value points to its smallest row, so a value that a
    third of all rows share costs one edge per row and no pairs; components follow from the edges.
    """
    edges = None
    for k in keys:
        has = rows.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "").select(F.col(row).alias("_row"), F.col(k).alias("_k"))
        least = has.groupBy("_k").agg(F.min("_row").alias("_first"))
        one = has.join(least, "_k").select("_row", "_first")
        edges = one if edges is None else edges.unionByName(one)
    parts = connected_components(edges, "_row", "_first")
    return rows.select(F.col(row).alias("node")).join(parts, "node", "left").select(F.col("node").alias(row), F.coalesce("component", "node").alias("group"))


def merged_observations(rows: DataFrame, row: str = "obs_id") -> DataFrame:
    """One row per group of observations that share an article id or a normalised address.

    The values come from the observation with most filled fields, then the longest summary and
    headline, then the smallest ``row``. Tickers and related tags are joined as sorted sets, the
    earliest retrieval and the number of observations are kept, and the id is the least text among
    the group's ids. Groups share neither ids nor addresses, so the least of each tell a group.

    Only ids and short columns go through the groups; texts are fetched for the chosen rows
    afterwards. Sets hold tickers and tags, whose number doesn't grow with a group. ``row`` is unique.
    """
    groups = exact_groups(rows, row, ["article_id", "normalized_url"])
    quality = F.struct(filled_fields([c for c in rows.columns if c != row]).alias("a"), F.length(F.coalesce("summary", F.lit(""))).alias("b"), F.length(F.coalesce("headline", F.lit(""))).alias("c"), (-F.col(row)).alias("d"))
    carried = ["headline", "summary", "source", "url", "normalized_url", "datetime", "category", "image"]
    small = rows.select(row, F.col("article_id").cast("string").alias("article_id"), F.nullif("normalized_url", F.lit("")).alias("_url"), "queried_ticker", "related", "retrieved_at_utc", quality.alias("_q"))
    joined = small.join(groups, row)
    tags = joined.select("group", F.explode(split_tags(F.col("related"))).alias("tag")).groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("related_tags"))
    merged = joined.groupBy("group").agg(
        F.max_by(row, "_q").alias(row), F.min("article_id").alias("article_key"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("queried_ticker", F.lit("")))), "|").alias("queried_tickers"),
        F.min("retrieved_at_utc").alias("retrieved_at_utc"), F.count(F.lit(1)).alias("raw_observation_count"), F.min("_url").alias("_url"),
    )
    group_id = stable_id("exact", [F.col("article_key"), F.col("_url")])
    out = merged.join(tags, "group", "left").join(rows.select(row, *carried), row)
    return out.select("article_key", "queried_tickers", *carried, "retrieved_at_utc", "raw_observation_count", F.coalesce("related_tags", F.lit("")).alias("related_tags"), group_id.alias("exact_duplicate_group_id"))


#: Rows of a time slice that are compared in one unit; more are split into blocks, every pair of
#: blocks being a unit.
BLOCK = 1 << 15


def similar_edges(items: DataFrame, key: str, at: str, sequence: float = 0.86, token: float = 0.78, hours: int = 72, shared: int = 2, extra: tuple[str, ...] = (), by: tuple[str, ...] = ("words", "characters"), linked: bool = False) -> DataFrame:
    """(a, b, tokens, jaccard, ratio): pairs of items published within ``hours`` whose headlines share
    enough words and are similar by their words or their characters.

    Time slices are as wide as the window, so a pair can only lie in the same or the next slice. A
    row goes to its own slice and, as the earlier side, to the next; all pairs are looked at within
    the task that holds a slice, see ``Search``, so only similar pairs leave it. Blocking words
    (``extra`` words are none) are those that must be shared. The ratio is taken only where the words
    don't decide and is null elsewhere; of ``by``, one may be left out where its pairs aren't asked for.
    ``a`` is the later item (ties by key), which the ratio takes first.

    Where a headline recurs, its pairs grow with the square of its rows. ``linked`` gives pairs (a, b) that
    connect the same items instead, at most one for each row that a task holds.
    """
    span = hours * 3_600_000_000
    size = F.size(blocking_tokens(F.col("headline"), extra))
    rows = items.where(F.col(at).isNotNull() & (size >= max(shared, 1))).select(F.col(key).alias("k"), F.col(at).cast("bigint").alias("t"), normalize_text(F.col("headline")).alias("n"))
    rows = written(rows.withColumn("s", F.floor(F.col("t") / F.lit(span))), "headlines")
    held = rows.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    ends = held.select("s", "c", F.col("c").alias("o")).unionByName(held.select((F.col("s") + 1).alias("s"), "c", F.lit(0).alias("o")))
    blocks = lambda n: F.ceil(F.sum(n) / F.lit(BLOCK))
    # per slice, the blocks of its own rows and of those with the slice before
    parts = ends.groupBy("s").agg(blocks("o").alias("mo"), blocks("c").alias("mn")).where(F.col("mo") > 0)
    to = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).withColumn("s", F.col("s") + F.col("d")).join(parts, "s")
    i, j = (F.pmod(F.xxhash64("k"), m) for m in ("mo", "mn"))
    unit = lambda i, j, role: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(role).cast("int").alias("role"))
    near = F.transform(F.sequence(F.lit(0), F.col("mo") - 1), lambda x: unit(x, j, 2))
    own = F.transform(F.sequence(F.lit(0), F.col("mn") - 1), lambda x: unit(i, x, 1))
    one = (F.col("mo") == 1) & (F.col("mn") == 1)
    units = F.when(F.col("d") == 1, near).when(one, F.array(unit(F.lit(0), F.lit(0), 3))).otherwise(F.concat(own, near))
    sent = to.select("s", F.explode(units).alias("u"), "k", "t", "n").select("s", "u.i", "u.j", "u.role", "k", "t", "n")
    search = Search(HEADLINE_STOPWORDS, BLOCKING_STOPWORDS + list(extra), sequence, token, span, shared, by, linked)
    kind = rows.schema["k"].dataType.simpleString()
    return sent.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j").mapInArrow(search, f"a {kind}, b {kind}" + ("" if linked else ", tokens bigint, jaccard double, ratio double"))


def event_groups(items: DataFrame, key: str, at: str, **thresholds) -> DataFrame:
    """Items with their event group: id, size, representative and why others are suppressed.

    Only relevant items with a time take part; all others stay alone. The representative is the
    first by (excluded, not relevant, published, longest summary, canonical key).
    """
    # what is needed of an item, once: its time is costly to read, and it is looked at several times
    canon = canonical_key(F.col(key), F.col("normalized_url"), F.col("published_at_utc"), F.col("headline"))
    items = written(items.select(key, at, "headline", "relevance_type", "excluded", F.length(F.coalesce("summary", F.lit(""))).alias("_length"), canon.alias("_canon")), "event-items")
    eligible = items.where(F.col("relevance_type").isin("direct", "indirect") & F.col(at).isNotNull())
    parts = connected_components(similar_edges(eligible, key, at, linked=True, **thresholds), "a", "b").select(F.col("node").alias(key), "component")
    placed = written(items.drop("headline").join(parts, key, "left").withColumn("_group", F.coalesce("component", key)).drop("component"), "event-members")
    discard(items)
    rank = Window.partitionBy("_group").orderBy(
        F.coalesce(F.col("excluded").cast("string"), F.lit("false")), F.when(F.col("relevance_type") == "not_relevant", 1).otherwise(0),
        F.col(at).asc_nulls_last(), F.desc("_length"), "_canon", key,
    )
    first = placed.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= 1).select("_group", F.col(key).alias("representative_id"))
    sizes = placed.groupBy("_group").agg(F.count(F.lit(1)).alias("event_group_size"), F.min("_canon").alias("_least"))
    out = placed.select(key, "_group", "excluded").join(first, "_group").join(sizes, "_group")
    same = F.col("representative_id") == F.col(key)
    reason = F.when(~same & (F.coalesce(F.col("excluded").cast("string"), F.lit("false")) != "true"), "duplicate_event_coverage")
    return out.select(key, stable_id("event", [F.col("_group")]).alias("event_group_id"), "event_group_size", "representative_id", same.alias("is_representative"), reason.alias("added_exclusion"))
