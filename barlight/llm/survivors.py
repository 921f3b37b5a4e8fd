"""The surviving values of each duplicate group, chosen field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.operators.timestamps import article_instants

#: What is written where there is nothing, in any case and with blanks around it.
STAND_INS = ["", "-", "--", "---", "–", "—", "n/a", "na", "n.a.", "null", "none", "nil", "nan", "#n/a", "unknown", "tbd", "?"]
FIELDS = ["headline", "summary", "url", "image_url"]


def missing(value: Column) -> Column:
    """Whether a value is null, blank or a stand-in for nothing."""
    bare = F.lower(F.regexp_replace(value, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return value.isNull() | bare.isin(STAND_INS)


def surviving_members(articles: DataFrame, feeds: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(duplicate_group_id, field_name, article_id) of the member whose value survives.

    For every non-null group of two or more rows and every field: among members whose value is not
    missing, the most trusted source (unknown sources last), then the latest publication (unusable
    times last), then the smallest id. Rows that repeat an id tie and give one row. A group without
    any value for a field has no row for it; an empty table has none at all.

    Only ids and ranks are shuffled, never texts. ``row_number() <= 1`` makes Spark keep one row
    per group and field already before the shuffle (WindowGroupLimit), and group sizes are
    combined before theirs, so a group that holds a third of all rows costs a few rows per task.
    """
    articles = articles.select("duplicate_group_id", "article_id", "source", "published_at_utc", *fields)
    ranked = article_instants(articles.where(F.col("duplicate_group_id").isNotNull()), feeds)
    has = F.array(*[F.when(~missing(F.col(f)), F.lit(f)) for f in fields])
    long = ranked.select("duplicate_group_id", "article_id", "trust_rank", "published_micros", F.explode(F.filter(has, lambda f: f.isNotNull())).alias("field_name"))
    best = Window.partitionBy("duplicate_group_id", "field_name").orderBy(F.asc_nulls_last("trust_rank"), F.desc_nulls_last("published_micros"), F.asc("article_id"))
    first = long.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= 1)
    sizes = articles.where(F.col("duplicate_group_id").isNotNull()).groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    return first.join(sizes, "duplicate_group_id", "left_semi").select("duplicate_group_id", "field_name", "article_id")


def best_records(articles: DataFrame, feeds: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(duplicate_group_id, article_id, filled, members): the one record that stands for its group.

    For every non-null group of two or more rows: the row with most of the ``fields`` filled, then of
    the most trusted source (unknown ones last), then the latest (unusable times last), then the
    smallest id. Rows that repeat an id tie and give one row; an empty table gives none. As in
    ``surviving_members`` only ids and ranks are shuffled, and a task keeps one row per group.
    """
    articles = articles.select("duplicate_group_id", "article_id", "source", "published_at_utc", *fields).where(F.col("duplicate_group_id").isNotNull())
    filled = sum(((~missing(F.col(f))).cast("int") for f in fields), F.lit(0))
    ranked = article_instants(articles.withColumn("filled", filled).drop(*fields), feeds).select("duplicate_group_id", "article_id", "filled", "trust_rank", "published_micros")
    best = Window.partitionBy("duplicate_group_id").orderBy(F.desc("filled"), F.asc_nulls_last("trust_rank"), F.desc_nulls_last("published_micros"), F.asc("article_id"))
    first = ranked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= 1)
    sizes = articles.groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= 2)
    return first.join(sizes, "duplicate_group_id").select("duplicate_group_id", "article_id", "filled", "members")


def surviving_records(articles: DataFrame, feeds: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """One row per group with the surviving value of every field (null if all are missing).

    The winners' values are fetched by id afterwards: at most one row per group and field. Where an
    id is repeated, the smallest of its values is taken.
    """
    winners = surviving_members(articles, feeds, fields).withColumnRenamed("article_id", "_winner")
    pick = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in fields])
    texts = articles.select(F.col("article_id").alias("_winner"), *fields)
    values = winners.join(texts, "_winner").select("duplicate_group_id", "field_name", pick.alias("_value"))
    return values.groupBy("duplicate_group_id").agg(*[F.min(F.when(F.col("field_name") == f, F.col("_value"))).alias(f) for f in fields])
