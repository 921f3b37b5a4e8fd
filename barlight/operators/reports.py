"""Counts, contracts and samples for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_key(day: Column) -> Column:
    """The first seven characters of a date's text, or unknown."""
    text = day.cast("string")
    return F.when(F.length(F.coalesce(text, F.lit(""))) >= 7, F.substring(text, 1, 7)).otherwise("unknown")


def monthly_counts(rows: DataFrame, day: str, measures: dict[str, Column], first: str, last: str) -> DataFrame:
    """(month, rows, one count per measure) for every month between two dates, empty ones as zeros.

    Rows outside the range of months are not counted.
    """
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("_m")).select(F.date_format("_m", "yyyy-MM").alias("month"))
    counts = rows.groupBy(month_key(F.col(day)).alias("month")).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(k) for k, v in measures.items()])
    out = spine.join(counts, "month", "left")
    return out.select("month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["rows", *measures]])


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """(reason, rows) of an array column, most frequent first."""
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "reason")


def status_counts(rows: DataFrame, status: str, prefixes: list[str]) -> DataFrame:
    """(status, rows) per exact value and per prefix (written with a star)."""
    exact = rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("rows"))
    stars = rows.agg(*[F.count_if(F.col(status).startswith(p)).alias(f"{p}*") for p in prefixes])
    return exact.unionByName(stars.unpivot([], stars.columns, "status", "rows"))


def groups_above_one(rows: DataFrame, group: str) -> DataFrame:
    """(groups, rows): how many groups have several rows, and how many rows those hold beyond one."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def contract_violations(rows: DataFrame, rules: dict[str, Column], unique: list[str]) -> DataFrame:
    """(rule, violations): rows that break a condition, and values of unique columns that repeat."""
    counts = rows.agg(*[F.count_if(~F.coalesce(v, F.lit(False))).alias(k) for k, v in rules.items()]).unpivot([], list(rules), "rule", "violations")
    for c in unique:
        again = rows.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
        counts = counts.unionByName(again.select(F.lit(f"{c}_repeated").alias("rule"), "violations"))
    return counts


def absent_from(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a subset that the whole does not hold."""
    return part.join(whole.select(*keys).distinct(), keys, "left_anti")


def reconciled(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check, left_count, right_count, equal) for pairs of tables that must have as many rows."""
    parts = [a.agg(F.count(F.lit(1)).alias("left_count")).select(F.lit(k).alias("check"), "left_count").join(b.agg(F.count(F.lit(1)).alias("right_count")).select(F.lit(k).alias("check"), "right_count"), "check") for k, (a, b) in pairs.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("equal", F.col("left_count") == F.col("right_count"))


def stratified_sample(rows: DataFrame, stratum: str, category: str, categories: list[str], month: str, quality: list[Column], key: str, size: int = 10) -> DataFrame:
    """Up to ``size`` rows per stratum: the best of each category in the given order, then the best
    remaining of each month, then the best remaining; ordered by quality and then the key.

    Each stage ranks within its groups and keeps one row there, so no stratum is gathered; the picks
    that later stages exclude are at most one per category and month.
    """
    order = [*[q.desc_nulls_last() for q in quality], F.asc(key)]
    best = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= 1).drop("_r")
    place = F.array_position(F.array(*map(F.lit, categories)), F.col(category))
    one = best(rows.where(place > 0), stratum, category).withColumns({"_stage": F.lit(1), "_at": place.cast("string")})
    two = best(rows.join(one.select(key), key, "left_anti"), stratum, month).withColumns({"_stage": F.lit(2), "_at": F.col(month)})
    rest = rows.join(one.select(key).union(two.select(key)), key, "left_anti")
    three = rest.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= size)
    three = three.withColumns({"_stage": F.lit(3), "_at": F.lpad(F.col("_r").cast("string"), 9, "0")}).drop("_r")
    ranked = one.unionByName(two).unionByName(three)
    pick = Window.partitionBy(stratum).orderBy("_stage", F.length("_at"), "_at", *order)
    return ranked.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= size).drop("_r", "_stage", "_at")


def evenly_spaced(rows: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """``count`` rows of each group at even steps from its first to its last, all if there are fewer."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": n})
    step = F.expr(f"transform(sequence(0, {count - 1}), k -> cast(bround(k * (_n - 1) / {max(1, count - 1)}) as int))")
    return ranked.where((F.col("_n") <= count) | F.array_contains(step, F.col("_i"))).drop("_i", "_n")


def first_per_group(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first row of each group, and of these the first ``limit`` in the same order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 1).drop("_r").orderBy(*order).limit(limit)


def sample_composition(rows: DataFrame, stratum: str, expected: int) -> DataFrame:
    """(stratum, rows, complete): whether each stratum of a sample has the expected size."""
    n = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("complete", F.col("rows") == expected)
