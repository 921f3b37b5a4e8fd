"""Totals and averages over trailing periods, from event-contribution deltas.

Every daily amount adds at its date and subtracts after the length of the window, so a running sum
of the deltas is the trailing total. Between two deltas nothing changes: the days in between are
filled by repeating the state, not by joining a calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _exact(column: str, scale: int) -> Column:
    """Fixed-point amount, so that adding and later subtracting it leaves nothing behind.

    NaN, infinities and values beyond 10^17 have no fixed-point form and count as missing.
    """
    value = F.col(column)
    return F.when(F.abs(value.cast("double")) < 1e17, value).try_cast(f"decimal({18 + scale},{scale})")


def trailing_totals(daily: DataFrame, entity: str, day: str, measures: dict[str, int], windows: tuple[int, ...]) -> DataFrame:
    """Trailing totals for every entity and every calendar day from its first to its last row.

    ``measures`` maps a numeric column to the number of decimals kept; ``windows`` are lengths in
    days, a window of w days being the day itself and the w - 1 before it. The result has
    ``entity``, ``day``, ``first_day`` and for each measure m and window w ``m_total_w`` (decimal;
    null if no value is in the window) and ``m_count_w`` (values in the window).

    Several rows of one entity and day add up. Null and non-finite values add nothing and do not
    count; the rows still extend the span of days. Rows without entity or day are left out, an
    empty table gives no rows. One shuffle by entity serves the aggregation of the deltas and all
    windows; an entity's partition is bounded by its number of days, because its rows are combined
    per day before the shuffle.
    """
    rows = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    names = list(measures)
    steps = sorted({0, *windows})
    base = rows.select(F.col(entity).alias("_e"), F.col(day).alias("_d"), *[_exact(m, measures[m]).alias(f"_v{i}") for i, m in enumerate(names)])
    # combined per day before anything goes by entity alone; no shuffle if the rows already lie so
    daily_sums = base.groupBy("_e", "_d").agg(*[x for i in range(len(names)) for x in (F.sum(f"_v{i}").alias(f"_v{i}"), F.count(f"_v{i}").alias(f"_c{i}"))])
    # one delta row per step: at the date itself, and after each window's length
    delta = daily_sums.repartition("_e").withColumn("_after", F.explode(F.array(*map(F.lit, steps))))
    sums = []
    for i in range(len(names)):
        for w in windows:
            sign = F.when(F.col("_after") == 0, F.lit(1)).when(F.col("_after") == w, F.lit(-1)).otherwise(F.lit(0))
            sums += [F.sum(F.col(f"_v{i}") * sign).alias(f"_s{i}_{w}"), F.sum(F.col(f"_c{i}") * sign).alias(f"_n{i}_{w}")]
    at = F.date_add("_d", F.col("_after"))
    # the last real day: later deltas lie outside the entity's span
    per_day = delta.groupBy("_e", at.alias("_at")).agg(*sums, F.max(F.when(F.col("_after") == 0, F.col("_d"))).alias("_real"))
    by_entity = Window.partitionBy("_e").orderBy("_at")
    whole = Window.partitionBy("_e")
    running = by_entity.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = per_day.select(
        "_e", "_at",
        *[F.sum(F.coalesce(F.col(f"_s{i}_{w}"), F.lit(0))).over(running).alias(f"_s{i}_{w}") for i in range(len(names)) for w in windows],
        *[F.sum(f"_n{i}_{w}").over(running).alias(f"_n{i}_{w}") for i in range(len(names)) for w in windows],
        F.lead("_at").over(by_entity).alias("_next"),
        F.min("_real").over(whole).alias("_first"),
        F.max("_real").over(whole).alias("_last"),
    ).where(F.col("_at") <= F.col("_last"))
    until = F.least(F.date_sub("_next", 1), F.col("_last"))
    filled = state.withColumn("_day", F.explode(F.sequence("_at", F.coalesce(until, F.col("_last")))))
    out = [F.col("_e").alias(entity), F.col("_day").alias(day), F.col("_first").alias("first_day")]
    for i, m in enumerate(names):
        for w in windows:
            count = F.col(f"_n{i}_{w}")
            out += [F.when(count > 0, F.col(f"_s{i}_{w}")).alias(f"{m}_total_{w}"), count.cast("bigint").alias(f"{m}_count_{w}")]
    return filled.select(*out)


def mean(measure: str, window: int) -> Column:
    """Trailing average as a double; null where the window holds no value."""
    return F.try_divide(F.col(f"{measure}_total_{window}").cast("double"), F.col(f"{measure}_count_{window}").cast("double"))
