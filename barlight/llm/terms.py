"""How often every term occurs, and in how many records, from last-seen counters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a term is a longest match in lower-cased text.
TERM = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)?")
#: Counters held by one task before they are handed on; they add up, so the bound changes no count.
HELD = 500_000

_PARTIAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _emit(counters: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    terms = list(counters)
    for at in range(0, len(terms), 50_000):
        part = terms[at : at + 50_000]
        yield pa.record_batch([pa.array(part), pa.array([counters[t][0] for t in part], pa.int64()), pa.array([counters[t][1] for t in part], pa.int64())], schema=_PARTIAL)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of one partition: term -> [occurrences, records, last record].

    Records come one after another, so comparing with the last record seen tells whether a term is
    new to the record; no set of a record's terms is kept.
    """
    counters: dict[str, list[int]] = {}
    record = 0
    for batch in batches:
        for text in batch.column(0):
            record += 1
            for m in TERM.finditer(text.as_py().lower()):
                term = m.group()
                c = counters.get(term)
                if c is None:
                    counters[term] = [1, 1, record]
                else:
                    c[0] += 1
                    if c[2] != record:
                        c[1] += 1
                        c[2] = record
            if len(counters) > HELD:
                yield from _emit(counters)
                counters = {}
    yield from _emit(counters)


def joined_text(*columns: str):
    """The columns' texts with one space between, null as empty text."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def term_counts(df: DataFrame, columns: list[str], rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """(term, occurrences, records, mark) of every term in the joined text of ``columns``.

    A record is a row: repeated rows count each, whatever their ids. ``mark`` is "rare" if fewer
    than ``rare_below`` records hold the term, else "common" if more than the share
    ``common_above`` of all records do, else "kept". Texts without a term count as records only; an
    empty table gives no rows.

    A record lies wholly in one partition, so the partitions' counters add up exactly: only one row
    per distinct term and partition is shuffled, hashed by term, and a term of every record is no
    hot key. The number of records is a scalar subquery.
    """
    texts = df.select(joined_text(*columns).alias("text"))
    partial = texts.mapInArrow(_count, "term string, occurrences bigint, records bigint")
    counts = partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = df.select(F.lit(1).alias("_one")).agg(F.count("_one").alias("n")).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > total * F.lit(common_above), "common").otherwise("kept")
    return counts.withColumn("mark", mark)
