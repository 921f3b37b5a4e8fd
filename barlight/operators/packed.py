"""Several values packed in one field, split by rules resolved once per delimiter skeleton.

A value is cut into runs: a run of ordinary characters, or one special character. Masking the
ordinary runs leaves the skeleton (``a`` for text, ``s`` for blanks, special characters as they
are). How to split is decided once per distinct skeleton, giving for every item the numbers of the
runs it is made of; a value is then split by picking those runs, without looking at quotes again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.session import written

#: What separates items, and what may quote one.
DELIMITERS = "|;；,/+\t\n\r"
QUOTES = "\"'"
#: The rule table is broadcast up to this many bytes of skeletons and rules, joined beyond.
BROADCAST_BYTES = 32 << 20

_CLASS = r"|;；,/+\t\n\r\"'\[\]\\"
RUN = rf"[^{_CLASS}]+|[{_CLASS}]"
RULE = T.ArrayType(T.ArrayType(T.IntegerType()))


def resolve(skeleton: str) -> list[list[int]]:
    """The runs of each item of a skeleton, blank items left out.

    A pair of brackets around quoted items is a JSON list. Outside quotes every delimiter splits. A
    quote opens at the start of an item and closes before a delimiter or the end; inside, a doubled
    quote or one after a backslash stands for itself. A quote that never closes is ordinary text, as
    are brackets and quotes in the middle of an item.
    """
    runs = list(skeleton)
    n = len(runs)
    lo, hi = 0, n
    filled = [i for i in range(n) if runs[i] not in "s\t\n\r"]
    if len(filled) > 1 and runs[filled[0]] == "[" and runs[filled[-1]] == "]":
        lo, hi = filled[0] + 1, filled[-1]
    close = _closers(runs, lo, hi)
    items: list[list[int]] = []
    item: list[int] = []
    start, i = True, lo  # start: nothing but blanks so far in this item
    while i < hi:
        c = runs[i]
        if c in DELIMITERS:
            items.append(item)
            item, start = [], True
        elif start and c in QUOTES and i in close:
            end, kept = close[i]
            item = kept
            i, start = end, False
        else:
            item.append(i)
            start = start and c == "s"
        i += 1
    items.append(item)
    return [x for x in items if any(runs[k] not in "s\t\n\r" for k in x)]


def _closers(runs: list[str], lo: int, hi: int) -> dict[int, tuple[int, list[int]]]:
    """For each quote that can open an item: its closing quote and the runs between, unescaped."""
    found: dict[int, tuple[int, list[int]]] = {}
    hopeless: set[str] = set()  # no later quote of this kind closes, so no earlier scan is repeated
    i, start = lo, True
    while i < hi:
        c = runs[i]
        if c in DELIMITERS:
            start = True
        elif start and c in QUOTES and c not in hopeless:
            kept: list[int] = []
            k, end = i + 1, None
            while k < hi:
                x = runs[k]
                if x == "\\" and k + 1 < hi and runs[k + 1] in "\"'\\":
                    kept.append(k + 1)
                    k += 2
                    continue
                if x == c:
                    if k + 1 < hi and runs[k + 1] == c and not _ends(runs, k + 1, hi, kept):
                        kept.append(k)
                        k += 2
                        continue
                    if _after(runs, k, hi):
                        end = k
                        break
                kept.append(k)
                k += 1
            if end is None:
                hopeless.add(c)
                start = False
            else:
                found[i] = (end, kept)
                i, start = end, False
        elif c != "s":
            start = False
        i += 1
    return found


def _after(runs: list[str], k: int, hi: int) -> bool:
    """Whether only blanks stand between the run k and a delimiter or the end."""
    k += 1
    while k < hi and runs[k] == "s":
        k += 1
    return k >= hi or runs[k] in DELIMITERS


def _ends(runs: list[str], k: int, hi: int, kept: list[int]) -> bool:
    """Whether a doubled quote is an empty item rather than an escaped quote."""
    return not kept and _after(runs, k, hi)


def split_packed(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per value: (key, field_name, item_pos, item), positions counted from 1 per field.

    Items are trimmed of blanks and freed of their quoting; blank items take no position, so null,
    empty and blank texts give no row. Rows are taken one by one: repeated keys repeat their items.

    The skeletons are aggregated before anything is shuffled. Their rule table is broadcast while
    its measured size stays below ``BROADCAST_BYTES``; otherwise it is joined by shuffle, where
    adaptive execution splits a skeleton that many rows share.
    """
    long = df.select(F.col(key).alias("_key"), *columns).unpivot("_key", columns, "_field", "_text")
    runs = long.where(F.trim("_text") != "").select("_key", "_field", F.regexp_extract_all("_text", F.lit(RUN), F.lit(0)).alias("_runs"))
    mask = F.transform("_runs", lambda r: F.when(r.rlike(rf"^[{_CLASS}]$"), r).when(r.rlike(r"^[\s\p{Z}]+$"), "s").otherwise("a"))
    rows = runs.withColumn("_skeleton", F.array_join(mask, ""))

    @F.pandas_udf(RULE)
    def rule(s: pd.Series) -> pd.Series:
        return s.map(resolve)

    rules = written(rows.select("_skeleton").distinct().select("_skeleton", rule("_skeleton").alias("_rule")), "skeletons")
    size = rules.agg(F.sum(F.length("_skeleton") * 8 + F.size("_rule") * 16)).first()[0] or 0
    joined = rows.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "_skeleton")
    items = F.transform("_rule", lambda picks: F.regexp_replace(F.array_join(F.transform(picks, lambda i: F.element_at(F.col("_runs"), i + 1)), ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    out = joined.select(F.col("_key").alias(key), F.col("_field").alias("field_name"), F.posexplode(items).alias("_pos", "item"))
    return out.select(key, "field_name", (F.col("_pos") + 1).cast("int").alias("item_pos"), "item")
