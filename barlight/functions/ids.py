"""Stable identifiers from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlight.functions.text import normalize_text

SEPARATOR = "\u001f"


def stable_id(prefix: str, values: list[Column], length: int = 16) -> Column:
    """prefix_ and the first digits of the SHA-256 of the values' texts; a null value reads None."""
    text = F.concat_ws(SEPARATOR, *[F.coalesce(v.cast("string"), F.lit("None")) for v in values])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, length))


def row_key(columns: list[str], length: int = 24) -> Column:
    """Digest of a whole row: its columns by name as JSON."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(row, 256), 1, length)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def canonical_key(article_id: Column, url: Column, published: Column, headline: Column) -> Column:
    """What tells an item: its id, else its address, else its time and headline."""
    return first_filled(article_id, url, F.concat_ws("|", F.coalesce(published, F.lit("")), normalize_text(headline)))
