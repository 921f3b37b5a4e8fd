"""Texts that look the same but differ in their characters.

Typographic quotes, dashes and the minus sign are drawn unlike the plain ones, as are raised and
circled forms: they are marks of their own and stay. Look-alike characters are mapped by rule and table, then values are grouped under Spark's UNICODE
collation, which tells case and accents apart but not composed from decomposed letters or text with
and without invisible characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from barlight.session import written

#: Fixed values, by script: letters drawn like the Latin letter below them.
ALIKE = (
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿνορϲϳ", "ABEZHIKMNOPTYXCMJvopcj"),
    # Cyrillic
    ("АВЕІЈКМНОРСТУХЅѴҮӀԌԚԜ", "ABEIJKMHOPCTYXSVYIGQW"),
    ("аеорсухіјѕһѵүӏԁԛԝ", "aeopcyxijshvyldqw"),
    # Armenian
    ("ՍՕհոսօ", "UOhnuo"),
    # Cherokee
    ("ᎠᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏩᏴ", "DAJEWMHYGZRWVSLCPKGB"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Latin letters for phonetic use
    ("ɡᴄᴏᴠᴡᴢ", "gcovwz"),
    # signs
    ("\xb5‐‑", "μ--"),
)
#: Compatibility characters drawn like several letters, or like another one.
COMPAT = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫⅬⅭⅮⅯⅰⅱⅲⅳⅴⅵⅶⅷⅸⅹⅺⅻⅼⅽⅾⅿĲĳǄǅǆǇǈǉǊǋǌǱǲǳﬀﬁﬂﬃﬄﬅﬆ‥…"
_PICTURE = "[\u2600-\u27bf\U0001f000-\U0001faff]"
#: A joiner between two pictures makes one picture of them.
_JOINED = re.compile(f"({_PICTURE}\ufe0f?)\u200d(?={_PICTURE})")


@cache
def _table() -> dict[int, str | None]:
    """One table for a single pass over a text: gaps become spaces, invisible characters go, full-width,
    half-width and font forms (mathematical letters) become plain by their Unicode decomposition, the
    characters of the tables above by these."""
    table: dict[int, str | None] = {}
    alike = {ord(x): y for a, b in ALIKE for x, y in zip(a, b, strict=True)}
    for c in (*range(0x20000), *range(0xE0000, 0xE1000)):
        kind = unicodedata.category(chr(c))
        if chr(c).isspace() or kind in ("Zs", "Zl", "Zp"):
            table[c] = " "
        elif kind in ("Cf", "Cc") or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= c <= 0x180F or 0xFE00 <= c <= 0xFE0F:
            table[c] = None
        else:
            kind, _, parts = unicodedata.decomposition(chr(c)).partition(" ")
            if kind in ("<wide>", "<narrow>", "<font>") or kind == "<compat>" and chr(c) in COMPAT:
                plain = unicodedata.normalize("NFKD", chr(c)) if kind == "<compat>" else "".join(chr(int(x, 16)) for x in parts.split())
                table[c] = plain.translate(alike)
    return table | alike


@cache
def _special() -> re.Pattern[str]:
    """Anything that mapping or canonical order may change, gaps aside: most texts hold none of it."""
    marks = [c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]
    table = _table()
    # letters with marks whose plain letter is mapped
    composed = [c for c in range(0xC0, 0x10000) if c not in table and any(table.get(ord(x), " ") != " " for x in unicodedata.normalize("NFD", chr(c)))]
    points = sorted({c for c, to in table.items() if to != " " and c < 0x10000} | set(marks) | set(composed) | {0x37E, 0x1FEF, 0x212A})
    # within the basic plane the class is a bitmap; all characters beyond it count as special
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in points) + "]|[\U00010000-\U0010ffff]")


def shown_text(text: str) -> str:
    """The text with look-alikes mapped, gaps made one space and invisible characters removed.

    Marks are taken off their letters for the mapping and put back afterwards, in canonical order,
    since collation compares them in that order only. A joiner between two pictures is kept as a
    mark of its own.
    """
    if not _special().search(text):
        return " ".join(text.split())
    if "\u200d" in text:
        text = _JOINED.sub("\\1\ue000", text)
    plain = unicodedata.normalize("NFD", text).translate(_table())
    return " ".join(unicodedata.normalize("NFC", plain).split())


@F.pandas_udf(StringType())
def mapped(texts: pd.Series) -> pd.Series:
    """``shown_text`` of every value, null for null.

    As column expressions this took 20 times the CPU: one translation table does in C what takes
    the engine eight regular expressions and a character map.
    """
    return texts.map(shown_text, na_action="ignore")


# a filter on the result would else be pushed below it and run the function a second time
mapped = mapped.asNondeterministic()


def _plain(shown: Column) -> Column:
    """Digest of the plain ASCII a mapped text shows: the same for all texts of a class.

    Letters with marks may be written composed or not, so both forms are left out.
    """
    return F.xxhash64(F.when(shown.rlike(r"\p{M}"), F.regexp_replace(shown, r"[A-Za-z]\p{M}+|[^\x21-\x7E]+", "")).otherwise(F.regexp_replace(shown, r"[^\x21-\x7E]+", "")))


def lookalike_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, variant, canonical, variants) of every row in a class with at least two different texts.

    ``variant`` is the digest of the row's own text, ``canonical`` the smallest key of the class and
    ``variants`` how many different texts it holds. Null texts and those without a visible
    character belong to no class; rows that only repeat a text form none; a repeated key keeps its
    rows.

    First only digests are shuffled: one of the text, one of the plain ASCII it shows, which is the
    same for all of a class. Groups with a single text, among them all masses of exact copies, go
    no further. Only the rest are mapped a second time, and grouped exactly under the collation, one
    row per different text, so a class costs its variants, not its copies.
    """
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shown = lambda d: d.withColumn("_mapped", mapped(F.col("_text"))).where(F.col("_mapped") != "").withColumn("_plain", _plain(F.col("_mapped")))
    digests = written(shown(texts).select("_key", "_plain", F.md5("_text").alias("_variant")), "alike-digests")
    groups = digests.groupBy("_plain").agg(F.min("_variant").alias("_lo"), F.max("_variant").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("_plain")
    # as a table its size is known: small, it is broadcast and no text is shuffled; large, it is not
    keys = written(digests.join(groups, "_plain", "left_semi").select("_key", "_variant").distinct(), "alike-keys")
    again = texts.join(keys.select("_key").distinct(), "_key", "left_semi").withColumn("_variant", F.md5("_text"))
    some = written(shown(again.join(keys, ["_key", "_variant"], "left_semi")).select("_key", "_mapped", "_plain", "_variant"), "alike-rows")
    spark = df.sparkSession
    return spark.sql(
        """
        WITH variants AS (
          SELECT _plain, _variant, min(_key) AS first_key, min(_mapped) COLLATE UNICODE AS shown
          FROM {some} GROUP BY _plain, _variant),
        classes AS (
          SELECT _plain, shown, min(first_key) AS canonical, count(*) AS variants
          FROM variants GROUP BY _plain, shown HAVING count(*) > 1),
        placed AS (
          SELECT v._plain, v._variant, c.canonical, c.variants
          FROM variants v JOIN classes c ON v._plain = c._plain AND v.shown = c.shown)
        SELECT s._key, p._variant AS variant, p.canonical, p.variants
        FROM {some} s JOIN placed p ON s._plain = p._plain AND s._variant = p._variant
        """,
        some=some,
    ).withColumnRenamed("_key", key)


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """({key}_a, {key}_b), a < b, of all rows whose texts look the same but differ as strings.

    Pairs of variants come first and are then joined with their rows, so the work is that of the
    result: copies of one text are never compared with each other.
    """
    members = written(lookalike_members(df, key, text).select(key, "variant", "canonical"), "alike-members")
    kinds = members.select("canonical", "variant").distinct()
    two = kinds.alias("x").join(kinds.alias("y"), (F.col("x.canonical") == F.col("y.canonical")) & (F.col("x.variant") < F.col("y.variant"))).select(F.col("x.canonical").alias("c"), F.col("x.variant").alias("v"), F.col("y.variant").alias("w"))
    left = members.select(F.col("canonical").alias("c"), F.col("variant").alias("v"), F.col(key).alias("_p"))
    right = members.select(F.col("canonical").alias("c"), F.col("variant").alias("w"), F.col(key).alias("_q"))
    pairs = two.join(left, ["c", "v"]).join(right, ["c", "w"])
    return pairs.select(F.least("_p", "_q").alias(f"{key}_a"), F.greatest("_p", "_q").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b")).distinct()
