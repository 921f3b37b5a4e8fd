"""Queries of the training-data operators over their whole tables, and the SQL they are checked against."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.leakage import leaked_items
from barlight.llm.lookalikes import lookalike_members, lookalike_pairs
from barlight.llm.nearest import article_bars
from barlight.llm.neardups import SimilarSets
from barlight.llm.survivors import best_records, surviving_members, surviving_records
from barlight.llm.terms import term_counts
from barlight.llm.tokens import decoded, encoded
from barlight.plans.sql_times import ARTICLE_TIMES
from barlight.sources.tables import all_bars, table

TEXT = ["headline", "summary"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of articles whose sets of terms are similar."""
    pairs = SimilarSets(table(spark, folder, "articles"), "article_id", TEXT).pairs()
    return pairs.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The class, group and number of links of every article."""
    groups = SimilarSets(table(spark, folder, "articles"), "article_id", TEXT).groups()
    return groups.withColumnRenamed("key", "article_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return term_counts(table(spark, folder, "articles"), TEXT).where(F.col("mark") != "kept").select("term", "mark")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every term."""
    return term_counts(table(spark, folder, "articles"), TEXT)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The member of each duplicate group whose value of each field survives."""
    return surviving_members(table(spark, folder, "articles"), table(spark, folder, "feeds"))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record per duplicate group."""
    return surviving_records(table(spark, folder, "articles"), table(spark, folder, "feeds"))


def p5_best(spark: SparkSession, folder: str) -> DataFrame:
    """The whole record of each duplicate group that is most complete, trusted and recent."""
    return best_records(table(spark, folder, "articles"), table(spark, folder, "feeds"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return article_bars(table(spark, folder, "articles"), all_bars(spark, folder), table(spark, folder, "session_calendar"), table(spark, folder, "feeds"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each article with the bar of its ticker whose session close is nearest."""
    return _pairs(spark, folder).select("article_id", "bar_id")


def p7_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with the signed distance in seconds."""
    return _pairs(spark, folder)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, folder, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document decoded from its token ids again."""
    return decoded(p8_ids(spark, folder), "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 12 consecutive words of an item, or a whole shorter one."""
    found = leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "item_id", radius=3)
    return found.where(F.col("verbatim")).select("doc_id", "item_id")


def p9_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage like an item's, with the best similarity."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but differ in their characters."""
    return lookalike_pairs(table(spark, folder, "documents"), "doc_id", "text")


def p10_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical member of each document that has look-alikes."""
    return lookalike_members(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "canonical", "variants")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_records": p5_records, "p5_best": p5_best, "p7_found": p7_found, "p7_gaps": p7_gaps}
QUERIES |= {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_similar": p9_similar, "p10_found": p10_found, "p10_canonical": p10_canonical}

_TERMS_SQL = """
WITH texts AS (SELECT article_id, lower(coalesce(headline, '') || ' ' || coalesce(summary, '')) AS t FROM articles),
tokens AS (SELECT article_id, unnest(regexp_extract_all(t, '[a-z0-9]+(?:''[a-z0-9]+)?')) AS term FROM texts),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT article_id) AS records FROM tokens GROUP BY term),
marked AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM articles) THEN 'common' ELSE 'kept' END AS mark FROM counts)
"""

_MISSING = r"regexp_replace(lower({0}), '^\s+|\s+$', '', 'g') IN ('', '-', '--', 'n/a', 'null', 'none')"
_SURVIVORS_SQL = f"""
WITH {ARTICLE_TIMES},
long AS (SELECT duplicate_group_id, article_id, trust_rank, utc, unnest(['headline', 'summary', 'url', 'image_url']) AS field_name,
  unnest([headline, summary, url, image_url]) AS v FROM art WHERE duplicate_group_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY duplicate_group_id, field_name ORDER BY trust_rank NULLS LAST, utc DESC NULLS LAST, article_id) AS rn
  FROM long WHERE v IS NOT NULL AND NOT {_MISSING.format('v')}),
winners AS (SELECT * FROM ranked WHERE rn = 1 AND duplicate_group_id IN (SELECT duplicate_group_id FROM articles GROUP BY 1 HAVING count(*) > 1))
"""
_NEAREST_SQL = f"""
WITH {ARTICLE_TIMES},
bars AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trading_date ORDER BY loaded_at DESC NULLS LAST, bar_id DESC) AS rn
  FROM (SELECT * FROM core_bars UNION ALL SELECT * FROM daily_bars)) WHERE rn = 1),
closes AS (SELECT ticker, bar_id, epoch_us(market_close_utc) AS c FROM bars JOIN session_calendar ON session_date = trading_date),
near AS (SELECT article_id, bar_id, epoch_us(utc) - c AS gap, row_number() OVER (PARTITION BY article_id ORDER BY abs(epoch_us(utc) - c), c) AS rn
  FROM art JOIN closes ON ticker = provider_related AND abs(epoch_us(utc) - c) <= 72000000000)
"""

# written by Latin letter, apart from the operator's table, which is by script
_DRAWN_ALIKE = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "ꓝ", "G": "ԌᏀᏩꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀꓲ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦꓗ", "L": "Ꮮꓡ", "M": "ΜМϺᎷꓟ",
    "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "Ꮢꓣ", "S": "ЅᏚꓢ", "T": "ΤТꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳᏔꓪ", "X": "ΧХꓫ", "Y": "ΥУҮᎽꓬ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "μ": "\xb5", "-": "‐‑",
}
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SINGLE = [(x, k) for k, v in _DRAWN_ALIKE.items() for x in v]
_SINGLE += list(zip("ӓӧӱёӗӑїӒӦӰЁѐЀЇόὸὰΆΈΊΌΎΪΫᾺῈῸῚ", "äöÿëĕăïÄÖŸËèÈÏóòὰÁÉÍÓÝÏŸÀÈÒÌ"))  # composed: this side maps composed text
_SINGLE += [(chr(c + 0xFEE0), chr(c)) for c in range(0x21, 0x7F)] + list(zip("￠￡￥￦", "¢£¥₩"))
_SINGLE += [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xFF61, 0xFFA0)]
_SINGLE += [(chr(0x1D400 + 52 * k + i), x) for k in range(13) for i, x in enumerate(_PLAIN)] + [(chr(0x1D7CE + 10 * k + i), str(i)) for k in range(5) for i in range(10)]
_SINGLE += list(zip("ℂℊℋℌℍℎℐℑℒℓℕℙℚℛℜℝℤℨℬℭℯℰℱℳℴℹ", "CgHHHhIILlNPQRRRZZBCeEFMoi")) + list(zip("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"))
_LONGER = dict(zip("ﬀﬁﬂﬃﬄﬅﬆ", ["ff", "fi", "fl", "ffi", "ffl", "st", "st"])) | {"…": "...", "‥": "..", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž"}
_LONGER |= dict(zip("ⅡⅢⅣⅥⅦⅧⅨⅪⅫⅱⅲⅳⅵⅶⅷⅸⅺⅻ", "II III IV VI VII VIII IX XI XII ii iii iv vi vii viii ix xi xii".split()))
_FROM, _TO = ("".join(x[i] for x in _SINGLE).replace("'", "''") for i in (0, 1))
_SEEN = "nfc_normalize(regexp_replace(text, '[\\p{Cf}\\x{FE00}-\\x{FE0F}]', '', 'g'))"
_ALIKE_SQL = f"""
WITH mapped AS (SELECT doc_id, text, nfc_normalize({reduce(lambda x, y: f"replace({x}, '{y[0]}', '{y[1]}')", _LONGER.items(), f"translate({_SEEN}, '{_FROM}', '{_TO}')")}) AS m FROM documents WHERE text IS NOT NULL),
shown AS (SELECT doc_id, text, trim(regexp_replace(m, '[\\s\\p{{Z}}]+', ' ', 'g')) AS s FROM mapped)
"""
_SETS_SQL = """
WITH sets AS (SELECT article_id, list_distinct(regexp_extract_all(lower(coalesce(headline, '') || ' ' || coalesce(summary, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS w FROM articles),
terms AS (SELECT article_id, len(w) AS n, unnest(w) AS term FROM sets WHERE len(w) >= 20),
shared AS (SELECT a.article_id AS article_id_a, b.article_id AS article_id_b, a.n + b.n AS total, count(*) AS common
  FROM terms AS a JOIN terms AS b ON a.term = b.term AND a.article_id < b.article_id GROUP BY 1, 2, 3)
"""

SQL = {
    "p2_found": _SETS_SQL + "SELECT article_id_a, article_id_b FROM shared WHERE 10 * common >= 6 * (total - common)",
    "p2_groups": _SETS_SQL.split("terms AS")[0].replace("WITH sets", "WITH RECURSIVE sets") + """own AS (SELECT article_id, w, min(article_id) OVER (PARTITION BY list_sort(w)) AS set_id FROM sets WHERE len(w) >= 20),
terms AS (SELECT set_id, len(w) AS n, unnest(w) AS term FROM own WHERE article_id = set_id),
shared AS (SELECT a.set_id AS x, b.set_id AS y, a.n + b.n AS total, count(*) AS common FROM terms AS a JOIN terms AS b ON a.term = b.term AND a.set_id <> b.set_id GROUP BY 1, 2, 3),
edges AS (SELECT x, y FROM shared WHERE 10 * common >= 6 * (total - common)),
reach AS (SELECT DISTINCT set_id AS x, set_id AS y FROM own UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y)
SELECT article_id, set_id, (SELECT min(y) FROM reach WHERE x = set_id) AS group_id, (SELECT count(*) FROM edges WHERE x = set_id) AS links FROM own""",
    "p5_found": _SURVIVORS_SQL + "SELECT duplicate_group_id, field_name, article_id FROM winners",
    "p5_records": _SURVIVORS_SQL + "SELECT duplicate_group_id, " + ", ".join(f"min(CASE WHEN field_name = '{f}' THEN v END) AS {f}" for f in ("headline", "summary", "url", "image_url")) + " FROM winners GROUP BY duplicate_group_id",
    "p5_best": f"WITH {ARTICLE_TIMES}, f AS (SELECT *, " + " + ".join(f"CAST(NOT ({c} IS NULL OR {_MISSING.format(c)}) AS INT)" for c in ("headline", "summary", "url", "image_url"))
    + """ AS filled FROM art WHERE duplicate_group_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY filled DESC, trust_rank NULLS LAST, utc DESC NULLS LAST, article_id) AS rn, count(*) OVER (PARTITION BY duplicate_group_id) AS members FROM f)
SELECT duplicate_group_id, article_id, filled, members FROM r WHERE rn = 1 AND members > 1""",
    "p7_found": _NEAREST_SQL + "SELECT article_id, bar_id FROM near WHERE rn = 1",
    "p7_gaps": _NEAREST_SQL + "SELECT article_id, bar_id, gap / 1e6 AS seconds_after FROM near WHERE rn = 1",
    "p4_found": _TERMS_SQL + "SELECT term, mark FROM marked WHERE mark <> 'kept'",
    "p4_counts": _TERMS_SQL + "SELECT term, occurrences, records, mark FROM marked",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": """
WITH dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 12) AS size FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM sized),
shown AS (SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size))
SELECT DISTINCT doc_id, item_id FROM shown JOIN windows USING (size, k)""",
    "p10_found": _ALIKE_SQL + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM shown AS a JOIN shown AS b ON a.s = b.s AND a.doc_id < b.doc_id AND a.text <> b.text WHERE a.s <> ''",
    "p10_canonical": _ALIKE_SQL + ", c AS (SELECT s, min(doc_id) AS canonical, count(DISTINCT text) AS variants FROM shown WHERE s <> '' GROUP BY s HAVING count(DISTINCT text) > 1) SELECT doc_id, canonical, variants FROM shown JOIN c USING (s)",
}
