"""SQL for the instants and dates that timestamp texts fix, shared by several checks."""

from __future__ import annotations

_OFFSETS = "WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CST' THEN -360 WHEN 'CDT' THEN -300 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'BST' THEN 60 WHEN 'GMT' THEN 0 WHEN 'UTC' THEN 0 WHEN 'Z' THEN 0"
_FORMATS = "'%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M', '%b %d, %Y %I:%M %p', '%Y%m%dT%H%M%S', '%a, %d %b %Y %H:%M:%S'"
_DATES = "'%Y-%m-%d', '%Y%m%d', '%Y/%m/%d', '%d-%b-%Y', '%a %d %b %Y', '%b %d, %Y', '%B %d, %Y'"


def parsed(name: str, source: str, dates: bool = False) -> str:
    """CTEs ending in ``name``: the columns of ``source`` (which has text, day_first, zone) with
    ``inst`` and ``local``, both TIMESTAMP, null where nothing is fixed."""
    more = f", {_DATES}" if dates else ""
    dmy = (", '%d/%m/%y', '%d/%m/%Y'", ", '%m/%d/%y', '%m/%d/%Y'") if dates else ("", "")
    return f"""
{name}_a AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM {source}),
{name}_b AS (SELECT *, CASE WHEN regexp_matches(s, ':[0-9][0-9]|[0-9]T[0-9]') THEN regexp_extract(s, '([Zz]| ?(?:UTC|[A-Z]{{3,4}})| ?[+-][0-9]{{2}}:?[0-9]{{2}})$', 1) ELSE '' END AS z FROM {name}_a),
{name}_c AS (SELECT *, regexp_replace(trim(left(s, length(s) - length(z))), '([.][0-9]{{6}})[0-9]+$', '\\1') AS body, upper(trim(z)) AS zz FROM {name}_b),
{name}_d AS (SELECT *,
  CASE WHEN day_first THEN try_strptime(body, [{_FORMATS}, '%d/%m/%Y %H:%M', '%d/%m/%Y %I:%M %p', '%d.%m.%Y %H:%M'{dmy[0]}{more}])
       ELSE try_strptime(body, [{_FORMATS}, '%m/%d/%Y %H:%M', '%m/%d/%Y %I:%M %p'{dmy[1]}{more}]) END AS wall,
  CASE WHEN zz = '' THEN NULL WHEN zz[1] IN ('+', '-') THEN (CASE WHEN zz[1] = '-' THEN -1 ELSE 1 END) * (CAST(zz[2:3] AS INT) * 60 + CAST(right(zz, 2) AS INT)) ELSE CASE zz {_OFFSETS} END END AS off_min
  FROM {name}_c),
{name} AS (SELECT *,
  CASE WHEN regexp_full_match(s, '[0-9]{{10}}') THEN make_timestamp(CAST(s AS BIGINT) * 1000000)
       WHEN regexp_full_match(s, '[0-9]{{13}}') THEN make_timestamp(CAST(s AS BIGINT) * 1000)
       WHEN regexp_full_match(s, '[0-9]{{16}}') THEN make_timestamp(CAST(s AS BIGINT))
       WHEN zz <> '' THEN wall - to_minutes(off_min) END AS inst,
  CASE WHEN zz = '' AND NOT regexp_full_match(s, '[0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}}') AND (NOT regexp_matches(s, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)') OR strftime(wall, '%a') = s[1:3]) THEN wall END AS local
  FROM {name}_d)"""


def placed(name: str, source: str) -> str:
    """CTEs ending in ``name``: ``source`` with ``utc``, the instant or the local time in its zone."""
    return f"""
{name}_e AS (SELECT *, local - ((local - INTERVAL 1 DAY) - timezone('UTC', timezone(zone, local - INTERVAL 1 DAY))) AS b,
  local - ((local + INTERVAL 1 DAY) - timezone('UTC', timezone(zone, local + INTERVAL 1 DAY))) AS a FROM {source}),
{name}_f AS (SELECT *, timezone(zone, timezone('UTC', b)) = local AS ok_b, timezone(zone, timezone('UTC', a)) = local AS ok_a FROM {name}_e),
{name} AS (SELECT *, CASE WHEN inst IS NOT NULL THEN inst WHEN ok_b AND ok_a THEN (CASE WHEN a = b THEN a END) WHEN ok_b THEN b WHEN ok_a THEN a END AS utc FROM {name}_f)"""


ARTICLE_TIMES = (
    "art_src AS (SELECT a.*, a.published_at_utc AS text, f.day_first, f.trust_rank, 'UTC' AS zone FROM articles AS a LEFT JOIN feeds AS f ON f.source = a.source),"
    + parsed("art_p", "art_src") + "," + placed("art", "art_p")
)
RAW_TIMES = (
    "raw_src AS (SELECT r.obs_id, r.\"datetime\" AS text, f.day_first, f.feed_zone AS zone FROM raw_articles AS r LEFT JOIN feeds AS f ON f.source = r.source),"
    + parsed("raw_p", "raw_src") + "," + placed("raw", "raw_p")
)
BAR_DATES = (
    "feed_src AS (SELECT r.feed_row_id, r.trading_date AS text, f.day_first, f.feed_zone AS zone FROM bar_feed AS r LEFT JOIN feeds AS f ON f.source = r.source),"
    + parsed("feed_p", "feed_src", dates=True)
)
P3 = f"""
WITH {RAW_TIMES}, {ARTICLE_TIMES}, {BAR_DATES}
SELECT 'raw_articles' AS src_table, obs_id AS rec_id, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') AS norm FROM raw WHERE utc IS NOT NULL
UNION ALL SELECT 'articles', article_id, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') FROM art WHERE utc IS NOT NULL
UNION ALL SELECT 'bar_feed', feed_row_id, strftime(CASE WHEN inst IS NOT NULL THEN timezone('America/New_York', timezone('UTC', inst)) ELSE local END, '%Y-%m-%d')
  FROM feed_p WHERE coalesce(inst, local) IS NOT NULL"""
