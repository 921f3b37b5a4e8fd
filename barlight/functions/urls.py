"""Web addresses in one canonical form, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track a reader; so does every key starting with utm_.
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]


def _recoded(part: Column) -> Column:
    """Percent-decoded and encoded again, so that equal values are written alike."""
    coded = F.url_encode(F.coalesce(F.try_url_decode(part), part))
    return F.replace(F.replace(coded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, default ports, fragments, tracking keys and doubled or final
    slashes dropped, the query sorted by key and value; https where no scheme is given.

    Null and blank give an empty text.
    """
    text = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "#.*$", "")
    authority = F.regexp_extract(rest, r"^//([^/?]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), host).otherwise(F.concat(host, F.lit(":"), port))
    after = F.regexp_replace(rest, r"^//[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(after, r"^([^?]*)", 1), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(after, r"\?(.*)$", 1)
    fields = F.filter(F.split(query, "&"), lambda x: x.contains("="))
    pairs = F.transform(fields, lambda x: F.struct(_recoded(F.substring_index(x, "=", 1)).alias("k"), _recoded(F.regexp_extract(x, "=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~(F.lower(p.k).startswith("utm_") | F.lower(p.k).isin(TRACKING_KEYS)))
    tail = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p.k, F.lit("="), p.v)), "&")
    full = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.when((host == "") & ~path.startswith("/"), F.lit(":")).otherwise(F.lit("://")), shown, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    return F.when(text == "", "").otherwise(full)
