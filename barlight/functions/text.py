"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a headline, and words too frequent to group by.
HEADLINE_STOPWORDS = ["a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"]
BLOCKING_STOPWORDS = ["ai", "chip", "chips", "company", "companies", "market", "markets", "new", "news", "says", "shares", "stock", "stocks", "tech", "technology"]
#: Words left out of word rankings.
RANKING_STOPWORDS = [
    "the", "and", "to", "of", "a", "in", "for", "on", "is", "with", "that", "as", "at", "by", "from", "it", "this", "be", "are", "an",
    "was", "or", "will", "has", "have", "its", "more", "about", "their", "they", "but", "not", "can", "into", "than", "also", "after",
    "over", "new", "up", "down", "how", "why", "what", "s", "t",
]
WORD = "[a-z0-9]+(?:'[a-z0-9]+)?"


def normalize_text(text: Column) -> Column:
    """Lower case, web addresses dropped, anything but a-z and 0-9 one space; null is empty."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def term_present(normalized: Column, term: str) -> Column:
    """Whether a normalised text holds a term as whole words; an empty term never occurs."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in term.lower()).split()
    if not words:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), normalized, F.lit(" ")), F.lit(f" {' '.join(words)} "))


def matched_terms(normalized: Column, terms: list[str]) -> Column:
    """The terms that occur, in the order of the list."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(term_present(normalized, t), F.lit(t)) for t in terms]))


def split_words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def headline_tokens(text: Column) -> Column:
    """Distinct words of two or more letters without stop words."""
    words = F.array_distinct(F.filter(split_words(normalize_text(text)), lambda w: F.length(w) > 1))
    return F.array_except(words, F.array(*map(F.lit, HEADLINE_STOPWORDS)))


def blocking_tokens(text: Column, extra: list[str] | None = None) -> Column:
    """Headline tokens that are specific enough to look for partners by."""
    return F.array_except(headline_tokens(text), F.array(*map(F.lit, BLOCKING_STOPWORDS + list(extra or []))))


def word_tokens(text: Column) -> Column:
    """Words of lower-cased text, an apostrophe inside a word kept; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def split_tags(text: Column) -> Column:
    """Items between commas or semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def join_distinct(items: Column, separator: str = "|") -> Column:
    """Items joined once each, in the order of their first occurrence."""
    return F.array_join(F.array_distinct(items), separator)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint number of distinct items; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def safe_link(url: Column) -> Column:
    """The address if it is http or https, else null."""
    return F.when(F.lower(url).rlike("^https?://"), url)


def to_number(text: Column) -> Column:
    """Double of a text, null if it is none."""
    return F.trim(text).try_cast("double")


def state_text(state: Column) -> Column:
    """What a coverage state means, in words."""
    return (
        F.when(state == "success", "collected, no known problem")
        .when(state == "success_empty_unverified", "the provider returned nothing; whether nothing existed is not verified")
        .when(state.contains("truncation"), "the response may be cut off")
        .when(state.startswith("failed"), "the request failed")
        .when(state.startswith("unavailable"), "the provider refused the request")
        .when(state == "no_terminal_request", "no finished request covers the day")
        .when(state == "outside_collected_date_range", "outside the range that was collected")
        .otherwise("unknown state")
    )
