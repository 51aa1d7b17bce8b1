"""Text and URL expressions, all of them column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that change while a state stays the same.
VOLATILE = (
    r"\d{1,2}:\d{2}",
    r"\(\s*\d+\s*\)",
    r"^\s*[\d.,]+\s*%?\s*$",
    r"(?i)\b\d+\s+(unread|items?|messages?|results?|files?|photos?|selected)\b",
    r"(?i)\b(just now|\d+\s+(seconds?|minutes?|hours?|days?)\s+ago)\b",
    r"(?i)\b\d+\s*(KB|MB|GB|TB)\b",
    r"^\s*(Edited|Modified)\s*$",
)
# Path segments that name one thing rather than a place.
ID_LIKE = (r"^\d+$", r"(?i)^[0-9a-f]{8,}$", r"(?i)^[0-9a-f]{8}-[0-9a-f-]{8,}$", r"^(?=.*\d)[A-Za-z0-9_-]{16,}$")


def volatile(label: Column) -> Column:
    """Whether a label is a clock, a counter, a size, a relative time or the like."""
    hit = F.lit(False)
    for pattern in VOLATILE:
        hit = hit | label.rlike(pattern)
    return hit


def non_speech(text: Column) -> Column:
    """Whether a transcript is nothing but a bracketed annotation."""
    return text.rlike(r"^\s*[(\[*][^)\]*]*[)\]*]\s*$")


def url_prefix(url: Column) -> Column:
    """Host without www and up to three path segments that are not ids; null where the URL names no site."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path = F.split(F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/")
    decoded = F.transform(F.filter(path, lambda s: s != ""), lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))

    def keeps(s: Column) -> Column:
        hit = F.lit(False)
        for pattern in ID_LIKE:
            hit = hit | s.rlike(pattern)
        return ~hit

    place = F.array_join(F.concat(F.array(host), F.slice(F.filter(decoded, keeps), 1, 3)), "/")
    return F.when(url.rlike("(?i)^https?://") & (host != ""), place)


def url_terms(url: Column) -> Column:
    """The URL itself and its bare host without port."""
    return F.array_distinct(F.array(url, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; any punctuation separates."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")
