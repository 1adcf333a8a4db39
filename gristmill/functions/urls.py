"""Parts of URLs, as columns; no error on any text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, words

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"[\[\]]", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def domain(url: Column) -> Column:
    """``local`` for files, else the host."""
    return F.when(F.lower(url).startswith("file:"), "local").otherwise(hostname(url))


def excluded(url: Column, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    host = hostname(url)
    found = F.lit(False)
    for d in domains:
        found = found | (host == d) | host.endswith("." + d)
    return found


def clean_id(raw: Column) -> Column:
    """An identifier without the marks that passage ids use."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(text, r"^<urn:uuid:(.*)>$", "$1")
    return F.translate(bare, ": ", "--")


def article_of(passage_id: Column) -> Column:
    """The passage's article: all before the last colon, or the whole id."""
    return F.regexp_replace(passage_id, r"(?s)^(.+):[^:]*$", "$1")


def looks_like_title(line: Column) -> Column:
    n = F.size(words(line))
    return (n >= 1) & (n <= 12) & (F.length(line) <= 100) & ~F.substring(line, -1, 1).isin(".", ";", ":", ",")


def url_title(url: Column) -> Column:
    """The last telling segment of the path as words, or the host."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    plain = F.transform(segments, lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    bare = F.transform(plain, lambda s: collapsed(F.regexp_replace(F.regexp_replace(s, r"(?i)[.](?:html?|php\d?|aspx?|jsp|shtml|cfm|cgi)$", ""), "[-_+]+", " ")))
    telling = F.filter(F.reverse(bare), lambda s: (F.length(s) >= 3) & ~F.rlike(s, F.lit(r"^[\p{Nd} ]+$")))
    first = F.try_element_at(telling, F.lit(1))
    named = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 20))
    return F.substring(F.coalesce(named, hostname(url)), 1, 100)
