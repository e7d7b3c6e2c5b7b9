"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DEFAULT_PORT = r"^(http://[^/?#:]+):80(?=[/?#]|$)|^(https://[^/?#:]+):443(?=[/?#]|$)"


def normalize_url(c: Column) -> Column:
    """Canonical form: scheme and host in lower case, no fragment, default port or trailing slash (but of the
    root), query parameters sorted by name, stably. What is no URL is trimmed and loses fragment and slash.
    """
    s = F.trim(c)
    bare = F.regexp_replace(s, "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)", 1)
    is_url = head != ""
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(parts, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("n"), i.alias("i"), p.alias("p")))
    ordered = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    whole = F.concat(F.regexp_replace(F.lower(head), _DEFAULT_PORT, "$1$2"), path, F.when(ordered == "", F.lit("")).otherwise(F.concat(F.lit("?"), ordered)))
    whole = F.when(path == "/", whole).otherwise(F.regexp_replace(whole, "/$", ""))
    return F.when(is_url, whole).otherwise(F.regexp_replace(bare, "/$", ""))


def bridge_url(c: Column) -> Column:
    """The crawler's looser form: no fragment, no trailing slashes."""
    cut = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", "")
    scheme = F.regexp_extract(cut, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.when(F.contains(c, F.lit("#")), F.concat(F.lower(scheme), F.substring(cut, F.length(scheme) + 1, F.length(cut)))).otherwise(cut)


def host(c: Column) -> Column:
    """Host in lower case without ``www.``; empty where there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(found, r"^www\.", "")


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are resolved; ``..`` at the root stays there."""
    parts = F.split(path, "/")
    ends = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == ".", out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))


def absolutize(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base`` (absolute, //host, /path, ?query and relative forms, with ``.`` and ``..``)
    and normalised; empty if none fits."""
    h = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(bare, r"(?<=[^/:])/[^/]*$", "")
    out = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(root == "", F.lit(""))
        .when(h.startswith("?"), F.concat(bare, h))
        .otherwise(F.concat(folder, F.lit("/"), h))
    )
    head = F.regexp_extract(out, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    rest = F.substring(out, F.length(head) + 1, F.length(out))
    path, tail = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1)
    tidy = F.when(F.concat(path, F.lit("/")).rlike(r"/\.{1,2}/"), F.concat(head, without_dots(path), tail)).otherwise(out)
    return F.when(out == "", out).otherwise(normalize_url(tidy))


def matches_any(url: Column, patterns: Column) -> Column:
    """Whether a URL fits one of an array of wildcard patterns (``*`` only, case-sensitive, anchored)."""
    like = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_")), F.lit("%"), F.lit("\\%"))
    return F.exists(patterns, lambda p: F.like(url, F.replace(like(p), F.lit("*"), F.lit("%"))))


def sitemap_locs(xml: Column) -> Column:
    """The locations of a sitemap, in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]+)\s*</loc>"), 1), lambda x: F.trim(x))


def links(html: Column, base: Column) -> Column:
    """Targets of href attributes and link elements, absolute; in-page, mail, phone and script links left out."""
    found = F.concat(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), 1), F.regexp_extract_all(html, F.lit(r"(?i)<link>\s*([^<]+)\s*</link>"), 1))
    usable = F.filter(found, lambda h: ~(h.startswith("#") | h.startswith("mailto:") | h.startswith("tel:") | h.startswith("javascript:")))
    return F.filter(F.transform(usable, lambda h: absolutize(base, h)), lambda u: u != "")


def feed_items(xml: Column) -> Column:
    """Items of an RSS or Atom feed in order: structs of link and title. Items without a link have an empty one."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)
    link = lambda x: F.coalesce(F.nullif(F.trim(F.regexp_extract(x, r"(?is)<link[^>]*>\s*([^<]+?)\s*</link>", 1)), F.lit("")), F.regexp_extract(x, r"(?is)<link[^>]*href=[\"']([^\"']+)", 1))
    return F.transform(items, lambda x: F.struct(F.replace(link(x), F.lit("&amp;"), F.lit("&")).alias("link"), F.trim(F.regexp_extract(x, r"(?is)<title[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>", 1)).alias("title")))
