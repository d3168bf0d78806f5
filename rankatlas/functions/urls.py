"""URLs by the generic syntax: parts, resolution of references against a base, and a normal form. Native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankatlas.functions.scalars import let

# The generic syntax's pattern of a reference, and the ports that schemes have by default.
REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
#: What browsers drop from a reference: blanks and control characters at its ends, line breaks and tabs anywhere.
_ENDS, _INNER = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[\t\n\r]"


def _part(url: Column, n: int, there: str) -> Column:
    """A part of a reference; null if its delimiter isn't there, empty if nothing follows it."""
    return F.when(url.rlike(there), F.regexp_extract(url, REFERENCE, n))


def parts(url: Column) -> Column:
    """A struct of scheme, authority, path, query and fragment; the path is null only where the URL is, the others where they are missing."""
    before_query = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?[^?#]*\?"
    return let(url, lambda u: F.struct(
        _part(u, 1, r"^[A-Za-z][A-Za-z0-9+.-]*:").alias("scheme"), _part(u, 2, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//").alias("authority"),
        F.regexp_extract(u, REFERENCE, 3).alias("path"), _part(u, 4, before_query).alias("query"), _part(u, 5, "#").alias("fragment"),
    ))


def without_dots(path: Column) -> Column:
    """A path whose `.` segments are gone and whose `..` segments took the one before along."""
    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s == ".", kept).when(s == "..", up).otherwise(F.concat(kept, F.array(s)))

    def walked(segments: Column) -> Column:
        rooted = (F.size(segments) > 1) & (segments[0] == "")
        inner = F.when(rooted, F.slice(segments, 2, F.size(segments))).otherwise(segments)
        kept = F.aggregate(inner, F.array().cast("array<string>"), step)
        # a dot segment at the end leaves the slash before it
        closed = F.concat(kept, F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
        return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(closed, "/"))

    return let(F.split(path, "/"), walked)


def _written(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    """The parts as one text; what is null is left out with its delimiter."""
    some = lambda before, x, after="": F.coalesce(F.concat(F.lit(before), x, F.lit(after)), F.lit(""))
    return F.concat(some("", scheme, ":"), some("//", authority), path, some("?", query), some("#", fragment))


def resolve(base: Column, reference: Column) -> Column:
    """The target of a reference found in a document at `base`, strictly by the generic syntax; null if either is, or the base has no scheme."""
    def target(x: Column) -> Column:
        b, r = x["b"], x["r"]
        own, full, empty = r["scheme"].isNotNull(), r["authority"].isNotNull(), r["path"] == ""
        merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_extract(b["path"], r"^(.*/)?", 0), r["path"]))
        raw = F.when(own | full | r["path"].startswith("/"), r["path"]).otherwise(merged)
        path = F.when(empty & ~own & ~full, b["path"]).otherwise(without_dots(raw))
        query = F.when(own | full | ~empty | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
        authority = F.when(own | full, r["authority"]).otherwise(b["authority"])
        return F.when(b["scheme"].isNotNull(), _written(F.coalesce(r["scheme"], b["scheme"]), authority, path, query, r["fragment"]))

    return let(F.struct(parts(base).alias("b"), parts(F.regexp_replace(F.regexp_replace(reference, _ENDS, ""), _INNER, "")).alias("r")), target)


def normalized(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no dot segments, a path at least of a slash where there is a host."""
    ports = F.create_map(*(F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv))

    def plain(p: Column) -> Column:
        user, host = F.regexp_extract(p["authority"], r"^(.*@)?", 0), F.lower(F.regexp_replace(p["authority"], r"^.*@", ""))
        needless = lambda h: (F.regexp_extract(h, r":(\d+)$", 1) == F.coalesce(F.try_element_at(ports, F.lower(p["scheme"])), F.lit("-"))) | h.endswith(":")
        shown = let(host, lambda h: F.when(needless(h), F.regexp_replace(h, r":\d*$", "")).otherwise(h))
        there = p["authority"].isNotNull()
        path = F.when(there & (p["path"] == ""), "/").when(there | p["path"].startswith("/"), without_dots(p["path"])).otherwise(p["path"])
        return _written(F.lower(p["scheme"]), F.concat(user, shown), path, p["query"], p["fragment"])

    return let(parts(url), plain)


def origin(url: Column) -> Column:
    """scheme://host[:port] of the normal form; null without a host."""
    def of(p: Column) -> Column:
        host = F.regexp_replace(p["authority"], r"^.*@", "")
        return F.when(p["scheme"].isNotNull() & (host != ""), F.concat(p["scheme"], F.lit("://"), host))

    return let(parts(normalized(url)), of)
