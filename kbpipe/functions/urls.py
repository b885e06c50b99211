"""URL helpers: code-host rewrite, authority, RFC 3986 joins, robots rules."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbpipe.functions import regexes as rx
from kbpipe.functions.text import col_of

# Code-host web UI -> raw content host
CODE_HOST = "github.com"
CODE_HOST_RAW = "raw.githubusercontent.com"
CODE_BLOB = "/blob/"


def rewrite_code_host(url) -> Column:
    """If the URL mentions the code host and ``/blob/``, every occurrence of
    the host becomes the raw host and every ``/blob/`` becomes ``/``."""
    u = col_of(url)
    hit = u.contains(CODE_HOST) & u.contains(CODE_BLOB)
    rewritten = F.replace(F.replace(u, F.lit(CODE_HOST), F.lit(CODE_HOST_RAW)),
                          F.lit(CODE_BLOB), F.lit("/"))
    return F.when(hit, rewritten).otherwise(u)


def authority(url) -> Column:
    """``userinfo@host:port`` exactly as written (case kept); '' if none."""
    return F.regexp_extract(col_of(url), rx.URL_AUTHORITY, 1)


def path_and_rest(url) -> Column:
    """Everything after the authority: path, parameters, query, fragment."""
    return F.regexp_extract(col_of(url), rx.URL_AFTER_AUTHORITY, 1)


@F.pandas_udf(T.StringType())
def _urljoin(base: pd.Series, href: pd.Series) -> pd.Series:
    # the few shapes the native rules below do not cover
    def join(b, h):
        try:
            return None if b is None or h is None else urllib.parse.urljoin(b, h)
        except ValueError:          # no URL, e.g. an unclosed bracket in the host
            return None
    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)


_PLAIN_BASE = r"^https?://[^/?#;\[\]\s\x00-\x1f\\]+(?:/[^;\s\x00-\x1f\\]*)?$"
_AWKWARD = r"[;\[\]\s\x00-\x1f\\]|\?$|#$|\?#"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_DOT_SEGMENT = r"(^|/)\.\.?(/|$)"


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments of an absolute path taken out; a path that
    ends in one ends in ``/``."""
    def step(kept, segment):
        return (F.when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
                 .when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment))))
    done = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    done = F.when(path.rlike(r"/\.\.?$"), F.concat(done, F.lit("/"))).otherwise(done)
    return F.when(done.startswith("/"), done).otherwise(F.concat(F.lit("/"), done))


def join_native(base, href) -> Column:
    """``urljoin(base, href)`` where column expressions can tell, else NULL.

    Resolved against an ``http(s)`` base: empty, absolute and scheme-relative
    references, other schemes (``mailto:``), a query or fragment alone, and
    absolute or relative paths with dot segments.
    """
    b, h = col_of(base), col_of(href)
    part = F.regexp_extract
    origin, base_path = part(b, rx.URL_SCHEME_AUTHORITY, 1), part(b, r"^https?://[^/?#]*([^?#]*)", 1)
    folder = part(b, r"^https?://[^/?#]*([^?#]*/|)", 1)
    scheme, path, rest = part(h, _SCHEME, 1), part(h, r"^([^?#]*)", 1), part(h, r"^[^?#]*(.*)$", 1)
    # segments of a relative path follow the base's folder; empty ones vanish
    segments = F.filter(F.split(F.concat(folder, F.lit("/"), path), "/", -1), lambda x: x != "")
    beside = F.concat(F.lit("/"), F.array_join(segments, "/"), F.when(path.endswith("/"), "/").otherwise(""))
    target = F.when(path.startswith("/"), path).otherwise(beside)
    # the element of a one-element array: the path is put together once
    target = F.transform(F.array(target), lambda t: F.when(
        t.rlike(_DOT_SEGMENT), _without_dots(t)).otherwise(t))[0]
    same = F.lower(scheme) == F.lower(part(b, _SCHEME, 1))
    plain = ~h.rlike(_AWKWARD) & b.rlike(_PLAIN_BASE)
    return (F.when(h == "", b)
             .when(~plain, F.lit(None))
             .when(h.rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]"), h)
             .when(scheme != "", F.when(~same, h))
             .when(h.rlike("^//[^/?#]"), F.concat(part(b, _SCHEME, 1), F.lit(":"), h))
             .when(h.startswith("//"), F.lit(None))
             .when(h.startswith("?"), F.concat(origin, base_path, h))
             .when(h.startswith("#"), F.concat(part(b, r"^([^#]*)", 1), h))
             .otherwise(F.concat(origin, target, rest)))


def join_rest(native, base, href) -> Column:
    """``native`` (of ``join_native``), or where it is NULL the vectorised
    standard-library join: parameters, empty queries or fragments, blanks,
    brackets, a base of another kind. NULL where the href is no URL. Other
    rows pass the join NULLs."""
    n, b, h = col_of(native), col_of(base), col_of(href)
    return F.coalesce(n, _urljoin(F.when(n.isNull(), b), F.when(n.isNull(), h)))


# ---------------------------------------------------------------------------
# robots rules
# ---------------------------------------------------------------------------

def requoted(path) -> Column:
    """Percent-decoded, then quoted again with only ``/`` kept."""
    p = col_of(path)
    enc = F.url_encode(F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))
    for a, b in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc


def robots_target(url) -> Column:
    """What a rule is matched against: the URL after its authority (path,
    parameters, query, fragment), requoted, ``/`` when empty."""
    enc = requoted(path_and_rest(url))
    return F.when(enc == "", F.lit("/")).otherwise(enc)


def first_rule_allows(target: Column, rules: Column) -> Column:
    """``rules`` is a host's array of (rule_no, path, allow) in file order:
    the first whose path starts ``target`` decides; none means allowed."""
    hits = F.filter(rules, lambda r: (r["path"] == "*") | target.startswith(r["path"]))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["allow"], F.lit(True))
