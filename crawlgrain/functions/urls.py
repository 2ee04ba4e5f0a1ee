"""URL algebra as columns: everything stays in the JVM.

A URL is cut by the pattern of RFC 3986, appendix B, which never fails on what is
found in pages, unlike parse_url.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgrain.config import TRACKING_PARAMETERS, CrawlConfig

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: The same, with the marks of authority, query and fragment kept, to cut a URL in one go.
_CUT = r"(?s)^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"
_MARK = "\x01"
_UNRESERVED = r"^[A-Za-z0-9._~-]$"
# Schemes that name no page.
_NO_PAGE = ("javascript:", "mailto:", "tel:", "data:")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once: the optimiser would else write it out wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def cut(url: Column) -> Column:
    """[scheme, //authority, path, ?query, #fragment], each empty where it is missing."""
    return F.split(F.regexp_replace(F.translate(url, _MARK, ""), _CUT, _MARK.join(f"${k}" for k in range(1, 6))), _MARK, 5)


def trimmed(c: Column) -> Column:
    """Without white space, line ends included, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    """The query, null if there is no question mark."""
    return F.when(url.rlike(r"^[^?#]*\?"), _part(url, 4))


def host(url: Column) -> Column:
    """Lower-case host without user and port; null where there is none."""
    return bound(_host(authority(url)), lambda h: F.when(h != "", h))


def _host(auth: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(auth, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)), r"\.$", "")


def robots_path(url: Column) -> Column:
    """Path and query, as robots rules see them."""
    p, q = path(url), query(url)
    return F.concat(F.when(p == "", "/").otherwise(p), F.when(q.isNull(), "").otherwise(F.concat(F.lit("?"), q)))


def sitemap_url(seed: Column) -> Column:
    """Where a seed's site keeps its sitemap."""
    return F.concat(scheme(seed), F.lit("://"), authority(seed), F.lit("/sitemap.xml"))


def _without_dots(p: Column) -> Column:
    """A path beginning with `/` without its dot segments (RFC 3986, 5.2.4)."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    def folded(q: Column) -> Column:
        kept = F.aggregate(F.split(F.substring(q, F.lit(2), F.length(q)), "/"), empty, step)
        return bound(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(q.rlike(r"/\.\.?$") & (F.size(k) > 0), "/").otherwise("")))

    return bound(p, lambda q: F.when(q.contains("/."), folded(q)).otherwise(q))


def _against(ref: Column, r: Column, b: Column) -> Column:
    """A reference, and its parts, against the parts of an absolute base."""
    root = F.concat(F.lower(b[0]), F.lit(":"), F.when(b[1] == "", "//").otherwise(b[1]))
    folder = F.concat(F.regexp_extract(F.when(b[2] == "", "/").otherwise(b[2]), r"(?s)^(.*/)", 1), r[2])
    rooted = F.when(r[2].startswith("/"), r[2]).otherwise(folder)
    rest = F.concat(r[3], r[4])
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(r[1] != "", F.concat(F.lower(b[0]), F.lit(":"), ref))
        .when(r[2] == "", F.concat(root, b[2], F.when(r[3] == "", b[3]).otherwise(""), rest))
        .otherwise(F.concat(root, _without_dots(rooted), rest))
    )


def resolve(ref: Column, base: Column) -> Column:
    """A reference against an absolute base, fragment and all (RFC 3986, 5.2)."""
    return bound(cut(base), lambda b: bound(ref, lambda x: bound(cut(x), lambda r: _against(x, r, b))))


def percent_normalized(c: Column) -> Column:
    """Unreserved ASCII characters decoded, other escapes upper-case, broken ones kept."""

    def piece(x: Column, i: Column) -> Column:
        code = F.substring(x, 1, 2)
        char = F.char(F.conv(code, 16, 10).cast("int"))
        whole = F.when(char.rlike(_UNRESERVED), char).otherwise(F.concat(F.lit("%"), F.upper(code)))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(whole, F.substring(x, F.lit(3), F.length(x)))).otherwise(F.concat(F.lit("%"), x))

    return bound(c, lambda x: F.when(x.contains("%"), F.array_join(F.transform(F.split(x, "%"), piece), "")).otherwise(x))


def strip_tracking(q: Column) -> Column:
    """A query without tracking parameters; null if nothing is left."""
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(q, "&"), lambda p: ~name(p).isin(*TRACKING_PARAMETERS))
    return bound(F.array_join(kept, "&"), lambda joined: F.when(joined != "", joined))


def sort_query(q: Column) -> Column:
    """A query with its parameters ordered by name, equal names in place."""
    keyed = F.transform(F.split(q, "&"), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("at"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")


def normalize(raw: Column, base: Column | None = None, config: CrawlConfig = CrawlConfig()) -> Column:
    """The canonical form of a URL, or null if it isn't a page of http or https.

    Paths are worked on in their encoded form, so an encoded slash stays one, and only
    ASCII characters are decoded. With fold_http, http becomes https.
    """
    if base is None:
        return bound(trimmed(raw), lambda ref: _page(ref, bound(cut(ref), lambda u: _canonical(u, config))))
    return bound(cut(base), lambda b: normalize_from(raw, b, config))


def normalize_from(raw: Column, base_parts: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """normalize() against a base that is cut() already."""
    full = lambda ref: bound(bound(cut(ref), lambda r: _against(ref, r, base_parts)), lambda url: bound(cut(url), lambda u: _canonical(u, config)))
    return bound(trimmed(raw), lambda ref: _page(ref, full(ref)))


def _page(ref: Column, out: Column) -> Column:
    """out, but null where the reference is empty or names no page."""
    fine = ref != ""
    for prefix in _NO_PAGE:
        fine = fine & ~ref.startswith(prefix)
    return F.when(fine, out)


def _canonical(u: Column, config: CrawlConfig) -> Column:
    """The canonical form of an absolute URL, from its parts."""
    s, auth = F.lower(u[0]), F.substring(u[1], F.lit(3), F.length(u[1]))
    to = F.lit("https") if config.fold_http else s
    port = F.regexp_extract(auth, r":(\d+)$", 1)
    default = (port == "") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443"))
    p = _without_dots(F.when(u[2] == "", "/").otherwise(u[2]))
    if config.normalize_trailing_slash:
        p = F.regexp_replace(p, r"(?s)(?<=.)/\z", "")
    q = F.substring(u[3], F.lit(2), F.length(u[3]))
    q = F.when(q != "", q)
    if config.strip_tracking_parameters:
        q = strip_tracking(q)
    if config.sort_query_parameters:
        q = sort_query(q)
    q = bound(q, lambda x: F.when(x.isNull(), "").otherwise(F.concat(F.lit("?"), percent_normalized(x))))
    user = F.regexp_extract(auth, r"^(.*@)", 1)
    whole = lambda h: F.when(h != "", F.concat(to, F.lit("://"), user, h, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), percent_normalized(p), q))
    return F.when(s.isin("http", "https"), bound(_host(auth), whole))


def registered_domain(h: Column) -> Column:
    """The last two labels of a host; null for a single label."""
    labels = F.split(h, r"\.")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), "."))


def in_scope(url: Column, seed: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """Whether a URL belongs to a seed's site, under the settings. Equal hosts of a single label do."""
    return bound(F.struct(host(url).alias("h"), host(seed).alias("s")), lambda x: _scope(url, x["h"], x["s"], config))


def _scope(url: Column, h: Column, s: Column, config: CrawlConfig) -> Column:
    fine = scheme(url).isin("http", "https") & h.isNotNull() & s.isNotNull()
    if config.constrain_to_seed_domain:
        same = h == s
        if config.include_subdomains:
            same = same | F.coalesce(registered_domain(h) == registered_domain(s), F.lit(False))
        fine = fine & same
    if config.allowed_paths:
        p = F.when(path(url) == "", "/").otherwise(path(url))
        allowed = F.lit(False)
        for prefix in config.allowed_paths:
            allowed = allowed | p.startswith(prefix)
        fine = fine & allowed
    return F.coalesce(fine, F.lit(False))


def is_internal(url: Column, seeds: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """Whether a URL is in scope of any of an array of seeds."""
    return F.exists(seeds, lambda s: in_scope(url, s, config))


def well_formed(url: Column) -> Column:
    """Whether a string is an absolute URL without blanks or stray characters."""
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#<>\"{}|\\^`]+(?:[/?#][^\s<>\"{}|\\^`]*)?$")
