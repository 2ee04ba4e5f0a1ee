"""XML sitemaps: parsing that bears broken files, dates, priorities."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgrain.schemas import PARSED_SITEMAP

_TYPE = pa.struct([("urls", pa.list_(pa.struct([(k, pa.string()) for k in ("loc", "lastmod", "changefreq", "priority")]))), ("children", pa.list_(pa.string())), ("error", pa.string())])
_FIELDS = ("loc", "lastmod", "changefreq", "priority")


def parse_text(text: str | None) -> dict:
    """URLs of a urlset, children of an index; what precedes an error is kept, with its message."""
    out: dict = {"urls": [], "children": [], "error": None}
    path: list[str] = []
    entry: dict[str, str] = {}

    def start(name: str, _: dict) -> None:
        path.append(name.lower())
        if path[-1] in ("url", "sitemap"):
            entry.clear()

    def data(s: str) -> None:
        if path and path[-1] in _FIELDS:
            entry[path[-1]] = entry.get(path[-1], "") + s

    def end(_: str) -> None:
        name = path.pop()
        loc = entry.get("loc", "").strip()
        if name == "url" and loc:
            out["urls"].append({k: entry[k].strip() or None if k in entry else None for k in _FIELDS} | {"loc": loc})
        elif name == "sitemap" and loc and "sitemapindex" in path:
            out["children"].append(loc)

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, data
    try:
        p.Parse((text or "").encode(), True)
    except expat.ExpatError as e:
        out["error"] = str(e) if text else None
    return out


def _parse(body: pa.Array) -> pa.Array:
    return pa.array([parse_text(x) for x in body.to_pylist()], _TYPE)


def parse(body: Column) -> Column:
    """Parsed sitemap of a column of texts, in one Arrow function."""
    return F.arrow_udf(_parse, PARSED_SITEMAP)(body)


def lastmod(text: Column) -> Column:
    """A timestamp from the three usual forms; UTC where no zone is named."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def priority(text: Column) -> Column:
    return text.try_cast("double")
