"""One Arrow function reads a page once and returns all that the audit asks of it."""

from __future__ import annotations

import json
import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgrain.schemas import PAGE_FACTS

_LINK = pa.struct([("url", pa.string()), ("tag", pa.string()), ("rel", pa.string()), ("anchor", pa.string()), ("nofollow", pa.bool_())])
_TYPE = pa.struct([
    ("title", pa.string()), ("meta_description", pa.string()), ("h1", pa.string()), ("h1_count", pa.int32()), ("h2_count", pa.int32()),
    ("canonical", pa.string()), ("robots", pa.string()),
    ("hreflang", pa.list_(pa.struct([("lang", pa.string()), ("url", pa.string()), ("region", pa.string())]))),
    ("og_title", pa.string()), ("og_description", pa.string()), ("structured_data_types", pa.list_(pa.string())),
    ("body_text", pa.string()), ("image_count", pa.int32()), ("bare_image_links", pa.int32()), ("links", pa.list_(_LINK)),
])

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_REMOVED = frozenset("script style nav header footer".split())
_ROBOT_NAMES = ("robots", "googlebot", "bingbot")
#: Kinds of links in the order in which a page lists them.
_KINDS = ("a", "canonical", "hreflang", "pagination", "img", "script", "iframe")
ANCHOR_CHARS = 500
#: What is read as it stands, and references to characters with or without their semicolon.
_REFERENCE = re.compile(r"(?is)<(script|style)\b.*?</\1|<!--.*?-->|&(#?\w+;?)")
#: What is read as it stands, and titles with their end tag, if they have one.
_TITLE = re.compile(r"(?is)<(script|style)\b.*?(?:</\1|\Z)|<!--.*?(?:-->|\Z)|(<title(?=[\s/>])[^<>]*>)(.*?)(</title(?=[\s/>])|\Z)")
_MARKED_TITLE = re.compile(r"<[Tt][Ii][Tt][Ll][Ee](?=[\s/>])[^<>]*>[^<]*<(?!/[Tt][Ii][Tt][Ll][Ee][\s/>])")

_SEPARATOR, _WHITE = re.compile(r"[\x1c-\x1f]"), re.compile(r"[^\S\x1c-\x1f]+")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.removed = 0
        self.in_body = False
        self.texts: dict[str, list[str]] = {}  # open captures: title, h1, a, json
        self.title: str | None = None
        self.h1: str | None = None
        self.counts = {"h1": 0, "h2": 0, "img": 0, "bare": 0}
        self.metas: dict[str, str] = {}
        self.og: dict[str, str] = {}
        self.canonical: str | None = None
        self.hreflang: list[dict] = []
        self.links: dict[str, list[dict]] = {k: [] for k in _KINDS}
        self.anchors: list[tuple[dict, list[str]]] = []
        self.body: list[str] = []
        self.types: set[str] = set()
        self.json: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "body":
            self.in_body = True
        if tag not in _INLINE:
            self._space()
        if tag == "a":
            self._end_anchor()
        if tag not in _VOID:
            removed = tag in _REMOVED or a.get("aria-hidden", "").lower() == "true"
            self.stack.append((tag, removed))
            self.removed += removed
        if tag in ("h1", "h2"):
            self.counts[tag] += 1
        if tag == "title" and self.title is None and "title" not in self.texts:
            self.texts["title"] = []
        elif tag == "h1" and self.h1 is None:
            self.texts["h1"] = []
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            self._link(a)
        elif tag == "a" and "href" in a:
            rel = a.get("rel", "")
            self.anchors.append(({"url": a["href"], "tag": "a", "rel": rel or None, "anchor": None, "nofollow": "nofollow" in rel.lower()}, []))
        elif tag == "img":
            if not self.removed and self.in_body:
                self.counts["img"] += 1
            if self.anchors and not a.get("alt", "").strip():
                self.counts["bare"] += 1
            if "src" in a:
                self.links["img"].append({"url": a["src"], "tag": "img", "rel": None, "anchor": a.get("alt"), "nofollow": False})
        elif tag == "script":
            if "src" in a:
                self.links["script"].append({"url": a["src"], "tag": "script", "rel": None, "anchor": None, "nofollow": False})
            if a.get("type", "").strip().lower() == "application/ld+json":
                self.json = []
        elif tag == "iframe" and "src" in a:
            self.links["iframe"].append({"url": a["src"], "tag": "iframe", "rel": None, "anchor": None, "nofollow": True})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _meta(self, a: dict) -> None:
        name, prop = a.get("name", "").lower(), a.get("property", "").lower()
        content = a.get("content", "").strip()
        if name and name not in self.metas:
            self.metas[name] = content
        if prop.startswith("og:") and prop not in self.og:
            self.og[prop] = content

    def _link(self, a: dict) -> None:
        rel, href = a.get("rel", "").lower(), a.get("href")
        if href is None:
            return
        row = {"url": href, "tag": "link", "rel": a.get("rel"), "anchor": None, "nofollow": False}
        if "canonical" in rel:
            self.canonical = self.canonical if self.canonical is not None else href.strip()
            self.links["canonical"].append(row | {"tag": "canonical"})
        if "alternate" in rel and "hreflang" in a:
            lang, _, region = a["hreflang"].partition("-")
            self.hreflang.append({"lang": lang, "url": href, "region": region or None})
            self.links["hreflang"].append(row | {"tag": "hreflang", "rel": a["hreflang"]})
        if "next" in rel or "prev" in rel:
            self.links["pagination"].append(row)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self._space()
        if tag == "title" and "title" in self.texts:
            self.title = _squash(self.texts.pop("title"))
        elif tag == "h1" and "h1" in self.texts:
            self.h1 = _squash(self.texts.pop("h1"))
        elif tag == "a":
            self._end_anchor()
        elif tag == "script" and self.json is not None:
            self._types("".join(self.json))
            self.json = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.removed -= sum(r for _, r in self.stack[i:])
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        top = self.stack[-1][0] if self.stack else ""
        if self.json is not None:
            self.json.append(data)
        if top in ("script", "style"):
            return
        for parts in self.texts.values():
            parts.append(data)
        if self.anchors:
            self.anchors[-1][1].append(data)
        if top != "title" and not self.removed and self.in_body:
            self.body.append(data)

    def _space(self) -> None:
        self.body.append(" ")
        for parts in self.texts.values():
            parts.append(" ")
        if self.anchors:
            self.anchors[-1][1].append(" ")

    def _end_anchor(self) -> None:
        if self.anchors:
            row, parts = self.anchors.pop()
            row["anchor"] = (_squash(parts) or "")[:ANCHOR_CHARS]
            self.links["a"].append(row)

    def _types(self, raw: str) -> None:
        try:
            todo = [json.loads(raw)]
        except ValueError:
            return
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                kind = x.get("@type")
                self.types.update([kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else [])
                todo.extend(x.values())
            elif isinstance(x, list):
                todo.extend(x)

    def facts(self) -> dict:
        self._end_anchor()
        if "h1" in self.texts:
            self.h1 = _squash(self.texts.pop("h1"))
        robots = [self.metas[n] for n in _ROBOT_NAMES if self.metas.get(n)]
        return {
            "title": self.title or None,
            "meta_description": self.metas.get("description") or None,
            "h1": self.h1 or None,
            "h1_count": self.counts["h1"],
            "h2_count": self.counts["h2"],
            "canonical": self.canonical or None,
            "robots": ",".join(robots) or None,
            "hreflang": self.hreflang,
            "og_title": self.og.get("og:title") or None,
            "og_description": self.og.get("og:description") or None,
            "structured_data_types": sorted(self.types),
            "body_text": _squash(self.body) or "",
            "image_count": self.counts["img"],
            "bare_image_links": self.counts["bare"],
            "links": [row for k in _KINDS for row in self.links[k]],
        }


def _squash(parts: list[str]) -> str | None:
    """Runs of white space as one blank; the separators U+001C to U+001F are none, though Python's split() takes them for it."""
    x = "".join(parts)
    return " ".join(filter(None, _WHITE.split(x)) if _SEPARATOR.search(x) else x.split()) or None


def _titles_as_text(html: str) -> str:
    """The page with what looks like markup in its titles escaped: titles hold text alone."""

    def one(m: re.Match) -> str:
        return f"{m[2]}{m[3].replace('<', '&lt;')}{m[4]}" if m[4] else m[0]

    return _TITLE.sub(one, html) if _MARKED_TITLE.search(html) else html


def _bare_as_text(html: str) -> str:
    """The page with every ampersand escaped that begins no reference, or one without its semicolon."""

    def one(m: re.Match) -> str:
        name = m[2]
        whole = name is None or name.endswith(";") and (name[0] == "#" or name in html5)
        return m[0] if whole else f"&amp;{name}"

    return _REFERENCE.sub(one, html)


def read_page(html: str | None, bare_references: bool = True) -> dict | None:
    """All facts of a page; null for a null page. bare_references: `&amp` without its semicolon is read as a browser reads it, else as text."""
    if html is None:
        return None
    page = _Page()
    html = _titles_as_text(html)
    page.feed(html if bare_references else _bare_as_text(html))
    page.close()
    return page.facts()


def _page_facts(html: pa.Array) -> pa.Array:
    return pa.array([read_page(x.as_py()) for x in html], _TYPE)


def _page_facts_strict(html: pa.Array) -> pa.Array:
    return pa.array([read_page(x.as_py(), bare_references=False) for x in html], _TYPE)


def page_facts(html: Column, bare_references: bool = True) -> Column:
    """Page facts of a column of texts, in one Arrow function.

    It is declared as nondeterministic, though it isn't, for the optimiser to leave it
    where it stands: conditions on facts would else be pushed below it with a copy of it.
    """
    return F.arrow_udf(_page_facts if bare_references else _page_facts_strict, PAGE_FACTS).asNondeterministic()(html)
