"""Main text of web pages by two passes of block rules.

Pass one classifies each block on its own by length, link density and stop-word
density; pass two gives undecided blocks the label of their nearest decided
neighbours. Both run on every page. What the markup says of a block is one more
feature: boilerplate elements and names decide against it, and inside an article
element the limits are wider and undecided blocks are text unless their neighbours
are not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from crawlgrain.llm.cluster import tidied

SCHEMA = "page_id long, url string, text string"

# Elements of HTML by what they mean for extraction.
_BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_HIDDEN = frozenset("head noscript template svg math object canvas audio video map button select datalist dialog".split())
_BOILER = frozenset("nav footer aside form menu header".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = frozenset("br img input embed td th".split())
_CLOSED_BY = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class and id names, and roles, of what isn't the article.
_NAMES = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe taboola toolbar widget".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his if in into is it its more no not of on one or our she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber alle als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur ob oder ohne schon sein sich sie sind so über um und uns von vor war was wie wir wird zu zum zur zwischen "
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais me même mes nous on ou où par pas pour qu que qui sa sans se ses son sont sur ta te tu un une vos vous y "
    "al como con cuando del desde donde el ella ellos entre era es esa ese eso esta este esto fue hasta hay la las lo los mas más me mi muy ni nos o para pero por que qué se ser si sí sin sobre su sus también te tiene todo tu un una uno unos y ya yo".split()
)

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(?P<odd>[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_WORD = re.compile(r"[^\W_]+")
_WHITE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Rules:
    """Limits of the two passes, in characters and shares; article_*: of blocks inside an article element."""

    short: int = 60
    long: int = 140
    notice: int = 200  # a line that begins with a copyright sign is a notice up to this length
    stop_low: float = 0.1
    stop_high: float = 0.22
    article_stop_high: float = 0.1
    links: float = 0.3
    article_links: float = 0.8


@dataclass
class Block:
    text: str
    tag: str
    boiler: bool
    article: bool
    link_chars: int
    label: str = ""


@dataclass
class _Open:
    name: str
    boiler: bool
    hidden: bool
    article: bool
    link: bool


@dataclass
class _Reader:
    """A lenient reader of tags: open elements and the text of the current block."""

    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top.hidden:
            return
        piece = html.unescape(raw) if "&" in raw else raw
        self.parts.append(piece)
        if top and top.link:
            self.linked += len(_WHITE.sub(" ", piece).strip())

    def flush(self) -> None:
        if self.parts:
            line = _WHITE.sub(" ", "".join(self.parts)).strip()
            if line:
                top = self.stack[-1] if self.stack else _Open("", False, False, False, False)
                tag = next((e.name for e in reversed(self.stack) if e.name in _BLOCKS), "")
                self.blocks.append(Block(line, tag, top.boiler, top.article, self.linked))
            self.parts.clear()
        self.linked = 0

    def open(self, name: str, attrs: str) -> None:
        if name in _BLOCKS:
            self.flush()
            if self.stack and name in _CLOSED_BY.get(self.stack[-1].name, ()):
                self.stack.pop()
            elif name in _BLOCKS and name not in ("li", "dt", "dd", "td", "th", "tr", "option"):
                self._close_paragraph()
        elif name in _SPACE:
            self.parts.append(" ")
        if name in _VOID:
            return
        top = self.stack[-1] if self.stack else _Open("", False, False, False, False)
        boiler, hidden = top.boiler, top.hidden or name in _HIDDEN
        article = top.article or name in ("article", "main")
        if name in _BOILER and not (name == "header" and top.article):
            boiler = True
        if attrs and name not in ("html", "body", "article", "main") and name not in _HEADINGS:
            boiler = boiler or _named_boiler(attrs)
            hidden = hidden or bool(re.search(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", attrs, re.I))
        if name == "article" and top.article and boiler is False and any(e.name == "article" for e in self.stack):
            boiler = True  # an article inside an article is a reader's comment
        self.stack.append(_Open(name, boiler, hidden, article, top.link or name == "a"))

    def _close_paragraph(self) -> None:
        """An open paragraph ends, with the inline elements left open in it, where a block begins."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == "p":
                del self.stack[i:]
                return
            if self.stack[i].name in _BLOCKS:
                return

    def close(self, name: str) -> None:
        if name in _BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                return
            if self.stack[i].name in _BLOCKS and name not in _BLOCKS:
                return


def _named_boiler(attrs: str) -> bool:
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role" and value.strip() in _ROLES:
            return True
        if key in ("class", "id", "itemprop") and not _NAMES.isdisjoint(_NAME.findall(value)):
            return True
    return False


def read_blocks(page: str) -> list[Block]:
    """Blocks of a page in order, outside scripts, styles and hidden elements."""
    r, at, n = _Reader(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            r.text(page[at:])
            break
        if m.start() > at:
            r.text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            r.close(name)
        elif name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        else:
            r.open(name, m["attrs"])
    r.flush()
    return r.blocks


def classify(blocks: list[Block], rules: Rules) -> None:
    """Pass one, by the block alone.

    out: boilerplate by the markup; bad: links, or a copyright line; short: too short to
    tell; good, near, weak: by stop-word density (and length, for good).
    """
    for b in blocks:
        n = len(b.text)
        links = b.link_chars > (rules.article_links if b.article else rules.links) * n and not (b.article and b.tag in _HEADINGS)
        if b.boiler:
            b.label = "out"
        elif links or (b.text[0] == "©" and n < rules.notice and not b.article):
            b.label = "bad"
        elif n < rules.short:
            b.label = "short"
        else:
            words = _WORD.findall(b.text.lower())
            stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
            if stops >= (rules.article_stop_high if b.article else rules.stop_high) and (n > rules.long or b.article):
                b.label = "good"
            else:
                b.label = "near" if stops >= rules.stop_low else "weak"


def inherit(blocks: list[Block], rules: Rules) -> list[bool]:
    """Pass two: which blocks belong to the text.

    Where a page has an article element with text, blocks outside any are none. Inside
    one, a block that is undecided is text unless all of its nearest decided
    neighbours there, before and after, are bad. On other pages near and weak blocks are
    text beside a good one, short ones between two good ones, and a heading if a good one
    follows; where no block is good, the near ones count as good, and without these the
    weak ones.
    """
    inside = [b.article and b.label != "out" for b in blocks]
    region = any(i and b.label != "bad" for i, b in zip(inside, blocks, strict=True))
    kinds = {b.label for i, b in zip(inside, blocks, strict=True) if i or not region}
    best = next((k for k in ("good", "near", "weak") if k in kinds), "good")
    decided = [None if region and not i else "good" if b.label == best else "bad" if b.label == "bad" or b.label == "out" and not region else None for i, b in zip(inside, blocks, strict=True)]
    before, after = _nearest(decided), _nearest(decided[::-1])[::-1]
    out = []
    for b, i, mine, x, y in zip(blocks, inside, decided, before, after, strict=True):
        if region:
            out.append(i and (mine == "good" or mine is None and ({x, y} - {None}) != {"bad"}))
        elif mine:
            out.append(mine == "good")
        elif b.label in ("near", "weak"):
            out.append("good" in (x, y))
        else:
            out.append(y == "good" if b.tag in _HEADINGS else x == y == "good")
    return out


def _nearest(decided: list[str | None]) -> list[str | None]:
    """Of each place, the last decided label before it."""
    out, last = [], None
    for label in decided:
        out.append(last)
        last = label or last
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The article's blocks, each on a line of its own; empty if there is none."""
    if not page:
        return ""
    blocks = read_blocks(page)
    classify(blocks, rules)
    return "\n".join(b.text for b, keep in zip(blocks, inherit(blocks, rules), strict=True) if keep)


def extract(pages: DataFrame, rules: Rules = Rules(), id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: SCHEMA, in one pass without a shuffle.

    Null and empty pages have an empty text; null ids and URLs and repeated rows stay;
    pages of any length are read whole; unclosed and stray tags are borne; an empty
    table gives no rows; other columns are ignored.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), rules) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(pages[id_column].cast("long"), pages[url_column].cast("string"), pages[html_column].cast("string")).mapInArrow(tidied(task), SCHEMA)
