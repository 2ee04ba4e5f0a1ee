from __future__ import annotations

import pytest

from crawlgrain.llm import html_blocks as H

LONG = "The old house by the river was one of the first that they built in this part of the town, and it is still there for all who want to see it. "
GERMAN = "Das alte Haus an dem Fluss war eines der ersten, die sie in diesem Teil der Stadt gebaut haben, und es ist noch da für alle, die es sehen wollen. "


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style>{head}</head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    body = f"""<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now. {LONG}</div>
    <div id="cookie-notice">We use cookies on this site and you have to agree.</div>
    <article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Second   &eacute;
    line.</p><script>var t="</p>";</script><p>Short.</p><form><p>Your name</p><input></form><aside>See also</aside>
    <ul><li>one</li><li>two</li></ul><section class="comments"><p>I agree. {LONG}</p></section></article>
    <div class="sidebar"><p>{LONG}</p></div><footer>&copy; site &middot; {LONG}</footer>"""
    text = LONG.strip()
    assert H.main_text(page(body)) == f"Title & more\n{text}\nSecond é line.\nShort.\none\ntwo"


def test_pages_without_an_article_element():
    links = " ".join(f'<a href="/{k}">Some linked words {k}</a>' for k in range(9))
    body = f"<div><h2>Heading</h2><p>{LONG * 2}</p><p>Short one.</p><p>{GERMAN * 2}</p></div><div>{links}</div><div>Contact us</div>"
    assert H.main_text(page(body)).split("\n") == ["Heading", (LONG * 2).strip(), "Short one.", (GERMAN * 2).strip()]


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "</p></div>", "<script>", "<p></p>", "<div class='ad'>x</div>", "&#0;<!DOCTYPE"])
def test_broken_and_empty_pages(html):
    assert "<" not in H.main_text(html) or html == "<"


def test_unclosed_article_and_references():
    assert H.main_text(f"<body><article><p>{LONG}A &lt;b&gt; &#8364; &#x20AC; &nbsp; &zzz; x") == LONG + "A <b> € € &zzz; x"


def test_structure_is_inherited_by_what_it_holds():
    html = f"<article><p>{LONG}</p></article><footer><article><p>{LONG}</p></article></footer><div role=navigation><p>{LONG}</p></div>"
    assert H.main_text(html) == LONG.strip()


def test_very_long_page_is_read_whole():
    assert len(H.main_text("<article>" + f"<p>{LONG}</p>" * 20000)) == 20000 * len(LONG) - 1


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "v", "")]
    table = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, text string")
    got = H.extract(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, u, LONG.strip() if h else "") for i, u, h in rows], key=str)
    assert H.extract(table.limit(0)).collect() == []


def driver_pages(spark):
    try:
        return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    except Exception:  # noqa: BLE001
        pytest.skip("no test data")


def article_blocks(html):
    """The blocks of a test page's article, cut out by another way."""
    import html as ref
    import re

    inner = re.search(r"<article>(.*)(?:</article>|\Z)", html, re.S)[1].split("</article>")[0]
    blocks = [" ".join(ref.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", inner)]
    return [b for b in blocks if b]


def test_driver_pages_match_their_article(spark):
    """Every block of the articles of the test pages, and nothing else of them."""
    for html in driver_pages(spark):
        assert H.main_text(html) == "\n".join(article_blocks(html))


def plain(html):
    """The page with nothing left of its markup that names the article or what surrounds it."""
    import re

    html = re.sub(r"<(/?)(?:article|nav|aside|section|main|header|footer)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", html)


def test_density_links_and_neighbours_find_the_article_by_themselves(spark, monkeypatch):
    from collections import Counter

    def shares():
        hit = found = due = 0
        for html in driver_pages(spark):
            got, want = Counter(H.main_text(plain(html)).split("\n")), Counter(article_blocks(html))
            hit += sum(len(k) * n for k, n in (got & want).items())
            found, due = found + sum(len(k) * n for k, n in got.items()), due + sum(len(k) * n for k, n in want.items())
        return hit / due, hit / found

    recall, precision = shares()
    assert recall >= 0.98 and precision >= 0.98
    monkeypatch.setattr(H, "STOP_WORDS", frozenset())
    assert shares() != (recall, precision)


def test_headings_look_as_far_ahead_as_the_page_goes():
    short = "".join(f"<p>Item {k}</p>" for k in range(500))
    assert H.main_text(page(f"<h2>Heading</h2>{short}<p>{LONG * 2}</p>")).startswith("Heading\n")
    assert not H.main_text(page(f"<h2>Heading</h2>{short}<p><a href=x>{LONG * 2}</a></p><p>{LONG * 2}</p>")).startswith("Heading")


def test_blocks_inside_an_article_follow_their_neighbours():
    links = "<p>" + " ".join(f'<a href="/{k}">Some more linked words {k}</a>' for k in range(4)) + "</p>"
    text = LONG.strip()
    got = H.main_text(page(f"<article><p>{LONG}</p><p>Short.</p><p>{LONG}</p>{links}<p>Read on here</p>{links}<form>Name</form></article>"))
    assert got == f"{text}\nShort.\n{text}"
    unknown = "Zażółć gęślą jaźń kiedyś wreszcie mocno szybko bardzo powoli trudniej prościej zawsze nigdy często rzadko "
    assert H.main_text(page(f"<article><h1>Tytuł</h1><p>{unknown}</p><p>Krótko.</p></article><footer>Stopka</footer>")) == f"Tytuł\n{unknown.strip()}\nKrótko."
