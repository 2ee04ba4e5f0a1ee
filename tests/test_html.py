from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from crawlgrain.functions.html import page_facts, read_page
from crawlgrain.operators import crawl
from crawlgrain.sources import fetches as S


def head(x):
    return read_page(f"<html><head>{x}</head><body></body></html>")


def body(x):
    return read_page(f"<html><head></head><body>{x}</body></html>")


def test_titles_and_metas():
    assert head("<title>My Page Title</title>")["title"] == "My Page Title"
    assert head("<title>  Padded \n Title &amp; x </title><title>2</title>")["title"] == "Padded Title & x"
    assert head("")["title"] is None and head("<title> </title>")["title"] is None
    assert head('<meta name="Description" content=" text "><meta name=description content=second>')["meta_description"] == "text"
    assert head('<meta property="og:title" content="O"><meta property="og:description" content="D">')["og_title"] == "O"
    assert head('<meta name=robots content="noindex"><meta name=googlebot content=nofollow>')["robots"] == "noindex,nofollow"


def test_headings_images_links():
    x = body('<h1>First <b>one</b></h1><h1></h1><h2>a</h2><h2>b</h2><h2>c</h2><img src=a.png alt=A><nav><img src=b.png></nav><a href="/x" rel="nofollow ugc">go <i>on</i></a><a>none</a><iframe src=f></iframe><script src=s.js></script>')
    assert (x["h1"], x["h1_count"], x["h2_count"], x["image_count"]) == ("First one", 2, 3, 1)
    assert [(k["tag"], k["url"], k["anchor"], k["nofollow"]) for k in x["links"]] == [("a", "/x", "go on", True), ("img", "a.png", "A", False), ("img", "b.png", None, False), ("script", "s.js", None, False), ("iframe", "f", None, True)]
    long = body(f"<a href=x>{'y' * 900}</a>")
    assert len(long["links"][0]["anchor"]) == 500


def test_link_elements():
    x = head('<link rel="Canonical" href="/c"><link rel=canonical href=/d><link rel=alternate hreflang=en-GB href=/gb><link rel=alternate hreflang=x-default href=/><link rel=next href=/2>')
    assert x["canonical"] == "/c" and [(h["lang"], h["region"]) for h in x["hreflang"]] == [("en", "GB"), ("x", "default")]
    assert [k["tag"] for k in x["links"]] == ["canonical", "canonical", "hreflang", "hreflang", "link"]


def test_structured_data():
    x = head('<script type="application/ld+json">{"@type":"Product","offers":[{"@type":["Offer","Thing"]}]}</script><script type="application/ld+json">{broken</script>')
    assert x["structured_data_types"] == ["Offer", "Product", "Thing"]


def test_body_text_leaves_out_what_surrounds_it():
    x = body('<header>H</header><nav>N</nav><p>One<b>two</b> three</p><div aria-hidden="true">no</div><style>s</style><script>var a="</p>";</script><p>four<footer>F</footer>')
    assert x["body_text"] == "Onetwo three four"
    assert read_page(None) is None and read_page("")["body_text"] == "" and read_page("<")["title"] is None


def test_arrow_function_and_directives(spark):
    rows = spark.createDataFrame([("<title>t</title>",), (None,), ("",)], "html string")
    assert [x.t for x in rows.select(page_facts(F.col("html"))["title"].alias("t")).collect()] == ["t", None, None]
    cases = [("noindex, nofollow", None, (True, True, "meta", None)), ("none", None, (True, True, "meta", None)), (None, "noindex", (True, False, "header", None)), ("all; unavailable_after: 2030-01-02", None, (False, False, "meta", date(2030, 1, 2))), (None, None, (False, False, "meta", None)), ("unavailable_after: soon", None, (False, False, "meta", None))]
    table = spark.createDataFrame([(m, h) for m, h, _ in cases], "m string, h string").select(crawl.directives(F.col("m"), F.col("h")).alias("d"))
    assert [(x.d.noindex, x.d.nofollow, x.d.source, x.d.unavailable_after) for x in table.collect()] == [w for _, _, w in cases]


def test_fetch_columns(spark):
    row = spark.createDataFrame([({"Content-Type": "a", "X-Robots-Tag": "b", "x-robots-tag": "c"}, "Text/HTML; x", "dns", "h")], "h map<string,string>, t string, code string, detail string")
    got = row.select(S.response_headers(F.col("h")), S.is_html(F.col("t")), S.error_text(S.fetch_error(F.col("code"), F.col("detail"))), S.kept_body(F.repeat(F.lit("x"), 9), F.col("t"))).first()
    assert got[0] == {"content-type": "a", "x-robots-tag": "c"} and got[1] and got[2] == "DNS failure: h" and got[3] == "x" * 9
    assert S.request_headers()["User-Agent"]
    texts = [(c, w) for c, w in (("timeout", "Timeout"), ("refused", "Connection refused"), ("too_many_redirects", "Too many redirects"), ("odd", "h"), (None, None))]
    table = spark.createDataFrame([(c, "h") for c, _ in texts], "code string, detail string")
    assert [x[0] for x in table.select(S.error_text(S.fetch_error(F.col("code"), F.col("detail")))).collect()] == [w for _, w in texts]
