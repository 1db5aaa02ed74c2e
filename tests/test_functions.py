"""URLs, HTML and scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.functions import html, scalars, urls


def one(spark, c, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://example.com/page#section", "https://example.com/page"),
        ("https://example.com/page/", "https://example.com/page/"),
        ("HTTPS://EXAMPLE.COM/Page", "https://example.com/Page"),
        ("https://example.com:443/page", "https://example.com/page"),
        ("https://example.com:8080/page", "https://example.com:8080/page"),
        ("https://example.com/?utm_source=google&id=123", "https://example.com/?id=123"),
        ("https://example.com/p?fbclid=x", "https://example.com/p"),
        ("https://example.com/p?z=1&a=2", "https://example.com/p?a=2&z=1"),
        ("https://example.com//a//b", "https://example.com/a/b"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com/a%2fb c", "https://example.com/a/b%20c"),
        ("https://example.com/p?b=&a=1&a=0", "https://example.com/p?a=1&a=0&b="),
        ("", None),
        (None, None),
        ("not-a-url", None),
        ("javascript:void(0)", None),
        ("mailto:a@b.c", None),
    ],
)
def test_normal_form(url, want):
    assert urls.normalize_one(url) == want


def test_parameter_policies():
    url = "https://example.com/?A=1&b=2&c=3"
    assert urls.normalize_one(url, deny=frozenset({"a"})) == "https://example.com/?b=2&c=3"
    assert urls.normalize_one(url, allow=frozenset({"a"})) == "https://example.com/?A=1"
    assert urls.normalize_one("https://example.com/?gclid=1", drop_tracking=False) == "https://example.com/?gclid=1"


def test_internal_and_resources(spark):
    rows = spark.createDataFrame([("https://example.com/a",), ("https://blog.example.com/a.PDF",), ("https://other.org/",), ("https://www.example.com/x.woff2?y",)], "url string")
    u = F.col("url")
    got = rows.select(urls.is_internal(u, "www.example.com").alias("own"), urls.is_internal(u, "example.com", True).alias("sub"), urls.is_internal(u, "example.com", allowlist=["blog"]).alias("listed"), urls.is_resource(u).alias("file"), urls.same_domain(u, F.lit("https://www.example.com/")).alias("same")).collect()
    assert [r.own for r in got] == [True, False, False, True]
    assert [r["sub"] for r in got] == [True, True, False, True]
    assert [r.listed for r in got] == [True, True, False, False]
    assert [r.file for r in got] == [False, True, False, True]
    assert [r.same for r in got] == [True, False, False, True]


def test_url_shapes(spark):
    rows = ["https://e.com/About-Us", "https://e.com/a/b/c/d/e/f/deep-page", "https://e.com/path/with spaces/file", "https://e.com/"]
    df = spark.createDataFrame([(r,) for r in rows], "url string")
    u = F.col("url")
    got = df.select(urls.is_mixed_case(u).alias("a"), urls.is_deep(u).alias("b"), urls.has_special_characters(u).alias("c"), urls.path_key(u).alias("k")).collect()
    assert [r.a for r in got] == [True, False, False, False]
    assert [r.b for r in got] == [False, True, False, False]
    assert [r.c for r in got] == [False, False, True, False]
    assert got[3].k == ""


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title> A <!-- c -->Title </title>
<meta name="Description" content=" About it "><meta name="robots" content="NoIndex, follow"><meta property="og:title" content="OG">
<link rel="canonical" href="/c"><link rel="alternate" hreflang="de" href="/de"><link rel="next" href="?p=2"><meta name="viewport" content="w">
<script type="application/ld+json">{"@type": ["Product", "Thing"], "name": "x"}</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="#main">Skip</a><a href="/n" rel="nofollow">Nav</a></nav><h1>Head <b>line</b></h1><h3>Third</h3><p>One two<p>three
<a href="//cdn.example.org/x"><img src="http://x/i.png" alt="pic"></a><a href="/empty"></a><img data-src="l.png"><form action="http://f/"><input id="q"><label for="q">Q</label><input name="z"></form>
<footer><a href="mailto:a@b">m</a><a href="/foot">F</a></footer><noscript>please turn on the scripts of this page, it needs them all to work</noscript></body></html>"""


def test_extraction():
    r = html.extract("https://example.com/dir/page", PAGE, lambda u: "example.com" in u)
    assert (r["title"], r["title_length"]) == ("ATitle", 6)
    assert r["meta_description"] == "About it" and r["meta_robots"] == "NoIndex, follow"
    assert (r["canonical_url"], r["canonical_count"]) == ("https://example.com/c", 1)
    assert r["hreflang_tags"] == [{"lang": "de", "href": "https://example.com/de"}]
    assert (r["h1_text"], r["h1_count"]) == ("Headline", 1)
    assert r["heading_hierarchy_gaps"] == [{"from_level": 1, "to_level": 3, "skipped": [2]}]
    assert "One two" in r["main_text"] and "Nav" not in r["main_text"] and "scripts" not in r["main_text"]
    assert r["word_count"] == len(r["main_text"].split())
    assert [(x["href_resolved"], x["is_internal"], x["is_follow"], x["context"]) for x in r["links"]] == [
        ("https://example.com/n", True, False, "nav"),
        ("https://cdn.example.org/x", False, True, "content"),
        ("https://example.com/empty", True, True, "content"),
        ("https://example.com/foot", True, True, "footer"),
    ]
    assert (r["internal_links_count"], r["external_links_count"], r["internal_nofollow_count"]) == (3, 1, 1)
    assert (r["img_count"], r["img_missing_alt"], r["img_lazy_broken"], r["img_missing_dimensions"]) == (2, 1, 1, 2)
    assert r["structured_data_types"] == ["Product", "Thing"] and "_error" in json.loads(r["structured_data"][1])
    assert r["robots_directives"] == ["follow", "noindex"] and r["is_noindex"] and not r["is_nofollow"]
    assert r["og_title"] == "OG" and r["twitter_card"] is None and r["has_viewport"] and r["charset_declared"] == "utf-8"
    assert r["pagination_next"] == "https://example.com/dir/page?p=2" and r["html_lang"] == "en"
    assert r["has_noscript_fallback"] and r["has_mixed_content"] and r["form_actions"] == ["http://f/"]
    assert (r["empty_link_count"], r["form_inputs_without_label"], r["has_skip_nav"]) == (1, 1, True)


def test_blank_page_and_frameworks():
    assert html.extract("https://e.com/", "  ", bool)["h1_count"] == 0
    find = lambda h: html.extract("https://e.com/", h, bool)["spa_framework"]
    assert [find(h) for h in ('<div id="root">', '<div id="__next">', '<div id="__nuxt">', "<app-root>", "<p>")] == ["react", "next", "nuxt", "angular", None]


def test_sections_close_at_enough_words():
    text = lambda n: {"type": "text", "text": "w " * n, "heading": "H", "level": 1, "tag": "p"}
    head = {"type": "heading", "text": "H", "heading": "H", "level": 1, "tag": "h1"}
    got = html.merge_sections([head, text(60), text(50), text(10), dict(text(5), heading="I")])
    assert [(x["type"], len(x["text"].split())) for x in got] == [("heading", 1), ("text", 110), ("text", 10), ("text", 5)]


def test_simple_profile():
    r = html.simple_page("https://e.com/a", '<h1><img alt="logo"></h1><a href="/b#x">1</a><a href="/b/">2</a><a href="http://www.e.com/c">3</a><a href="http://o.org">4</a>', "e.com")
    assert r["h1"] == "logo" and r["internal_links"] == ["https://e.com/b", "http://www.e.com/c"] and r["external_links"] == ["http://o.org"] and r["word_count"] == 4


def test_scalars(spark):
    x = lambda c, **v: one(spark, c, **v)
    col = F.col
    assert x(scalars.brand_tokens(col("n")), n="Lanternfish Group AB") == ["lanternfish group ab", "lanternfish group"]
    assert [x(scalars.authority_bonus(col("r")), r=r) for r in (0, 5, 37, 99)] == [1, 1, 4, 10]
    assert [x(scalars.vital_grade("lcp", col("v")), v=v) for v in (2500, 4000, 4001)] == ["good", "needs-improvement", "poor"]
    assert x(scalars.cosine(col("a"), col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    assert x(scalars.hamming(col("a"), col("b")), a=5, b=6) == 2
    assert x(scalars.first_json_object(col("t")), t='so {"a": {"b": 1}} there') == '{"a": {"b": 1}}'
    assert x(scalars.json_list(col("t")), t="oops") == []
    assert x(scalars.entity_list(col("t"), 2), t='{"entities": ["a", "b", "c"]}') == ["a", "b"]
    assert x(scalars.split_list(col("t"), 3), t="a, ,b,c,d") == ["a", "b", "c"]
    assert x(scalars.lead_parts(col("t")), t="Ann, a@b.c")["company"] == ""
    assert x(scalars.rewrite_bounds(col("n")), n=10).asDict() == {"least": 20, "most": 13}
    assert x(scalars.inject_link(col("h"), col("a"), col("u")), h='<p title="red car">A Red Car here</p>', a="red car", u="/c") == '<p title="red car">A <a href="/c">Red Car</a> here</p>'
    assert x(scalars.inject_link(col("h"), col("a"), col("u")), h='<a href="/c">x</a> red', a="red", u="/c") == '<a href="/c">x</a> red'
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    day = lambda d: F.lit(d).cast("timestamp")
    due = [x(scalars.crawl_due(F.lit(c), day(d), now)) for c, d in (("0 0 1 * *", "2024-05-05"), ("0 0 1 * *", "2024-05-04"), ("0 0 * * 1", "2024-05-25"), ("0 0 * * *", "2024-05-31"), ("x", "2024-05-03"))]
    assert due == [False, True, True, True, False]
    assert x(scalars.is_stale(F.lit("2023-01-01T10:00:00Z"), F.lit("2024-06-01").cast("date"))) is True
    assert x(scalars.indexability_reason(F.lit(False), F.lit(True), F.lit(404), F.lit(None).cast("string"), F.lit("u"))) == "http_404"
    assert x(scalars.differ(F.lit(""), F.lit(None).cast("string"))) is False


def test_simhash_is_stable_and_close(spark):
    text = "the quick brown fox jumps over the lazy dog " * 20
    rows = spark.createDataFrame([(text,), (text + "x",), ("ab",), (None,)], "t string").select(scalars.simhash64("t").alias("h")).collect()
    assert (rows[0].h ^ rows[1].h).bit_count() < 6 and rows[2].h == rows[3].h == 0


def test_render_and_mobile(spark):
    page = lambda **v: {k: F.lit(x) for k, x in ({"title": "T", "h1_text": "H", "canonical_url": None, "meta_robots": None, "internal_links_count": 1, "word_count": 100} | v).items()}
    raw, rich = page(), page(h1_text="H2", internal_links_count=20, word_count=300)
    got = spark.range(1).select(scalars.render_diff(raw.__getitem__, rich.__getitem__).alias("d"), scalars.mobile_diff(raw.__getitem__, rich.__getitem__).alias("m")).first()
    assert (got.d.h1_changed, got.d.title_changed, got.d.links_added, got.d.word_count_diff, got.d.has_significant_changes) == (True, False, 19, 200, True)
    assert got.m.mobile_links == 20
    need = lambda h, **v: one(spark, scalars.needs_render(F.lit(h), F.lit(v.get("h1", "H")), F.lit("T"), F.lit(v.get("links", 5)), F.lit(200), F.lit(None).cast("string")))
    full = "<html><body>" + "x" * 2100 + "</body></html>"
    assert [need("short"), need(full), need(full, links=0), need('<body id="root"><script>' + "x" * 2100 + "</script></body>")] == [True, False, True, True]


def test_divergence_and_sections(spark):
    t, a = F.create_map(F.lit("warm"), F.lit(1.0)), F.create_map(F.lit("warm"), F.lit(0.0), F.lit("dry"), F.lit(0.0))
    d = one(spark, scalars.divergence(t, a))
    assert abs(d.distance - 0.5**0.5) < 1e-9 and d.off
    r = one(spark, scalars.report_sections(F.lit("All good.\n1. Fix titles\n2) Add links\n## Competitor view")))
    assert r.summary == "All good." and r.priorities == ["1. Fix titles", "2) Add links"] and r.competitors == ["## Competitor view"]
