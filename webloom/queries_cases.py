"""Queries of functions of one row: each page of the table is given one of some listed inputs, and the SQL holds what is to come out.

The expected values are written by hand from what the functions are to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, scalars, urls
from webloom.operators import aggregates, rankings
from webloom.sources import tables
from webloom.sources.fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_KINDS = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP"}


def _kind(kind: str) -> str:
    """A type's name in DuckDB: of arrays of plain types, else of plain ones."""
    return f"{_kind(kind[6:-1])}[]" if kind.startswith("array<") else _KINDS[kind]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)


def _cased(name: str, given: str, out: str, rows: list[tuple], make: Callable[[DataFrame], DataFrame]) -> None:
    """A query over all pages: ``rows`` are inputs followed by outputs; ``make`` gets page_id and the inputs, and returns the outputs beside page_id."""
    names, fields = [f.split(" ")[0] for f in given.split(", ")], [tuple(f.split(" ", 1)) for f in out.split(", ")]
    n = len(names)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        cases = spark.createDataFrame([(k, *r[:n]) for k, r in enumerate(rows)], f"case_ int, {given}")
        pages = table(spark, sf, "pages").select("page_id", (F.col("page_id") % len(rows)).cast("int").alias("case_"))
        return make(pages.join(F.broadcast(cases), "case_").drop("case_")).select("page_id", *[f for f, _ in fields])  # the cases are a literal list

    listed = ", ".join(f"({k}, {', '.join(f'CAST({_literal(v)} AS {_kind(kind)})' for v, (_, kind) in zip(r[n:], fields))})" for k, r in enumerate(rows))
    QUERIES[name] = run
    SQL[name] = f"SELECT page_id, {', '.join(f for f, _ in fields)} FROM pages JOIN (VALUES {listed}) AS v(case_, {', '.join(f for f, _ in fields)}) ON page_id % {len(rows)} = case_"


def _columns(**columns: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("page_id", *[c().alias(name) for name, c in columns.items()])


_C = F.col

# fetching and robots

_cased(
    "response_headers",
    "header string, status int",
    "kind string, charset string, again boolean",
    [
        ("Text/HTML; Charset=UTF-8", 200, "text/html", "utf-8", False),
        (" application/JSON ", 429, "application/json", None, True),
        ('text/plain ;charset="ISO-8859-1"', 404, "text/plain", "iso-8859-1", False),
        ("text/html; boundary=x; charset=windows-1252;", 503, "text/html", "windows-1252", True),
        ("", 500, "", None, True),
        ("image/png", 502, "image/png", None, True),
        ("text/css", 504, "text/css", None, True),
        ("text/css", 501, "text/css", None, False),
    ],
    _columns(kind=lambda: scalars.content_type(_C("header")), charset=lambda: scalars.header_charset(_C("header")), again=lambda: scalars.retryable(_C("status"))),
)
_cased(
    "robots_prefixes",
    "path string, disallow array<string>",
    "blocked boolean",
    [("/private/x", ["/private/"], True), ("/private", ["/private/"], False), ("/a", [], False), ("/a", [""], False), ("/anything", ["/"], True), ("/b/c", ["/a", "/b"], True), ("/x*y", ["/*"], False)],
    _columns(blocked=lambda: urls.robots_blocks(_C("path"), _C("disallow"))),
)


def _rules(df: DataFrame) -> DataFrame:
    hosts = df.withColumn("host", _C("page_id").cast("string"))
    got = tables.robots_rules(hosts).groupBy("host").agg(F.array_sort(F.collect_list(F.concat(F.when(_C("allow"), "+").otherwise("-"), "prefix"))).alias("rules"))
    state = tables.parse_robots(hosts).select("host", "exists", "parse_error", "sitemap_urls")
    met = state.join(got, "host", "left")
    return met.select(_C("host").cast("long").alias("page_id"), "exists", "parse_error", "sitemap_urls", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


_cased(
    "robots_files",
    "text string, status_code int",
    "exists boolean, parse_error string, sitemap_urls array<string>, rules array<string>",
    [
        ("User-agent: *\nDisallow: /a\nAllow: /a/b # but this\nSitemap: https://s.example/m.xml", 200, True, None, ["https://s.example/m.xml"], ["+/a/b", "-/a"]),
        ("User-agent: x\nDisallow: /\n\nUSER-AGENT: *\nDisallow:\nDisallow: /c", 200, True, None, [], ["-/c"]),
        ("anything", 404, False, None, [], []),
        ("", 503, False, "status 503", [], []),
        ("user-agent: *\r\ndisallow: /d\r\nsitemap: https://s.example/1.xml\r\nSITEMAP:https://s.example/2.xml", 200, True, None, ["https://s.example/1.xml", "https://s.example/2.xml"], ["-/d"]),
        ("Disallow: /before any agent", 200, True, None, [], []),
    ],
    _rules,
)

# urls

_NORMAL = [
    ("https://example.com/page#section", "https://example.com/page"),
    ("https://example.com/page/", "https://example.com/page/"),
    ("https://example.com", "https://example.com/"),
    ("HTTPS://EXAMPLE.COM/Page", "https://example.com/Page"),
    ("https://example.com:443/page", "https://example.com/page"),
    ("http://example.com:80/", "http://example.com/"),
    ("http://example.com:443/", "http://example.com:443/"),
    ("https://example.com:8080/page", "https://example.com:8080/page"),
    ("https://user:secret@Example.com/x", "https://example.com/x"),
    ("https://example.com/page?utm_source=google&id=123", "https://example.com/page?id=123"),
    ("https://example.com/page?FBCLID=1", "https://example.com/page"),
    ("https://example.com/page?z=1&a=2&z=0", "https://example.com/page?a=2&z=1&z=0"),
    ("https://example.com/page?b=&a", "https://example.com/page?a=&b="),
    ("https://example.com/a//b///c", "https://example.com/a/b/c"),
    ("https://example.com/a/../b/.", "https://example.com/a/../b/."),
    ("https://example.com/%7euser/a%20b", "https://example.com/~user/a%20b"),
    ("https://example.com/café", "https://example.com/caf%C3%A9"),
    ("https://example.com/p;v=1?q=a+b", "https://example.com/p?q=a+b"),
    ("  https://example.com/x  ", "https://example.com/x"),
    ("https://example.com/?q=%C3%A9&A=1", "https://example.com/?A=1&q=%C3%A9"),
    ("", None),
    ("not-a-url", None),
    ("javascript:void(0)", None),
    ("mailto:test@example.com", None),
    ("ftp://example.com/x", None),
    ("//example.com/x", None),
    ("https:///nohost", None),
]
_cased("url_normal_forms", "url string", "normal string", _NORMAL, _columns(normal=lambda: urls.normalizer()(_C("url"))))
_cased(
    "url_parameter_policies",
    "url string",
    "denied string, allowed string, whole string",
    [
        ("https://e.example/?session_id=a&color=red&utm_id=1", "https://e.example/?color=red", "https://e.example/", "https://e.example/?color=red&session_id=a&utm_id=1"),
        ("https://e.example/l?Page=2&sort=d&ref=n", "https://e.example/l?Page=2&sort=d", "https://e.example/l?Page=2&sort=d", "https://e.example/l?Page=2&ref=n&sort=d"),
        ("https://e.example/l?DEBUG=1", "https://e.example/l", "https://e.example/l", "https://e.example/l?DEBUG=1"),
    ],
    _columns(
        denied=lambda: urls.normalizer(deny=["session_id", "debug"])(_C("url")),
        allowed=lambda: urls.normalizer(allow=["page", "sort"])(_C("url")),
        whole=lambda: urls.normalizer(drop_tracking=False)(_C("url")),
    ),
)
_RULES = urls.suffix_rules("// a list\ncom\nexample\nuk\nco.uk\n*.ck\n!www.ck\n// ===BEGIN PRIVATE DOMAINS===\nblogs.com\n")
_cased(
    "url_internal",
    "url string",
    "plain boolean, allowed boolean, subdomains boolean, www boolean, crawled boolean",
    [
        ("https://shop.co.uk/page", True, True, True, True, True),
        ("https://SHOP.co.uk:8080/", True, True, True, True, True),
        ("https://blog.shop.co.uk/page", False, True, True, False, False),
        ("https://api.shop.co.uk/page", False, False, True, False, False),
        ("https://www.shop.co.uk/", False, False, True, True, False),
        ("https://other.co.uk/", False, False, False, False, False),
        ("https://shop.com/", False, False, False, False, False),
        ("https://localhost/", False, False, False, False, False),
        ("mailto:a@shop.co.uk", False, False, False, False, False),
    ],
    _columns(
        plain=lambda: urls.is_internal_by(_RULES, "shop.co.uk")(_C("url")),
        allowed=lambda: urls.is_internal_by(_RULES, "shop.co.uk", allowlist=["Blog"])(_C("url")),
        subdomains=lambda: urls.is_internal_by(_RULES, "shop.co.uk", True)(_C("url")),
        www=lambda: urls.is_internal_by(_RULES, "www.shop.co.uk")(_C("url")),
        crawled=lambda: F.coalesce(urls.should_crawl(_C("url"), "shop.co.uk"), F.lit(False)),
    ),
)
_cased(
    "url_suffixes",
    "url string",
    "ck boolean, private boolean",
    [
        ("https://a.b.ck/", True, False),
        ("https://x.a.b.ck/", False, False),
        ("https://www.ck/", False, False),
        ("https://one.blogs.com/", False, False),
        ("https://blogs.com/", False, True),
        ("https://b.ck/", False, False),
    ],
    _columns(ck=lambda: urls.is_internal_by(_RULES, "a.b.ck")(_C("url")), private=lambda: urls.is_internal_by(_RULES, "blogs.com")(_C("url"))),
)
_cased(
    "url_tests",
    "url string",
    "same boolean, resource boolean, mixed boolean, deep boolean, special boolean, tracker boolean",
    [
        ("https://www.e.example/About-Us", True, False, True, False, False, False),
        ("https://e.example/", True, False, False, False, False, False),
        ("https://e.example/IMG.JPG", True, True, True, False, False, False),
        ("https://e.example/a/b/c/d/e/f/deep-page", True, False, False, True, False, False),
        ("https://e.example/a/b/c/d/e/", True, False, False, False, False, False),
        ("https://e.example/path/with%20spaces/file", True, False, False, False, True, False),
        ("https://sub.e.example/style.css?v=1", False, True, False, False, False, False),
        ("https://www.google-analytics.com/x.js", False, True, False, False, False, True),
        ("https://e.example/page.html?f=x.png", True, False, False, False, False, False),
        ("https://www.www.e.example/a_b", False, False, False, False, False, False),
    ],
    _columns(
        same=lambda: urls.same_domain(_C("url"), F.lit("https://e.example/x")),
        resource=lambda: urls.is_resource(_C("url")),
        mixed=lambda: urls.is_mixed_case(_C("url")),
        deep=lambda: urls.is_deep(_C("url")),
        special=lambda: urls.has_special_characters(_C("url")),
        tracker=lambda: urls.is_blocked_tracker(_C("url")),
    ),
)
_cased(
    "url_resolution",
    "base string, href string",
    "resolved string",
    [
        ("https://e.example/a/b", "c", "https://e.example/a/c"),
        ("https://e.example/a/b/", "../c?x#y", "https://e.example/a/c?x#y"),
        ("https://e.example/a", "//cdn.example/x", "https://cdn.example/x"),
        ("https://e.example/a?q", "?p=2", "https://e.example/a?p=2"),
        ("https://e.example/a", "http://o.example/", "http://o.example/"),
        ("https://e.example/a", "", "https://e.example/a"),
    ],
    _columns(resolved=lambda: urls.resolve(_C("base"), _C("href"))),
)
_cased(
    "frontier_priorities",
    "source string, depth int, lastmod string",
    "priority int",
    [("sitemap", 9, "2024-01-01", 0), ("sitemap", 0, None, 1), ("seed", 0, None, 2), ("discovered", 0, None, 3), ("discovered", 1, "2024-01-01", 4), ("discovered", 2, None, 5), ("discovered", 3, None, 6), ("discovered", 5, None, 6), ("discovered", 6, None, 7)],
    _columns(priority=lambda: urls.priority(_C("source"), _C("depth"), _C("lastmod"))),
)

# html

_PAGE = """<!DOCTYPE html><html lang=" en-GB "><head><title> My  Page </title><!-- <title>no</title> -->
<meta name="Description" content=" A description. "><meta name="description" content="second"><meta name="ROBOTS" content="NoIndex, follow"><meta name="googlebot" content=" nofollow ">
<link rel="canonical" href="/canon"><link rel="canonical" href="/second"><link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="" href="/x"><link rel="alternate" hreflang="fr" href="https://fr.example.com/">
<meta property="og:title" content=" OG "><meta property="og:image" content=""><meta property="OG:url" content="x"><meta name="twitter:card" content="summary"><meta name="viewport" content="width=device-width"><meta charset=" UTF-8 ">
<link rel="next" href="?p=3"><link rel="prev" href="/list?p=1"><link rel="stylesheet" href="http://cdn.example/x.css">
<script type="application/ld+json">{"@type": ["Article", "Thing"], "headline": "x"}</script><script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type": "Person"}, {"@type": ["A", "B"]}, 3]</script><script>var a = "<p>no</p>"</script></head>
<body><header><a href="/home">Home</a></header><nav><a href="/n1"> One </a><a href="#main">skip</a></nav><h2>Second</h2><h1>First <b>bold</b></h1><h4></h4><h4>Fourth</h4>
<p>Some  text &amp; more.<!-- hidden --></p><div class="sidebar wide"><a href="https://o.example/p" rel="NoFollow sponsored"></a></div><a href="rel/page?q=1"><img src="a.png" alt=" "></a><a href="javascript:x()">no</a><a href="mailto:a@b.c">m</a><a href="//cdn.example/y" title="t"></a>
<img data-src="lazy.jpg"><img src="data:image/gif;base64,x" data-src="z.jpg" alt="pic" width="1" height="2"><noscript><img data-src="w.jpg" alt="w" width="1" height="1">A fallback text that is longer than fifty characters, no doubt.</noscript>
<form action=" http://f.example/post "><label for="a">A</label><input id="a"><input id="b"><input type="hidden"><label>C <select></select></label><textarea aria-label="t"></textarea><input type="text"></form><form></form>
<footer id="footer"><a href="/f">F</a></footer><div id="root"></div></body></html>"""
_BARE = "<p>Only text</p><p>and more"
_OLD = '<HTML><HEAD><TITLE></TITLE><META HTTP-EQUIV="content-type" CONTENT="text/html; CHARSET=latin1;"></HEAD><BODY><h3>x</h3><div ng-app>y</div><a href=" "></a><a name="z">n</a></BODY></HTML>'
_HTML = "url string, html string"


def _extracted(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: html.extract_pages(df, lambda u: "//www.example.com/" in u).select("page_id", *columns)


_AT = "https://www.example.com/dir/page"
_cased(
    "html_heads",
    _HTML,
    "title string, title_length int, meta_description string, meta_description_length int, meta_robots string, canonical_url string, canonical_count int, robots_directives array<string>, is_noindex boolean, is_nofollow boolean, html_lang string, pagination_next string, pagination_prev string, has_pagination boolean, viewport_content string, has_viewport boolean, charset_declared string, og_title string, og_image string, og_url string, twitter_card string",
    [
        (_AT, _PAGE, "My  Page", 8, "A description.", 14, "NoIndex, follow", "https://www.example.com/canon", 2, ["follow", "nofollow", "noindex"], True, True, "en-GB", "https://www.example.com/dir/page?p=3", "https://www.example.com/list?p=1", True, "width=device-width", True, "UTF-8", "OG", None, None, "summary"),
        (_AT, _BARE, None, 0, None, 0, None, None, 0, [], False, False, None, None, None, False, None, False, None, None, None, None, None),
        (_AT, _OLD, "", 0, None, 0, None, None, 0, [], False, False, None, None, None, False, None, False, "latin1", None, None, None, None),
        (_AT, " ", None, 0, None, 0, None, None, 0, [], False, False, None, None, None, False, None, False, None, None, None, None, None),
        (_AT, None, None, 0, None, 0, None, None, 0, [], False, False, None, None, None, False, None, False, None, None, None, None, None),
    ],
    _extracted(*"title title_length meta_description meta_description_length meta_robots canonical_url canonical_count robots_directives is_noindex is_nofollow html_lang pagination_next pagination_prev has_pagination viewport_content has_viewport charset_declared og_title og_image og_url twitter_card".split()),
)
_cased(
    "html_headings",
    _HTML,
    "h1_count int, h1_text string, levels array<int>, texts array<string>, gaps array<string>",
    [
        (_AT, _PAGE, 1, "Firstbold", [1, 2, 4], ["Firstbold", "Second", "Fourth"], ["2-4:3"]),
        (_AT, _BARE, 0, None, [], [], []),
        (_AT, "<h1> </h1><h1>b</h1><h5>e</h5><h2>" + "x" * 300 + "</h2>", 2, "", [1, 2, 5], ["b", "x" * 200, "e"], ["2-5:3,4"]),
    ],
    lambda df: _extracted("h1_count", "h1_text", "heading_outline", "heading_hierarchy_gaps")(df).select(
        "page_id",
        "h1_count",
        "h1_text",
        _C("heading_outline.level").alias("levels"),
        _C("heading_outline.text").alias("texts"),
        F.transform("heading_hierarchy_gaps", lambda g: F.concat(g["from_level"].cast("string"), F.lit("-"), g["to_level"].cast("string"), F.lit(":"), F.array_join(g["skipped"].cast("array<string>"), ","))).alias("gaps"),
    ),
)
_cased(
    "html_texts",
    _HTML,
    "main_text string, word_count int, content_hash string",
    [
        (_AT, _BARE, "Only text and more", 4, "57b5a5e2ac9a0d2c0b1a5f42cc8dfbd4"),
        (_AT, "<body><nav>menu</nav> a<b>b</b>\n c <script>x</script><style>y</style><aside>z</aside><!-- d --></body>", "a b c", 3, ""),
        (_AT, "<footer>only</footer>", "", 0, ""),
    ],
    lambda df: _extracted("main_text", "word_count", "content_hash")(df),
)
SQL["html_texts"] = SQL["html_texts"].replace("word_count, content_hash FROM", "word_count, CASE WHEN main_text = '' THEN '' ELSE sha256(main_text) END AS content_hash FROM")
_cased(
    "html_links",
    _HTML,
    "hrefs array<string>, resolved array<string>, anchors array<string>, inside array<boolean>, follows array<boolean>, contexts array<string>, internal_links_count int, external_links_count int, internal_nofollow_count int, tags array<string>",
    [
        (
            _AT,
            _PAGE,
            ["/home", "/n1", "https://o.example/p", "rel/page?q=1", "https://cdn.example/y", "/f"],
            ["https://www.example.com/home", "https://www.example.com/n1", "https://o.example/p", "https://www.example.com/dir/rel/page?q=1", "https://cdn.example/y", "https://www.example.com/f"],
            ["Home", "One", "", "", "", "F"],
            [True, True, False, True, False, True],
            [True, True, False, True, True, True],
            ["header", "nav", "sidebar", "content", "content", "footer"],
            4,
            2,
            0,
            ["de https://www.example.com/de", "fr https://fr.example.com/"],
        ),
        (_AT, _BARE, [], [], [], [], [], [], 0, 0, 0, []),
        (_AT, '<div role="navigation"><a href="a" rel="nofollow"> x <i>y</i></a></div>', ["a"], ["https://www.example.com/dir/a"], ["xy"], [True], [False], ["nav"], 1, 0, 1, []),
    ],
    lambda df: _extracted("links", "internal_links_count", "external_links_count", "internal_nofollow_count", "hreflang_tags")(df).select(
        "page_id",
        _C("links.href").alias("hrefs"),
        _C("links.href_resolved").alias("resolved"),
        _C("links.anchor_text").alias("anchors"),
        _C("links.is_internal").alias("inside"),
        _C("links.is_follow").alias("follows"),
        _C("links.context").alias("contexts"),
        "internal_links_count",
        "external_links_count",
        "internal_nofollow_count",
        F.transform("hreflang_tags", lambda t: F.concat_ws(" ", t["lang"], t["href"])).alias("tags"),
    ),
)
_cased(
    "html_images",
    _HTML,
    "sources array<string>, named array<boolean>, broken array<boolean>, img_count int, img_missing_alt int, img_lazy_broken int, img_missing_dimensions int",
    [
        (_AT, _PAGE, ["a.png", "lazy.jpg", "data:image/gif;base64,x", "w.jpg"], [False, False, True, True], [False, True, True, False], 4, 2, 2, 2),
        (_AT, _BARE, [], [], [], 0, 0, 0, 0),
        (_AT, '<img src="x" width="" height="1" alt="a" loading="lazy"><img>', ["x", ""], [True, False], [False, False], 2, 1, 0, 2),
    ],
    lambda df: _extracted("images", "img_count", "img_missing_alt", "img_lazy_broken", "img_missing_dimensions")(df).select(
        "page_id", _C("images.src").alias("sources"), _C("images.has_alt").alias("named"), _C("images.is_lazy_broken").alias("broken"), "img_count", "img_missing_alt", "img_lazy_broken", "img_missing_dimensions"
    ),
)
_cased(
    "html_signals",
    _HTML,
    "structured_data_types array<string>, blocks int, errors int, spa_framework string, has_noscript_fallback boolean, has_mixed_content boolean, form_actions array<string>, empty_link_count int, form_inputs_without_label int, has_skip_nav boolean",
    [
        (_AT, _PAGE, ["Article", "Person", "Thing", "['A', 'B']"], 3, 1, "react", True, True, ["http://f.example/post"], 2, 2, True),
        ("http://www.example.com/dir/page", _PAGE, ["Article", "Person", "Thing", "['A', 'B']"], 3, 1, "react", True, False, ["http://f.example/post"], 2, 2, True),
        (_AT, _BARE, [], 0, 0, None, False, False, [], 0, 0, False),
        (_AT, _OLD, [], 0, 0, "angular", False, False, [], 1, 0, False),
        (_AT, '<div id="__next"></div><a href="/x">a</a><a href="/y">b</a><a href="/z">c</a><a href="#content">d</a>', [], 0, 0, "next", False, False, [], 0, 0, False),
    ],
    lambda df: _extracted("structured_data_types", "structured_data", "spa_framework", "has_noscript_fallback", "has_mixed_content", "form_actions", "empty_link_count", "form_inputs_without_label", "has_skip_nav")(df).select(
        "page_id",
        "structured_data_types",
        F.size("structured_data").alias("blocks"),
        F.size(F.filter("structured_data", lambda b: F.contains(b, F.lit('"_error"')))).alias("errors"),
        "spa_framework",
        "has_noscript_fallback",
        "has_mixed_content",
        "form_actions",
        "empty_link_count",
        "form_inputs_without_label",
        "has_skip_nav",
    ),
)
_LONG = " ".join(f"w{k}" for k in range(60))
_cased(
    "html_sections_cases",
    _HTML,
    "kinds array<string>, levels array<int>, texts array<string>, headings array<string>",
    [
        (
            _AT,
            f"<body><h1>A heading here</h1><p>{_LONG}</p><p>{_LONG}</p><p>The last of them.</p><h2>Another heading</h2><p>short</p><p>Long enough to stay.</p><nav><p>Not in the navigation.</p></nav></body>",
            ["heading", "text", "text", "heading", "text"],
            [1, 1, 1, 2, 2],
            ["A heading here", f"{_LONG} {_LONG}", "The last of them.", "Another heading", "Long enough to stay."],
            ["A heading here", "A heading here", "A heading here", "Another heading", "Another heading"],
        ),
        (_AT, "<main><p>In the main part.</p></main><p>Out of the main part.</p>", ["text"], [0], ["In the main part."], [""]),
    ],
    lambda df: _extracted("sections")(df).select("page_id", _C("sections.type").alias("kinds"), _C("sections.level").alias("levels"), _C("sections.text").alias("texts"), _C("sections.heading").alias("headings")),
)
_cased(
    "html_outline_rows",
    _HTML,
    "rows array<string>",
    [(_AT, _PAGE, ["0 1 Firstbold", "1 2 Second", "2 4 Fourth"]), (_AT, "<h2>b</h2><h1>a</h1>", ["0 1 a", "1 2 b"])],
    lambda df: html.headings_of(html.extract_pages(df)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", _C("pos").cast("string"), _C("level").cast("string"), "text"))).alias("rows")),
)


def _simple(df: DataFrame) -> DataFrame:
    kind = "h1 string, internal_links array<string>, external_links array<string>, word_count int"

    @F.udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def page(url, text):
        return html.simple_page(url, text, "www.example.com")

    return df.select("page_id", page("url", "html").alias("x")).select("page_id", "x.*")


_cased(
    "html_simple_pages",
    _HTML,
    "h1 string, internal_links array<string>, external_links array<string>, word_count int",
    [
        (_AT, '<nav>one two</nav><h1>A <b>b</b></h1><a href="/x#f">x</a><a href="/x/">x</a><a href="http://example.com/y">y</a><a href="https://o.example/">o</a><a href="#f">f</a>', "A b", ["https://www.example.com/x", "http://example.com/y", "https://www.example.com/dir/page"], ["https://o.example"], 9),
        (_AT, '<h1 aria-label=" Named "><img alt="i"></h1>', "Named", [], [], 0),
        (_AT, '<h1><img alt=" I "></h1>t', "I", [], [], 1),
        (_AT, None, "", [], [], 0),
    ],
    _simple,
)

# derived columns of pages

_cased(
    "indexability",
    "noindex boolean, allowed boolean, status int, canonical string, url string",
    "reason string, indexable boolean",
    [
        (True, False, 404, None, "u", "noindex", False),
        (False, False, 404, None, "u", "robots_blocked", False),
        (False, True, 404, "x", "u", "http_404", False),
        (False, True, None, None, "u", "http_0", False),
        (False, True, 200, "x", "u", "canonical_other", True),
        (False, True, 200, "u/", "u", "canonical_other", True),
        (False, True, 200, "u", "u", None, True),
        (False, True, 200, "", "u", None, True),
        (None, None, 200, None, "u", None, True),
    ],
    _columns(reason=lambda: scalars.indexability_reason(_C("noindex"), _C("allowed"), _C("status"), _C("canonical"), _C("url")), indexable=lambda: scalars.is_indexable(_C("noindex"), _C("allowed"), _C("status"))),
)


def _records(df: DataFrame) -> DataFrame:
    hop = lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.lit("u").alias("url"), F.lit(301).alias("status_code")))
    fetched = df.select("page_id", F.lit("u").alias("url"), F.create_map("name", "value").alias("headers"), F.when(_C("hops") > 0, hop(_C("hops"))).otherwise(F.array().cast("array<struct<url:string,status_code:int>>")).alias("redirect_chain"), "body")
    return tables.page_records(fetched)


_cased(
    "page_records",
    "name string, value string, hops int, body string",
    "content_type string, redirect_hops int, response_bytes long",
    [("Content-Type", "Text/HTML; charset=x", 2, "abc", "text/html", 2, 3), ("content-type", "image/png", 0, "é€", "image/png", 0, 5), ("Server", "x", 1, "", None, 1, 0)],
    _records,
)
_SHELL = "<html><body><div id=\"root\"></div></body></html>" + "<!-- " + "x" * 2000 + " -->"
_FULL = "<html><body><p>" + "word " * 500 + "</p></body></html>"
_cased(
    "render_needs",
    "html string, h1 string, title string, links int, words int, framework string",
    "needed boolean",
    [
        (None, "h", "t", 5, 500, None, True),
        ("", "h", "t", 5, 500, None, True),
        ("<html>short</html>", "h", "t", 5, 500, None, True),
        (_SHELL, "h", "t", 5, 500, None, True),
        (_FULL, "h", "t", 5, 500, None, False),
        (_FULL, None, "t", 5, 500, None, False),
        (_FULL, "", None, 5, 500, None, True),
        (_FULL, "h", "t", 0, 500, None, True),
        (_FULL, "h", "t", 5, 49, None, True),
        (_FULL, "h", "t", 5, 500, "vue", True),
        (_FULL.replace("</body>", "<noscript>" + "please " * 20 + "</noscript></body>"), "h", "t", 5, 500, None, True),
        (_FULL.replace("</body>", "<noscript>short</noscript></body>"), "h", "t", 5, 500, None, False),
    ],
    _columns(needed=lambda: scalars.needs_render(_C("html"), _C("h1"), _C("title"), _C("links"), _C("words"), _C("framework"))),
)


def _two(df: DataFrame) -> DataFrame:
    one = lambda side: lambda c: _C({"title": f"t{side}", "h1_text": f"h{side}", "canonical_url": f"c{side}", "meta_robots": f"r{side}", "internal_links_count": f"l{side}", "word_count": f"w{side}"}[c])
    return df.select("page_id", scalars.render_diff(one(1), one(2)).alias("d"), scalars.mobile_diff(one(1), one(2)).alias("m")).select("page_id", "d.*", "m.*")


_cased(
    "parity_diffs",
    "t1 string, t2 string, h1 string, h2 string, c1 string, c2 string, r1 string, r2 string, l1 int, l2 int, w1 int, w2 int",
    "title_changed boolean, h1_changed boolean, canonical_changed boolean, robots_changed boolean, links_added int, word_count_diff int, has_significant_changes boolean, desktop_words int, mobile_words int, desktop_links int, mobile_links int",
    [
        ("a", " a ", "h", "h", None, "", "x", "x", 3, 8, 100, 200, False, False, False, False, 5, 100, False, 100, 200, 3, 8),
        ("a", "b", "h", "h", None, None, None, None, 8, 3, 100, 100, True, False, False, False, 0, 0, True, 100, 100, 8, 3),
        ("a", "a", "h", "H", None, "u", None, "noindex", 0, 0, 0, 0, False, True, True, True, 0, 0, True, 0, 0, 0, 0),
        (None, None, None, None, None, None, None, None, None, 6, None, 10, False, False, False, False, 6, 10, True, 0, 10, 0, 6),
        ("", None, "", "", "", "", "", "", 1, 1, 300, 199, False, False, False, False, 0, -101, True, 300, 199, 1, 1),
    ],
    _two,
)
_cased(
    "browser_signals",
    "raw string, rendered string, page string",
    "changed boolean, ratio double, thin boolean",
    [("a", "b", "xxxx", True, 0.25, True), ("", None, "", False, 0.0, True), ("", "b", "xy", True, 0.5, True), ("a", "a", "xxx", False, 0.333, True), ("c" * 300, "c" * 300, "x" * 900, False, 0.333, False)],
    _columns(changed=lambda: scalars.differ(_C("raw"), _C("rendered")), ratio=lambda: scalars.text_ratio(F.coalesce("rendered", F.lit("")), _C("page")), thin=lambda: scalars.is_thin_text(F.coalesce("rendered", F.lit("")))),
)
_cased(
    "tag_and_vitals_signals",
    "html string",
    "gtm boolean, gtag boolean, pixel boolean, double_fire boolean, preload boolean, defer boolean, images int",
    [
        ('<script src="https://www.GoogleTagManager.com/gtm.js?id=1"></script><script>gtag("x")</script>', True, True, False, True, False, False, 0),
        ("<script defer src=x></script><script>fbq('init')</script>", False, False, True, False, False, True, 0),
        ('<link as="image" rel="preload" href="x"><img src=a><IMG src=b><imgx>', False, False, False, False, True, False, 2),
        ("", False, False, False, False, False, False, 0),
    ],
    lambda df: df.select("page_id", scalars.tag_signals(_C("html")).alias("t"), scalars.vitals_signals(_C("html")).alias("v")).select("page_id", "t.*", "v.*"),
)

# text and numbers

_cased("hamming_distances", "a long, b long", "d int", [(0, 0, 0), (1, 2, 2), (-1, 0, 64), (7, 4, 2), (-(2**63), 0, 1)], _columns(d=lambda: scalars.hamming(_C("a"), _C("b"))))


def _reward(df: DataFrame) -> DataFrame:
    side = lambda k: lambda c: _C({"gsc_ctr": f"c{k}", "gsc_position": f"p{k}"}[c])
    return df.select("page_id", scalars.reward(side(1), side(2)).alias("reward"))


_cased(
    "action_rewards",
    "c1 double, p1 double, c2 double, p2 double",
    "reward double",
    [(1.0, 10.0, 2.5, 8.0, 1.6), (None, None, 1.0, 20.0, 5.0), (2.0, 5.0, None, None, -6.75), (0.5, 3.0, 0.5, 3.0, 0.0), (0.0, 7.5, 0.12345, 7.5, 0.1234)],
    _reward,
)
_cased(
    "page_dates",
    "text string",
    "day date, stale boolean",
    [
        ("2020-01-02T03:04:05Z", "2020-01-02", True),
        ("2024-12-31", "2024-12-31", True),
        ("2025-01-01T00:00:01", "2025-01-01", False),
        ("2025-01-01T00:00:00+05:00", "2025-01-01", False),
        ("2024-12-31T00:00:00", "2024-12-31", True),
        ("2025-6-1", "2025-06-01", False),
        ("01/02/2003", None, None),
        ("2020-01-02 03:04:05", None, None),
        ("soon", None, None),
        (None, None, None),
    ],
    _columns(day=lambda: scalars.parse_date(_C("text")).cast("date"), stale=lambda: scalars.is_stale(_C("text"), F.lit("2026-01-01").cast("timestamp"))),
)
_cased(
    "json_texts",
    "text string",
    "list array<string>, found string",
    [('["a", "b"]', ["a", "b"], None), ("", [], None), (None, [], None), ("not json", [], None), ('So: {"a": {"b": 1}} done', [], '{"a": {"b": 1}}'), ("{x} and {y}", [], None), ('```json\n{"k":\n2}\n```', [], '{"k":\n2}')],
    _columns(list=lambda: scalars.json_list(_C("text")), found=lambda: scalars.first_json_object(_C("text"))),
)


def _divergence(df: DataFrame) -> DataFrame:
    got = df.select("page_id", scalars.divergence(F.map_from_arrays("ka", "va"), F.map_from_arrays("kb", "vb")).alias("d"))
    return got.select("page_id", F.round("d.distance", 6).alias("distance"), "d.off", F.array_sort(F.transform(F.map_entries("d.by_key"), lambda e: F.concat_ws(" ", e["key"], F.format_number(e["value"], 2)))).alias("keys"))


_cased(
    "voice_divergence",
    "ka array<string>, va array<double>, kb array<string>, vb array<double>",
    "distance double, off boolean, keys array<string>",
    [(["a", "b"], [0.5, 0.9], ["a", "b"], [0.5, 0.4], 0.353553, True, ["a 0.00", "b 0.50"]), (["a"], [0.3], ["a", "c"], [0.3, 0.2], 0.141421, False, ["a 0.00", "c -0.20"])],
    _divergence,
)
_cased("rewrite_lengths", "n int", "least int, most int", [(10, 20, 13), (100, 80, 130), (33, 26, 42), (0, 20, 0), (25, 20, 32)], lambda df: df.select("page_id", scalars.rewrite_bounds(_C("n")).alias("b")).select("page_id", "b.*"))
_cased(
    "injected_links",
    "html string, anchor string, href string",
    "linked string",
    [
        ("<p>See our Blue Shoes and blue shoes.</p>", "blue shoes", "/s", '<p>See our <a href="/s">Blue Shoes</a> and blue shoes.</p>'),
        ("<p>shoestring</p>", "shoe", "/s", "<p>shoestring</p>"),
        ('<img alt="shoe"> a shoe', "shoe", "/s", '<img alt="shoe"> a <a href="/s">shoe</a>'),
        ('<a href="/s">x</a> shoe', "shoe", "/s", '<a href="/s">x</a> shoe'),
        ("no such word", "shoe", "/s", "no such word"),
    ],
    _columns(linked=lambda: scalars.inject_link(_C("html"), _C("anchor"), _C("href"))),
)
_cased("lead_lines", "line string", "name string, email string, company string", [("Ann, a@b.c , Co", "Ann", "a@b.c", "Co"), ("Ann", "Ann", "", ""), ("", "", "", ""), ("A,B,C,D", "A", "B", "C")], lambda df: df.select("page_id", scalars.lead_parts(_C("line")).alias("x")).select("page_id", "x.*"))
_cased(
    "query_kinds",
    "text string",
    "kind string, file string",
    [("https://e.example/a/b.png?x", "url", "b.png"), ("www.e.example", "url", "www.e.example"), ("e.example/x", "url", "x"), ("blue shoes", "keyword", "blue shoes"), ("shoes", "keyword", "shoes"), (" http://e.example/ ", "url", " ")],
    _columns(kind=lambda: scalars.url_or_keyword(_C("text")), file=lambda: scalars.file_name(_C("text"))),
)
_cased("entity_lists", "text string", "found array<string>", [('["a", "b", "c", "d"]', ["a", "b", "c"]), ('{"entities": ["x"]}', ["x"]), ('{"k": 1, "l": 2}', ["k", "l"]), ("none", []), ("[]", [])], _columns(found=lambda: scalars.entity_list(_C("text"), 3)))
_cased(
    "form_inputs",
    "text string, n int, old double",
    "parts array<string>, clamped int, filled double, class string",
    [("a, b,,c , d", 3, 0.0, ["a", "b", "c"], 5, 2.5, "poor"), ("", 31, None, [], 30, 2.5, "poor"), (" x ", 12, 0.3, ["x"], 12, 0.3, "medium"), (",", 5, 0.5, [], 5, 0.5, "good")],
    _columns(parts=lambda: scalars.split_list(_C("text"), 3), clamped=lambda: scalars.clamp(_C("n")), filled=lambda: scalars.or_default(_C("old"), 2.5), **{"class": lambda: scalars.rate_class(scalars.or_default(_C("old"), 0.1))}),
)
_cased(
    "site_settings",
    "pages int, rate double, robots boolean",
    "pages int, rate double, robots boolean",
    [(None, None, None, 500, 2.0, True), (0, 0.0, False, 500, 2.0, False), (7, 0.5, True, 7, 0.5, True)],
    lambda df: tables.with_defaults(df, {"pages": 500, "rate": 2.0}, {"robots": True}),
)
_cased("competitors", "id int, competitor_urls string", "id int, competitors int", [(1, '["a","b"]', 1, 2), (2, None, 2, 0), (3, "broken", 3, 0), (4, "[]", 4, 0)], lambda df: df.select("page_id", "id", F.size(scalars.json_list(_C("competitor_urls"))).alias("competitors")))
_cased(
    "report_parts",
    "text string",
    "summary string, priorities array<string>, competitors array<string>",
    [("All is well.\n# First\n1. do this\n2) and that\n## Competitor view\nx", "All is well.", ["1. do this", "2) and that"], ["## Competitor view"]), ("just words", "just words", [], [])],
    lambda df: df.select("page_id", scalars.report_sections(_C("text")).alias("r")).select("page_id", "r.*"),
)
_cased("toggled_tools", "tools array<string>", "tools array<string>", [(["a", "x"], ["a"]), (["a"], ["a", "x"]), ([], ["x"]), (["x", "b", "x"], ["b"])], lambda df: df.withColumn("tools", rankings.toggle(_C("tools"), "x")))
_cased(
    "learning_context",
    "id int, actions string",
    "id int, n int, first array<string>",
    [(1, '[{"type": "a", "url": "u", "success": true}, {"type": "b", "success": false}, {"type": "c"}]', 1, 1, ["a u"]), (2, None, 2, 0, None), (3, "[]", 3, 0, []), (4, str([{"type": f"t{k}", "url": "u", "success": True} for k in range(7)]).replace("'", '"').replace("True", "true"), 4, 7, ["t0 u", "t1 u", "t2 u", "t3 u", "t4 u"])],
    lambda df: df.select("page_id", "id", "actions").join(aggregates.learning_context(df.select("id", "actions").distinct()), "id").select("page_id", "id", "n", F.transform("first", lambda a: F.concat_ws(" ", a["type"], a["url"])).alias("first")),
)
_cased(
    "crawl_requests",
    "client_url string, competitor_urls array<string>, max_pages int",
    "max_pages int, valid boolean",
    [("https://e.example", [], 3, 10, True), ("http://e.example", ["https://a.example"], 50, 50, True), ("e.example", [], 50, None, False), ("https://e.example", ["ftp://x"], 50, None, False), ("https://e.example", ["https://a.example"] * 6, 50, None, False), ("https://e.example", ["https://a.example"] * 5, 50, 50, True)],
    lambda df: df.select("page_id").join(rankings.crawl_request(df).select("page_id", "max_pages", F.lit(True).alias("ok")), "page_id", "left").select("page_id", "max_pages", F.coalesce("ok", F.lit(False)).alias("valid")),
)
