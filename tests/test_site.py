"""Audit rules, joins, graph, rankings, sources and online limits on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import aggregates as agg
from webloom.operators import graph, joins, rankings, rules
from webloom.plans import reports
from webloom.sources import schemas, tables
from webloom.streaming import limits

HEALTHY = {
    "status_code": 200, "is_indexable": True, "title": "A healthy page title of some length", "meta_description": "d" * 85, "h1_text": "A good heading", "h1_count": 1, "word_count": 500,
    "content_hash": "abc", "hreflang_tags": [], "structured_data": ['{"@type": "WebSite"}'], "img_missing_alt": 0, "internal_links_count": 10, "was_rendered": False, "redirect_chain": [], "ttfb_ms": 200.0, "response_bytes": 50000,
    "og_title": "t", "twitter_card": "c", "has_viewport": True, "charset_declared": "utf-8", "html_lang": "en", "has_skip_nav": True, "headers": {"Strict-Transport-Security": "1"}, "form_actions": [], "robots_txt_allowed": True, "main_text": "",
}


def pages(spark, *changes):
    rows = []
    for k, c in enumerate(changes):
        url = c.get("url", f"https://example.com/{k}")
        row = HEALTHY | {"url": url, "pos": k, "canonical_url": url, "content_hash": f"h{k}", "title": f"{HEALTHY['title']} {k}", "meta_description": f"{k}" + "d" * 85} | c
        rows.append(row | {f"{x}_length": len(row[x] or "") for x in ("title", "meta_description")})
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schemas.PAGES)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def found(df):
    return {(r.issue_type, r.severity): r.affected_urls_count for r in rules.rollup(df).collect()}


def test_a_healthy_page_has_no_issues(spark):
    assert found(rules.audit(pages(spark, {}))) == {}


HOP = lambda *codes: [(f"u{c}", c) for c in codes]


@pytest.mark.parametrize(
    "change,want",
    [
        ({"status_code": 404}, ("http_4xx", "high")),
        ({"status_code": 500}, ("http_5xx", "critical")),
        ({"title": "Page Not Found", "word_count": 30}, ("soft_404", "medium")),
        ({"redirect_chain": HOP(301, 301, 301)}, ("redirect_chain", "medium")),
        ({"redirect_chain": HOP(301, 302)}, ("mixed_redirect_chain", "medium")),
        ({"redirect_loop": True}, ("redirect_loop", "critical")),
        ({"redirect_chain": HOP(301), "status_code": 404}, ("redirect_to_error", "high")),
        ({"canonical_url": None}, ("canonical_missing", "medium")),
        ({"canonical_count": 2}, ("canonical_multiple", "high")),
        ({"canonical_url": "https://example.com/other"}, ("canonical_mismatch", "medium")),
        ({"is_noindex": True, "internal_links_count": 9}, ("noindex_should_index", "critical")),
        ({"robots_txt_allowed": False, "is_noindex": True}, ("robots_noindex_conflict", "high")),
        ({"source": "sitemap", "status_code": 404}, ("sitemap_url_error", "high")),
        ({"title": ""}, ("title_missing", "high")),
        ({"title": "Short"}, ("title_too_short", "medium")),
        ({"title": "t" * 71}, ("title_too_long", "low")),
        ({"meta_description": None}, ("meta_desc_missing", "low")),
        ({"meta_description": "d" * 161}, ("meta_desc_too_long", "low")),
        ({"h1_count": 0}, ("h1_missing", "high")),
        ({"h1_count": 3}, ("h1_multiple", "low")),
        ({"h1_text": "Tiny"}, ("h1_too_short", "low")),
        ({"h1_text": "same thing", "title": " Same Thing"}, ("h1_matches_title", "low")),
        ({"heading_hierarchy_gaps": [(1, 3, [2])]}, ("heading_hierarchy_gap", "low")),
        ({"word_count": 30}, ("thin_content", "medium")),
        ({"depth": 6}, ("high_click_depth", "low")),
        ({"internal_nofollow_count": 1}, ("internal_nofollow", "low")),
        ({"img_missing_alt": 2}, ("img_missing_alt", "medium")),
        ({"img_lazy_broken": 1}, ("img_lazy_broken", "medium")),
        ({"img_missing_dimensions": 1}, ("cls_risk", "medium")),
        ({"structured_data": ['{"_error": "Invalid JSON-LD"}']}, ("structured_data_invalid", "medium")),
        ({"structured_data": []}, ("structured_data_missing", "low")),
        ({"structured_data": ['{"@type": ["Product"], "name": "x"}']}, ("structured_data_missing_fields", "medium")),
        ({"was_rendered": True, "console_errors": ["e"]}, ("js_render_errors", "medium")),
        ({"was_rendered": True, "raw_vs_rendered_diff": (False, True, False, False, 0, 0, True)}, ("js_content_parity", "high")),
        ({"was_rendered": True, "raw_vs_rendered_diff": (False, False, False, False, 11, 0, True)}, ("js_link_parity", "medium")),
        ({"ttfb_ms": 2001.0}, ("slow_ttfb", "high")),
        ({"ttfb_ms": 601.0}, ("slow_ttfb", "medium")),
        ({"response_bytes": 3_000_001}, ("large_page", "low")),
        ({"hreflang_tags": [("en", "https://example.com/o"), ("x-default", "https://example.com/o")]}, ("hreflang_missing_self", "medium")),
        ({"hreflang_tags": [("qq-US", "https://example.com/0"), ("x-default", "https://example.com/0")]}, ("hreflang_invalid_lang", "medium")),
        ({"hreflang_tags": [("en", "https://example.com/0")]}, ("hreflang_x_default_missing", "low")),
        ({"mobile_checked": True, "mobile_diff": (200, 100, 5, 5)}, ("mobile_content_parity", "high")),
        ({"mobile_checked": True, "mobile_diff": (50, 50, 20, 5)}, ("mobile_link_parity", "medium")),
        ({"og_title": None}, ("og_tags_missing", "low")),
        ({"twitter_card": ""}, ("twitter_card_missing", "low")),
        ({"has_viewport": False}, ("viewport_missing", "medium")),
        ({"charset_declared": None}, ("charset_missing", "low")),
        ({"has_mixed_content": True}, ("mixed_content", "high")),
        ({"headers": {}}, ("missing_hsts", "medium")),
        ({"form_actions": ["http://x/"]}, ("insecure_form_action", "high")),
        ({"html_lang": None}, ("missing_html_lang", "medium")),
        ({"empty_link_count": 1}, ("empty_link_text", "medium")),
        ({"form_inputs_without_label": 1}, ("missing_form_label", "low")),
        ({"has_skip_nav": False}, ("missing_skip_nav", "low")),
    ],
)
def test_each_row_rule_fires(spark, change, want):
    got = {(r.issue_type, r.severity) for r in rules.row_violations(pages(spark, change), {want[0]}).collect()}
    assert got == {want}


def test_grouped_rules(spark):
    p = pages(spark, *[{"title": "One shared title here", "h1_text": "Same heading"} for _ in range(4)], {"content_hash": "h0"}, {"url": "https://example.com/p?a=1", "content_hash": "q"}, {"url": "https://example.com/p?a=2", "content_hash": "q"})
    got = found(rules.audit(p))
    assert got["title_duplicate", "medium"] == 4 and got["duplicate_title", "medium"] == 4
    assert got["duplicate_content", "high"] == 4 and got["param_duplicate", "medium"] == 2


def test_text_and_reference_rules(spark):
    text = " ".join(f"word{k % 97}" for k in range(300))
    stuffed = " ".join(["casino"] * 20 + [f"w{k}" for k in range(100)])
    en, de = "https://example.com/en", "https://example.com/de"
    p = pages(spark, {"main_text": text}, {"main_text": text + " end"}, {"main_text": stuffed}, {"url": en, "hreflang_tags": [("en", en), ("de", de), ("x-default", en)]}, {"url": de, "status_code": 404}, {"structured_data": ['{"dateModified": "2019-01-01"}']})
    got = found(rules.audit(p, now=F.lit("2024-01-01").cast("date")))
    assert got["near_duplicate_content", "medium"] == 2 and got["keyword_stuffing", "medium"] == 1
    assert got["hreflang_missing_return", "high"] == 1 and got["hreflang_to_error", "high"] == 1 and got["stale_content", "low"] == 1


def test_combined_run_without_robots(spark):
    robots = spark.createDataFrame([(False, 404, None, None)], schemas.ROBOTS)
    links = spark.createDataFrame([(None, "https://example.com/0", "https://example.com/1", None, "x", True, True, "nav")], schemas.LINKS)
    got = found(rules.audit(pages(spark, {}, {"status_code": 404, "depth": 1}, {"depth": 2}), links, robots, 0))
    assert {("robots_txt_missing", "medium"), ("sitemap_missing", "medium"), ("broken_internal_link", "high"), ("orphan_page", "medium")} <= set(got)
    assert got["orphan_page", "medium"] == 1


SITE = ["https://e.com/", "https://e.com/about", "https://e.com/blog", "https://e.com/blog/post-1", "https://e.com/orphan"]
EDGES = [(0, 1), (0, 2), (2, 3), (1, 0)]


def test_five_page_site(spark):
    p = pages(spark, *[{"url": u} for u in SITE])
    links = spark.createDataFrame([(None, SITE[a], SITE[b], None, "About Us" if b == 1 else "", True, True, "content") for a, b in EDGES], schemas.LINKS)
    starts = spark.createDataFrame([("https://e.com",)], "node string")
    got = reports.graph_bundle(p, links, starts)
    assert {r.node: r.depth for r in got["depths"].collect()} == dict(zip([u.rstrip("/") for u in SITE], [0, 1, 1, 2, -1]))
    assert {r.depth: r.n for r in got["distribution"].collect()} == {0: 1, 1: 2, 2: 1, -1: 1}
    assert [r.url for r in got["orphans"].collect()] == [SITE[4]]
    assert {r.url: r.outlinks for r in got["counts"].collect()}[SITE[0]] == 2
    assert [(r.dest, r.anchors) for r in got["anchors"].collect()] == [(SITE[1], ["About Us"])]


def naive_rank(nodes, edges, p, iterations):
    out = {n: sorted({b for a, b in edges if a == n and b != n and b in nodes}) for n in nodes}
    pr = dict(p)
    for _ in range(iterations):
        lost = sum(pr[n] for n in nodes if not out[n])
        pr = {n: 0.15 * p[n] + 0.85 * (lost * p[n] + sum(pr[a] / len(out[a]) for a in nodes if n in out[a])) for n in nodes}
    return pr


@pytest.mark.parametrize("together", [1, 3])
def test_page_rank(spark, monkeypatch, together):
    monkeypatch.setattr(graph.Ranks.__init__, "__defaults__", (*graph.Ranks.__init__.__defaults__[:-1], together))
    nodes = [str(k) for k in range(8)]
    rng = np.random.default_rng(5)
    edges = [(str(a), str(b)) for a, b in rng.integers(0, 9, (20, 2)) if a != 3]
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r["rank"] for r in graph.pagerank(n, e, iterations=3).collect()}
    want = naive_rank(nodes, edges, dict.fromkeys(nodes, 1 / 8), 3)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in nodes) and abs(sum(got.values()) - 1) < 1e-9
    authority = spark.createDataFrame([("1", 10.0), ("2", 5.0)], "node string, authority double")
    raw = {k: 0.7 / 8 + 0.3 * {"1": 1.0, "2": 0.5}.get(k, 0.0) for k in nodes}
    p = {k: v / sum(raw.values()) for k, v in raw.items()}
    want = naive_rank(nodes, edges, p, 3)
    ipr = {r.node: r.ipr for r in graph.internal_pagerank(n, e, authority, iterations=3).collect()}
    assert all(abs(ipr[k] - want[k] * 10 / max(want.values())) < 1e-4 for k in nodes)


def test_rank_queries_read_all_edges(spark, tmp_path):
    from webloom.queries import QUERIES

    rng = np.random.default_rng(7)
    keys = [(int(a), int(b)) for a, b in zip(rng.integers(1, 9, 30), rng.integers(1, 60, 30))]
    spark.createDataFrame(keys, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 10.0 * k) for k in range(1, 9)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    nodes, edges = [str(k) for k in range(1, 9)], {(str(a), str(b % 8 + 1)) for a, b in keys if a != b % 8 + 1}
    want = naive_rank(nodes, edges, dict.fromkeys(nodes, 1 / 8), 50)
    got = {r.node: r["rank"] for r in QUERIES["page_rank"](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(want[k], abs=1e-8) for k in nodes}
    raw = {k: 0.7 / 8 + 0.3 * int(k) / 8 for k in nodes}
    want = naive_rank(nodes, edges, {k: v / sum(raw.values()) for k, v in raw.items()}, 50)
    ipr = {r.node: r.ipr for r in QUERIES["internal_rank"](spark, str(tmp_path)).collect()}
    assert ipr == {k: pytest.approx(want[k] * 10 / max(want.values()), abs=1e-4) for k in nodes}
    plan = {r.src: set(r.removed.split(" | ")) for r in QUERIES["link_plan"](spark, str(tmp_path)).where("removed is not null").collect()}
    assert plan == {"5": {b for a, b in edges if a == "5"}}


def tables_of_edges(spark):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith("webloom_edges")]


@pytest.mark.parametrize("few", [200, 0])
def test_differences_of_edits_are_those_of_full_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "SMALL", few)
    rng = np.random.default_rng(8)
    nodes = [f"n{k}" for k in range(12)]
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 13, (24, 2)) if a not in (3, 4)]
    n, e = spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")
    # a node without edges gets some, one loses all, some targets are unknown or the source itself
    more = [("n3", "n0"), ("n3", "n5"), ("n1", "n7"), ("n1", "n1"), ("n2", "unknown"), ("n99", "n1"), edges[0]]
    gone = [x for x in edges if x[0] == edges[1][0]] + [edges[5], ("n7", "n98")]
    added, removed = (spark.createDataFrame(x, "src string, dst string") for x in (more, gone))
    p = dict.fromkeys(nodes, 1 / 12)
    want = naive_rank(nodes, [x for x in {*edges, *more} if x not in gone], p, 7)
    own = graph.Ranks(n, e, iterations=7)
    plans = {r.node: r["rank"] for r in own.after(added, removed).collect()}
    assert plans == {k: pytest.approx(want[k], abs=1e-12) for k in nodes}
    for a, b in ((added, None), (None, None)):
        want = naive_rank(nodes, [x for x in {*edges, *(more if a else [])} if b is None or x not in gone], p, 7)
        assert {r.node: r["rank"] for r in own.after(a, b).collect()} == {k: pytest.approx(want[k], abs=1e-12) for k in nodes}
    plan = own._flow(own.shares.select("node", F.lit(1.0).alias("x")), own.edges)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.index("Exchange") > plan.index("Bucketed: true")  # the edges stay where they lie
    own.close()
    assert tables_of_edges(spark) == []


def test_what_if_and_plan(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    more = spark.createDataFrame([("a", "c"), ("a", "a")], "src string, dst string")
    got = {r.url: r.delta for r in graph.what_if(n, e, added=more, iterations=5).collect()}
    assert got["b"] < 0 and tables_of_edges(spark) == []
    plan = graph.link_plan(e, graph.edit_edges(e, more, e.where("src = 'b'"))).collect()
    assert {(r.src, r.added, r.removed) for r in plan} == {("a", "c", None), ("b", None, "c")}


def test_redirects_and_crawl(spark):
    hops = spark.createDataFrame([("a", "b", 301), ("b", "c", 302), ("x", "y", 301), ("y", "x", 301)], "url string, location string, status_code int")
    got = {r.url: (len(r.chain), r.final_url, r.looped) for r in graph.redirect_chains(hops, spark.createDataFrame([("a",), ("c",), ("x",)], "url string")).collect()}
    assert got["a"] == (2, "c", False) and got["c"] == (0, "c", False) and got["x"][2]
    out = spark.createDataFrame([("s", "p"), ("p", "q"), ("q", "r")], "src string, dst string")
    order = {r.url: r.depth for r in graph.crawl(spark.createDataFrame([("s",)], "url string"), out, max_pages=3).collect()}
    assert order == {"s": 0, "p": 1, "q": 2}


def test_brands_and_rewards(spark):
    answers = spark.createDataFrame([(1, None, "a", None, "s", None, "p", "Lanternfish Group is fine"), (2, None, "b", None, "", None, "p", "nothing"), (3, None, "b", None, "s", None, "p", None)], schemas.ANSWERS)
    brands = spark.createDataFrame([("Lanternfish Group AB",), ("Rival",)], "brand string")
    flags = joins.mentions(answers, brands)
    rates = {r.brand: (r.mention_rate, r.sov_mentions) for r in agg.brand_rates(flags, "Lanternfish Group AB").collect()}
    assert rates == {"Lanternfish Group AB": (0.333, 1.0), "Rival": (0.0, 0.0)}
    assert {(r.kind, r.value, r.mention_rate) for r in agg.rates_by(flags, "Lanternfish Group AB").collect()} == {("persona", "a", 1.0), ("persona", "b", 0.0), ("service", "s", 0.5)}
    wide = joins.mention_columns(flags, "pos").where("pos = 1").first()
    assert wide["mentions_lanternfish_group_ab"] and not wide["mentions_rival"]


def test_upsert_patch_and_files(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string")
    assert sorted(map(tuple, tables.upsert(t, new, "id").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, tables.upsert(t, new, "id", update=False).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, tables.patch(t, F.col("id") == 1, name="z").collect())) == [(1, "z"), (2, "b")]
    assert tables.delete(t, "id", 1).count() == 1 and tables.add_column(t, "x", "int").columns == ["id", "name", "x"]
    (tmp_path / "run_gpt_2024.csv").write_text("prompt_id,original_query,prompt_type,prompt_text,response,success,latency_ms,cosine_score,timestamp\n1,q,t,p,r,true,1.0,0.5,x\n")
    (tmp_path / "ai_progress.jsonl").write_text('{"prompt_id": "1", "response": "r"}\nbroken\n')
    assert tables.read_run_files(spark, str(tmp_path), "gpt", "run").first().response == "r"
    assert tables.read_run_files(spark, str(tmp_path), "ai", "run").count() == 1 and tables.read_run_files(spark, str(tmp_path), "none", "run").count() == 0
    robots = spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /a\nAllow: /a/b\nSitemap: http://e.com/s.xml\nUser-agent: x\nDisallow: /", 200)], "host string, text string, status_code int")
    urls_ = spark.createDataFrame([("1", "e.com", "/a/c"), ("2", "e.com", "/a/b/x"), ("3", "e.com", "/z")], "url string, host string, path string")
    assert {r.url: r.allowed for r in joins.longest_robots_rule(urls_, tables.robots_rules(robots)).collect()} == {"1": False, "2": True, "3": True}
    assert tables.parse_robots(robots).first().sitemap_urls == ["http://e.com/s.xml"]


def test_rankings(spark):
    p = pages(spark, {"title": "", "word_count": 10}, {}, {"word_count": 5}).withColumns({"broken_links": F.lit(0)})
    assert [r.url[-1] for r in rankings.thin_pages(p).collect()] == ["2", "0"]
    assert [(r.score, r.reasons) for r in rankings.problem_pages(p).collect()] == [(1, "no title")]
    reqs = spark.createDataFrame([("https://a", ["https://b"], 5), ("ftp://a", [], 50)], "client_url string, competitor_urls array<string>, max_pages int")
    assert [r.max_pages for r in rankings.crawl_request(reqs).collect()] == [10]


def test_rate_limits_agree(spark):
    rng = np.random.default_rng(6)
    rows = [(str(rng.integers(3)), int(t), i) for i, t in enumerate(sorted(rng.integers(0, 300_000_000, 200)))]
    want = []
    for tenant in "012":
        own = [(us, i) for t, us, i in rows if t == tenant]
        want += [(tenant, i, a) for (us, i), a in zip(own, limits.accept([u for u, _ in own], [], 5, 60_000_000)[0])]
    df = spark.createDataFrame(rows, "tenant string, us long, id long")
    got = limits.rate_limit_batch(df, limit=5).collect()
    assert sorted((r.tenant, r.id, r.accepted) for r in got) == sorted(want)


def test_rate_limit_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("a", i * 1_000_000, i) for i in range(10)]
    df = spark.createDataFrame(rows, "tenant string, us long, id long")
    df.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = limits.rate_limit_stream(stream, limit=4).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.sql("select * from limited where accepted").count() == 4


def test_windows_over_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", "v", 1.0), (1, "2024-01-01 00:02:00", "v", 2.0), (2, "2024-01-01 02:00:00", "v", 4.0)]
    df = spark.createDataFrame(rows, "user_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = limits.windowed(stream).writeStream.format("memory").queryName("wins").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [(r.n, r.total) for r in spark.sql("select * from wins").collect()] == [(2, 3.0)]


def test_schedules(spark):
    r = spark.createDataFrame([("h", 0, 1), ("h", 100, 2), ("h", 2_000_000, 3)], "host string, us long, id long")
    assert [x.start_us for x in limits.host_schedule(r).orderBy("id").collect()] == [0, 500_000, 2_000_000]
    e = spark.createDataFrame([("j", 1, "pending"), ("j", 2, "running"), ("j", 3, "completed"), ("j", 4, "running"), ("k", 1, "pending")], "job_id string, us long, status string")
    assert {x.job_id: x.status for x in limits.job_status(e).collect()} == {"j": "completed", "k": "pending"}
    seeds = spark.createDataFrame([("s.pdf",), ("a",)], "url string")
    maps = spark.createDataFrame([("a", "2024"), ("b", None)], "url string, lastmod string")
    more = spark.createDataFrame([("b", 1), ("c", 99), ("d.jpg", 1)], "url string, depth int")
    got = {x.url: x.priority for x in limits.seed_frontier(seeds, maps, more).collect()}
    assert got == {"s.pdf": 2, "a": 0, "b": 1}


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
