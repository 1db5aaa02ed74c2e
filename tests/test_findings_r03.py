"""What the findings of round 3 were about, each on small tables."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from webloom import queries, queries_more
from webloom.functions import html
from webloom.operators import graph, joins, mentions, search
from webloom.sources import tables as source
from webloom.streaming import limits

SMALL = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["graph_orphans", "orphan_pages", "broken_link_sources", "audit_links", "link_graph_by_both_keys", "linked_by_none", "internal_link_lists"])
def test_links_meet_their_pages_by_a_key(spark, name):
    """No page is joined with every other one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")  # the pages are larger
    try:
        assert "CartesianProduct" not in plan(queries.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_page_of_several_rows_is_broken_with_each_status(spark):
    """broken_by_source left out a page whose last row has another status than those before."""
    pages = spark.createDataFrame([(1, "a", 500), (2, "a", 200), (3, "b", 404), (4, "b", 500), (5, "b", 404), (6, "c", None)], "pos int, url string, status_code int")
    links = spark.createDataFrame([("s", "a", True), ("s", "b", True), ("s", "b", True), ("t", "c", True), ("t", "a", False)], "source_url string, dest_url string, is_internal boolean")
    got = [(r.source_url, [tuple(b) for b in r.broken]) for r in joins.broken_by_source(links, pages).collect()]
    assert got == [("s", [("a", 500), ("b", 404), ("b", 500)])]


def test_a_frontier_beyond_its_budget_tells_by_how_much(spark):
    """frontier_state gave 0 where more pages are done than allowed."""
    urls = spark.createDataFrame([(str(i),) for i in range(7)], "url string")
    got = limits.frontier_state(urls, urls.where("url < '5'"), 3).first()
    assert (got.seen, got.done, got.budget, got.queued) == (7, 5, -2, 2)


def test_a_reference_without_its_semicolon_is_plain_text():
    """html_page_facts read '&amp' at the end of a title as '&'."""
    page = '<title>a &amp; b &lt;&amp</title><a href="/x?a=1&copy=2&amp;b=3&#38;c">&notit; &#65 &eacute;</a><script type="application/ld+json">{"a": "&amp;b &c"}</script>'
    got = html.extract("https://s.example/", page, lambda u: True)
    assert got["title"] == "a & b <&amp"
    assert (got["links"][0]["href"], got["links"][0]["anchor_text"]) == ("/x?a=1&copy=2&b=3&c", "&notit; A é")
    assert got["structured_data"] == ['{"a": "&amp;b &c"}']


def test_a_round_of_ranks_shuffles_a_row_for_each_bucket_and_node(spark, monkeypatch):
    """Buckets grew with the edges, one for each 500,000, and the shuffled rows with edges times nodes; names went along."""
    monkeypatch.setattr(graph, "FULL", 10)
    monkeypatch.setattr(graph, "BUCKET", 160)
    n = spark.createDataFrame([(f"n{k}",) for k in range(30)], "node string")
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(30) for b in range(30)], "src string, dst string")
    own = graph.Ranks(n, e, iterations=2)
    assert own.edges.rdd.getNumPartitions() <= graph.LEAST_BUCKETS and dict(own.edges.dtypes)["dst"] == "bigint"
    assert {round(r["rank"], 9) for r in own.ranks().collect()} == {round(1 / 30, 9)}
    own.close()
    assert graph.BUCKET > graph.FULL


def test_extractions_are_held_for_a_slice_of_a_batch(spark):
    """html_signals held the extractions of a whole batch of up to 10,000 pages."""
    batches = [pd.DataFrame({"x": range(600)}), pd.DataFrame({"x": range(0)}), pd.DataFrame({"x": range(1)})]
    assert [len(p) for p in html.slices(iter(batches))] == [256, 256, 88, 1]
    pages = spark.range(600).selectExpr("id as page_id", "'https://s.example/' as url", "concat('<title>', id, '</title>') as html").coalesce(1)
    assert {(r.page_id, r.title) for r in html.extract_pages(pages).collect()} == {(i, str(i)) for i in range(600)}


def test_a_list_of_brands_is_an_automaton_of_bounded_size():
    """a worker's automaton held up to 32 MB of spellings, some 16 times that in memory."""
    rng = np.random.default_rng(17)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (20_000, 10))]
    made = mentions.automaton([(w, i) for i, w in enumerate(words)])
    per_byte = made.get_stats()["total_size"] / sum(len(w) + 16 for w in words)
    assert per_byte * mentions.LIST_BYTES < 300 << 20


@tables
def test_issues_are_not_dealt_by_their_few_types(spark):
    """new_issues shuffled all issues by five types."""
    assert "SortMergeJoin" not in plan(queries.QUERIES["new_issues"](spark, SMALL))


def test_hops_are_not_broadcast(spark):
    """followed_redirects sent the hops through the driver once for each step of the chains."""
    hops = spark.createDataFrame([("a", "b", 301), ("b", "c", 301), ("d", "d", 302)], "url string, location string, status_code int").where("url <> ''")
    got = graph.redirect_chains(spark.range(1).selectExpr("'a' as url", "'b' as location", "301 as status_code").unionByName(hops), hops.select("url"))
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()  # whatever the sizes turn out to be
    assert {(r.url, r.final_url, r.looped) for r in got.collect()} == {("a", "c", False), ("b", "c", False), ("d", "d", True)}


@tables
def test_sitemaps_hold_many_suppliers(spark, monkeypatch):
    """sitemap_entries wrote a file for each supplier, all in one task."""
    at = []
    made = queries_more.fresh_dir
    monkeypatch.setattr(queries_more, "fresh_dir", lambda *a: at.append(made(*a)) or at[-1])
    got = queries.QUERIES["sitemap_entries"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/supplier.parquet").count() > 50
    assert len([f for f in os.listdir(at[0]) if f.startswith("part-")]) == 1


def test_a_sitemap_is_cut_after_so_many_entries(spark, tmp_path):
    """the entries go on in another file, in their order; the last one of a loc is read."""
    rows = spark.createDataFrame([(f" l{k // 2} ", "new" if k % 2 else "old", k / 2) for k in range(20)], "loc string, lastmod string, priority double").coalesce(1)
    source.write_sitemaps(rows, str(tmp_path / "maps"), 6)
    files = sorted((tmp_path / "maps").glob("part-*"))
    assert [f.read_text().count("<url>") for f in files] == [6, 6, 6, 2]
    assert all("sitemaps.org/schemas/sitemap/0.9" in f.read_text() for f in files)
    got = source.read_sitemaps(spark, str(tmp_path / "maps")).collect()
    assert sorted((r.loc, r.lastmod, r.priority) for r in got) == [(f"l{k}", "new", k + 0.5) for k in range(10)]


def test_a_trigram_is_a_row_for_many_texts(spark):
    """the index of trigram_search held, shuffled and sorted a row for each trigram of each text."""
    rows = spark.createDataFrame([(k, f"the same words {k % 7}") for k in range(300)], "id long, text string").coalesce(1)
    index = search.Trigrams(rows, "id", "text", folders=4)
    grams = {t[i : i + 3] for k in range(7) for t in [f"the same words {k}"] for i in range(len(t) - 2)}
    assert index.lists.count() == index.counts.count() == len(grams)
    assert {r.gram: r.n for r in index.counts.collect()} == {g: sum(g in f"the same words {k % 7}" for k in range(300)) for g in grams}
    assert sorted(r.id for r in index.search("WORDS 3").collect()) == [*range(3, 300, 7)]


def test_posting_lists_are_those_of_each_text(monkeypatch):
    """of texts that are cut, and of more letters than a number holds beside the texts."""
    monkeypatch.setattr(search, "PART", 20)
    rng = np.random.default_rng(18)
    texts = ["".join(rng.choice(list("abé🎉\x00 "), n)) for n in (0, 1, 2, 3, 19, 20, 21, 22, 23, 60, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(len(texts))]), pa.array(texts)], names=["key", "text"])
    lists = lambda got: {(g, k) for b in got for g, ks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in ks}
    assert lists(search._postings([batch])) == {(t[i : i + 3], f"k{k}") for k, t in enumerate(texts) for i in range(len(t) - 2)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    got = [*search.postings(pa.array(range(10)), [*range(10)], [every] + ["abc"] * 9)]
    assert len(got) > 1 and sorted(k for g, k in lists(got) if g == "abc") == [*range(10)]
    assert ("\U0010fffd\U0010fffe\U0010ffff", 0) in lists(got)
