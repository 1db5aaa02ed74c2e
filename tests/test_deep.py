"""Domains, ranks, mentions, structured data, search and sources on small tables against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions import html
from webloom.operators import domains, graph, joins, mentions, rules, search, structured
from webloom.plans import progress


def naive_split(host, rules):
    labels = host.split(".")
    best, exception = None, None
    for r in rules:
        own = r.lstrip("!").split(".")
        fits = len(own) <= len(labels) and all(a in ("*", b) for a, b in zip(own, labels[-len(own) :]))
        if fits and r.startswith("!"):
            exception = max(exception or 0, len(own))
        elif fits:
            best = max(best or 0, len(own))
    n = exception - 1 if exception else best
    if n is None:
        return "", ".".join(labels[:-1])
    return (".".join(labels[-n - 1 :]), ".".join(labels[: -n - 1])) if n < len(labels) else ("", "")


@pytest.mark.parametrize("most", [domains.BROADCAST, 0])
def test_registrable_names_are_those_of_every_rule(spark, most):
    rng = np.random.default_rng(1)
    labels = ["a", "b", "ck", "com", "uk", "www"]
    draw = lambda n: ".".join(rng.choice(labels, n))
    rules = {draw(rng.integers(1, 4)) for _ in range(8)} | {"*." + draw(rng.integers(1, 3)) for _ in range(4)} | {"!" + draw(rng.integers(2, 4)) for _ in range(3)}
    hosts = [draw(rng.integers(1, 6)) for _ in range(300)] + ["", "localhost"]
    table = domains.rule_table(spark.createDataFrame([(x,) for x in [*rules, "// com", "", "  ", *rules]], "rule string"))
    rows = spark.createDataFrame([(i, h, "x") for i, h in enumerate(hosts)] + [(-1, None, "x")], "id int, host string, depth string")
    got = domains.with_registrable(rows, "host", table, most=most)
    assert got.columns == ["id", "host", "depth", "registrable", "subdomain"]
    by = {r.id: (r.registrable, r.subdomain) for r in got.collect()}
    assert by.pop(-1) == (None, None)
    assert by == {i: naive_split(h, rules) for i, h in enumerate(hosts)}
    assert domains.with_registrable(rows, "host", table.limit(0), most=most).where("registrable <> ''").count() == 0


def test_suffix_files_and_hosts(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// a list\ncom\n*.ck\n!www.ck\n\nco.uk // trailing\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n")
    official, every = (domains.suffix_list(spark, str(tmp_path / "list.dat"), private) for private in (False, True))
    urls = ["https://User@Blog.Shop.CO.UK:8080/x?y", "http://me.github.io./", "http://a.b.ck/", "http://www.ck/", "mailto:x@y.com", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string").withColumn("host", domains.host_of(F.col("url")))
    name = lambda rules: [r.registrable for r in domains.with_registrable(rows, "host", rules).orderBy("id").collect()]
    assert name(official) == ["shop.co.uk", "", "a.b.ck", "www.ck", "", None]
    assert name(every)[1] == "me.github.io"
    inside = domains.with_internal(rows, "url", "shop.co.uk", official, allowlist=["blog"]).orderBy("id").collect()
    assert [r.internal for r in inside] == [True, False, False, False, False, False]


def answers(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos int, answer_text string")


@pytest.mark.parametrize("list_bytes", [mentions.LIST_BYTES, 60])
def test_mentions_are_those_of_each_brand_alone(spark, list_bytes):
    names = ["Lanternfish Group AB", "lanternfish", "The Of AB", "of", "Übermut GmbH", "he", "she", "hers", None, "", "of"]
    texts = ["A LANTERNFISH group, hers", "übermut of the", None, "", "x" * 100_000 + "she", "nothing", "A LANTERNFISH group, hers"]
    brands = spark.createDataFrame([(x,) for x in names], "brand string")
    got = mentions.found(answers(spark, texts), brands, list_bytes=list_bytes)
    want = joins.mentions(answers(spark, texts), brands.where("brand <> ''")).where("mentioned").drop("mentioned")
    assert got.columns == ["pos", "answer_text", "brand"]
    assert sorted((r.pos, r.brand) for r in got.collect()) == sorted((r.pos, r.brand) for r in want.collect())
    assert mentions.found(answers(spark, []), brands).count() == 0 and mentions.found(answers(spark, texts), brands.limit(0)).count() == 0


def test_mentions_of_fifty_thousand_brands(spark):
    brands = spark.range(50_000).selectExpr("concat('brand', id, 'x') AS brand")
    texts = [f"brand{k}x and brand{7 * k}x" for k in range(0, 20_000, 10)]
    got = {r.brand: r.answers for r in mentions.counts(answers(spark, texts), brands).collect()}
    want = {}
    for k in range(0, 20_000, 10):
        for n in {k, 7 * k}:
            if n < 50_000:
                want[f"brand{n}x"] = want.get(f"brand{n}x", 0) + 1
    assert got == want


def test_trigram_search_finds_what_a_scan_finds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abAé ß🎉"), rng.integers(0, 30))) for _ in range(200)] + [None, "", "ab", "a" * 50_000 + "needle"]
    rows = spark.createDataFrame([(i % 190, t, "k") for i, t in enumerate(texts)], "id int, text string, key string")
    index = search.Trigrams(rows, "id", "text", folders=8)
    for bound in (search.BROADCAST, 0):
        monkeypatch.setattr(search, "BROADCAST", bound)
        for needle in ("", "a", "ab", "aba", "AÉß", "ab a", "🎉a", "needle", "zzz", "aaaaaaa"):
            got = sorted(map(repr, index.search(needle).collect()))
            assert got == sorted(map(repr, rows.where(F.contains(F.lower("text"), F.lit(needle.lower()))).collect())), needle
    plan = index.candidates("needle")[0]._jdf.queryExecution().executedPlan().toString()
    assert "folder#" in plan.split("PartitionFilters: [")[1].split("]")[0]  # other folders aren't read
    assert search.Trigrams(rows.limit(0), "id", "text").search("abc").count() == 0


def test_redirects_of_a_thousand_hops_take_few_joins(spark, monkeypatch):
    rounds = []
    kept = graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: rounds.append(1) or kept(df))
    chain = [(f"a{k:04}", f"a{k + 1:04}") for k in range(1000)]
    loops = [("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("into", "x"), ("two", "b"), ("two", "a0999"), (None, "q"), ("end", None)]
    got = {r.url: (r.final_url, r.hops, r.looped) for r in graph.resolved_redirects(spark.createDataFrame(chain + loops, "url string, location string")).collect()}
    assert len(rounds) <= 13
    assert all(got[a] == ("a1000", 1000 - int(a[1:]), False) for a, _ in chain)
    assert {k: got[k] for k in ("x", "y", "z", "s", "into")} == dict.fromkeys(("x", "y", "z", "s", "into"), (None, None, True))
    assert got["two"] == ("a1000", 2, False) and "end" not in got
    assert graph.resolved_redirects(spark.createDataFrame([], "url string, location string")).count() == 0


BLOCKS = [
    '{"@type": "Product", "name": "x", "image": null}',
    '{"@type": ["Article", "Thing"], "headline": "x", "dateModified": "2001-02-03"}',
    '{"@graph": [{"@type": "Organization"}, {"@type": "WebSite"}], "datePublished": "2001-02-03", "dateModified": ""}',
    '{"@type": "Organization", "_error": "bad"}',
    "[1]",
    "no json",
    "",
    None,
    '{"@type": 7}',
]


def test_structured_data_as_variants(spark):
    pages = spark.createDataFrame([("u", BLOCKS), ("none", None), ("empty", [])], "url string, structured_data array<string>")
    parsed = structured.blocks(pages)
    assert [(r.pos, r.there) for r in parsed.select("pos", F.col("block").isNotNull().alias("there")).orderBy("pos").collect()] == [(i, i not in (5, 6, 7)) for i in range(9)]
    missing = {r.pos: (r.kind, r.missing) for r in structured.missing_fields(parsed).collect()}
    assert missing == {0: ("Product", ["offers"]), 1: ("Article", ["author", "datePublished"])}
    assert [r.pos for r in structured.invalid(parsed).collect()] == [3]
    assert sorted((r.pos, r.kind) for r in structured.nodes(parsed).collect()) == [(0, "Product"), (1, "Article"), (1, "Thing"), (2, "Organization"), (2, "WebSite"), (3, "Organization"), (8, "7")]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert sorted(r.pos for r in structured.stale(parsed, now).collect()) == [1, 2]
    # the audit's rules on the text form agree
    flat = pages.withColumns({"pos": F.lit(1), "is_indexable": F.lit(True), "status_code": F.lit(200)})
    assert [r.url for r in rules.stale_content(flat, now).collect()] == ["u"]


def test_parts_of_pages_by_sql(spark):
    rows = [(1, "https://e.example/", "<h2>a</h2><a href='/x'>X</a><a href='#y'>no</a><img src='i.png'><h4>b</h4><p>" + "some words of a text that is long enough for a part " * 5 + "</p>", "s"), (2, "https://e.example/", None, "s"), (3, None, "<a href='/z'>Z</a>", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, place string")
    html.register_html_parts(spark)
    for kind in ("links", "images", "heading_outline", "sections"):
        got = spark.sql(f"SELECT * FROM html_parts(TABLE(SELECT page_id, url, html, place FROM {{p}}), '{kind}')", p=pages)
        want = html.extract_pages(pages).select("page_id", "url", F.posexplode(kind).alias("place", "part")).select("page_id", "url", "place", "part.*")
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert spark.sql("SELECT count(*) AS n FROM html_parts(TABLE(SELECT url, html FROM {p}), 'links')", p=pages).first().n == 2
    with pytest.raises(Exception, match="isn't a list of parts"):
        spark.sql("SELECT * FROM html_parts(TABLE(SELECT url, html FROM {p}), 'title')", p=pages).collect()


def test_observed_counts_are_those_of_the_table(spark, tmp_path):
    counts = {"n": F.count(F.lit(1)), "odd": F.count(F.when(F.col("id") % 2 == 1, 1)), "total": F.sum("id")}
    assert progress.write_observed(spark.range(101), f"{tmp_path}/a", **counts) == {"n": 101, "odd": 50, "total": 5050}
    assert progress.write_observed(spark.range(0), f"{tmp_path}/b", **counts) == {"n": 0, "odd": 0, "total": 0}
    told = []
    heard = progress.Progress(lambda batch, row: told.append((batch, row["n"])))
    spark.streams.addListener(heard)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/a")
    got = progress.stream_observed(stream, f"{tmp_path}/c", checkpoint=f"{tmp_path}/d", **counts)
    spark.streams.removeListener(heard)
    assert got == {"n": 101, "odd": 50, "total": 5050} and spark.read.parquet(f"{tmp_path}/c").count() == 101
    assert sum(n for _, n in told) == 101 and len(told) > 1
    # nothing new: nothing is counted again
    again = progress.stream_observed(stream, f"{tmp_path}/c", checkpoint=f"{tmp_path}/d", **counts)
    assert again == {"n": 0, "odd": 0, "total": 0}
