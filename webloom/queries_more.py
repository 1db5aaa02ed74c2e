"""Queries of sources, joins, rankings, the graph and online state that stand in no other file, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import scalars
from webloom.operators import aggregates as agg
from webloom.operators import graph, joins, rankings, rules
from webloom.plans import reports
from webloom.queries_audit import audit_pages
from webloom.sources import tables
from webloom.sources.fixtures import BRANDS, table, view, with_views
from webloom.sources.shared import fresh_dir, keep
from webloom.streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql.strip())
        return f

    return add


def _c(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment"))


_C = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount, c_mktsegment AS segment FROM customer"

# sources and sinks: what is written is read again


@query(_C)
def json_files(spark, sf):
    path = fresh_dir(spark, "json")
    tables.write_json(_c(spark, sf), path)
    return spark.read.schema("id long, name string, amount double, segment string").json(path)


@query("SELECT c_custkey AS id, json_extract_string(v, '$.name') AS name, json_extract(v, '$.amount')::DOUBLE AS amount FROM (SELECT c_custkey, to_json({'name': c_name, 'amount': c_acctbal}) AS v FROM customer)")
def json_rows(spark, sf):
    made = tables.as_json(_c(spark, sf))
    return made.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.amount").cast("double").alias("amount"))


@query("SELECT url, status_code, title, word_count, is_indexable, depth FROM v_pages WHERE title <> ''")
def csv_export(spark, sf):
    path = fresh_dir(spark, "csv")
    tables.export_csv("pages", {"pages": view(spark, sf, "v_pages")}, path)
    got = spark.read.option("header", True).option("escape", '"').csv(path)
    assert got.columns == [c for c in tables.PAGE_FIELDS if c in got.columns] and "pos" not in got.columns
    got = got.where("title is not null and title <> ''")
    return got.select("url", F.col("status_code").cast("int").alias("status_code"), "title", F.col("word_count").cast("int").alias("word_count"), F.col("is_indexable").cast("boolean").alias("is_indexable"), F.col("depth").cast("int").alias("depth"))


@query("SELECT url, crawl_run_id, status_code FROM v_pages WHERE crawl_run_id = '3' UNION ALL SELECT url, crawl_run_id, status_code FROM v_pages WHERE crawl_run_id = '3' AND depth > 3")
def appended_runs(spark, sf):
    """Two appends; one run is read from its own partition."""
    path, pages = fresh_dir(spark, "runs"), view(spark, sf, "v_pages").select("url", "crawl_run_id", "status_code", "depth")
    tables.append_run(pages.drop("depth"), path)
    tables.append_run(pages.where("depth > 3").drop("depth"), path)
    return tables.read_table(spark, path, "url string, status_code int, crawl_run_id string", "3").select("url", "crawl_run_id", "status_code")


@query("SELECT n_nationkey AS prompt_id, 'r' || n_regionkey AS response FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def run_files(spark, sf):
    """The newest CSV of a platform; of one without CSV, the progress lines that parse."""
    folder = fresh_dir(spark, "tracker")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("prompt_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("response"))
    full = nation.select(F.col("prompt_id").cast("string").alias("prompt_id"), *[F.lit(None).cast("string").alias(c) for c in ("original_query", "prompt_type", "prompt_text")], "response")
    full.limit(3).write.option("header", True).csv(f"{folder}/run_a_20240101.csv")
    full.write.option("header", True).csv(f"{folder}/run_a_20240102.csv")
    lines = table(spark, sf, "region").select(F.to_json(F.struct(F.col("r_regionkey").cast("string").alias("prompt_id"), F.col("r_name").alias("response"))).alias("value"))
    lines.unionByName(lines.limit(1).select(F.lit('{"prompt_id": broken').alias("value"))).write.text(f"{folder}/b_progress.jsonl")
    got = tables.read_run_files(spark, folder, "a", "run").unionByName(tables.read_run_files(spark, folder, "b", "run")).unionByName(tables.read_run_files(spark, folder, "none", "run"))
    return got.select(F.col("prompt_id").cast("int").alias("prompt_id"), "response")


@query("SELECT row_number() OVER (ORDER BY r_name DESC)::INTEGER AS place, r_name AS run FROM region")
def run_folders(spark, sf):
    folder, region = fresh_dir(spark, "folders"), table(spark, sf, "region")
    for r in region.collect():
        region.limit(1).write.parquet(f"{folder}/{r.r_name}")
    return spark.createDataFrame(list(enumerate(tables.list_runs(spark, folder), 1)), "place int, run string")


@query("""SELECT 'summary' AS sheet, 9::BIGINT AS rows UNION ALL SELECT 'issues', count(*) FROM v_issues UNION ALL SELECT 'pages', count(*) FROM v_audit UNION ALL SELECT 'redirects', count(*) FROM v_audit WHERE r1 IS NOT NULL OR r2 IS NOT NULL
  UNION ALL SELECT 'indexability', count(*) FROM v_audit UNION ALL SELECT 'link_graph', count(*) FROM v_audit UNION ALL SELECT 'js_parity', count(*) FROM v_audit WHERE was_rendered""")
def workbook_sheets(spark, sf):
    folder, pages = fresh_dir(spark, "book"), _sheet_pages(spark, sf)
    tables.write_report(reports.workbook(pages, view(spark, sf, "v_alinks"), view(spark, sf, "v_issues")), folder)
    out = None
    for name in ("summary", "issues", "pages", "redirects", "indexability", "link_graph", "js_parity"):
        n = spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.lit(name).alias("sheet"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"SELECT id, name, CASE WHEN id % 3 = 0 THEN 0.0 ELSE amount END AS amount, CASE WHEN id % 3 = 0 THEN 'NONE' ELSE segment END AS segment FROM ({_C})")
def patched_rows(spark, sf):
    return tables.patch(_c(spark, sf), F.col("id") % 3 == 0, amount=0.0, segment="NONE")


@query(f"SELECT id, name FROM ({_C}) WHERE segment IS NULL OR segment <> 'MACHINERY'")
def deleted_rows(spark, sf):
    return tables.delete(_c(spark, sf), "segment", "MACHINERY").select("id", "name")


@query(f"SELECT id, name FROM ({_C}) WHERE segment = 'MACHINERY'")
def looked_up_rows(spark, sf):
    return tables.lookup(_c(spark, sf), "segment", "MACHINERY").select("id", "name")


@query(f"SELECT id, segment, 7::INTEGER AS extra, name FROM ({_C})")
def added_columns(spark, sf):
    return tables.add_column(tables.add_column(_c(spark, sf), "extra", "int", 7), "name", "string", "not used").select("id", "segment", "extra", "name")


@query(f"SELECT id, name, CASE WHEN id % 2 = 0 THEN segment ELSE 'kept' END AS segment FROM ({_C}) UNION ALL SELECT -id, name, segment FROM ({_C}) WHERE id % 5 = 0")
def inserted_or_kept(spark, sf):
    """An insert that passes over known keys."""
    c = _c(spark, sf).select("id", "name", "segment")
    have = c.withColumn("segment", F.when(F.col("id") % 2 == 0, F.col("segment")).otherwise("kept"))
    return tables.upsert(have, c.unionByName(c.where("id % 5 = 0").withColumn("id", -F.col("id"))), "id", update=False)


@query("SELECT DISTINCT 'https://s.example/' || s_suppkey AS loc, CASE WHEN s_suppkey % 3 > 0 THEN '2024-01-0' || (s_suppkey % 3) END AS lastmod, CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS priority FROM supplier")
def sitemap_entries(spark, sf):
    """Sitemaps of up to 48,000 entries (the protocol allows 50,000); the three of one supplier follow each other in one file."""
    path, k = fresh_dir(spark, "sitemap"), F.col("s_suppkey")
    entry = lambda loc, mod, priority: F.struct(loc.alias("loc"), mod.cast("string").alias("lastmod"), priority.cast("string").alias("priority"))
    loc, priority = F.concat(F.lit(" https://s.example/"), k.cast("string"), F.lit(" ")), F.when(k % 2 == 0, F.lit("0.5"))
    mod = F.when(k % 3 > 0, F.concat(F.lit("2024-01-0"), (k % 3).cast("string")))
    each = table(spark, sf, "supplier").select(F.inline(F.array(entry(F.lit(""), F.lit(None), F.lit(None)), entry(loc, F.lit(None), priority), entry(loc, mod, priority))))
    tables.write_sitemaps(each, path, 48_000)  # a multiple of three
    return tables.read_sitemaps(spark, path).select("loc", "lastmod", "priority")


@query("SELECT DISTINCT 'https://s.example/map' || n_regionkey || '.xml' AS loc FROM nation")
def sitemap_indexes(spark, sf):
    path = fresh_dir(spark, "sitemap-index")
    body = table(spark, sf, "nation").select(F.concat(F.lit("<sitemapindex><sitemap><loc>https://s.example/map"), F.col("n_regionkey").cast("string"), F.lit(".xml</loc></sitemap></sitemapindex>")).alias("value"))
    body.coalesce(1).write.option("maxRecordsPerFile", 1).text(path)
    return tables.sitemap_children(spark, path)


@query("SELECT DISTINCT 'https://s.example/' || (page_id % 90) AS loc, 's.example' AS host FROM pages")
def sitemap_documents(spark, sf):
    at = F.col("page_id")
    rows = table(spark, sf, "pages").select(at.alias("pos"), F.lit("s.example").alias("host"), F.concat(F.lit("<x:loc>\n https://s.example/"), (at % 90).cast("string"), F.lit(" </x:loc><loc>https://o.example/1</loc>")).alias("xml"))
    return tables.sitemap_text(rows)


@query("""SELECT o_orderkey::VARCHAR AS url, (o_orderkey % 50)::INTEGER AS gsc_clicks, (o_orderkey % 900)::INTEGER AS gsc_impressions, round_even((o_orderkey % 97) / 977.0 * 100, 2)::DOUBLE AS gsc_ctr, round_even((o_orderkey % 1009) / 37.0, 1)::DOUBLE AS gsc_position,
  CAST(o_orderdate AS DATE) - 30 AS since, CAST(o_orderdate AS DATE) - 2 AS until FROM orders""")
def search_rows(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(k.cast("string").alias("url"), (k % 50).alias("clicks"), (k % 900).alias("impressions"), ((k % 97) / 977.0).alias("ctr"), ((k % 1009) / 37.0).alias("position"))
    window = table(spark, sf, "orders").select(k.cast("string").alias("u"), tables.gsc_window(F.col("o_orderdate").cast("date")).alias("w"))
    return tables.gsc_rows(raw).join(window, F.col("url") == F.col("u")).select("url", "gsc_clicks", "gsc_impressions", "gsc_ctr", "gsc_position", F.col("w.start").alias("since"), F.col("w.end").alias("until"))


_SPEED = '{"lighthouseResult": {"categories": {"performance": {"score": %s}}, "audits": {"largest-contentful-paint": {"numericValue": %s, "displayValue": "%s s", "score": 0.5}, "cumulative-layout-shift": {"numericValue": %s}, "server-response-time": {"numericValue": %s}, "interactive": {"score": %s}}}}'


def _speed(spark, sf):
    k = F.col("s_suppkey")
    json = F.format_string(_SPEED, (k % 101) / 100, k * 12.5, k.cast("string"), k / 7000, k * 3.25, (k % 10) / 10)
    return table(spark, sf, "supplier").select(k.alias("pos"), F.concat(F.lit("u"), k.cast("string")).alias("url"), json.alias("json"))


@query("""SELECT 'u' || s_suppkey AS url, round_even((s_suppkey % 101) / 100 * 100, 0)::INTEGER AS psi_score, round_even(s_suppkey * 12.5, 0)::INTEGER AS psi_lcp_ms, round_even(s_suppkey / 7000, 3)::DOUBLE AS psi_cls, NULL::INTEGER AS psi_inp_ms, NULL::INTEGER AS psi_fcp_ms,
  round_even(s_suppkey * 3.25, 0)::INTEGER AS psi_ttfb_ms FROM supplier ORDER BY s_suppkey LIMIT 20""")
def speed_rows(spark, sf):
    return tables.psi_rows(_speed(spark, sf))


@query("SELECT 'u' || s_suppkey AS url, s_suppkey || ' s' AS lcp_value, 0.5::DOUBLE AS lcp_score, NULL::VARCHAR AS cls_value, (s_suppkey % 10) / 10 AS tti_score, NULL::DOUBLE AS si_score FROM supplier")
def speed_details(spark, sf):
    return tables.psi_detail(_speed(spark, sf)).select("url", "lcp_value", "lcp_score", "cls_value", "tti_score", "si_score")


# joins


@query("SELECT c_custkey AS id, c_name AS name, n_name AS policy FROM customer LEFT JOIN nation ON n_nationkey = c_custkey WHERE c_custkey % 4 > 0")
def sites_with_policy(spark, sf):
    sites = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 4 > 0).alias("is_active"))
    policies = table(spark, sf, "nation").select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("policy"))
    return joins.sites_with_policy(sites, policies).select("id", "name", "policy")


@query("SELECT vec_id AS id, (i - 1)::INTEGER AS pos, label::VARCHAR || '-' || i AS a, i * 10 AS b FROM embeddings, unnest(range(1, 4)) AS x(i) WHERE i <= label % 4")
def paired_results(spark, sf):
    e = table(spark, sf, "embeddings")
    left = e.select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.col("label").cast("string"), F.lit("-"), i.cast("string"))).alias("a"))
    right = e.where("label % 4 > 0").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(1), F.col("label") % 4), lambda i: i.cast("long") * 10).alias("b"))
    return joins.pair_by_position(left, right, "a", "b", ["id"]).select("id", "pos", "a", "b")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey <= (SELECT max(s_suppkey) FROM supplier) THEN c_custkey END AS post_id FROM customer")
def posts_by_path(spark, sf):
    urls_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("https://s.example/post-"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise("?x=1")).alias("url"))
    posts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://old.example/post-"), F.col("s_suppkey").cast("string"), F.lit("/#top")).alias("link"))
    return joins.posts_by_path(urls_, posts).select("id", "post_id")


@query("""SELECT o_orderkey::VARCHAR AS id, round_even((o_orderkey % 7) / 10 - (o_orderkey % 5) / 10 + (o_orderkey % 20 - o_orderkey % 10) * 0.05, 4)::DOUBLE AS reward_score FROM
  (SELECT * FROM orders WHERE o_orderkey % 3 > 0 AND o_orderdate BETWEEN TIMESTAMP '1997-03-04' AND TIMESTAMP '1997-03-18' ORDER BY o_orderdate, o_orderkey::VARCHAR LIMIT 500) WHERE o_custkey % 4 > 0""")
def due_rewards(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    side = lambda a, b: F.struct((k % a / 10).alias("gsc_ctr"), (k % b).cast("double").alias("gsc_position"), F.lit(1.0).alias("gsc_impressions"))
    page = F.concat(F.lit("p"), k.cast("string"))
    memory = o.select(k.cast("string").alias("id"), F.lit("s").alias("site_url"), page.alias("page_url"), side(5, 20).alias("before_metrics"), F.when(k % 3 == 0, 1.0).alias("reward_score"), F.col("o_orderdate").cast("timestamp").alias("action_taken_at"))
    fresh = o.where("o_custkey % 4 > 0").select(F.lit("s").alias("site_url"), page.alias("page_url"), side(7, 10).alias("after_metrics"))
    return joins.rewards(memory, fresh, F.lit("1997-04-01").cast("timestamp")).select("id", "reward_score")


@query("""WITH me AS (SELECT id, site_id FROM v_runs ORDER BY id LIMIT 1), last AS (SELECT id FROM v_runs WHERE status = 'completed' AND id <> (SELECT id FROM me) AND site_id = (SELECT site_id FROM me) ORDER BY completed_at DESC, id DESC LIMIT 1)
SELECT DISTINCT issue_type FROM v_issues JOIN last ON crawl_run_id = last.id""")
def previous_issue_types(spark, sf):
    runs = view(spark, sf, "v_runs")
    me = runs.orderBy("id").first()["id"]
    return joins.previous_issue_types(runs, view(spark, sf, "v_issues"), me)


@query("SELECT src, dst FROM v_edges WHERE src IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 2 = 0) AND dst IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 2 = 0)")
def edges_among(spark, sf):
    nodes = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("url"))
    return joins.edges_among(view(spark, sf, "v_edges"), nodes)


@query("SELECT o_custkey AS k, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1")
def first_and_last(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"))
    return joins.keep_first(o, "k").withColumnRenamed("pos", "first_id").join(joins.keep_last(o, "k").withColumnRenamed("pos", "last_id"), "k")


@query("""WITH a AS (SELECT n_regionkey AS k, list(n_name) AS l FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1), b AS (SELECT n_regionkey AS k, list(n_name) AS l FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey > 0 GROUP BY 1)
SELECT coalesce(a.k, b.k)::VARCHAR AS source_url, list_sort(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))) AS broken FROM a FULL JOIN b ON a.k = b.k""")
def merged_broken_links(spark, sf):
    n = table(spark, sf, "nation")
    side = lambda where: n.where(where).groupBy(F.col("n_regionkey").cast("string").alias("source_url")).agg(F.collect_list("n_name").alias("broken"))
    return joins.merge_broken(side("n_nationkey % 2 = 0"), side("n_nationkey % 3 = 0 and n_regionkey > 0"))


@query("SELECT source_url, list_sort(list(DISTINCT dest_url)) AS internal_links FROM v_links WHERE is_internal GROUP BY 1")
def internal_link_lists(spark, sf):
    return joins.link_lists(view(spark, sf, "v_links"))


@query("SELECT c_custkey AS url, coalesce(o.n, 0) AS keywords, o.n IS NOT NULL AS known FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) o ON o_custkey = c_custkey")
def enriched_pages(spark, sf):
    """Provider counts with zero where there are none, beside whether there are any."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("url"))
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("url")).agg(F.count("*").alias("keywords")).withColumn("known", F.lit(True))
    return joins.merge(joins.merge(c, o, ["keywords"], default=0), o, ["known"], default=False)


# aggregates


@query("""SELECT count(*)::BIGINT AS total, count_if(status_code > 199 AND status_code < 300)::BIGINT AS ok, count_if(status_code > 499)::BIGINT AS server_errors, count_if(h AND coalesce(title, '') = '')::BIGINT AS title_missing, count_if(h AND length(title) > 60)::BIGINT AS title_long,
  count_if(h AND coalesce(word_count, 0) < 200)::BIGINT AS thin, count_if(h AND is_noindex)::BIGINT AS noindex, sum(CASE WHEN h THEN coalesce(img_missing_alt, 0) END)::BIGINT AS images_without_alt
FROM (SELECT *, status_code = 200 AND (content_type = '' OR content_type LIKE '%text/html%') AS h FROM v_pages)""")
def loose_domain_summary(spark, sf):
    """The summary in which a page without content type counts as HTML."""
    return agg.domain_summary(view(spark, sf, "v_pages"), strict=False).select("total", "ok", "server_errors", "title_missing", "title_long", "thin", "noindex", "images_without_alt")


@query("""WITH last AS (SELECT arg_max(id, (completed_at, id)) AS id FROM v_runs WHERE status = 'completed' GROUP BY site_id)
SELECT severity, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) AS s(severity) LEFT JOIN (SELECT severity, count(*) AS n FROM v_issues JOIN last ON crawl_run_id = last.id GROUP BY 1) USING (severity)""")
def latest_severities(spark, sf):
    return reports.run_report(view(spark, sf, "v_runs"), view(spark, sf, "v_issues"), F.lit("1998-08-01").cast("timestamp"))["severities"]


@query("SELECT external::BIGINT AS external, broken::BIGINT AS broken FROM (SELECT sum(page_id % 5) AS external, sum(CASE WHEN page_id % 4 > 0 THEN page_id % 3 ELSE 0 END) AS broken FROM pages)")
def external_totals(spark, sf):
    of = lambda n: F.slice(F.array(*[F.lit("x")] * 5), F.lit(1), n.cast("int"))
    p = table(spark, sf, "pages").select(of(F.col("page_id") % 5).alias("external_links"), F.when(F.col("page_id") % 4 > 0, of(F.col("page_id") % 3)).alias("broken"))
    return agg.external_totals(p)


@query("SELECT avg(value) AS avg_score, count_if(value * 100 > 2500)::BIGINT AS slow_lcp, count_if(value / 1000 > 0.1)::BIGINT AS high_cls, count_if(value * 10 > 200)::BIGINT AS slow_inp FROM events")
def vitals_totals(spark, sf):
    v = F.col("value")
    return agg.vitals(table(spark, sf, "events").select(v.alias("psi_score"), (v * 100).alias("psi_lcp_ms"), (v / 1000).alias("psi_cls"), (v * 10).alias("psi_inp_ms")))


@query("SELECT count(*)::BIGINT AS total, count_if(page_id % 3 > 0)::BIGINT AS with_a, count_if(page_id % 7 = 0)::BIGINT AS with_b FROM pages")
def match_rates(spark, sf):
    p = table(spark, sf, "pages").selectExpr("if(page_id % 3 > 0, 1, null) as a", "if(page_id % 7 = 0, 1, null) as b")
    return agg.match_rates(p, ["a", "b"])


@query("SELECT count_if(c_mktsegment = 'BUILDING')::BIGINT AS building, count_if(c_acctbal < 0)::BIGINT AS owing, count_if(c_acctbal >= 5000)::BIGINT AS rich, count(*)::BIGINT AS everyone FROM customer")
def customer_counts(spark, sf):
    c = table(spark, sf, "customer")
    return agg.filtered_counts(c, building=F.col("c_mktsegment") == "BUILDING", owing=F.col("c_acctbal") < 0, rich=F.col("c_acctbal") >= 5000, everyone=F.lit(True))


@query("SELECT pos, contains(lower(coalesce(answer_text, '')), 'the of') AS mentions_the_of, contains(lower(coalesce(answer_text, '')), 'and') AS mentions_and, length(coalesce(answer_text, '')) > 20 AS has_response FROM v_answers")
def enriched_answers(spark, sf):
    got = agg.enrich_answers(view(spark, sf, "v_answers").withColumnRenamed("answer_text", "response"), ["The Of", "and"])
    return got.select("pos", "mentions_the_of", "mentions_and", "has_response")


@query("""WITH f AS (SELECT persona, service, brand, mentioned FROM (SELECT *, len(list_filter(b.tokens, lambda t: contains(lower(coalesce(answer_text, '')), t))) > 0 AS mentioned FROM v_answers,
  (VALUES ('The Of AB', ['the of ab', 'the of']), ('and', ['and']), ('der', ['der']), ('que la', ['que la'])) AS b(brand, tokens))),
rates AS (SELECT brand, round_even(avg(mentioned::INT), 3) AS rate FROM f GROUP BY 1),
gaps AS (SELECT 0 AS o, persona AS what, round_even(avg(mentioned::INT), 3) AS mention_rate FROM f WHERE brand = 'que la' GROUP BY 2 UNION ALL SELECT 1, service, round_even(avg(mentioned::INT), 3) FROM f WHERE brand = 'que la' AND service <> '' GROUP BY 2)
SELECT o AS ord, what, mention_rate FROM (SELECT * FROM gaps WHERE mention_rate < 0.3 UNION ALL SELECT 2, brand, rate FROM rates WHERE brand <> 'que la' AND rate > 1.5 * (SELECT rate FROM rates WHERE brand = 'que la')) ORDER BY o, what LIMIT 5""")
def visibility_gaps(spark, sf):
    answers, brands = view(spark, sf, "v_answers"), spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    return reports.visibility(answers, brands, "que la")["gaps"].select("ord", "what", "mention_rate")


@query("SELECT event_id, count(*)::BIGINT AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE user_id % 10 = 0) GROUP BY 1 HAVING count(*) > 1")
def repeated_events(spark, sf):
    e = table(spark, sf, "events")
    return agg.event_reports(e.unionByName(e.where("user_id % 10 = 0")))["repeated"]


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_id % 6 < 2 GROUP BY 1")
def events_without_key(spark, sf):
    k = F.col("event_id") % 6
    e = table(spark, sf, "events").withColumn("props", F.when(k == 0, F.lit("{}")).when(k == 1, F.lit('{"k": ""}')).otherwise(F.col("props")))
    return agg.event_reports(e)["without"]


@query("""SELECT conv_id * 1000 + turn AS pos, i::INTEGER AS i, ['a', 'b', 'c'][(i - 1) % 3 + 1] AS service, i <= 7 AS brand_prompt FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations) WHERE i <= 20""")
def assigned_services(spark, sf):
    prompts = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return agg.assign_services(prompts, ["a", "b", "c"], 20)


@query("SELECT o_custkey AS job_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS done, count(*) OVER (PARTITION BY o_custkey)::BIGINT AS total FROM orders")
def job_progress(spark, sf):
    return agg.progress(table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id")), "job_id", "id")


# rankings


@query("SELECT issue_type, severity, affected_urls_count FROM v_issues WHERE severity = 'high' AND issue_type = 'type_2' ORDER BY affected_urls_count DESC LIMIT 15 OFFSET 5")
def issues_page(spark, sf):
    return rankings.issues_page(view(spark, sf, "v_issues"), "high", "type_2", 5, 15).select("issue_type", "severity", "affected_urls_count")


@query("SELECT c_custkey AS id FROM customer WHERE (lower(c_name) LIKE '%00012%' OR 'd' || c_custkey LIKE '%00012%') AND c_mktsegment = 'BUILDING'")
def customer_search(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("domain"), F.col("c_mktsegment").alias("status"), F.lit("m").alias("service_mode"))
    return rankings.search_customers(c, "00012", "BUILDING").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 4 = 0 OR o_orderkey % 10 >= 7)")
def optional_filters(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 10).alias("reward_score"))
    return rankings.optional(o, 7, status="F", kind="").select("id")


@query("""SELECT url, min((p, d, s))[1]::INTEGER AS priority, min((p, d, s))[2]::INTEGER AS depth, min((p, d, s))[3] AS source FROM (
  SELECT 'https://s.example/' || page_id AS url, 2 AS p, 0 AS d, 'seed' AS s FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT 'https://s.example/' || page_id, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END, 0, 'sitemap' FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT 'https://s.example/' || page_id, CASE page_id % 60 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 4 THEN 6 WHEN 5 THEN 6 ELSE 7 END, page_id % 60, 'discovered' FROM pages WHERE page_id % 60 <= 50 AND page_id % 7 > 0) GROUP BY url""")
def seeded_frontier(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    url = F.concat(F.lit("https://s.example/"), k.cast("string"))
    found = p.select(F.when(k % 7 == 0, F.concat(url, F.lit(".png"))).otherwise(url).alias("url"), (k % 60).alias("depth"))
    got = limits.seed_frontier(p.where("page_id % 10 = 0").select(url.alias("url")), p.where("page_id % 3 = 0").select(url.alias("url"), F.when(k % 4 == 0, "2024-01-01").alias("lastmod")), found)
    return got.select("url", "priority", "depth", "source")


@query("""SELECT * FROM (SELECT 'missing_title' AS list, url FROM (SELECT url FROM v_audit WHERE coalesce(is_indexable, true) AND status_code = 200 AND coalesce(title, '') = '' ORDER BY pos LIMIT 20)
  UNION ALL SELECT 'missing_meta', url FROM (SELECT url FROM v_audit WHERE coalesce(is_indexable, true) AND status_code = 200 AND coalesce(meta_description, '') = '' ORDER BY pos LIMIT 20)
  UNION ALL SELECT 'orphan', url FROM (SELECT url FROM v_audit WHERE coalesce(is_indexable, true) AND status_code = 200 AND pos % 4 < 2 ORDER BY pos LIMIT 15))""")
def prompt_context(spark, sf):
    k = F.col("pos") % 4
    return rankings.prompt_context(audit_pages(spark, sf).withColumn("inlinks", F.when(k == 0, 0).when(k > 1, 3)))


@query("SELECT url FROM (SELECT * FROM v_audit WHERE status_code = 200 AND is_noindex IS DISTINCT FROM true AND (coalesce(title, '') = '' OR coalesce(meta_description, '') = '' OR coalesce(h1_text, '') = '' OR pos % 30 >= 20) ORDER BY pos LIMIT 50)")
def agent_candidates(spark, sf):
    return rankings.agent_candidates(audit_pages(spark, sf).withColumn("gsc_impressions", F.when(F.col("pos") % 30 > 0, F.col("pos") % 30)))


@query("SELECT 'u' || k AS url, list_sort(list('w' || o_orderkey)) AS keywords FROM (SELECT c_custkey AS k FROM customer ORDER BY c_custkey LIMIT 30) JOIN orders ON o_custkey = k GROUP BY 1")
def keyword_lookup(spark, sf):
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("url")
    pages = table(spark, sf, "customer").select(u("c_custkey"), F.col("c_custkey").alias("pos"))
    return rankings.keyword_lookup(pages, table(spark, sf, "orders").select(u("o_custkey"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("keyword")))


@query("SELECT o_custkey::VARCHAR AS url, o_orderkey::VARCHAR AS keyword, o_totalprice AS traffic FROM orders WHERE o_orderkey % 5 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) <= 10")
def organic_keywords(spark, sf):
    key = F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_orderkey").cast("string"))
    return rankings.organic_keywords(table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("url"), key.alias("keyword"), F.col("o_totalprice").alias("traffic")))


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 10")
def newest_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "P").cast("int").alias("pinned"))
    return rankings.newest(o, "at", "id", 20, 10, "pinned").select("id")


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS place, c_custkey AS id FROM (SELECT * FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 100)")
def top_rows(spark, sf):
    got = rankings.top(table(spark, sf, "customer"), F.desc("c_acctbal"), "c_custkey", 100, F.col("c_acctbal") > 0)
    return agg.progress(got.select(F.lit(1).alias("all"), "c_custkey", (-F.col("c_acctbal")).alias("worst")), "all", "worst", "c_custkey").select(F.col("done").alias("place"), F.col("c_custkey").alias("id"))


_IPR = "SELECT s_suppkey::VARCHAR AS node, (s_suppkey * 37 % 101) / 10 AS ipr, s_suppkey % 4 AS i, s_suppkey % 3 AS o FROM supplier"


@query(f"""SELECT * FROM (SELECT 'top' AS list, node FROM (SELECT * FROM ({_IPR}) ORDER BY ipr DESC, node LIMIT 10) UNION ALL SELECT 'orphans', node FROM (SELECT * FROM ({_IPR}) WHERE i = 0 ORDER BY ipr DESC, node LIMIT 8)
  UNION ALL SELECT 'sinks', node FROM (SELECT * FROM ({_IPR}) WHERE o = 0 AND i > 1 ORDER BY i DESC, node LIMIT 5))""")
def ranked_lists(spark, sf):
    k = F.col("s_suppkey")
    ipr = table(spark, sf, "supplier").select(k.cast("string").alias("node"), (k * 37 % 101 / 10).alias("ipr"), (k % 4).alias("ipr_inbound"), (k % 3).alias("ipr_outbound"))
    parts = {"top": rankings.top_ranked(ipr), "orphans": rankings.ranked_orphans(ipr), "sinks": rankings.link_sinks(ipr)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("list"), "node")
        out = df if out is None else out.unionByName(df)
    return out


def _gsc(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.cast("string").alias("url"), F.when(k % 9 > 0, (k % 9) / 10).otherwise(F.when(k % 2 == 0, 0.0)).alias("gsc_ctr"), (k % 120).alias("gsc_impressions"), (k % 25).cast("double").alias("gsc_position"))


@query("""SELECT * FROM (SELECT 'ctr' AS list, url FROM (SELECT c_custkey::VARCHAR AS url FROM customer WHERE c_custkey % 120 >= 50 ORDER BY CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 9) / 10 ELSE 100 END, url LIMIT 8)
  UNION ALL SELECT 'position', url FROM (SELECT c_custkey::VARCHAR AS url FROM customer WHERE c_custkey % 25 > 10 ORDER BY c_custkey % 120 DESC, url LIMIT 8))""")
def search_weaknesses(spark, sf):
    g = _gsc(spark, sf)
    return rankings.low_ctr(g).select(F.lit("ctr").alias("list"), "url").unionByName(rankings.low_position(g).select(F.lit("position").alias("list"), "url"))


@query("SELECT 'u' || s_suppkey AS url, round_even((s_suppkey % 101) / 100 * 100, 0)::INTEGER AS psi_score FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 20) ORDER BY 2, 1 LIMIT 5")
def slowest_pages(spark, sf):
    return rankings.slowest(tables.psi_rows(_speed(spark, sf))).select("url", "psi_score")


@query("SELECT s_nationkey AS domain, arg_max(s_suppkey::VARCHAR, (s_suppkey * 37 % 101, s_suppkey::VARCHAR)) AS url, max(s_suppkey * 37 % 101) AS ipr FROM supplier GROUP BY 1")
def best_by_domain(spark, sf):
    k = F.col("s_suppkey")
    return rankings.best_by_domain(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("domain"), k.cast("string").alias("url"), (k * 37 % 101).alias("ipr")))


@query("SELECT o_orderkey::VARCHAR AS url, (o_orderkey % 31 - 15) / 1000 AS delta FROM orders WHERE abs(o_orderkey % 31 - 15) > 2 ORDER BY abs(o_orderkey % 31 - 15) DESC, url LIMIT 20")
def movers(spark, sf):
    return rankings.movers(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("url"), ((F.col("o_orderkey") % 31 - 15) / 1000).alias("delta")))


@query("SELECT page_id AS seq, page_id % 5 AS priority FROM pages ORDER BY page_id % 5, page_id LIMIT 40")
def popped_frontier(spark, sf):
    return rankings.pop(table(spark, sf, "pages").select(F.col("page_id").alias("seq"), (F.col("page_id") % 5).alias("priority")), 40)


@query("SELECT 'u' || page_id AS url, 'i' || i || '.png' AS src FROM pages, unnest(range(0, 6)) AS x(i) WHERE i < page_id % 6 AND (page_id + i) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 3 ORDER BY page_id, i LIMIT 30")
def images_to_describe(spark, sf):
    k = F.col("page_id")
    image = lambda i: F.struct(F.concat(F.lit("i"), i.cast("string"), F.lit(".png")).alias("src"), ((k + i) % 2 == 1).alias("has_alt"))
    images = F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), F.lit(1), (k % 6).cast("int")), image)
    return rankings.images_to_describe(table(spark, sf, "pages").select(k.alias("pos"), F.concat(F.lit("u"), k.cast("string")).alias("url"), images.alias("images")))


@query("SELECT url FROM (SELECT * FROM v_audit WHERE coalesce(is_indexable, true) AND status_code = 200 ORDER BY pos LIMIT 50)")
def first_candidates(spark, sf):
    return rankings.first_candidates(audit_pages(spark, sf), 50).select("url")


@query("SELECT url, name FROM (SELECT r_regionkey::VARCHAR AS url, r_name AS name FROM region WHERE r_regionkey > 2 UNION ALL SELECT n_nationkey::VARCHAR, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)) ORDER BY url LIMIT 15")
def union_by_url(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("url"), F.col("n_name").alias("name"))
    b = table(spark, sf, "region").where("r_regionkey > 2").select(F.col("r_regionkey").cast("string").alias("url"), F.col("r_name").alias("name"))
    return rankings.union_by_url([a, b])


@query("SELECT string_agg(format('- act on p{}: v{} (reward {:.2f})', s_suppkey, s_suppkey, (s_suppkey * 7919 % 1000) / 1000), chr(10) ORDER BY (s_suppkey * 7919 % 1000) DESC, s_suppkey) AS block FROM supplier WHERE s_suppkey <= 40")
def memory_block(spark, sf):
    k = F.col("s_suppkey")
    text = lambda a: F.concat(F.lit(a), k.cast("string"))
    m = table(spark, sf, "supplier").where("s_suppkey <= 40").select(k.alias("id"), F.lit("act").alias("action_type"), text("p").alias("page_url"), text("v").alias("action_value"), (k * 7919 % 1000 / 1000).alias("reward_score"))
    return rankings.memory_block(m)


# sets and the graph


@query("SELECT DISTINCT rtrim(url, '/') AS url FROM pages WHERE page_id % 2 = 0 AND rtrim(url, '/') NOT IN (SELECT rtrim(url, '/') FROM pages WHERE page_id % 3 = 0) ORDER BY url LIMIT 100")
def crawl_only(spark, sf):
    p = table(spark, sf, "pages")
    return joins.sitemap_gap(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0").select(F.col("url").alias("loc")))["in_crawl_only"]


@query("SELECT DISTINCT rtrim(url, '/') AS node FROM v_audit WHERE rtrim(url, '/') NOT IN (SELECT rtrim(CASE WHEN dest_url_normalized <> '' THEN dest_url_normalized ELSE dest_url END, '/') FROM v_alinks WHERE is_internal) AND rtrim(url, '/') <> 'https://s.example/de/0'")
def linked_by_none(spark, sf):
    pages = audit_pages(spark, sf)
    _, edges = graph.build(pages, view(spark, sf, "v_alinks"))
    return graph.plain_orphans(pages, edges, "https://s.example/de/0/")


@query("SELECT url FROM v_audit WHERE coalesce(is_indexable, true) AND status_code = 200 AND rtrim(url, '/') NOT IN (SELECT rtrim(CASE WHEN dest_url_normalized <> '' THEN dest_url_normalized ELSE dest_url END, '/') FROM v_alinks WHERE is_internal) AND pos <> 5")
def graph_orphans(spark, sf):
    pages = audit_pages(spark, sf)
    seed = pages.where("pos = 5").first()["url"]
    return graph.orphan_pages(pages, graph.build(pages, view(spark, sf, "v_alinks"))[1], [seed])


@query("SELECT rtrim(source_url, '/') AS src, rtrim(CASE WHEN dest_url_normalized <> '' THEN dest_url_normalized ELSE dest_url END, '/') AS dst FROM v_alinks WHERE is_internal")
def graph_edges(spark, sf):
    return graph.build(audit_pages(spark, sf), view(spark, sf, "v_alinks"))[1]


@query("SELECT src, dst FROM (SELECT src, dst FROM v_edges WHERE src::BIGINT % 5 > 0 UNION SELECT s_suppkey::VARCHAR, (s_suppkey + 1)::VARCHAR FROM supplier WHERE s_suppkey % 5 > 0) WHERE src <> dst")
def edited_edges(spark, sf):
    e = view(spark, sf, "v_edges")
    k = F.col("s_suppkey")
    more = table(spark, sf, "supplier").select(k.cast("string").alias("src"), F.explode(F.array((k + 1).cast("string"), k.cast("string"))).alias("dst"))
    gone = e.unionByName(more).where("cast(src as bigint) % 5 = 0")
    return graph.edit_edges(e, more, gone)


@query("""WITH more AS (SELECT s_suppkey::VARCHAR AS src, 'new' || (s_suppkey % 3) AS dst FROM supplier), a AS (SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ' | ') AS added FROM more WHERE src::BIGINT % 5 > 0 GROUP BY 1),
r AS (SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ' | ') AS removed FROM v_edges WHERE src::BIGINT % 5 = 0 GROUP BY 1) SELECT src, added, removed FROM a FULL JOIN r USING (src)""")
def link_plan(spark, sf):
    e = view(spark, sf, "v_edges")
    k = F.col("s_suppkey")
    more = table(spark, sf, "supplier").select(k.cast("string").alias("src"), F.concat(F.lit("new"), (k % 3).cast("string")).alias("dst"))
    return reports.link_plan_report(e.select(F.col("src").alias("node")), e, more, e.unionByName(more).where("cast(src as bigint) % 5 = 0"))


def _pagerank_sql(start: str, share: str, rounds: int = graph.ITERATIONS, edges: str = "v_edges") -> str:
    """Power iteration, one common table for each round; share: SQL for (node, p)."""
    out = [f"n AS (SELECT s_suppkey::VARCHAR AS node FROM supplier), p AS MATERIALIZED ({share}), e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS d FROM (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst AND src IN (FROM n) AND dst IN (FROM n)))"]
    out.append("r0 AS MATERIALIZED (SELECT node, p AS rank FROM p)")
    for k in range(rounds):
        out.append(
            f"r{k + 1} AS MATERIALIZED (SELECT p.node, 0.15 * p.p + 0.85 * ((SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM e)) * p.p + coalesce(f.flow, 0)) AS rank FROM p LEFT JOIN (SELECT dst, sum(rank / d) AS flow FROM e JOIN r{k} ON node = src GROUP BY dst) f ON dst = p.node)"
        )
    return f"WITH {', '.join(out)} {start.format(f'r{rounds}')}"


_EVEN = "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS p FROM n"
_LED = "SELECT node, w / sum(w) OVER () AS p FROM (SELECT s_suppkey::VARCHAR AS node, 0.7 / (SELECT count(*) FROM supplier) + 0.3 * abs(s_acctbal) / (SELECT max(abs(s_acctbal)) FROM supplier) AS w FROM supplier)"


@query(_pagerank_sql("SELECT node, round(rank, 8) AS rank FROM {0}", _EVEN))
def page_rank(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("node"))
    return graph.pagerank(nodes, view(spark, sf, "v_edges")).select("node", F.round("rank", 8).alias("rank"))


@query(_pagerank_sql("""SELECT node, round_even(rank * 10 / (SELECT max(rank) FROM {0}), 4) AS ipr, coalesce(i, 0)::BIGINT AS ipr_inbound, coalesce(o, 0)::BIGINT AS ipr_outbound FROM {0}
  LEFT JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS o FROM e GROUP BY 1) USING (node)""", _LED))
def internal_rank(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("node"))
    authority = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), F.abs("s_acctbal").alias("authority"))
    return graph.internal_pagerank(nodes, view(spark, sf, "v_edges"), authority)


@query(_pagerank_sql("SELECT node AS url, round(rank / greatest((SELECT max(rank) FROM {0}), 1e-9), 8) AS score FROM {0}", _EVEN))
def sandbox_rank(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("node"))
    return graph.sandbox_pagerank(nodes, view(spark, sf, "v_edges")).select("url", F.round("score", 8).alias("score"))


_EDITED = """(SELECT src, dst FROM (SELECT src, dst FROM v_edges UNION ALL SELECT s_suppkey::VARCHAR, (s_suppkey % (SELECT count(*) FROM supplier) + 1)::VARCHAR FROM supplier WHERE s_suppkey % 50 = 1)
  WHERE NOT (src::BIGINT % 50 = 7 AND dst::BIGINT % 2 = 0))"""


def _what_if_sql() -> str:
    b, a = (_pagerank_sql("SELECT node AS url, rank / greatest((SELECT max(rank) FROM {0}), 1e-9) AS score FROM {0}", _EVEN, edges=e) for e in ("v_edges", _EDITED))
    return f"SELECT url, round(b.score, 8) AS before, round(a.score, 8) AS after, round(a.score - b.score, 8) AS delta FROM ({b}) b JOIN ({a}) a USING (url)"


@query(_what_if_sql())
def what_if_ranks(spark, sf):
    """Each fiftieth supplier gets an edge to the next, each other fiftieth loses its even ones."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("node"))
    e = view(spark, sf, "v_edges")
    added = table(spark, sf, "supplier").crossJoin(F.broadcast(s.agg(F.count("*").alias("n")))).where("s_suppkey % 50 = 1").select(F.col("s_suppkey").cast("string").alias("src"), (F.col("s_suppkey") % F.col("n") + 1).cast("string").alias("dst"))  # one row
    removed = e.where("cast(src as bigint) % 50 = 7 and cast(dst as bigint) % 2 = 0")
    got = graph.what_if(s, e, added, removed)
    return got.select("url", *[F.round(c, 8).alias(c) for c in ("before", "after", "delta")])


@query("SELECT d.d AS domain, page_id FROM (VALUES ('0'), ('1'), ('none')) AS d(d) LEFT JOIN pages ON (page_id % 4)::VARCHAR = d.d")
def pages_of_domains(spark, sf):
    p = table(spark, sf, "pages").select((F.col("page_id") % 4).cast("string").alias("domain"), "page_id")
    return graph.by_domain(p, ["0", "1", "none"])


@query("""WITH RECURSIVE hop AS MATERIALIZED (SELECT p_partkey AS k, CASE WHEN p_partkey % 35 = 20 THEN p_partkey - 1 WHEN p_partkey % 7 > 0 THEN p_partkey + 1 END AS n FROM part),
w AS (SELECT k AS first, k AS place, CAST([] AS BIGINT[]) AS seen, false AS loops FROM hop UNION ALL SELECT first, n, list_append(seen, place), list_contains(list_append(seen, place), n) FROM w JOIN hop ON k = place WHERE n IS NOT NULL AND NOT loops AND len(seen) < 10)
SELECT 'p' || first AS url, len(seen)::INTEGER AS hops, 'p' || place AS final_url, loops AS looped FROM w QUALIFY row_number() OVER (PARTITION BY first ORDER BY len(seen) DESC) = 1""")
def followed_redirects(spark, sf):
    k = F.col("p_partkey")
    to = F.when(k % 35 == 20, k - 1).when(k % 7 > 0, k + 1)
    hops = table(spark, sf, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("url"), F.concat(F.lit("p"), to.cast("string")).alias("location"), F.lit(301).alias("status_code"))
    got = graph.redirect_chains(hops, hops.select("url"))
    return got.select("url", F.size("chain").alias("hops"), "final_url", "looped")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT rtrim(source_url, '/') AS s, rtrim(dest_url, '/') AS d FROM v_links WHERE is_internal), w AS (SELECT rtrim(url, '/') AS url, 0 AS depth FROM v_pages WHERE pos = 0 UNION SELECT e.d, w.depth + 1 FROM w JOIN e ON e.s = w.url WHERE w.depth < 12)
SELECT url, min(depth)::INTEGER AS depth FROM w GROUP BY 1""")
def crawled_pages(spark, sf):
    nodes, edges = graph.build(view(spark, sf, "v_pages"), view(spark, sf, "v_links"))
    seeds = view(spark, sf, "v_pages").where("pos = 0").select(F.regexp_replace("url", "/+$", "").alias("url"))
    return graph.crawl(seeds, edges, max_pages=10**6, max_depth=12, batch=10**6).select("url", "depth")


# sheets


def _sheet_pages(spark, sf):
    """Audit pages with the columns that sheets show beside those."""
    more = {"meta_robots": F.when(F.col("is_noindex"), "noindex"), "external_links_count": F.col("pos") % 5, "img_count": F.col("pos") % 7}
    p = audit_pages(spark, sf).withColumns(more)
    return p.withColumn("indexability_reason", scalars.indexability_reason(F.coalesce("is_noindex", F.lit(False)), F.coalesce("robots_txt_allowed", F.lit(True)), F.col("status_code"), F.col("canonical_url"), F.col("url")))


_REASON = "CASE WHEN coalesce(is_noindex, false) THEN 'noindex' WHEN NOT coalesce(robots_txt_allowed, true) THEN 'robots_blocked' WHEN coalesce(status_code, 0) <> 200 THEN 'http_' || coalesce(status_code, 0) WHEN coalesce(canonical_url, '') <> '' AND canonical_url <> url THEN 'canonical_other' END"


@query(f"""SELECT url, final_url, status_code, title, length(title)::INTEGER AS title_length, meta_description, length(meta_description)::INTEGER AS meta_description_length, h1_text, h1_count, word_count, CASE WHEN is_indexable THEN 'Yes' ELSE 'No' END AS is_indexable,
  {_REASON} AS indexability_reason, canonical_url, depth, round_even(ttfb_ms, 1) AS ttfb_ms, response_bytes, internal_links_count, pos % 5 AS external_links_count, pos % 7 AS img_count, CASE WHEN was_rendered THEN 'Yes' ELSE 'No' END AS was_rendered FROM v_audit""")
def pages_sheet(spark, sf):
    return reports.pages_sheet(_sheet_pages(spark, sf))


@query("""SELECT url, final_url, len(c)::INTEGER AS hops, array_to_string(list_transform(c, lambda x: 'https://s.example/hop (' || x || ')'), ' → ') AS chain FROM (SELECT url, final_url, list_filter([r1, r2], lambda x: x IS NOT NULL) AS c FROM v_audit) WHERE len(c) > 0""")
def redirects_sheet(spark, sf):
    return reports.redirects_sheet(_sheet_pages(spark, sf))


@query(f"SELECT url, status_code, CASE WHEN is_indexable THEN 'Yes' ELSE 'No' END AS is_indexable, {_REASON} AS indexability_reason, CASE WHEN is_noindex THEN 'noindex' END AS meta_robots, CASE WHEN robots_txt_allowed THEN 'Yes' ELSE 'No' END AS robots_txt_allowed, canonical_url FROM v_audit")
def indexability_sheet(spark, sf):
    return reports.indexability_sheet(_sheet_pages(spark, sf))


@query("SELECT url, CASE WHEN d_some THEN d_h1 END AS h1_changed, CASE WHEN d_some THEN d_title END AS title_changed, CASE WHEN d_some THEN d_links END AS links_added FROM v_audit WHERE was_rendered")
def js_sheet(spark, sf):
    return reports.js_sheet(_sheet_pages(spark, sf))


@query("""WITH i AS (SELECT CASE WHEN dest_url_normalized <> '' THEN dest_url_normalized ELSE dest_url END AS k, count(*) AS n FROM v_alinks WHERE is_internal GROUP BY 1)
SELECT url, depth, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS inlinks FROM v_audit LEFT JOIN i a ON a.k = url LEFT JOIN i b ON b.k = url_normalized""")
def link_graph_by_both_keys(spark, sf):
    return reports.link_graph_sheet(audit_pages(spark, sf), view(spark, sf, "v_alinks"))


@query("SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END, issue_type)::INTEGER AS place, severity, issue_type FROM (SELECT DISTINCT severity, issue_type FROM v_issues UNION ALL SELECT 'odd', 'type_9')")
def issues_sheet(spark, sf):
    i = view(spark, sf, "v_issues").select("severity", "issue_type").distinct()
    got = reports.issues_sheet(i.unionByName(spark.createDataFrame([("odd", "type_9")], "severity string, issue_type string")))
    return agg.progress(got.select(F.lit(1).alias("all"), rules.severity_order(F.col("severity")).alias("o"), "severity", "issue_type"), "all", "o", "issue_type").select(F.col("done").alias("place"), "severity", "issue_type")


@query("""SELECT * FROM (SELECT 'mixed_case' AS list, url FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) <> lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AND regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) <> '/'
  UNION ALL SELECT 'deep', url FROM pages WHERE len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) > 5
  UNION ALL SELECT 'deep', url || '/a/b/c/d/E/f' FROM (SELECT regexp_extract(url, '^[^?#]*', 0) AS url FROM pages WHERE page_id % 5 = 0)
  UNION ALL SELECT 'mixed_case', url || '/a/b/c/d/E/f' FROM (SELECT regexp_extract(url, '^[^?#]*', 0) AS url FROM pages WHERE page_id % 5 = 0))""")
def url_hygiene(spark, sf):
    u = table(spark, sf, "pages").select("page_id", "url")
    u = u.unionByName(u.where("page_id % 5 = 0").withColumn("url", F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/a/b/c/d/E/f")))).select("url")
    got = reports.url_hygiene(u, u.select(F.col("url").alias("loc")))
    return got["mixed_case"].select(F.lit("mixed_case").alias("list"), "url").unionByName(got["deep"].select(F.lit("deep").alias("list"), "url"))


# online state


_REQUESTS = "SELECT user_id % 5 AS tenant, epoch_us(ts)::BIGINT // 3600 AS us, event_id AS id FROM events"


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY us, id) AS i FROM ({_REQUESTS})),
w AS (SELECT tenant, us, id, i, true AS accepted, [us] AS kept FROM q WHERE i = 1
  UNION ALL SELECT q.tenant, q.us, q.id, q.i, len(list_filter(w.kept, lambda k: k > q.us - 60000000)) < 120,
    CASE WHEN len(list_filter(w.kept, lambda k: k > q.us - 60000000)) < 120 THEN list_append(list_filter(w.kept, lambda k: k > q.us - 60000000), q.us) ELSE list_filter(w.kept, lambda k: k > q.us - 60000000) END
  FROM w JOIN q ON q.tenant = w.tenant AND q.i = w.i + 1)
SELECT tenant, us, id, accepted FROM w""")
def rate_limited(spark, sf):
    """120 a minute, over requests that come 3600 times as fast as the events did."""
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("tenant"), F.expr("unix_micros(cast(ts as timestamp)) div 3600").alias("us"), F.col("event_id").alias("id"))
    return limits.rate_limit_batch(e)


@query("""WITH RECURSIVE q AS (SELECT user_id % 5 AS host, epoch_us(ts)::BIGINT // 3600 AS us, event_id AS id, event_id % 7 * 900000 AS took, row_number() OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts)::BIGINT // 3600, event_id) AS i FROM events),
w AS (SELECT host, us, id, i, us AS start_us, [us + took] AS ends FROM q WHERE i = 1
  UNION ALL SELECT q.host, q.us, q.id, q.i, greatest(q.us, w.start_us + 500000, CASE WHEN len(w.ends) >= 5 THEN list_min(w.ends) END),
    list_append(CASE WHEN len(w.ends) >= 5 THEN list_sort(w.ends)[2:] ELSE w.ends END, greatest(q.us, w.start_us + 500000, CASE WHEN len(w.ends) >= 5 THEN list_min(w.ends) END) + q.took)
  FROM w JOIN q ON q.host = w.host AND q.i = w.i + 1)
SELECT host, us, id, start_us FROM w""")
def host_schedule_in_flight(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("host"), F.expr("unix_micros(cast(ts as timestamp)) div 3600").alias("us"), F.col("event_id").alias("id"), (F.col("event_id") % 7 * 900_000).alias("took_us"))
    return limits.host_schedule_in_flight(e)


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12")
def last_messages(spark, sf):
    return agg.last_messages(table(spark, sf, "conversations"))


@query("""SELECT 'u' || n_nationkey AS url, greatest(CASE WHEN n_nationkey % 4 > 0 THEN TIMESTAMP '2024-01-01' - to_days(n_nationkey) + to_hours(24 * (1 + n_nationkey % 3)) ELSE TIMESTAMP '2024-01-01' END, TIMESTAMP '2024-01-01') + to_minutes(5 + 10 * (row_number() OVER (ORDER BY 'u' || n_nationkey) - 1)) AS next_run FROM nation""")
def next_runs(spark, sf):
    k, now = F.col("n_nationkey"), F.lit("2024-01-01").cast("timestamp")
    sites = table(spark, sf, "nation").select(F.concat(F.lit("u"), k.cast("string")).alias("url"), F.when(k % 4 > 0, now - F.make_dt_interval(k)).alias("last_run"), (24 * (1 + k % 3)).alias("every_hours"))
    return limits.next_runs(sites, now).select("url", "next_run")


@query("SELECT r_regionkey AS id, pow(2, r_regionkey)::DOUBLE AS least, pow(2, r_regionkey) + 1::DOUBLE AS most, r_regionkey <= 3 AS again FROM region")
def retry_delays(spark, sf):
    k = F.col("r_regionkey")
    return table(spark, sf, "region").select(k.alias("id"), limits.backoff(k).alias("least"), (limits.backoff(k) + limits.JITTER_S).alias("most"), limits.may_retry(k).alias("again"))


@query("""WITH t AS (SELECT event_type, value, time_bucket(INTERVAL 5 MINUTES, ts) AS start FROM events), m AS (SELECT max(ts) AS last FROM events)
SELECT start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM t, m WHERE start + INTERVAL 5 MINUTES <= date_trunc('milliseconds', last) - INTERVAL 10 MINUTES GROUP BY 1, 2""")
def streamed_windows(spark, sf):
    """A stream over the table, to its end: windows that the watermark has passed."""
    work = fresh_dir(spark, "stream")
    events = table(spark, sf, "events")
    events.coalesce(1).write.parquet(f"{work}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{work}/in")
    limits.windowed(source).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{work}/out").select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query(f"SELECT tenant, count(*)::BIGINT AS n FROM ({_REQUESTS}) GROUP BY 1")
def streamed_lines(spark, sf):
    """Lines of run files as they grow: two files, read as a stream to its end."""
    work = fresh_dir(spark, "tail")
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("tenant"), F.col("event_id").alias("id"))
    e.repartition(2, "id").write.json(f"{work}/in")
    limits.tail_json(spark, f"{work}/in", "tenant long, id long").writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{work}/out").groupBy("tenant").agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT page_id)::BIGINT AS seen, count_if(page_id % 3 = 0)::BIGINT AS done, (200 - count_if(page_id % 3 = 0))::BIGINT AS budget, count_if(page_id % 3 > 0)::BIGINT AS queued FROM pages""")
def frontier_state(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    url = k.cast("string").alias("url")
    found = p.select(url).unionByName(p.where("page_id % 2 = 0").select(url))
    return limits.frontier_state(found, p.where("page_id % 3 = 0").select(url), 200)
