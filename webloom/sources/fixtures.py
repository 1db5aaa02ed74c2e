"""Crawl tables derived from the test tables by fixed rules, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IDX = "(coalesce(is_indexable, true) AND coalesce(status_code, 0) = 200)"

V_PAGES = """SELECT page_id AS pos, url, CAST(NULL AS STRING) AS url_normalized, CAST(NULL AS STRING) AS final_url, CAST(page_id % 7 AS STRING) AS crawl_run_id,
  CAST(CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 301 ELSE 200 END AS INT) AS status_code,
  CASE WHEN page_id % 9 = 0 THEN '' ELSE 'text/html' END AS content_type,
  CAST(page_id % 8 AS INT) AS depth, CAST(page_id * 37 % 3000 AS DOUBLE) AS ttfb_ms, CAST(length(html) * 40 AS BIGINT) AS response_bytes,
  CASE WHEN page_id % 10 = 3 THEN 'Same Title' WHEN page_id % 25 = 4 THEN 'Page not found' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title,
  CASE WHEN page_id % 10 = 3 THEN 'Same Title' ELSE regexp_extract(html, '<h1>([^<]*)', 1) END AS h1_text, CAST(page_id % 3 AS INT) AS h1_count,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS html_lang,
  CAST(page_id * 31 % 400 AS INT) AS word_count, CAST(page_id % 100 AS STRING) AS content_hash,
  page_id % 11 <> 0 AS is_indexable, page_id % 13 <> 0 AS robots_txt_allowed, page_id % 17 = 0 AS is_noindex, page_id % 2 = 0 AS was_rendered,
  CAST(page_id % 3 AS INT) AS img_missing_alt, CAST(page_id % 5 AS INT) AS img_missing_dimensions,
  CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN concat(url, '/x') ELSE url END AS canonical_url, CAST(CASE WHEN page_id % 4 = 0 THEN 2 ELSE 1 END AS INT) AS canonical_count,
  CASE WHEN page_id % 5 = 0 THEN 'sitemap' ELSE 'discovered' END AS source,
  CASE WHEN page_id % 4 = 1 THEN NULL ELSE substr(regexp_extract(html, '<h1>([^<]*)', 1), 1, CAST(page_id % 90 AS INT)) END AS meta_description,
  CAST(page_id % 12 AS INT) AS internal_links_count, CAST(page_id % 15 AS INT) AS external_links_count, CAST(page_id % 4 AS INT) AS internal_nofollow_count, CAST(page_id % 6 AS INT) AS broken_links
FROM pages"""

V_LINKS = """SELECT p.page_id AS src_id, k.k AS k, p.url AS source_url, q.url AS dest_url, CAST(NULL AS STRING) AS dest_url_normalized, k.k <> 3 AS is_internal,
  CASE WHEN q.page_id % 9 = 0 THEN ' ' ELSE concat('to ', CAST(q.page_id AS STRING)) END AS anchor_text
FROM pages p JOIN (VALUES (0), (1), (2), (3)) AS k(k) ON k.k <= p.page_id % 4
CROSS JOIN (SELECT count(*) AS n FROM pages) AS c JOIN pages q ON q.page_id = (p.page_id * 7 + k.k * 13 + 1) % c.n"""

V_RUNS = """SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS site_id, o_custkey % 3 AS tenant,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS completed_at, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(floor(o_totalprice / 100) AS BIGINT) AS pages FROM orders"""

V_ISSUES = """SELECT CAST(l_orderkey AS STRING) AS crawl_run_id, concat('type_', CAST(l_partkey % 5 AS STRING)) AS issue_type,
  CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  CAST(l_quantity AS BIGINT) AS affected_urls_count, concat('u', CAST(l_suppkey AS STRING)) AS affected_url FROM lineitem"""

V_ANSWERS = """SELECT conv_id * 1000 + turn AS pos, concat('p', CAST(conv_id % 5 AS STRING)) AS persona, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('s', CAST(turn % 3 AS STRING)) END AS service,
  CAST(turn % 3 AS STRING) AS prompt_type, concat('q', CAST(conv_id % 30 AS STRING)) AS query, text AS answer_text FROM conversations WHERE role = 'assistant'"""

V_EDGES = """SELECT DISTINCT CAST(l_suppkey AS STRING) AS src, CAST(l_partkey % s.n + 1 AS STRING) AS dst FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM supplier) AS s
WHERE l_suppkey <> l_partkey % s.n + 1"""

_P4 = "CAST(floor(page_id / 4.0) AS BIGINT)"
_P40 = "CAST(floor(page_id / 40.0) AS BIGINT)"
_LANG = "CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'sv' END"
_FILL = " ".join(f"f{k}" for k in range(70))

#: Pages with every column that the audit reads, in flat form: lists as some columns each, null where a list is shorter.
V_AUDIT = f"""SELECT page_id AS pos, CASE WHEN page_id % 10 >= 8 THEN concat('https://s.example/list', CAST({_P40} AS STRING), '?c=', CAST(page_id AS STRING), CASE WHEN page_id % 20 = 9 THEN '#f' ELSE '' END)
    ELSE concat(CASE WHEN page_id % 29 = 0 THEN 'http://' ELSE 'https://' END, 's.example/', {_LANG}, '/', CAST({_P4} AS STRING), CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END) END AS url,
  CASE WHEN page_id % 6 = 0 THEN concat('n:', CAST(page_id AS STRING)) WHEN page_id % 6 = 1 THEN '' END AS url_normalized,
  CAST(CASE page_id % 17 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 301 WHEN 3 THEN NULL ELSE 200 END AS INT) AS status_code,
  CASE WHEN page_id % 7 = 0 THEN false WHEN page_id % 7 = 1 THEN NULL ELSE true END AS is_indexable,
  CASE WHEN page_id % 13 = 0 THEN false WHEN page_id % 13 < 9 THEN true END AS robots_txt_allowed, CASE WHEN page_id % 9 = 4 OR page_id % 27 = 6 THEN true WHEN page_id % 9 < 7 THEN false END AS is_noindex,
  CASE page_id % 3 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'discovered' END AS source, CAST(CASE WHEN page_id % 19 < 18 THEN page_id % 9 END AS INT) AS depth,
  CASE WHEN page_id % 6 = 2 THEN '' WHEN page_id % 6 = 3 THEN concat('https://s.example/final/', CAST(page_id AS STRING)) END AS final_url,
  CAST(CASE WHEN page_id % 8 < 3 THEN 301 END AS INT) AS r1, CAST(CASE page_id % 8 WHEN 0 THEN 302 WHEN 1 THEN 301 END AS INT) AS r2, CASE WHEN page_id % 16 = 2 THEN true WHEN page_id % 16 < 8 THEN false END AS redirect_loop,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://s.example/other' WHEN 3 THEN concat('https://s.example/final/', CAST(page_id AS STRING), '/')
    ELSE concat('https://s.example/', {_LANG}, '/', CAST({_P4} AS STRING), '//') END AS canonical_url, CAST(CASE WHEN page_id % 12 < 11 THEN page_id % 4 END AS INT) AS canonical_count,
  CASE page_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN 'Same  Title of many pages' WHEN 4 THEN concat('same  title OF many pages', ' ') WHEN 5 THEN 'Short' WHEN 6 THEN 'Error 404'
    WHEN 7 THEN concat('A title that is by far too long for any list of results, that of page ', CAST(page_id AS STRING)) ELSE concat('A title of its own, ', CAST(page_id AS STRING)) END AS title,
  CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'One description that several pages have and that is of seventy characters or more' WHEN 3 THEN concat('Short ', CAST(page_id AS STRING))
    WHEN 4 THEN repeat(concat(CAST(page_id AS STRING), ' many words '), 20) ELSE concat('A description of its own with a number that makes it differ from others ', CAST(page_id AS STRING)) END AS meta_description,
  CASE page_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '         h  ' WHEN 3 THEN 'Same heading' WHEN 4 THEN repeat('long heading ', 7) WHEN 5 THEN concat('a TITLE of its own, ', CAST(page_id AS STRING), ' ')
    WHEN 6 THEN concat(repeat(' ', 50), 'Short enough once stripped', repeat(' ', 50)) ELSE 'Shared heading of pages' END AS h1_text, CAST(CASE WHEN page_id % 14 < 13 THEN page_id % 3 END AS INT) AS h1_count,
  CAST(CASE WHEN page_id % 22 = 3 THEN 2 END AS INT) AS gap, CAST(CASE WHEN page_id % 18 < 17 THEN page_id * 31 % 400 END AS INT) AS word_count,
  CASE WHEN page_id % 10 >= 8 THEN CASE WHEN {_P40} % 3 = 0 THEN concat('c', CAST(page_id AS STRING)) WHEN {_P40} % 3 = 1 THEN concat('l', CAST({_P40} AS STRING)) END
    WHEN page_id % 23 = 0 THEN '' WHEN page_id % 23 = 1 THEN NULL ELSE concat('h', CAST(page_id * 7 % 120 AS STRING)) END AS content_hash,
  CAST(page_id % 12 AS INT) AS internal_links_count, CAST(CASE WHEN page_id % 4 > 0 THEN page_id % 4 - 1 END AS INT) AS internal_nofollow_count,
  CAST(CASE WHEN page_id % 5 > 0 THEN page_id % 5 - 1 END AS INT) AS img_missing_alt, CAST(CASE WHEN page_id % 15 = 1 THEN 1 END AS INT) AS img_lazy_broken, CAST(CASE WHEN page_id % 4 > 0 THEN page_id % 4 - 1 END AS INT) AS img_missing_dimensions,
  CASE page_id % 8 WHEN 0 THEN '{{"@type": "Product", "name": "x", "image": "y", "offers": {{}}}}' WHEN 1 THEN '{{"@type": "Product", "name": "x"}}' WHEN 2 THEN '{{"_error": "broken"}}' WHEN 3 THEN '{{"@type": ["Article", "Thing"], "headline": "x"}}'
    WHEN 4 THEN '[1, 2]' WHEN 5 THEN '{{"@type": "Organization", "name": "x", "url": null, "_error": ""}}' END AS sd1,
  CASE page_id % 13 WHEN 0 THEN '{{"dateModified": "2020-01-02T03:04:05Z"}}' WHEN 1 THEN '{{"dateModified": "", "datePublished": "2023-05-06"}}' WHEN 2 THEN '{{"dateModified": "2025-12-01", "datePublished": "2001-01-01"}}' WHEN 3 THEN '{{"datePublished": "01/02/2003"}}'
    WHEN 4 THEN '{{"dateModified": "2019-01-01 10:00:00"}}' WHEN 5 THEN '{{"dateModified": "2024-12-31T00:00:01"}}' WHEN 6 THEN '{{"dateModified": "2024-12-31T00:00:00+02:00"}}' END AS sd2,
  CASE WHEN page_id % 2 = 0 THEN true WHEN page_id % 4 = 1 THEN false END AS was_rendered, CASE WHEN page_id % 6 = 2 THEN 'a script failed' END AS ce,
  page_id % 8 < 7 AS d_some, page_id % 10 = 2 AS d_h1, page_id % 12 = 4 AS d_title, CAST(page_id % 16 AS INT) AS d_links,
  CAST(CASE WHEN page_id % 11 < 10 THEN page_id * 37 % 3000 END AS DOUBLE) AS ttfb_ms, CAST(CASE WHEN page_id % 10 < 9 THEN page_id * 12347 % 4000000 END AS BIGINT) AS response_bytes,
  page_id % 3 <> 0 AND page_id % 10 < 8 AS tagged, CASE WHEN page_id % 11 = 1 THEN 'XX-us' WHEN page_id % 11 = 2 THEN ' X-Default' ELSE ' EN-gb ' END AS t1_lang,
  CASE WHEN page_id % 13 = 1 THEN '' ELSE concat('https://s.example/en/', CAST({_P4} AS STRING)) END AS t1_href, 'de' AS t2_lang, concat('https://s.example/de/', CAST({_P4} AS STRING), '/') AS t2_href,
  CASE WHEN page_id % 7 < 4 THEN 'x-default' END AS t3_lang, concat('https://s.example/fr/', CAST({_P4} AS STRING)) AS t3_href,
  CASE WHEN page_id % 3 = 0 THEN true WHEN page_id % 3 = 1 THEN false END AS mobile_checked, CAST(CASE WHEN page_id % 12 > 0 THEN page_id % 200 END AS INT) AS wd, CAST(page_id * 3 % 200 AS INT) AS wm, CAST(page_id % 24 AS INT) AS ld, CAST(page_id * 5 % 24 AS INT) AS lm,
  CASE page_id % 4 WHEN 0 THEN 'og' WHEN 1 THEN '' END AS og_title, CASE page_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN '' END AS twitter_card, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_viewport, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'utf-8' END AS charset_declared,
  CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_mixed_content, CASE page_id % 4 WHEN 0 THEN 'Strict-Transport-Security' WHEN 1 THEN 'STRICT-transport-security' WHEN 2 THEN 'Server' END AS hk,
  CASE page_id % 5 WHEN 0 THEN '/local' WHEN 1 THEN 'http://s.example/in' END AS fa1, CASE page_id % 7 WHEN 0 THEN 'http://other.example/' WHEN 1 THEN 'https://s.example/' END AS fa2,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'en' END AS html_lang, CAST(CASE WHEN page_id % 7 > 0 THEN page_id % 7 - 1 END AS INT) AS empty_link_count, CAST(CASE WHEN page_id % 9 > 0 THEN page_id % 9 - 1 END AS INT) AS form_inputs_without_label,
  CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_skip_nav,
  CASE WHEN page_id % 16 = 0 THEN NULL ELSE concat(repeat('of ', CAST(page_id % 9 AS INT)), repeat('Alpha ', CAST(page_id % 11 AS INT)), repeat(' beta', CAST(page_id % 7 AS INT)), repeat(' gamma', CAST(page_id % 5 AS INT) + 2), ' {_FILL} ', repeat('it ', CAST(page_id % 20 AS INT))) END AS main_text
FROM pages"""

V_ALINKS = """SELECT p.url AS source_url, q.url AS dest_url, CASE WHEN p.pos % 3 < 2 THEN q.url_normalized END AS dest_url_normalized, CASE k.k WHEN 1 THEN true WHEN 2 THEN p.pos % 5 > 0 END AS is_internal
FROM v_audit p JOIN (VALUES (0), (1), (2)) AS k(k) ON k.k <= p.pos % 4
CROSS JOIN (SELECT count(*) AS n FROM v_audit) AS c JOIN v_audit q ON q.pos = (p.pos * 7 + k.k * 13 + 1) % c.n"""

VIEWS = {"v_pages": V_PAGES, "v_links": V_LINKS, "v_runs": V_RUNS, "v_issues": V_ISSUES, "v_answers": V_ANSWERS, "v_edges": V_EDGES, "v_audit": V_AUDIT, "v_alinks": V_ALINKS}
#: Views of links in the form that Spark reads: the target's place is a column ahead of the join. In the form above a filter over columns of both ends made the
#: optimizer join the ends first, without a key: every page with every page.
_LINKED = """FROM (SELECT p.*, k.k AS k, (p.{0} * 7 + k.k * 13 + 1) % c.n AS to FROM {1} p JOIN (VALUES {2}) AS k(k) ON k.k <= p.{0} % 4 CROSS JOIN (SELECT count(*) AS n FROM {1}) AS c) AS p JOIN {1} q ON q.{0} = p.to"""


def _linked(sql: str, key: str, of: str, values: str) -> str:
    return sql.split(f"FROM {of} p JOIN ")[0].replace("k.k", "p.k") + _LINKED.format(key, of, values)


SPARK_VIEWS = VIEWS | {"v_links": _linked(V_LINKS, "page_id", "pages", "(0), (1), (2), (3)"), "v_alinks": _linked(V_ALINKS, "pos", "v_audit", "(0), (1), (2)")}
BRANDS = ["The Of AB", "and", "der", "que la"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the test tables; the names it reads are local to the statement."""
    tables = {t: table(spark, sf_dir, t) for t in ("pages", "orders", "lineitem", "conversations", "supplier") if f" {t}" in VIEWS[name]}
    tables |= {v: view(spark, sf_dir, v) for v in VIEWS if f" {v} " in VIEWS[name]}
    sql = SPARK_VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **tables)


def with_views(sql: str) -> str:
    """A DuckDB statement with the views that it names in front."""
    used = {v for v in VIEWS if v in sql}
    used |= {v for v in VIEWS for u in used if f" {v} " in VIEWS[u]}
    listed = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in used)
    if not listed:
        return sql
    for lead in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(lead):
            return f"{lead}{listed}, {sql[len(lead):]}"
    return f"WITH {listed} {sql}"
