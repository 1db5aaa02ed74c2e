"""The site analytics queries over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import queries_audit, queries_cases, queries_deep, queries_more
from webloom.functions import scalars, urls
from webloom.operators import aggregates as agg
from webloom.operators import graph, joins, rankings, rules
from webloom.plans import reports
from webloom.sources.fixtures import BRANDS, IDX, table, view, with_views
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


def _pages(spark, sf):
    return view(spark, sf, "v_pages")


def _links(spark, sf):
    return view(spark, sf, "v_links")


# pages and texts


@query("""SELECT text_hash, count(*)::BIGINT AS n, min(doc_id)::BIGINT AS first_id FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query()
def near_duplicate_pages(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("pos"), F.col("text").alias("main_text"), F.sha2("text", 256).alias("content_hash"))
    return rules.near_duplicates(d.withColumns({"word_count": scalars.word_count(F.col("main_text")), "is_indexable": F.lit(True), "status_code": F.lit(200)}))


@query("""
SELECT url, pos FROM (SELECT 'd' || doc_id AS url, doc_id AS pos, word, n, total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS r FROM
  (SELECT doc_id, word, count(*) AS n, min(place) AS place, any_value(total) AS total FROM
    (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place, len(w) AS total FROM
      (SELECT doc_id, list_filter(string_split_regex(trim(lower(text)), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 100) GROUP BY doc_id, word))
WHERE r <= 3 AND length(word) > 3 AND n / total > 0.05 GROUP BY url, pos""")
def keyword_stuffed(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("pos"), F.col("text").alias("main_text"))
    return rules.keyword_stuffing(d.withColumns({"is_indexable": F.lit(True), "status_code": F.lit(200)}))


# urls


@query(r"""SELECT page_id, rtrim(split_part(url, '#', 1), '/') AS defragmented, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS domain,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''))::INTEGER AS depth,
  regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.defragment(u).alias("defragmented"), urls.domain(u).alias("domain"), urls.path(u).alias("path"), urls.path_depth(u).alias("depth"), urls.query(u).alias("query"))


@query()
def url_normalized(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.normalizer()(u).alias("normalized"), urls.has_special_characters(u).alias("special"), urls.is_internal(u, "www.example.com", True).alias("internal"))


@query("""SELECT split_part(split_part(url, '#', 1), '?', 1) AS base, count(DISTINCT url)::BIGINT AS variants FROM
  (SELECT url FROM pages UNION ALL SELECT 'http://a.example.com/p?c=' || page_id FROM pages) WHERE regexp_extract(url, '[?]([^#]*)', 1) <> '' GROUP BY 1 HAVING count(DISTINCT url) > 5""")
def faceted_navigation(spark, sf):
    p = table(spark, sf, "pages")
    more = p.select(F.concat(F.lit("http://a.example.com/p?c="), F.col("page_id").cast("string")).alias("url"))
    return agg.faceted(p.select("url").unionByName(more))


@query("""SELECT count(*)::BIGINT AS crawled, (SELECT count(*) FROM pages WHERE page_id % 3 = 0)::BIGINT AS listed,
  (SELECT count(DISTINCT rtrim(url, '/')) FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 0)::BIGINT AS overlap FROM pages WHERE page_id % 2 = 0""")
def sitemap_counts(spark, sf):
    p = table(spark, sf, "pages")
    return joins.sitemap_gap(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0").select(F.col("url").alias("loc")))["counts"]


@query("""SELECT DISTINCT rtrim(url, '/') AS url FROM pages WHERE page_id % 3 = 0 AND rtrim(url, '/') NOT IN (SELECT rtrim(url, '/') FROM pages WHERE page_id % 2 = 0) ORDER BY url LIMIT 100""")
def sitemap_only(spark, sf):
    p = table(spark, sf, "pages")
    return joins.sitemap_gap(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0").select(F.col("url").alias("loc")))["in_sitemap_only"]


# html


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title_raw, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang,
  (len(string_split(html, '<a href="')) - 1)::INTEGER AS hrefs, strlen(html)::BIGINT AS bytes FROM pages""")
def html_quick(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)", 1).alias("title_raw"), F.regexp_extract(h, '<html lang="([^"]*)"', 1).alias("html_lang"), F.regexp_count(h, F.lit('<a href="')).alias("hrefs"), F.octet_length(h).cast("long").alias("bytes"))


@query()
def html_extract(spark, sf):
    from webloom.functions import html

    return html.extract_pages(table(spark, sf, "pages"))


@query()
def html_sections(spark, sf):
    from webloom.functions import html

    got = html.extract_pages(table(spark, sf, "pages")).select("page_id", F.posexplode("sections").alias("index", "s"))
    return got.select("page_id", "index", "s.type", "s.level", "s.text")


# metrics and summaries

_MEAN = "avg(CASE WHEN {0} <> 0 THEN {0} END)"


@query(f"""SELECT * FROM (SELECT unnest(['total_pages', 'indexable_pages', 'status_2xx', 'status_3xx', 'status_4xx', 'status_5xx', 'missing_titles', 'missing_h1', 'avg_ttfb_ms', 'avg_response_bytes', 'avg_word_count', 'p90_ttfb_ms']) AS metric_name,
  unnest([count(*), count_if(is_indexable), count_if(status_code BETWEEN 200 AND 299), count_if(status_code BETWEEN 300 AND 399), count_if(status_code BETWEEN 400 AND 499), count_if(status_code >= 500), count_if(title = ''), count_if(h1_count = 0),
  {_MEAN.format('ttfb_ms')}, {_MEAN.format('response_bytes')}, {_MEAN.format('word_count')}, list_sort(list(ttfb_ms) FILTER (WHERE ttfb_ms <> 0))[floor(count(*) FILTER (WHERE ttfb_ms <> 0) * 0.9)::BIGINT + 1]]::DOUBLE[]) AS metric_value FROM v_pages)""")
def run_metrics(spark, sf):
    return agg.basic_metrics(_pages(spark, sf))


@query("""SELECT severity, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) AS s(severity) LEFT JOIN (SELECT severity, count(*) AS n FROM v_issues GROUP BY 1) USING (severity)""")
def severity_counts(spark, sf):
    return agg.severity_counts(view(spark, sf, "v_issues"))


@query("SELECT crawl_run_id, count(*)::BIGINT AS pages, count_if(is_indexable)::BIGINT AS indexable, count_if(was_rendered)::BIGINT AS rendered FROM v_pages GROUP BY 1")
def run_totals(spark, sf):
    return agg.run_totals(_pages(spark, sf))


_HTML = "status_code = 200 AND content_type = 'text/html'"


@query(f"""SELECT count(*)::BIGINT AS total, count_if(status_code BETWEEN 200 AND 299)::BIGINT AS ok, count_if(status_code BETWEEN 300 AND 399)::BIGINT AS redirects, count_if(status_code BETWEEN 400 AND 499)::BIGINT AS client_errors, count_if(status_code >= 500)::BIGINT AS server_errors,
  count_if({_HTML} AND title = '')::BIGINT AS title_missing, count_if({_HTML} AND length(title) > 60)::BIGINT AS title_long, count_if({_HTML} AND title <> '' AND length(title) < 30)::BIGINT AS title_short,
  count_if({_HTML} AND coalesce(meta_description, '') = '')::BIGINT AS meta_missing, count_if({_HTML} AND length(meta_description) > 160)::BIGINT AS meta_long, count_if({_HTML} AND meta_description <> '' AND length(meta_description) < 70)::BIGINT AS meta_short,
  count_if({_HTML} AND h1_count = 0)::BIGINT AS h1_missing, count_if({_HTML} AND h1_count > 1)::BIGINT AS h1_multiple, count_if({_HTML} AND word_count < 200)::BIGINT AS thin, count_if({_HTML} AND is_noindex)::BIGINT AS noindex,
  count_if({_HTML} AND canonical_url IS NULL)::BIGINT AS canonical_missing, sum(CASE WHEN {_HTML} THEN img_missing_alt END)::BIGINT AS images_without_alt,
  (SELECT count(*) FROM (SELECT title FROM v_pages WHERE {_HTML} AND title <> '' GROUP BY 1 HAVING count(*) > 1))::BIGINT AS duplicate_titles,
  (SELECT count(*) FROM (SELECT meta_description FROM v_pages WHERE {_HTML} AND meta_description <> '' GROUP BY 1 HAVING count(*) > 1))::BIGINT AS duplicate_metas FROM v_pages""")
def domain_summary(spark, sf):
    return agg.domain_summary(_pages(spark, sf))


@query("""SELECT CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx' WHEN status_code BETWEEN 300 AND 399 THEN '3xx' WHEN status_code BETWEEN 400 AND 499 THEN '4xx' ELSE '5xx' END AS class, count(*)::BIGINT AS n FROM v_pages GROUP BY 1""")
def status_classes(spark, sf):
    return agg.status_classes(_pages(spark, sf))


@query(f"""SELECT round(count_if(title <> '') * 100.0 / count(*))::BIGINT AS title, round(count_if(meta_description <> '') * 100.0 / count(*))::BIGINT AS meta, round(count_if(h1_count > 0) * 100.0 / count(*))::BIGINT AS h1,
  round(count_if(word_count >= 300) * 100.0 / count(*))::BIGINT AS words FROM v_pages WHERE {IDX}""")
def quality_shares(spark, sf):
    return agg.quality_shares(_pages(spark, sf))


@query("""SELECT v.url, coalesce(i.n, 0)::BIGINT AS inlinks, coalesce(o.n, 0)::BIGINT AS outlinks, coalesce(i.n, 0) < 2 AS few_inlinks, coalesce(o.n, 0) > 100 AS many_outlinks FROM v_pages v
  LEFT JOIN (SELECT rtrim(dest_url, '/') AS k, count(*) AS n FROM v_links WHERE is_internal GROUP BY 1) i ON rtrim(v.url, '/') = i.k
  LEFT JOIN (SELECT rtrim(source_url, '/') AS k, count(*) AS n FROM v_links WHERE is_internal GROUP BY 1) o ON rtrim(v.url, '/') = o.k""")
def link_counts(spark, sf):
    return agg.link_counts(_pages(spark, sf), _links(spark, sf))


@query("SELECT rtrim(dest_url, '/') AS dest, list_sort(list(anchor_text)) AS anchors FROM v_links WHERE trim(anchor_text) <> '' GROUP BY 1")
def anchor_texts(spark, sf):
    return agg.anchors(_links(spark, sf))


@query("""SELECT source_url, list_sort(list(DISTINCT {'url': dest_url, 'status': p.status_code})) AS broken FROM v_links JOIN v_pages p ON dest_url = p.url WHERE is_internal AND p.status_code >= 400 GROUP BY 1""")
def broken_by_source(spark, sf):
    return joins.broken_by_source(_links(spark, sf), _pages(spark, sf))


@query("SELECT url, depth, n::BIGINT AS inlinks FROM (SELECT v.url, depth, count(l.dest_url) AS n FROM v_pages v LEFT JOIN (SELECT * FROM v_links WHERE is_internal) l ON l.dest_url = v.url GROUP BY v.url, v.depth, v.pos)")
def link_graph_sheet(spark, sf):
    return reports.link_graph_sheet(_pages(spark, sf), _links(spark, sf))


@query("SELECT severity AS name, count(*)::BIGINT AS value FROM v_issues GROUP BY 1 UNION ALL SELECT unnest(['pages', 'indexable', 'noindex', 'robots_blocked', 'errors']), unnest([count(*), count_if(is_indexable), count_if(is_noindex), count_if(NOT robots_txt_allowed), count_if(status_code >= 400)])::BIGINT FROM v_pages")
def summary_sheet(spark, sf):
    return reports.summary_sheet(_pages(spark, sf), view(spark, sf, "v_issues"))


# rankings


@query("SELECT url, word_count FROM v_pages WHERE word_count < 200 AND status_code = 200 AND NOT is_noindex ORDER BY word_count, url LIMIT 8")
def thin_pages(spark, sf):
    return rankings.thin_pages(_pages(spark, sf))


@query("""SELECT url, score::INTEGER AS score, reasons FROM (SELECT url, (title = '')::INT + (h1_text = '')::INT + (coalesce(meta_description, '') = '')::INT + 2 * broken_links + is_noindex::INT AS score,
  array_to_string(list_filter([CASE WHEN title = '' THEN 'no title' END, CASE WHEN h1_text = '' THEN 'no h1' END, CASE WHEN coalesce(meta_description, '') = '' THEN 'no meta' END, CASE WHEN broken_links > 0 THEN 'broken links' END, CASE WHEN is_noindex THEN 'noindex' END], lambda x: x IS NOT NULL), ', ') AS reasons
  FROM v_pages ORDER BY score DESC, url LIMIT 10) WHERE score > 0""")
def problem_pages(spark, sf):
    return rankings.problem_pages(_pages(spark, sf))


@query("SELECT url, external_links_count FROM v_pages WHERE external_links_count > 3 ORDER BY external_links_count DESC, url LIMIT 5")
def most_external(spark, sf):
    return rankings.most_external(_pages(spark, sf))


@query("""SELECT issue_type, severity, affected_urls_count, crawl_run_id, affected_url FROM v_issues ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, affected_urls_count DESC, crawl_run_id, affected_url, issue_type LIMIT 20""")
def issues_first(spark, sf):
    i = view(spark, sf, "v_issues").select("issue_type", "severity", "affected_urls_count", "crawl_run_id", "affected_url")
    return i.orderBy(rules.severity_order(F.col("severity")), F.desc("affected_urls_count"), "crawl_run_id", "affected_url", "issue_type").limit(20)


_COS = "list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings) SELECT b.vec_id, round({_COS}, 4) AS similarity FROM v a, v b WHERE a.vec_id = 0 ORDER BY similarity DESC, b.vec_id LIMIT 20""")
def semantic_ranking(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    got = rankings.semantic_sections(e.select("vec_id", F.col("vec_id").alias("index"), "embedding"), list(first[0]), 20)
    return got.select("vec_id", "similarity")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (vec_id * 7919 % 1000) / 1000 AS r FROM embeddings), c AS (SELECT * FROM v WHERE r > 0.2 ORDER BY r DESC, vec_id LIMIT 300)
SELECT b.vec_id AS id, round({_COS} * b.r, 6) AS score FROM v a, c b WHERE a.vec_id = 0 ORDER BY {_COS} * b.r DESC, b.vec_id LIMIT 5""")
def memory_recall(spark, sf):
    e = table(spark, sf, "embeddings")
    m = e.select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") * 7919 % 1000 / 1000).alias("reward_score"))
    return rankings.recall_memory(m, list(e.where("vec_id = 0").first()["embedding"]), 5, 0.2).select("id", F.round("score", 6).alias("score"))


# runs


@query("SELECT site_id, max_by(id, {'a': completed_at, 'b': id}) AS id, max(completed_at) AS completed_at FROM v_runs WHERE status = 'completed' GROUP BY 1")
def latest_runs(spark, sf):
    return agg.latest_run(view(spark, sf, "v_runs"))


@query("SELECT site_id, id, lag(id) OVER (PARTITION BY site_id ORDER BY completed_at, id) AS previous_id FROM v_runs WHERE status = 'completed'")
def previous_runs(spark, sf):
    return agg.with_previous(view(spark, sf, "v_runs")).select("site_id", "id", "previous_id")


@query("SELECT site_id, id, completed_at, pages, pages - lag(pages) OVER (PARTITION BY site_id ORDER BY completed_at, id) AS delta FROM v_runs WHERE status = 'completed' AND completed_at >= TIMESTAMP '1998-08-01' - INTERVAL 180 DAYS")
def run_trends(spark, sf):
    return agg.trends(view(spark, sf, "v_runs"), F.lit("1998-08-01").cast("timestamp"))


@query("""SELECT count(DISTINCT c_custkey)::BIGINT AS sites, (SELECT count_if(status IN ('pending', 'running')) FROM v_runs WHERE tenant = 1)::BIGINT AS active_runs,
  (SELECT coalesce(sum(CASE WHEN created_at >= TIMESTAMP '1998-07-01' THEN pages END), 0) FROM v_runs WHERE tenant = 1)::BIGINT AS month_pages FROM customer WHERE c_custkey % 3 = 1""")
def tenant_quota(spark, sf):
    sites = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 3).cast("string").alias("tenant_id"))
    return agg.quota(sites, view(spark, sf, "v_runs"), "1", F.lit("1998-07-15").cast("timestamp")).select("sites", "active_runs", "month_pages")


@query("SELECT issue_type, severity, crawl_run_id, affected_url, affected_urls_count, issue_type NOT IN ('type_1', 'type_2') AS is_new, issue_type IN ('type_1', 'type_2') AS is_regression FROM v_issues")
def new_issues(spark, sf):
    before = spark.createDataFrame([("type_1",), ("type_2",)], "issue_type string")
    return joins.flag_new(view(spark, sf, "v_issues"), before)


# answers

_FLAGS = """SELECT pos, persona, service, prompt_type, query, answer_text, b.brand, len(list_filter(b.tokens, lambda t: contains(lower(coalesce(answer_text, '')), t))) > 0 AS mentioned FROM v_answers,
  (VALUES ('The Of AB', ['the of ab', 'the of']), ('and', ['and']), ('der', ['der']), ('que la', ['que la'])) AS b(brand, tokens)"""


def _flags(spark, sf):
    brands = spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    return joins.mentions(view(spark, sf, "v_answers"), brands)


@query(f"SELECT pos, brand, mentioned FROM ({_FLAGS})")
def brand_mentions(spark, sf):
    return _flags(spark, sf).select("pos", "brand", "mentioned")


@query(f"""SELECT brand, CASE WHEN brand = 'and' THEN 'client' ELSE 'competitor' END AS type, round_even(k / n, 3) AS mention_rate, round_even(k / greatest(sum(k) OVER (), 1), 3) AS sov_mentions, k::BIGINT AS prompts_with_mentions
  FROM (SELECT brand, count_if(mentioned) AS k, count(*) AS n FROM ({_FLAGS}) GROUP BY 1)""")
def brand_rates(spark, sf):
    return agg.brand_rates(_flags(spark, sf), "and")


@query(f"""WITH f AS (SELECT * FROM ({_FLAGS}) WHERE brand = 'and') SELECT 'persona' AS kind, persona AS value, round_even(avg(mentioned::INT), 3) AS mention_rate, count(*)::BIGINT AS prompts FROM f GROUP BY 2
  UNION ALL SELECT 'service', service, round_even(avg(mentioned::INT), 3), count(*) FROM f WHERE service <> '' GROUP BY 2""")
def brand_rates_by_group(spark, sf):
    return agg.rates_by(_flags(spark, sf), "and")


@query(f"SELECT persona, brand, round_even(avg(mentioned::INT) * 100, 1) AS rate FROM ({_FLAGS}) GROUP BY 1, 2")
def platform_rates(spark, sf):
    return agg.platform_rates(_flags(spark, sf), "persona", "brand")


@query(f"SELECT query, count(*)::BIGINT AS mentions FROM ({_FLAGS}) WHERE mentioned GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_queries(spark, sf):
    return agg.top_queries(_flags(spark, sf))


@query("SELECT round_even(sum(length(answer_text)) / count(*), 0)::BIGINT AS avg_response_length FROM v_answers")
def answer_length(spark, sf):
    return agg.average_length(view(spark, sf, "v_answers"))


@query("""WITH a AS (SELECT persona, length(answer_text) AS n FROM v_answers), e AS (SELECT min(n) AS lo, max(n) AS hi FROM a) SELECT persona, least(floor((n - lo) * 40 / (hi - lo)), 39)::INTEGER AS bin, count(*)::BIGINT AS n FROM a, e GROUP BY 1, 2""")
def length_histogram(spark, sf):
    return agg.histogram(view(spark, sf, "v_answers").withColumn("size", F.length("answer_text")), "size", 40, ["persona"])


@query(f"""WITH f AS (SELECT * FROM ({_FLAGS}) WHERE brand = 'and') SELECT pos, CASE WHEN length(answer_text) > 300 THEN left(answer_text, 300) || '…' ELSE answer_text END AS answer, mentioned
  FROM f QUALIFY row_number() OVER (PARTITION BY mentioned ORDER BY pos) <= CASE WHEN mentioned THEN 3 ELSE 2 END""")
def sample_answers(spark, sf):
    return agg.sample_answers(_flags(spark, sf), "and")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, (i / 100 + 1)::INTEGER AS chunk, array_to_string(w[i + 1 : i + 100], ' ') AS text FROM w, unnest(range(0, len(w), 100)) AS x(i)""")
def text_chunks(spark, sf):
    return agg.word_chunks(table(spark, sf, "documents"), "doc_id", "text")


# graph


@query("""WITH RECURSIVE n AS (SELECT rtrim(url, '/') AS node, min(pos) AS pos FROM v_pages GROUP BY 1), e AS (SELECT DISTINCT rtrim(source_url, '/') AS s, rtrim(dest_url, '/') AS d FROM v_links WHERE is_internal),
d AS (SELECT node, 0 AS depth FROM n WHERE pos = 0 UNION SELECT e.d, d.depth + 1 FROM d JOIN e ON e.s = d.node WHERE d.depth < 40)
SELECT node, coalesce(min(depth), -1)::INTEGER AS depth FROM n LEFT JOIN d USING (node) GROUP BY node""")
def click_depths(spark, sf):
    nodes, edges = graph.build(_pages(spark, sf), _links(spark, sf))
    start = _pages(spark, sf).where("pos = 0").select(urls.strip_slashes(F.col("url")).alias("node"))
    return graph.with_unreached(nodes, graph.click_depths(nodes, edges, start))


# vitals, events, online state


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value * 100 <= 2500 THEN 'good' WHEN value * 100 <= 4000 THEN 'needs-improvement' ELSE 'poor' END AS lcp, CASE WHEN value >= 0.45 THEN 'High' WHEN value >= 0.25 THEN 'Medium' ELSE 'Low' END AS label,
  (CASE WHEN value <= 0 THEN 1 ELSE least(10, floor(value / 10) + 1) END)::INTEGER AS bonus FROM events""")
def grades(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", scalars.vital_grade("lcp", v * 100).alias("lcp"), scalars.similarity_label(v).alias("label"), scalars.authority_bonus(v).alias("bonus"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, count(*)::BIGINT AS n FROM events GROUP BY 1")
def event_sessions(spark, sf):
    return agg.event_reports(table(spark, sf, "events"))["sessions"]


@query("""WITH a AS (SELECT user_id % 5 AS host, epoch_us(ts)::BIGINT AS us, event_id AS id FROM events), b AS (SELECT *, (row_number() OVER (PARTITION BY host ORDER BY us, id) - 1) * 500000 AS k FROM a)
SELECT host, us, id, (max(us - k) OVER (PARTITION BY host ORDER BY us, id ROWS UNBOUNDED PRECEDING) + k)::BIGINT AS start_us FROM b""")
def host_schedule(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"))
    return limits.host_schedule(e)


@query("""SELECT c_custkey::VARCHAR AS url, c_name, o.n AS gsc_clicks FROM customer LEFT JOIN (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def merged_metrics(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("url"), "c_name")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("url")).agg(F.count("*").alias("gsc_clicks"))
    return joins.merge(c, o, ["gsc_clicks"])


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_name END AS updated FROM customer")
def upserted(spark, sf):
    from webloom.sources.tables import upsert

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("updated"))
    return upsert(c, c.where("id % 4 = 0").select("id", F.lit("changed").alias("updated")), "id")


# smaller operators, each on the substrate that fits


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS cosine,
  round(list_inner_product(a.e, b.e), 6) AS dot FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_scores(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return e.join(b, "vec_id").select("vec_id", F.round(scalars.cosine(x, y), 6).alias("cosine"), F.round(scalars.dot(x, y), 6).alias("dot"))


@query("SELECT depth, list_sort(list(url)) AS urls FROM v_pages WHERE depth BETWEEN 0 AND 5 GROUP BY 1")
def pages_by_depth(spark, sf):
    return agg.pages_by_depth(_pages(spark, sf), 5)


@query("SELECT depth, count(*)::BIGINT AS n FROM v_pages GROUP BY 1")
def depth_distribution(spark, sf):
    return agg.depth_distribution(_pages(spark, sf))


@query("SELECT id, status, pages FROM v_runs WHERE tenant = 1")
def tenant_runs(spark, sf):
    sites = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 3).cast("string").alias("tenant_id"))
    return joins.runs_of_tenant(view(spark, sf, "v_runs"), sites, "1").select("id", "status", "pages")


@query("SELECT DISTINCT url AS url_normalized FROM pages WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def unseen_frontier(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("url_normalized"))
    return joins.unseen(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0")).select("url_normalized")


@query("""SELECT page_id, CASE WHEN starts_with(p, '/en/2') THEN true WHEN starts_with(p, '/en/') OR starts_with(p, '/fr/') THEN false ELSE true END AS allowed
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def robots_decisions(spark, sf):
    u = F.col("url")
    asked = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("url"), F.lit("h").alias("host"), urls.path(u).alias("path"))
    listed = spark.createDataFrame([("h", False, "/en/"), ("h", True, "/en/2"), ("h", False, "/fr/")], "host string, allow boolean, prefix string")
    return joins.longest_robots_rule(asked, listed).select(F.col("url").cast("long").alias("page_id"), "allowed")


@query("SELECT url, status_code FROM v_pages WHERE contains(lower(url), 'blog') AND floor(status_code / 100) = 2")
def page_search(spark, sf):
    return rankings.search_pages(_pages(spark, sf), "Blog", 2).select("url", "status_code")


@query("SELECT issue_type, severity, affected_url FROM v_issues WHERE severity = 'high' AND (contains(issue_type, 'e_1') OR contains(affected_url, 'e_1'))")
def issue_search(spark, sf):
    return rankings.search_issues(view(spark, sf, "v_issues"), "E_1", "high").select("issue_type", "severity", "affected_url")


@query(r"""SELECT c_custkey, list_sort(list_distinct(list_filter([lower(n), lower(b), CASE WHEN len(w) >= 2 THEN lower(w[1] || ' ' || w[2]) END], lambda t: t IS NOT NULL))) AS tokens FROM
  (SELECT *, string_split(b, ' ') AS w FROM (SELECT c_custkey, n, trim(regexp_replace(n, '(?i)\s+(ab|hb|kb|as|inc|ltd|gmbh|llc|bv|oy)\.?$', '')) AS b FROM
  (SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN ' AB' WHEN 1 THEN ' Group Ltd.' ELSE '' END AS n FROM customer)))""")
def brand_spellings(spark, sf):
    k = F.col("c_custkey") % 3
    n = F.concat("c_name", F.when(k == 0, " AB").when(k == 1, " Group Ltd.").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", F.array_sort(scalars.brand_tokens(n)).alias("tokens"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(trim(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::INTEGER AS words FROM documents")
def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.word_count(F.col("text")).alias("words"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, sf):
    e = table(spark, sf, "events")
    return limits.windowed(e, size="1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS cut FROM events),
g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, s""")
def user_sessions(spark, sf):
    return limits.sessions(table(spark, sf, "events"))


@query("""SELECT count(*)::BIGINT AS backlinks, sum(CASE WHEN value <= 0 THEN 1 ELSE least(10, floor(value / 10) + 1) END)::BIGINT AS bonus FROM events""")
def bonus_total(spark, sf):
    return agg.bonus_total(table(spark, sf, "events").select(F.col("value").alias("domain_rating")))


@query("SELECT user_id::VARCHAR AS url, count(*)::BIGINT AS ref_domains, count_if(value >= 10)::BIGINT AS ref_domains_dr10 FROM events GROUP BY 1")
def referring_domains(spark, sf):
    return agg.referring_domains(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("url"), F.col("value").alias("domain_rating")))


@query("""SELECT coalesce(a.url, b.url) AS url, a.before, b.after, coalesce(b.after, 0) - coalesce(a.before, 0) AS delta, CASE WHEN a.before > 0 THEN (coalesce(b.after, 0) - coalesce(a.before, 0)) / a.before * 100 END AS delta_pct
  FROM (SELECT s_suppkey AS url, s_acctbal AS before FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS url, s_acctbal * 2 AS after FROM supplier WHERE s_suppkey % 4 <> 0) b ON a.url = b.url""")
def score_changes(spark, sf):
    s = table(spark, sf, "supplier")
    return joins.score_delta(s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("url"), F.col("s_acctbal").alias("score")), s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("url"), (F.col("s_acctbal") * 2).alias("score")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 4 = 0 THEN d >= 28 WHEN c_custkey % 4 = 1 THEN d >= 7 WHEN c_custkey % 4 = 2 THEN d >= 1 ELSE d >= 30 END AS due FROM (SELECT *, c_custkey % 40 AS d FROM customer)""")
def due_crawls(spark, sf):
    k = F.col("c_custkey")
    cron = F.when(k % 4 == 0, "0 0 1 * *").when(k % 4 == 1, "0 0 * * 1").when(k % 4 == 2, "0 0 * * *").otherwise("weekly")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    last = F.when(k % 5 != 0, now - F.make_dt_interval((k % 40).cast("int")))
    return table(spark, sf, "customer").select(k.alias("id"), scalars.crawl_due(cron, last, now).alias("due"))


@query("SELECT platform, count(*)::BIGINT AS n FROM (SELECT 'a' AS platform FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b' FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1")
def platform_union(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    both = joins.platforms({"a": o.where("o_orderkey % 2 = 0"), "b": o.where("o_orderkey % 5 = 0").withColumn("extra", F.lit(1))})
    return both.groupBy("platform").agg(F.count("*").alias("n"))


@query("SELECT user_id AS job_id, CASE WHEN min(CASE WHEN event_type = 'purchase' THEN ts END) IS NOT NULL THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY 1")
def job_states(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"))
    return limits.job_status(e).select("job_id", "status")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_audit.title_issues(spark, sf_dir)


for _more in (queries_audit, queries_cases, queries_deep, queries_more):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL
