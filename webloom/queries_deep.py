"""Queries of domains, ranks, mentions, structured data, search and sources, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html
from webloom.operators import domains, graph, mentions, search, structured
from webloom.plans import progress
from webloom.queries_audit import audit_pages
from webloom.sources.fixtures import table, view, with_views
from webloom.sources.shared import fresh_dir, keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql.strip())
        return f

    return add


# registrable domains of the pages' hosts

SUFFIXES = ("com", "net", "example.com", "*.example.net", "!tiontion.example.net", "tionsh.example.com", "// a comment", "*.theron.example.net")
_HOSTS = """h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.') AS l FROM pages),
rules(s, kind) AS (VALUES ('com', 'p'), ('net', 'p'), ('example.com', 'p'), ('example.net', 'w'), ('tiontion.example.net', 'x'), ('tionsh.example.com', 'p'), ('theron.example.net', 'w')),
m AS (SELECT page_id, k, kind, len(l) AS labels FROM h, unnest(range(1, len(l) + 1)) AS x(k) JOIN rules ON s = array_to_string(l[len(l) - k + 1 :], '.')),
n AS (SELECT page_id, coalesce(max(CASE WHEN kind = 'x' THEN k - 1 END), max(CASE WHEN kind = 'p' THEN k WHEN kind = 'w' AND k < labels THEN k + 1 END)) AS n FROM m GROUP BY page_id),
named AS (SELECT page_id, host, CASE WHEN n < len(l) THEN array_to_string(l[len(l) - n :], '.') ELSE '' END AS registrable,
  CASE WHEN n < len(l) THEN array_to_string(l[: len(l) - n - 1], '.') WHEN n IS NULL THEN array_to_string(l[: len(l) - 1], '.') ELSE '' END AS subdomain FROM h LEFT JOIN n USING (page_id))"""


def _rules(spark):
    return domains.rule_table(spark.createDataFrame([(x,) for x in SUFFIXES], "rule string"))


@query(f"WITH {_HOSTS} SELECT * FROM named")
def registrable_domains(spark, sf):
    p = table(spark, sf, "pages").select("page_id", domains.host_of(F.col("url")).alias("host"))
    return domains.with_registrable(p, "host", _rules(spark))


@query(f"WITH {_HOSTS} SELECT registrable, count(*)::BIGINT AS pages, count(DISTINCT host)::BIGINT AS hosts FROM named WHERE registrable <> '' GROUP BY 1")
def pages_by_registrable(spark, sf):
    """The same by shuffles, as for rule tables beyond the bound of broadcasts."""
    p = table(spark, sf, "pages").select("page_id", domains.host_of(F.col("url")).alias("host"))
    got = domains.with_registrable(p, "host", _rules(spark), most=0).where("registrable <> ''")
    return got.groupBy("registrable").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


@query(f"""WITH {_HOSTS} SELECT page_id, registrable = 'theron.example.net' AND subdomain IN ('', 'm') AS internal, registrable = 'tionble.example.com' AND subdomain IN ('', 'www', 'blog') AS listed,
  registrable = 'ththan.example.com' AS whole FROM named""")
def internal_pages(spark, sf):
    p, rules = table(spark, sf, "pages").select("page_id", "url"), domains.rule_table(spark.createDataFrame([(x,) for x in SUFFIXES if "theron" not in x], "rule string"))
    got = domains.with_internal(p, "url", "m.www.theron.example.net", _rules(spark), name="internal")
    got = domains.with_internal(got, "url", "www.tionble.example.com", _rules(spark), allowlist=["Blog"], name="listed")
    return domains.with_internal(got, "url", "ththan.example.com", rules, True, name="whole").drop("url")


# mentions of many brands

_WORDS = "SELECT DISTINCT w AS brand FROM (SELECT split_part(text, ' ', 3) AS w FROM documents UNION ALL SELECT split_part(text, ' ', 5) FROM documents) WHERE regexp_matches(w, '^[^ \\t\\n\\r]+$')"


def _brands(spark, sf):
    """Words of all documents: as many brands as there are."""
    d = table(spark, sf, "documents")
    return d.select(F.explode(F.array(F.split_part("text", F.lit(" "), F.lit(3)), F.split_part("text", F.lit(" "), F.lit(5)))).alias("brand")).where(r"brand rlike '^[^ \t\n\r]+$'").distinct()


@query(f"SELECT pos, brand FROM v_answers JOIN ({_WORDS}) ON contains(lower(answer_text), lower(brand))")
def found_mentions(spark, sf):
    return mentions.found(view(spark, sf, "v_answers").select("pos", "answer_text"), _brands(spark, sf)).select("pos", "brand")


@query(f"SELECT brand, count(*)::BIGINT AS answers FROM v_answers JOIN ({_WORDS}) ON contains(lower(answer_text), lower(brand)) GROUP BY 1")
def mention_counts(spark, sf):
    return mentions.counts(view(spark, sf, "v_answers"), _brands(spark, sf))


# substring search by trigrams

_NEEDLES = ("thesh", "é e", "ón", "IDIOT", "the and attion to", "no such text")
_FOUND = " UNION ALL ".join(f"SELECT '{n}' AS needle, doc_id FROM documents WHERE contains(lower(text), lower('{n}'))" for n in _NEEDLES)


@query(_FOUND)
def trigram_search(spark, sf):
    index = search.Trigrams(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    out = None
    for n in _NEEDLES:
        got = index.search(n).select(F.lit(n).alias("needle"), "doc_id")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT needle, c_custkey AS id FROM customer JOIN (VALUES ('00001'), ('r#000000012'), ('zz')) AS v(needle) ON contains(lower(c_name), needle)")
def customer_names_by_trigrams(spark, sf):
    index = search.Trigrams(table(spark, sf, "customer"), "c_custkey", "c_name", folders=16)
    parts = [index.search(n).select(F.lit(n).alias("needle"), F.col("c_custkey").alias("id")) for n in ("00001", "R#000000012", "zz")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("needle", F.lower("needle"))


# redirects of any length

_HOPS = "SELECT p_partkey AS url, CASE WHEN p_partkey % 300 = 299 THEN p_partkey - 7 WHEN p_partkey % 211 > 0 THEN p_partkey + 1 END AS location FROM part"


@query(f"""WITH RECURSIVE h AS MATERIALIZED (SELECT * FROM ({_HOPS}) WHERE location IS NOT NULL), w AS (SELECT url, location AS z, 1 AS hops FROM h UNION ALL SELECT w.url, h.location, hops + 1 FROM w JOIN h ON w.z = h.url WHERE hops < 600),
e AS (SELECT url, z, hops FROM w WHERE z NOT IN (SELECT url FROM h)) SELECT h.url, z AS final_url, hops::BIGINT AS hops, z IS NULL AS looped FROM h LEFT JOIN e USING (url)""")
def resolved_redirects(spark, sf):
    k = F.col("p_partkey")
    hops = table(spark, sf, "part").select(k.alias("url"), F.when(k % 300 == 299, k - 7).when(k % 211 > 0, k + 1).alias("location"))
    return graph.resolved_redirects(hops)


# extraction over the table's own pages


_PLAIN = "trim(replace(replace(replace(replace(regexp_extract(html, '{}', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'))"


@query("SELECT page_id, " + _PLAIN.format("<title>([^<]*)") + " AS title, " + _PLAIN.format("<h1>([^<]*)") + r""" AS h1_text, len(regexp_extract_all(html, '<h1[ >]'))::INTEGER AS h1_count, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang,
  regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset_declared, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs, len(regexp_extract_all(html, '<img '))::INTEGER AS img_count FROM pages""")
def html_page_facts(spark, sf):
    got = html.extract_pages(table(spark, sf, "pages"))
    return got.select("page_id", "title", "h1_text", "h1_count", "html_lang", "charset_declared", F.transform("links", lambda x: x["href"]).alias("hrefs"), "img_count")


@query(r"""SELECT page_id, place::INTEGER AS place, t[1] AS href, t[2] AS anchor_text FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2))) AS t,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">')))) AS place FROM pages)""")
def html_links_by_sql(spark, sf):
    html.register_html_parts(spark)
    return spark.sql("SELECT page_id, place, href, anchor_text FROM html_parts(TABLE(SELECT page_id, url, html FROM {pages}), 'links')", pages=table(spark, sf, "pages"))


# structured data as variants


def _parsed(spark, sf):
    return structured.blocks(audit_pages(spark, sf).select(F.col("pos").alias("page"), "structured_data"), "page")


_BLOCKS = """s AS (SELECT v_audit.pos AS page, list_filter([sd1, sd2], lambda x: x IS NOT NULL) AS l FROM v_audit), raw AS (SELECT page, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM s),
o AS (SELECT page, pos::INTEGER AS pos, t::JSON AS b FROM raw WHERE json_type(t) = 'OBJECT')"""


@query(f"""WITH {_BLOCKS}, k AS (SELECT *, CASE json_type(b, '$."@type"') WHEN 'ARRAY' THEN b->>'$."@type"[0]' ELSE b->>'$."@type"' END AS kind FROM o WHERE coalesce(b->>'$._error', '') = ''),
needs(kind, fields) AS (VALUES ('Product', ['name', 'image', 'offers']), ('Article', ['headline', 'author', 'datePublished']), ('Organization', ['name', 'url']))
SELECT page, pos, kind, list_filter(fields, lambda f: NOT list_contains(json_keys(b), f)) AS missing FROM k JOIN needs USING (kind) WHERE len(list_filter(fields, lambda f: NOT list_contains(json_keys(b), f))) > 0""")
def variant_missing_fields(spark, sf):
    return structured.missing_fields(_parsed(spark, sf), "page")


@query(f"""WITH {_BLOCKS} SELECT page, pos, 'invalid' AS what FROM o WHERE coalesce(b->>'$._error', '') <> '' UNION ALL
SELECT page, pos, 'kind ' || x FROM o, unnest(CASE json_type(b, '$."@type"') WHEN 'ARRAY' THEN (b->'$."@type"')::VARCHAR[] WHEN 'VARCHAR' THEN [b->>'$."@type"'] END) AS v(x)""")
def variant_kinds(spark, sf):
    parsed = keep(_parsed(spark, sf))
    kinds = structured.nodes(parsed, "page").select("page", "pos", F.concat(F.lit("kind "), "kind").alias("what"))
    return structured.invalid(parsed, "page").withColumn("what", F.lit("invalid")).unionByName(kinds)


# what is observed of writes


@query("SELECT 'pages' AS what, count(*)::BIGINT AS n FROM v_pages UNION ALL SELECT 'errors', count(*) FROM v_pages WHERE status_code >= 400 UNION ALL SELECT 'words', sum(word_count) FROM v_pages UNION ALL SELECT 'stream', count(*) FROM v_pages UNION ALL SELECT 'stream_errors', count(*) FROM v_pages WHERE status_code >= 400")
def observed_writes(spark, sf):
    """Counts that are taken while tables are written, in batch and as a stream, not by reading them again."""
    pages = view(spark, sf, "v_pages").select("url", "status_code", "word_count")
    counts = {"pages": F.count(F.lit(1)), "errors": F.count(F.when(F.col("status_code") >= 400, 1)), "words": F.sum("word_count")}
    source = fresh_dir(spark, "observed")
    got = progress.write_observed(pages, source, **counts)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = progress.stream_observed(stream, fresh_dir(spark, "observed"), stream=counts["pages"], stream_errors=counts["errors"])
    return spark.createDataFrame([*got.items(), *seen.items()], "what string, n long")  # a row for each count
