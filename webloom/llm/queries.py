"""One query for each operator over its whole table, and DuckDB SQL where that can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import align, bpe, decontam, licenses, linededup, negatives, quality, simhash, topk, toxicity, transcripts, urlrules, warc
from webloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    return toxicity.classify(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), places="removed")
    return got.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = transcripts.held_out(F.col("conv_id"))
    got = transcripts.format_chats(transcripts.transcripts(table(spark, sf_dir, "conversations")), train=~held)
    return got.withColumn("held_out", held)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_licenses, op3_urls, op4_topk, op5_linededup, op6_warc, op7_chats, op8_bpe, op9_decontam, op10_simhash, op11_negatives, op12_align, op13_quality]
    return {f.__name__: f for f in own}


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), {_AZ}), '{_WORD}')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _op2_sql() -> str:
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    rows = []
    for k, (_, label, family, text) in enumerate(licenses.TEMPLATES):
        w = [x.decode() for x in licenses.words(text)]
        n = len(set(w))
        rows.append(f"({k}, '{label}', '{family}', {n}, {math.ceil(licenses.THRESHOLD * n - 1e-9)}, {math.ceil(licenses.STRETCH * len(w) - 1e-9)}, {_list(sorted(set(w)))})")
    return f"""
WITH phrases(p, label) AS (VALUES {phrases}), templates(k, label, family, size, need, room, t) AS (VALUES {', '.join(rows)}), tw AS (SELECT k, room, need, unnest(t) AS word FROM templates),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
places AS (SELECT r, label, i FROM docs, phrases, unnest(range(0, len(w) - len(p) + 1)) AS x(i) WHERE w[i + 1 : i + len(p)] = p),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY r),
flat AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
every AS (SELECT r, k, room, need, i, word FROM flat JOIN tw USING (word)),
enough AS (SELECT r, k FROM every GROUP BY r, k, need HAVING count(DISTINCT word) >= need),
occ AS (SELECT r, k, room, need, i, lag(i) OVER (PARTITION BY r, k, word ORDER BY i) AS before FROM every JOIN enough USING (r, k)),
hits AS (SELECT e.r, e.k, greatest(0, e.i + 1 - e.room) AS lo, e.i + 1 AS hi, count(*) AS n FROM occ e JOIN occ j ON e.r = j.r AND e.k = j.k AND j.i <= e.i AND j.i > e.i - e.room AND (j.before IS NULL OR j.before <= e.i - e.room)
  GROUP BY e.r, e.k, e.i, e.room, e.need HAVING count(*) >= e.need),
found AS (SELECT r, label, family, lo, hi, n::DOUBLE / size AS share, size FROM hits JOIN templates USING (k)),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (FROM found g WHERE g.r = f.r AND g.family = f.family AND g.lo < f.hi AND f.lo < g.hi AND (g.share > f.share OR (g.share = f.share AND g.size > f.size)))),
method AS (SELECT r, list(DISTINCT label) AS labels FROM kept GROUP BY r), best AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',') AS labels,
  CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN method USING (r) LEFT JOIN best USING (r)"""


OP3_SQL = f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
numbered AS (SELECT row_number() OVER () AS r, * FROM parts),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (r)"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS a, c.vec_id AS b, q.label = c.label AS same, list_inner_product(q.e, c.e)::BIGINT AS s FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT a, b, s FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY o.s DESC, o.b)::INTEGER AS rank, o.b AS negative_id, p.s AS positive_score, o.s AS negative_score
  FROM p JOIN pairs o ON o.a = p.a AND NOT o.same AND 50 * p.s <= 100 * o.s AND 100 * o.s <= 95 * p.s)
SELECT * FROM n WHERE rank <= 3"""

OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to FROM o"""

def _op9_sql() -> str:
    # n words from each place on; too near the end the last of them is null and so is the whole
    lead = lambda k: f"lead(word, {k}) OVER o" if k else "word"
    cases = " ".join(f"WHEN {n} THEN " + " || ' ' || ".join(lead(k) for k in range(n)) for n in range(1, 11))
    return f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_words('text')} AS w FROM benchmark),
sizes AS (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM sizes, unnest(range(0, len(w) - n + 1)) AS x(i)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
flat AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
spans AS (SELECT r, n, i - 1 AS i, CASE n {cases} END AS s FROM flat, (SELECT DISTINCT n FROM win) AS k
  WINDOW o AS (PARTITION BY r, n ORDER BY i)),
hit AS (SELECT r, i, spans.n, item FROM spans JOIN win USING (n, s)),
words AS (SELECT r, count(DISTINCT i + d) AS n_hit FROM hit, unnest(range(0, n)) AS x(d) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


def _op13_sql() -> str:
    of = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    phrases = " OR ".join(f"contains(low, '{x}')" for x in quality.BOILERPLATE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
flat AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS s FROM flat WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, s FROM win WHERE s IS NOT NULL GROUP BY r, s HAVING count(*) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM win JOIN twice USING (r, s), unnest([0, 1, 2]) AS x(k) GROUP BY r),
every AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT r, line, regexp_extract_all(line, '{word}') AS w, translate(line, {_AZ}) AS low, right(regexp_replace(line, '{blank}+$', ''), 1) AS last,
  length(line) - length(regexp_replace(line, '{quality.SIGNS}', '', 'g')) AS signs FROM every WHERE regexp_matches(line, '{word}')),
told AS (SELECT r, line, CASE WHEN signs * 8 > length(line) OR last NOT IN ({of(quality.ENDS)}) AND len(w) >= {quality.LONG_LINE} THEN 'punctuation'
  WHEN len(list_filter(w, lambda x: x IN ({of(quality.SEPARATORS)}))) >= greatest(2, len(w) / 4.0) OR regexp_matches(low, '{quality.MENU}') AND len(w) <= {quality.MENU_WORDS} THEN 'navigation'
  WHEN {phrases} THEN 'boilerplate' END AS rule FROM l),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup, count(*) AS n, sum(length(line)) AS chars, sum(length(line)) FILTER (rule IS NOT NULL) AS lost,
  count(*) FILTER (rule = 'punctuation') AS p, count(*) FILTER (rule = 'navigation') AS v, count(*) FILTER (rule = 'boilerplate') AS b FROM told GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(chars, 0)::BIGINT AS n_line_chars, coalesce(lost, 0)::BIGINT AS n_lost_chars,
  coalesce(p, 0)::BIGINT AS n_punctuation, coalesce(v, 0)::BIGINT AS n_navigation, coalesce(b, 0)::BIGINT AS n_boilerplate FROM d LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r))
SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AND 100 * n_lost_chars <= {quality.MOST_LOST} * n_line_chars AS kept FROM m"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": _op2_sql(), "op3_urls": OP3_SQL, "op4_topk": OP4_SQL, "op6_warc": OP6_SQL, "op9_decontam": _op9_sql(), "op11_negatives": OP11_SQL, "op13_quality": _op13_sql()}
