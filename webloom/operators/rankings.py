"""Sorted lists: what a report shows first. Each is a top-k, so only k rows are gathered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.functions.scalars import blank, cosine, cosine_eps, issue_score
from webloom.operators.aggregates import first_n
from webloom.operators.rules import severity_order


def issues_page(issues: DataFrame, severity: str | None = None, issue_type: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """Optional filters, worst first, then by pages affected."""
    some = issues
    if severity:
        some = some.where(F.col("severity") == severity)
    if issue_type:
        some = some.where(F.col("issue_type") == issue_type)
    return some.orderBy(severity_order(F.col("severity")), F.desc("affected_urls_count"), "issue_type").offset(offset).limit(limit)


def search_issues(issues: DataFrame, text: str = "", severity: str = "") -> DataFrame:
    low = F.lit(text.lower())
    hit = F.contains(F.lower("issue_type"), low) | F.contains(F.lower(F.coalesce("affected_url", F.lit(""))), low)
    return issues.where(hit & (F.lit(severity == "") | (F.col("severity") == severity)))


def search_pages(pages: DataFrame, text: str = "", status_class: int | None = None) -> DataFrame:
    some = pages.where(F.contains(F.lower("url"), F.lit(text.lower())))
    return some if status_class is None else some.where(F.floor(F.col("status_code") / 100) == status_class)


def search_customers(customers: DataFrame, text: str = "", status: str = "", mode: str = "") -> DataFrame:
    low = F.lit(text.lower())
    hit = F.contains(F.lower("name"), low) | F.contains(F.lower("domain"), low)
    return customers.where(hit & (F.lit(status == "") | (F.col("status") == status)) & (F.lit(mode == "") | (F.col("service_mode") == mode)))


def optional(df: DataFrame, least_reward: float | None = None, **equal) -> DataFrame:
    """Equality where a value is given; rows without a reward pass the reward's bound."""
    for c, v in equal.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df if least_reward is None else df.where(F.col("reward_score").isNull() | (F.col("reward_score") >= least_reward))


def newest(df: DataFrame, time: str, tie: str, limit: int = 20, offset: int = 0, pinned: str | None = None) -> DataFrame:
    first = [F.desc(pinned)] if pinned else []
    return df.orderBy(*first, F.desc(time), tie).offset(offset).limit(limit)


def top(df: DataFrame, by: Column, tie: str, n: int, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).orderBy(by, tie).limit(n)


def top_ranked(ipr: DataFrame, n: int = 10) -> DataFrame:
    return top(ipr, F.desc("ipr"), "node", n)


def ranked_orphans(ipr: DataFrame, n: int = 8) -> DataFrame:
    return top(ipr, F.desc("ipr"), "node", n, F.col("ipr_inbound") == 0)


def link_sinks(ipr: DataFrame, n: int = 5) -> DataFrame:
    return top(ipr, F.desc("ipr_inbound"), "node", n, (F.col("ipr_outbound") == 0) & (F.col("ipr_inbound") > 1))


def thin_pages(pages: DataFrame, n: int = 8) -> DataFrame:
    return top(pages, F.asc("word_count"), "url", n, (F.col("word_count") < 200) & (F.col("status_code") == 200) & ~F.coalesce("is_noindex", F.lit(False))).select("url", "word_count")


def problem_pages(pages: DataFrame, n: int = 10) -> DataFrame:
    """The n pages of the highest score, those of score 0 then left out, with the reasons."""
    score = issue_score()
    said = [("no title", blank(F.col("title"))), ("no h1", blank(F.col("h1_text"))), ("no meta", blank(F.col("meta_description"))), ("broken links", F.col("broken_links") > 0), ("noindex", F.coalesce("is_noindex", F.lit(False)))]
    why = F.array_join(F.filter(F.array(*[F.when(t, w) for w, t in said]), lambda x: x.isNotNull()), ", ")
    return pages.select("url", score.alias("score"), why.alias("reasons")).orderBy(F.desc("score"), "url").limit(n).where("score > 0")


def most_external(pages: DataFrame, n: int = 5) -> DataFrame:
    return top(pages, F.desc("external_links_count"), "url", n, F.col("external_links_count") > 3).select("url", "external_links_count")


def low_ctr(pages: DataFrame, n: int = 8) -> DataFrame:
    rate = F.coalesce(F.nullif("gsc_ctr", F.lit(0.0)), F.lit(100.0))
    return top(pages, rate, "url", n, F.col("gsc_impressions") >= 50).select("url", "gsc_ctr", "gsc_impressions")


def low_position(pages: DataFrame, n: int = 8) -> DataFrame:
    return top(pages, F.desc("gsc_impressions"), "url", n, F.col("gsc_position") > 10).select("url", "gsc_position", "gsc_impressions")


def slowest(psi: DataFrame, n: int = 5) -> DataFrame:
    return top(psi, F.asc("psi_score"), "url", n, F.col("psi_score").isNotNull())


def best_by_domain(ipr: DataFrame) -> DataFrame:
    return ipr.groupBy("domain").agg(F.max_by("url", F.struct("ipr", "url")).alias("url"), F.max("ipr").alias("ipr"))


def organic_keywords(rows: DataFrame, n: int = 10) -> DataFrame:
    return first_n(rows.where(F.trim("keyword") != ""), ["url"], [F.desc("traffic"), "keyword"], n)


def semantic_sections(sections: DataFrame, query: list[float], n: int = 10) -> DataFrame:
    """The most similar sections, ties in order of the text."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return sections.withColumn("similarity", F.bround(cosine_eps(F.col("embedding"), q), 4)).orderBy(F.desc("similarity"), "index").limit(n)


def recall_memory(memory: DataFrame, query: list[float], k: int = 5, least_reward: float = 0.0, candidates: int = 300) -> DataFrame:
    """The best rewards first, of those the k best by similarity times reward."""
    q = F.array(*[F.lit(float(x)) for x in query])
    some = memory.where(F.col("reward_score") > least_reward).orderBy(F.desc("reward_score"), "id").limit(candidates)
    near = cosine(F.col("embedding"), q)
    return some.withColumns({"similarity": near, "score": near * F.col("reward_score")}).orderBy(F.desc("score"), "id").limit(k)


def movers(delta: DataFrame, least: float = 0.002, n: int = 20) -> DataFrame:
    return delta.where(F.abs("delta") > least).orderBy(F.desc(F.abs("delta")), "url").limit(n)


def pop(frontier: DataFrame, n: int) -> DataFrame:
    """The next addresses of a crawl: priority, then order of arrival."""
    return frontier.orderBy("priority", "seq").limit(n)


def images_to_describe(pages: DataFrame, per_page: int = 3, most: int = 30) -> DataFrame:
    """Images without alt text, in page order: a few of each page, a limited number in all."""
    each = pages.select("pos", "url", F.posexplode(F.filter("images", lambda i: ~i["has_alt"])).alias("at", "image")).where(F.col("at") < per_page)
    return each.orderBy("pos", "at").limit(most).select("url", "image.src")


def first_candidates(pages: DataFrame, n: int, where: Column | None = None) -> DataFrame:
    some = pages.where(F.coalesce("is_indexable", F.lit(True)) & (F.coalesce("status_code", F.lit(0)) == 200))
    return (some if where is None else some.where(where)).orderBy("pos").limit(n)


def prompt_context(pages: DataFrame) -> DataFrame:
    """Pages without title, without description, and ranked without links, up to 20, 20 and 15 of them."""
    parts = [("missing_title", blank(F.col("title")), 20), ("missing_meta", blank(F.col("meta_description")), 20), ("orphan", F.coalesce("inlinks", F.lit(0)) == 0, 15)]
    out = None
    for name, test, n in parts:
        got = first_candidates(pages, n, test).select(F.lit(name).alias("list"), "url")
        out = got if out is None else out.unionByName(got)
    return out


def agent_candidates(pages: DataFrame, n: int = 50) -> DataFrame:
    """Pages to improve: 200, indexed, with a missing tag or twenty impressions."""
    test = (F.col("status_code") == 200) & ~F.coalesce("is_noindex", F.lit(False)) & (blank(F.col("title")) | blank(F.col("meta_description")) | blank(F.col("h1_text")) | (F.coalesce("gsc_impressions", F.lit(0)) >= 20))
    return pages.where(test).orderBy("pos").limit(n).select("url")


def keyword_lookup(pages: DataFrame, keywords: DataFrame, n: int = 30) -> DataFrame:
    first = pages.orderBy("pos").limit(n).select("url")
    return first.join(keywords.groupBy("url").agg(F.sort_array(F.collect_list("keyword")).alias("keywords")), "url").where(F.size("keywords") > 0)


def crawl_request(requests: DataFrame) -> DataFrame:
    """Valid requests: web addresses, up to five competitors, at least ten pages."""
    web = lambda u: u.rlike("^https?://")
    return requests.where(web(F.col("client_url")) & (F.size("competitor_urls") <= 5) & F.forall("competitor_urls", web)).withColumn("max_pages", F.greatest("max_pages", F.lit(10)))


def union_by_url(frames: list[DataFrame], most: int = 15) -> DataFrame:
    """Rows of several lists, the last list winning for one url."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("_k", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_n(out, ["url"], [F.desc("_k")], 1).orderBy("url").limit(most).drop("_k")


def toggle(tools: Column, item: str) -> Column:
    """A list without the element if it has it, else with it at the end."""
    return F.when(F.array_contains(tools, item), F.array_remove(tools, item)).otherwise(F.array_append(tools, F.lit(item)))


@F.pandas_udf(StringType())
def _two_places(x: pd.Series) -> pd.Series:
    """Rounded from the binary value, which Java's formats round from its shortest decimal form."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.2f}")


def memory_block(memory: DataFrame) -> DataFrame:
    """One text of remembered actions, best first."""
    line = F.format_string("- %s on %s: %s (reward %s)", "action_type", "page_url", F.left("action_value", F.lit(120)), _two_places("reward_score"))
    return memory.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("reward_score"), "id", line.alias("t")))), lambda x: x["t"]), "\n").alias("block"))
