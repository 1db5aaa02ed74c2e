"""Reports of several tables: sheets, the analysis context, the visibility bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import has_special_characters, is_deep, is_mixed_case
from webloom.operators import aggregates as agg
from webloom.operators import graph, joins, rankings
from webloom.operators.rules import severity_order

PAGE_SHEET = "url final_url status_code title title_length meta_description meta_description_length h1_text h1_count word_count is_indexable indexability_reason canonical_url depth ttfb_ms response_bytes internal_links_count external_links_count img_count was_rendered".split()


def _yes(c: str) -> Column:
    return F.when(F.col(c), "Yes").otherwise("No")


def summary_sheet(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(name, value): severities, then the pages by indexability."""
    ok = F.coalesce("is_indexable", F.lit(True))
    some = agg.filtered_counts(pages, pages=F.lit(True), indexable=ok, noindex=F.coalesce("is_noindex", F.lit(False)), robots_blocked=~F.coalesce("robots_txt_allowed", F.lit(True)), errors=F.coalesce("status_code", F.lit(0)) >= 400)
    long = some.unpivot([], some.columns, "name", "value")
    return agg.severity_counts(issues).select(F.col("severity").alias("name"), F.col("n").alias("value")).unionByName(long)


def issues_sheet(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_order(F.col("severity")), "issue_type")


def pages_sheet(pages: DataFrame) -> DataFrame:
    how = {"is_indexable": _yes("is_indexable"), "was_rendered": _yes("was_rendered"), "ttfb_ms": F.bround("ttfb_ms", 1)}
    return pages.select(*[how[c].alias(c) if c in how else c for c in PAGE_SHEET if c in pages.columns])


def redirects_sheet(pages: DataFrame) -> DataFrame:
    chain = F.array_join(F.transform("redirect_chain", lambda h: F.concat(h["url"], F.lit(" ("), h["status_code"].cast("string"), F.lit(")"))), " → ")
    return pages.where(F.size("redirect_chain") > 0).select("url", "final_url", F.size("redirect_chain").alias("hops"), chain.alias("chain"))


def indexability_sheet(pages: DataFrame) -> DataFrame:
    return pages.select("url", "status_code", _yes("is_indexable").alias("is_indexable"), "indexability_reason", "meta_robots", _yes("robots_txt_allowed").alias("robots_txt_allowed"), "canonical_url")


def link_graph_sheet(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links to a page by its url plus those by its normal form: where both are the same they count twice, as the sheet always did."""
    into = links.where("is_internal").groupBy(F.coalesce(F.nullif("dest_url_normalized", F.lit("")), "dest_url").alias("_k")).agg(F.count("*").alias("_n"))
    one = lambda c, n: into.withColumnsRenamed({"_k": f"_{c}", "_n": n})
    met = pages.join(one("url", "a"), F.col("url") == F.col("_url"), "left").join(one("norm", "b"), F.col("url_normalized") == F.col("_norm"), "left")
    n = (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).cast("long")
    return met.select("url", "depth", n.alias("inlinks")).orderBy(F.desc("inlinks"), "url")


def js_sheet(pages: DataFrame) -> DataFrame:
    return pages.where("was_rendered").select("url", "raw_vs_rendered_diff.*")


def workbook(pages: DataFrame, links: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": summary_sheet(pages, issues),
        "issues": issues_sheet(issues),
        "pages": pages_sheet(pages),
        "redirects": redirects_sheet(pages),
        "indexability": indexability_sheet(pages),
        "link_graph": link_graph_sheet(pages, links),
        "js_parity": js_sheet(pages),
    }


def run_report(runs: DataFrame, issues: DataFrame, now: Column) -> dict[str, DataFrame]:
    last = agg.latest_run(runs).select(F.col("id").alias("crawl_run_id"))
    own = issues.join(last, "crawl_run_id", "left_semi")
    return {"severities": agg.severity_counts(own), "top": rankings.issues_page(own), "trends": agg.trends(runs, now)}


def analysis_context(pages: DataFrame, ipr: DataFrame, psi: DataFrame) -> dict[str, DataFrame]:
    return {
        "top_ranked": rankings.top_ranked(ipr),
        "orphans": rankings.ranked_orphans(ipr),
        "sinks": rankings.link_sinks(ipr),
        "thin": rankings.thin_pages(pages),
        "problems": rankings.problem_pages(pages),
        "external": rankings.most_external(pages),
        "low_ctr": rankings.low_ctr(pages),
        "low_position": rankings.low_position(pages),
        "slowest": rankings.slowest(psi),
        "vitals": agg.vitals(psi),
    }


def visibility(answers: DataFrame, brands: DataFrame, client: str) -> dict[str, DataFrame]:
    flags = graph.keep(joins.mentions(answers, brands))
    rates, groups = agg.brand_rates(flags, client), agg.rates_by(flags, client)
    return {"brands": rates, "groups": groups, "gaps": agg.visibility_gaps(rates, groups), "samples": agg.sample_answers(flags, client), "length": agg.average_length(answers)}


def url_hygiene(urls: DataFrame, sitemap: DataFrame) -> dict[str, DataFrame]:
    u = F.col("url")
    gap = joins.sitemap_gap(urls, sitemap)
    return {"mixed_case": urls.where(is_mixed_case(u)), "deep": urls.where(is_deep(u)), "special": urls.where(has_special_characters(u)), "faceted": agg.faceted(urls)} | {f"sitemap_{k}": v for k, v in gap.items()}


def graph_bundle(pages: DataFrame, links: DataFrame, starts: DataFrame) -> dict[str, DataFrame]:
    nodes, edges = graph.build(pages, links)
    depths = graph.with_unreached(nodes, graph.click_depths(nodes, edges, starts))
    return {"depths": depths, "distribution": agg.depth_distribution(depths), "orphans": graph.orphan_pages(pages, edges), "counts": agg.link_counts(pages, links), "anchors": agg.anchors(links)}


def link_plan_report(nodes: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    return graph.link_plan(edges, graph.edit_edges(edges, added, removed))
