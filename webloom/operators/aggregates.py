"""Counts, rates and distributions of runs, links, answers and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.scalars import VITALS, authority_bonus, blank, is_indexed, json_list
from webloom.functions.urls import base_path, query, strip_slashes
from webloom.operators.rules import SEVERITIES


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def status(default: int = 0) -> Column:
    return F.coalesce("status_code", F.lit(default))


def basic_metrics(pages: DataFrame) -> DataFrame:
    """(metric_name, metric_value), one pass: eight counters, averages without nulls and zeros, the discrete 90th percentile of ttfb."""
    mean = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)))
    one = pages.agg(
        F.count("*").cast("double").alias("total_pages"),
        count_if(F.coalesce("is_indexable", F.lit(True))).cast("double").alias("indexable_pages"),
        count_if(status().between(200, 299)).cast("double").alias("status_2xx"),
        count_if(status().between(300, 399)).cast("double").alias("status_3xx"),
        count_if(status().between(400, 499)).cast("double").alias("status_4xx"),
        count_if(status() >= 500).cast("double").alias("status_5xx"),
        count_if(blank(F.col("title"))).cast("double").alias("missing_titles"),
        count_if(F.coalesce("h1_count", F.lit(0)) == 0).cast("double").alias("missing_h1"),
        mean("ttfb_ms").alias("avg_ttfb_ms"),
        mean("response_bytes").alias("avg_response_bytes"),
        mean("word_count").alias("avg_word_count"),
    )
    long = one.unpivot([], one.columns, "metric_name", "metric_value")
    return long.unionByName(discrete_quantile(pages, "ttfb_ms", 0.9).select(F.lit("p90_ttfb_ms").alias("metric_name"), F.col("value").cast("double").alias("metric_value"))).where("metric_value is not null")


def discrete_quantile(df: DataFrame, column: str, share: float, ranges: int = 1024) -> DataFrame:
    """The value at place floor(n * share) in order, zeros and nulls left out.

    Counts of values, and of ``ranges`` ranges of them: only the values of the range that holds the place are put in order, a few times narrowed down.
    """
    values = df.where(F.coalesce(F.col(column), F.lit(0)) != 0).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    place = None
    for _ in range(4):
        ends = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
        if not ends.k:
            break
        place = int(ends.n * share) if place is None else place
        if ends.k <= ranges or not 0 < ends.hi - ends.lo < float("inf"):
            break
        part = F.least(F.lit(ranges - 1), F.floor((F.col("value") - ends.lo) / (ends.hi - ends.lo) * ranges)).cast("int")
        before = 0
        for r in values.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each range
            if before + r.n > place:
                values, place = values.where(part == r.part), place - before
                break
            before += r.n
    upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("value")))  # the values of one range
    return upto.where(F.col("upto") > (place or 0)).agg(F.min("value").alias("value")).where("value is not null")


def severity_counts(issues: DataFrame) -> DataFrame:
    """All four severities, zero where there is none."""
    every = issues.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    got = issues.groupBy("severity").agg(F.count("*").alias("n"))
    return every.join(got, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def run_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_run_id").agg(F.count("*").alias("pages"), count_if(F.coalesce("is_indexable", F.lit(True))).alias("indexable"), count_if(F.col("was_rendered")).alias("rendered"))


def domain_summary(pages: DataFrame, strict: bool = True) -> DataFrame:
    """Counters of a crawl. strict: only text/html pages of known status; else an empty type counts and status 0 or null is skipped."""
    known = F.col("status_code").isNotNull() & (F.col("status_code") != 0 if not strict else F.lit(True))
    kind = F.contains("content_type", F.lit("text/html"))
    html = known & (status() == 200) & (kind if strict else (kind | blank(F.col("content_type"))))
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    one = pages.agg(
        F.count("*").alias("total"),
        count_if(known & status().between(200, 299)).alias("ok"),
        count_if(known & status().between(300, 399)).alias("redirects"),
        count_if(known & status().between(400, 499)).alias("client_errors"),
        count_if(known & (status() >= 500)).alias("server_errors"),
        count_if(html & (n("title") == 0)).alias("title_missing"),
        count_if(html & (n("title") > 60)).alias("title_long"),
        count_if(html & (n("title") > 0) & (n("title") < 30)).alias("title_short"),
        count_if(html & (n("meta_description") == 0)).alias("meta_missing"),
        count_if(html & (n("meta_description") > 160)).alias("meta_long"),
        count_if(html & (n("meta_description") > 0) & (n("meta_description") < 70)).alias("meta_short"),
        count_if(html & (F.coalesce("h1_count", F.lit(0)) == 0)).alias("h1_missing"),
        count_if(html & (F.coalesce("h1_count", F.lit(0)) > 1)).alias("h1_multiple"),
        count_if(html & (F.coalesce("word_count", F.lit(0)) < 200)).alias("thin"),
        count_if(html & F.col("is_noindex")).alias("noindex"),
        count_if(html & blank(F.col("canonical_url"))).alias("canonical_missing"),
        F.sum(F.when(html, F.coalesce("img_missing_alt", F.lit(0)))).alias("images_without_alt"),
    )
    twice = lambda c, name: pages.where(html & ~blank(F.col(c))).groupBy(c).count().where("count > 1").agg(F.count("*").alias(name))
    return one.crossJoin(twice("title", "duplicate_titles")).crossJoin(twice("meta_description", "duplicate_metas"))  # one row each


def brand_rates(flags: DataFrame, client: str) -> DataFrame:
    """Mention rate and share of voice of each brand."""
    by = flags.groupBy("brand").agg(count_if(F.col("mentioned")).alias("prompts_with_mentions"), F.count("*").alias("n"))
    everything = F.greatest(F.sum("prompts_with_mentions").over(Window.partitionBy()), F.lit(1))  # a row for each brand
    rate = lambda d: F.bround(F.col("prompts_with_mentions") / d, 3)
    kind = F.when(F.col("brand") == client, "client").otherwise("competitor")
    return by.select("brand", kind.alias("type"), rate(F.greatest("n", F.lit(1))).alias("mention_rate"), rate(everything).alias("sov_mentions"), "prompts_with_mentions")


def rates_by(flags: DataFrame, client: str) -> DataFrame:
    """Of the client, by persona and by service (blank ones left out), in one pass over grouping sets."""
    own = flags.where(F.col("brand") == client)
    got = own.groupingSets([["persona"], ["service"]], "persona", "service").agg(F.grouping("persona").alias("_g"), F.bround(F.avg(F.col("mentioned").cast("double")), 3).alias("mention_rate"), F.count("*").alias("prompts"))
    kind = F.when(F.col("_g") == 0, "persona").otherwise("service")
    return got.select(kind.alias("kind"), F.when(F.col("_g") == 0, F.col("persona")).otherwise(F.col("service")).alias("value"), "mention_rate", "prompts").where("kind = 'persona' or value <> ''")


def average_length(answers: DataFrame, text: str = "answer_text") -> DataFrame:
    return answers.agg(F.bround(F.sum(F.length(text)) / F.greatest(F.count("*"), F.lit(1)), 0).cast("long").alias("avg_response_length"))


def visibility_gaps(brands: DataFrame, groups: DataFrame, most: int = 5) -> DataFrame:
    """Personas and services below 0.3, then competitors over one and a half times the client's rate."""
    low = groups.where("mention_rate < 0.3").select(F.when(F.col("kind") == "persona", 0).otherwise(1).alias("ord"), F.col("value").alias("what"), "mention_rate")
    own = brands.where("type = 'client'").select(F.col("mention_rate").alias("own"))
    rival = brands.where("type = 'competitor'").join(F.broadcast(own.limit(1)), F.col("mention_rate") > F.col("own") * 1.5).select(F.lit(2).alias("ord"), F.col("brand").alias("what"), "mention_rate")
    return low.unionByName(rival).orderBy("ord", "what").limit(most)


def sample_answers(flags: DataFrame, client: str, yes: int = 3, no: int = 2) -> DataFrame:
    """The first answers with and without a mention, cut to 300 characters."""
    own = flags.where(F.col("brand") == client)
    first = own.where("mentioned").orderBy("pos").limit(yes).unionByName(own.where("not mentioned").orderBy("pos").limit(no))
    cut = F.when(F.length("answer_text") > 300, F.concat(F.left("answer_text", F.lit(300)), F.lit("…"))).otherwise(F.col("answer_text"))
    return first.select("pos", cut.alias("answer"), "mentioned")


def platform_rates(flags: DataFrame, *by: str) -> DataFrame:
    return flags.groupBy(*by).agg(F.bround(F.avg(F.col("mentioned").cast("double")) * 100, 1).alias("rate"))


def top_queries(flags: DataFrame, most: int = 20) -> DataFrame:
    return flags.where("mentioned").groupBy("query").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "query").limit(most)


def histogram(df: DataFrame, column: str, bins: int, by: list[str]) -> DataFrame:
    """Equal bins between the least and the largest value, the last one closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).otherwise(0)
    return df.join(F.broadcast(ends)).withColumn("bin", F.least(width, F.lit(bins - 1)).cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def enrich_answers(df: DataFrame, brands: list[str]) -> DataFrame:
    low = F.lower(F.coalesce("response", F.lit("")))
    flags = {f"mentions_{b.lower().replace(' ', '_')}": F.contains(low, F.lit(b.lower())) for b in brands}
    return df.withColumns(flags | {"has_response": F.length(F.coalesce("response", F.lit(""))) > 20})


def quota(sites: DataFrame, runs: DataFrame, tenant: str, now: Column) -> DataFrame:
    """Sites, active runs and pages since the month began, against 20, 2 and 100 000."""
    own = sites.where(F.col("tenant_id") == tenant).select(F.col("id").alias("site_id"))
    n = own.agg(F.count("*").alias("sites"))
    used = runs.join(own, "site_id", "left_semi").agg(count_if(F.col("status").isin("pending", "running")).alias("active_runs"), F.coalesce(F.sum(F.when(F.col("created_at") >= F.date_trunc("month", now), F.col("pages"))), F.lit(0)).alias("month_pages"))
    return n.crossJoin(used).withColumns({"sites_ok": F.col("sites") < 20, "runs_ok": F.col("active_runs") < 2, "pages_ok": F.col("month_pages") < 100_000})  # one row each


def filtered_counts(df: DataFrame, **tests: Column) -> DataFrame:
    return df.agg(*[count_if(t).alias(n) for n, t in tests.items()])


def anchors(links: DataFrame) -> DataFrame:
    """All anchor texts of each target, blank ones dropped, repeats kept."""
    return links.where(F.trim(F.coalesce("anchor_text", F.lit(""))) != "").groupBy(strip_slashes(F.col("dest_url")).alias("dest")).agg(F.sort_array(F.collect_list("anchor_text")).alias("anchors"))


def link_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links in and out of every page, parallel ones counted each, with the two warnings."""
    key = lambda c: strip_slashes(F.col(c))
    inner = links.where("is_internal")
    into = inner.groupBy(key("dest_url").alias("_k")).agg(F.count("*").alias("inlinks"))
    out = inner.groupBy(key("source_url").alias("_s")).agg(F.count("*").alias("outlinks"))
    met = pages.select("url", key("url").alias("k")).join(into, F.col("k") == F.col("_k"), "left").join(out, F.col("k") == F.col("_s"), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return met.select("url", n("inlinks").alias("inlinks"), n("outlinks").alias("outlinks"), (n("inlinks") < 2).alias("few_inlinks"), (n("outlinks") > 100).alias("many_outlinks"))


def depth_distribution(depths: DataFrame) -> DataFrame:
    """Pages by depth; those without one at -1."""
    return depths.groupBy(F.coalesce("depth", F.lit(-1)).alias("depth")).agg(F.count("*").alias("n"))


def pages_by_depth(depths: DataFrame, most: int = 10) -> DataFrame:
    return depths.where(F.col("depth").between(0, most)).groupBy("depth").agg(F.sort_array(F.collect_list("url")).alias("urls"))


def faceted(urls: DataFrame, least: int = 5) -> DataFrame:
    """Base addresses with many distinct parameter variants."""
    return urls.where(query(F.col("url")) != "").groupBy(base_path(F.col("url")).alias("base")).agg(F.countDistinct("url").alias("variants")).where(F.col("variants") > least)


def status_classes(pages: DataFrame) -> DataFrame:
    c = F.when(status().between(200, 299), "2xx").when(status().between(300, 399), "3xx").when(status().between(400, 499), "4xx").when(status() >= 500, "5xx").otherwise("other")
    return pages.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


def quality_shares(pages: DataFrame) -> DataFrame:
    """Whole percentages of the indexed pages with title, description, h1 and enough words."""
    some = pages.where(is_indexed())
    share = lambda t: F.round(count_if(t) * 100 / F.greatest(F.count("*"), F.lit(1)), 0).cast("long")
    return some.agg(share(~blank(F.col("title"))).alias("title"), share(~blank(F.col("meta_description"))).alias("meta"), share(F.col("h1_count") > 0).alias("h1"), share(F.col("word_count") >= 300).alias("words"))


def vitals(psi: DataFrame) -> DataFrame:
    over = lambda c, m: count_if(F.col(c) > VITALS[m][0])
    return psi.agg(F.avg("psi_score").alias("avg_score"), over("psi_lcp_ms", "lcp").alias("slow_lcp"), over("psi_cls", "cls").alias("high_cls"), over("psi_inp_ms", "inp").alias("slow_inp"))


def external_totals(pages: DataFrame) -> DataFrame:
    return pages.agg(F.sum(F.coalesce(F.size("external_links"), F.lit(0))).alias("external"), F.sum(F.coalesce(F.size("broken"), F.lit(0))).alias("broken"))


def bonus_total(backlinks: DataFrame) -> DataFrame:
    return backlinks.agg(F.count("*").alias("backlinks"), F.coalesce(F.sum(authority_bonus(F.col("domain_rating"))), F.lit(0)).cast("long").alias("bonus"))


def learning_context(history: DataFrame, text: str = "actions") -> DataFrame:
    """Successful actions of a JSON list: how many, and the first five."""
    done = F.filter(F.from_json(text, "array<struct<type:string,url:string,success:boolean>>"), lambda a: F.coalesce(a["success"], F.lit(False)))
    return history.select("id", F.coalesce(F.size(done), F.lit(0)).alias("n"), F.slice(done, 1, 5).alias("first"))


def competitor_counts(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", F.size(json_list(F.col("competitor_urls"))).alias("competitors"))


def match_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"with_{c}") for c in columns])


def referring_domains(rows: DataFrame, least: int = 10) -> DataFrame:
    return rows.groupBy("url").agg(F.count("*").alias("ref_domains"), count_if(F.col("domain_rating") >= least).alias("ref_domains_dr10"))


def event_reports(events: DataFrame) -> dict[str, DataFrame]:
    """p75 by day, sessions by campaign, ids seen more than once, rows without an id."""
    k = F.get_json_object("props", "$.k")
    return {
        "p75": events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.percentile_approx("value", 0.75, 10_000).alias("p75")),
        "sessions": events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n")),
        "repeated": events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1"),
        "without": events.where(k.isNull() | (k == "")).groupBy("event_type").agg(F.count("*").alias("n")),
    }


# windows


def latest_run(runs: DataFrame) -> DataFrame:
    """Of each site its latest completed run, ties to the larger id."""
    done = runs.where("status = 'completed'")
    return done.groupBy("site_id").agg(F.max_by("id", F.struct("completed_at", "id")).alias("id"), F.max("completed_at").alias("completed_at"))


def with_previous(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("site_id").orderBy("completed_at", "id")
    return runs.where("status = 'completed'").withColumn("previous_id", F.lag("id").over(w))


def trends(runs: DataFrame, now: Column, months: int = 6) -> DataFrame:
    """Completed runs of the last months of 30 days, with the change of pages."""
    w = Window.partitionBy("site_id").orderBy("completed_at", "id")
    some = runs.where((F.col("status") == "completed") & (F.col("completed_at") >= now - F.expr(f"INTERVAL {months * 30} DAYS")))
    return some.select("site_id", "id", "completed_at", "pages", (F.col("pages") - F.lag("pages").over(w)).alias("delta"))


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def progress(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Each step of a job with its place (done) among all of the job's steps (total)."""
    job = Window.partitionBy(by)
    return df.withColumns({"done": F.row_number().over(job.orderBy(*order)), "total": F.count("*").over(job)})


def last_messages(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last messages of each conversation, in order of their turns."""
    return first_n(messages, ["conv_id"], [F.desc("turn")], n)


def word_chunks(df: DataFrame, key: str, text: str, size: int = 100) -> DataFrame:
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    listed = df.select(key, w.alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size))
    each = listed.select(key, F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, F.lit(size)), " "))).alias("i", "text"))
    return each.select(key, (F.col("i") + 1).alias("chunk"), "text")


def assign_services(prompts: DataFrame, services: list[str], n: int) -> DataFrame:
    """Prompt numbers from 1 in order of pos, services in turn, the first max(2, 35 %) for the brand."""
    names = F.array(*[F.lit(s) for s in services])
    budget = F.greatest(F.lit(2), F.bround(F.lit(n) * 0.35, 0).cast("int"))
    first = prompts.orderBy("pos").limit(n).withColumn("i", F.row_number().over(Window.orderBy("pos")))  # n rows
    return first.select("pos", "i", F.get(names, (F.col("i") - 1) % len(services)).alias("service"), (F.col("i") <= budget).alias("brand_prompt"))
