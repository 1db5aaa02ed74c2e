"""Readers and writers of the service's files and tables. Fetches, renders and provider calls are inputs: their rows come as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.joins import keep_first, keep_last
from webloom.sources import schemas

#: The fields of the files for people.
PAGE_FIELDS = "url final_url status_code title meta_description h1_text word_count is_indexable indexability_reason canonical_url depth ttfb_ms response_bytes redirect_hops robots_txt_allowed is_noindex internal_links_count external_links_count img_count img_missing_alt was_rendered content_hash html_lang".split()
ISSUE_FIELDS = "issue_type severity confidence affected_url affected_urls_count how_to_fix why_it_matters".split()
LINK_FIELDS = "source_url dest_url anchor_text is_internal is_follow link_context".split()


def read_table(spark: SparkSession, path: str, schema: str, run_id: str | None = None) -> DataFrame:
    """A Parquet table; one run's rows come from its partition alone."""
    df = spark.read.schema(schema).parquet(path)
    return df if run_id is None else df.where(F.col("crawl_run_id") == run_id)


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("crawl_run_id").parquet(path)


def present(df: DataFrame, fields: list[str]) -> DataFrame:
    """Those of the fields that there are, in their order."""
    return df.select(*[c for c in fields if c in df.columns])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Flat columns; nested ones as JSON text."""
    some = present(df, fields)
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in some.dtypes]
    _csv(some.select(*flat), path)


def _csv(df: DataFrame, path: str) -> None:
    """With a header, and with the blanks at the ends of its texts."""
    df.write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def export_csv(dataset: str, tables: dict[str, DataFrame], path: str) -> None:
    write_csv(tables[dataset], path, {"pages": PAGE_FIELDS, "issues": ISSUE_FIELDS, "links": LINK_FIELDS}[dataset])


def write_report(sheets: dict[str, DataFrame], folder: str) -> None:
    for name, df in sheets.items():
        flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
        _csv(df.select(*flat), f"{folder}/{name}")


def upsert(table: DataFrame, rows: DataFrame, key: str, update: bool = True) -> DataFrame:
    """The table with the rows of new keys; rows of known keys replace non-null columns, or are passed over."""
    new = [c for c in table.columns if c != key and c in rows.columns]
    side = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in new])
    met = table.join(side, F.col(key) == F.col("_k"), "full")
    pick = lambda c: (F.coalesce(f"_{c}", c) if update else F.when(F.col(key).isNotNull(), F.col(c)).otherwise(F.col(f"_{c}"))) if c in new else F.col(c)
    return met.select(*[F.coalesce(key, "_k").alias(key) if c == key else pick(c).alias(c) for c in table.columns])


def patch(table: DataFrame, where: Column, **values) -> DataFrame:
    """Given columns changed where a condition holds."""
    return table.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(~F.coalesce(F.col(key) == value, F.lit(False)))


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def add_column(table: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """Adds a column unless it is there."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(kind))


def with_defaults(config: DataFrame, numbers: dict, flags: dict) -> DataFrame:
    """Null, empty and zero become the default; booleans only where they are null."""
    loose = {c: F.when(F.col(c).isNull() | (F.col(c).cast("string").isin("", "0", "0.0")), F.lit(v)).otherwise(F.col(c)) for c, v in numbers.items()}
    return config.withColumns(loose | {c: F.coalesce(c, F.lit(v)) for c, v in flags.items()})


def read_run_files(spark: SparkSession, folder: str, key: str, prefix: str) -> DataFrame:
    """The newest CSV of a platform by name (prefix_key_time.csv), else its progress lines (broken ones passed over), else nothing."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda pattern: sorted(str(s.getPath()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")) or [])
    if found := names(f"{prefix}_{key}_*.csv"):
        return spark.read.schema(schemas.TRACKER_RUN).option("header", True).option("multiLine", True).option("escape", '"').csv(found[-1])
    if found := names(f"{key}_progress.jsonl"):
        return spark.read.schema(schemas.TRACKER_RUN).option("mode", "DROPMALFORMED").json(found[-1])
    return spark.createDataFrame([], schemas.TRACKER_RUN)


def list_runs(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True)


def write_sitemaps(entries: DataFrame, path: str, most: int = 50_000) -> None:
    """Sitemap files of at most so many entries (loc, lastmod, changefreq, priority or some of them), in their order; every task writes its own."""
    write = entries.write.format("xml").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url")
    write.option("maxRecordsPerFile", most).save(path)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Entries of sitemap files (loc, lastmod, changefreq, priority), the last of each loc."""
    df = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema("loc string, lastmod string, changefreq string, priority double").load(path)
    df = df.select(F.trim("loc").alias("loc"), "lastmod", "changefreq", "priority", F.monotonically_increasing_id().alias("pos")).where("loc <> ''")
    return keep_last(df, "loc").drop("pos")


def sitemap_children(spark: SparkSession, path: str) -> DataFrame:
    """The sitemaps that index files name."""
    df = spark.read.format("xml").option("rowTag", "sitemap").option("ignoreNamespace", True).schema("loc string, lastmod string").load(path)
    return df.select(F.trim("loc").alias("loc")).where("loc <> ''").distinct()


def sitemap_text(rows: DataFrame, first: bool = True) -> DataFrame:
    """Entries of sitemap documents held in a table (pos, host, xml): internal ones, the first of each loc."""
    each = rows.select("pos", "host", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))).alias("loc"))
    inside = each.where(F.contains("loc", F.concat(F.lit("://"), F.col("host"))))
    return (keep_first if first else keep_last)(inside, "loc").select("loc", "host")


def parse_robots(rows: DataFrame) -> DataFrame:
    """(host, exists, status_code, parse_error) and the rules of every agent, from robots files in a table (host, text, status_code)."""
    status = F.coalesce("status_code", F.lit(0))
    error = F.when(status >= 500, F.concat(F.lit("status "), status.cast("string")))
    return rows.select("host", (status == 200).alias("exists"), "status_code", error.alias("parse_error"), sitemap_lines(F.col("text")).alias("sitemap_urls"))


def sitemap_lines(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), F.array().cast("array<string>"))


def robots_rules(rows: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, prefix) of the group of an agent; an empty Disallow allows all and gives no rule."""
    lines = rows.where("status_code = 200").select("host", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    part = lines.select("host", "n", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_extract("line", r"^[^:]*:([^#]*)", 1)).alias("v"))
    from pyspark.sql.window import Window

    own = part.withColumn("agent", F.last(F.when(F.col("k") == "user-agent", F.lower("v")), ignorenulls=True).over(Window.partitionBy("host").orderBy("n")))
    return own.where((F.col("agent") == agent.lower()) & F.col("k").isin("allow", "disallow") & (F.col("v") != "")).select("host", (F.col("k") == "allow").alias("allow"), F.col("v").alias("prefix"))


def gsc_rows(raw: DataFrame) -> DataFrame:
    """Search rows: click rate as a percentage, position to one place."""
    return raw.select("url", F.col("clicks").cast("int").alias("gsc_clicks"), F.col("impressions").cast("int").alias("gsc_impressions"), F.bround(F.col("ctr") * 100, 2).alias("gsc_ctr"), F.bround("position", 1).alias("gsc_position"))


def gsc_window(today: Column, days: int = 28) -> Column:
    end = F.date_sub(today, 2)
    return F.struct(F.date_sub(end, days).alias("start"), end.alias("end"))


def psi_rows(raw: DataFrame, most: int = 20) -> DataFrame:
    """Speed figures from the provider's answers (pos, url, json), a limited number of pages."""
    audit = lambda name: F.get_json_object("json", f"$.lighthouseResult.audits.{name}.numericValue").cast("double")
    ms = lambda name: F.bround(audit(name), 0).cast("int")
    score = F.get_json_object("json", "$.lighthouseResult.categories.performance.score").cast("double")
    return raw.orderBy("pos").limit(most).select(
        "url",
        F.bround(score * 100, 0).cast("int").alias("psi_score"),
        ms("largest-contentful-paint").alias("psi_lcp_ms"),
        F.bround(audit("cumulative-layout-shift"), 3).alias("psi_cls"),
        ms("interaction-to-next-paint").alias("psi_inp_ms"),
        ms("first-contentful-paint").alias("psi_fcp_ms"),
        ms("server-response-time").alias("psi_ttfb_ms"),
    )


def psi_detail(raw: DataFrame) -> DataFrame:
    names = {"fcp": "first-contentful-paint", "lcp": "largest-contentful-paint", "cls": "cumulative-layout-shift", "tbt": "total-blocking-time", "si": "speed-index", "tti": "interactive"}
    get = lambda a, what: F.get_json_object("json", f"$.lighthouseResult.audits.{a}.{what}")
    return raw.select("url", *[c for k, a in names.items() for c in (get(a, "displayValue").alias(f"{k}_value"), get(a, "score").cast("double").alias(f"{k}_score"))])


def page_records(fetched: DataFrame) -> DataFrame:
    """Page rows of fetch results (url, final_url, status_code, headers, redirect_chain, ttfb_ms, body)."""
    from webloom.functions.scalars import content_type

    header = lambda name: F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == name)), F.lit(0))
    return fetched.withColumns({"content_type": content_type(header("content-type")), "redirect_hops": F.size("redirect_chain"), "response_bytes": F.octet_length("body").cast("long")})
