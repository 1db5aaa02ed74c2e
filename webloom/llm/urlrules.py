"""URL filters: rules on hosts and paths as a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels reversed, each closed by a dot (``com.example.www.``), led by the
length and text of a rule path that the url's path starts with. A rule's key is then a prefix of the keys
of all hosts that it fits, so a rule is the interval from its key up to that key with the last ``.`` as
``/``; these intervals nest or are apart. Rule starts, rule ends and the distinct keys of urls are sorted
together; sweeping them, the number of open rules is the stack's height, and the rule on top at a key is
the last one that began at that height. The sweep runs in ranges of keys; a rule that spans into a range
is entered again at its start, outermost first.

For each (host, rule path) the sweep gives the longest host rule; among a url's rule paths the longest rule
(host and path together) wins, ties go to the smaller rule text. Without a rule the verdict is ``allow``.

Null urls and those without ``://`` have empty host and path and no rule. A rule that is given more than
once counts once; if one of them blocks, it blocks. Rules with an empty or null host or path are void. Repeated rows
stay as they are, and so do very long urls. Hot hosts: the sweep sees each host once, a host's rules are never gathered, and the join back
by host and path is left to adaptive skew handling, which can split the rows of one url. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import ascii_lower, materialise

#: Host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
#: Ranges of the sweep: one for so many distinct keys, and no more than these.
KEYS_PER_RANGE = 200_000
MOST_RANGES = 512
#: Distinct rule paths up to which they are broadcast.
BROADCAST = 20_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    labels = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.concat(F.lpad(F.length(path).cast("string"), 10, "0"), path, F.lit("\x01"), labels, F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _bounds(points: DataFrame, ranges: int) -> list[str]:
    """Keys that cut the distinct keys into about equal ranges, from at most 20 drawn keys a range."""
    drawn = sorted(r.key for r in points.orderBy(F.xxhash64("key")).limit(20 * ranges).select("key").collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def sweep(points: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, host, path) of distinct points with the rule (rhost, verdict) on top of the stack, where there is one."""
    if ranges is None:
        ranges = min(MOST_RANGES, 1 + points.count() // KEYS_PER_RANGE)
    bounds = _bounds(points, ranges) if ranges > 1 else []
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<string>")
    of = lambda c: F.size(F.filter(edges, lambda b: b <= c))
    start = rules.select(_key(F.col("host"), F.col("path")).alias("key"), F.col("host").alias("rhost"), "verdict")
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    start = start.withColumns({"end": end, "depth": F.length("key")})
    nothing = F.lit(None).cast("string")
    # kinds in order at one key: 0 an end, 1 a start, 2 a point; those carried into a range come before its keys
    opened = start.select(F.col("key").alias("at"), "key", "rhost", "verdict", F.explode(F.sequence(of(F.col("key")), of(F.col("end")))).alias("part"))
    opened = opened.select("part", F.when(F.col("part") == of(F.col("key")), F.col("at")).otherwise(F.lit("")).alias("at"), F.lit(1).alias("kind"), F.col("key").alias("tie"), F.lit(1).alias("step"), "rhost", "verdict", nothing.alias("host"), nothing.alias("path"))
    closed = start.select(of(F.col("end")).alias("part"), F.col("end").alias("at"), F.lit(0).alias("kind"), F.col("key").alias("tie"), F.lit(-1).alias("step"), nothing.alias("rhost"), nothing.alias("verdict"), nothing.alias("host"), nothing.alias("path"))
    asked = points.select(of(F.col("key")).alias("part"), F.col("key").alias("at"), F.lit(2).alias("kind"), F.col("key").alias("tie"), F.lit(0).alias("step"), nothing.alias("rhost"), nothing.alias("verdict"), "host", "path")
    order = ["at", "kind", "tie"]
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    height = opened.unionByName(closed).unionByName(asked).withColumn("height", F.sum("step").over(run))
    same = Window.partitionBy("part", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("kind") == 1, F.struct("rhost", "verdict")), ignorenulls=True).over(same)
    return height.withColumn("top", top).where((F.col("kind") == 2) & (F.col("height") > 0)).select("host", "path", "top.rhost", "top.verdict")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", ranges: int | None = None) -> DataFrame:
    """Key, host, path, rule and verdict of each row."""
    rules = rules.where("host <> '' and path <> ''").select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    rules = materialise(rules.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict")))
    asked = pages.select(F.col(key).alias("key_"), F.col(url).alias("url_")).select("key_", host_of(F.col("url_")).alias("host"), path_of(F.col("url_")).alias("path"))
    # the lengths of rule paths: no more than the longest path has characters
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    if not lengths:
        return asked.select(F.col("key_").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    each = asked.where("host <> '' and path <> ''").select("host", "path").distinct()
    each = each.select("host", "path", F.explode(F.transform(cut, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("head"))
    paths = rules.select(F.col("path").alias("head")).distinct()
    # few paths lead very many urls: while they are few they are broadcast, else dealt after the urls' heads are made distinct
    few = paths.count() <= BROADCAST
    heads = each.join(F.broadcast(paths), "head", "left_semi").select("host", "head").distinct() if few else each.select("host", "head").distinct().join(paths, "head", "left_semi")
    points = heads.select(_key(F.col("host"), F.col("head")).alias("key"), "host", F.col("head").alias("path"))
    if ranges is None:
        points = materialise(points)
    won = materialise(sweep(points, rules, ranges).select(F.col("host").alias("h_"), F.col("path").alias("p_"), "rhost", "verdict"))
    # the longest rule of each distinct url, ties to the smaller text
    rule = F.struct((-F.length("rhost") - F.length("head")).alias("n"), F.concat("rhost", "head").alias("rule"), "verdict")
    best = each.join(won, (F.col("host") == F.col("h_")) & (F.col("head") == F.col("p_"))).groupBy("host", "path").agg(F.min(rule).alias("best"))
    # kept apart, so that both sides are dealt anew and the rows of a hot url can be split
    best = materialise(best).withColumnsRenamed({"host": "h_", "path": "p_"})
    joined = asked.join(best, (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")), "left")
    return joined.select(F.col("key_").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
