"""Registrable domains under a table of public suffix rules, in joins only.

A rule is a suffix, a wildcard ``*.suffix`` (one more label, whatever it is) or an exception ``!suffix`` (one label fewer). The rule of the most labels
that fits a host counts, an exception before all others. Rules are a table keyed by their suffix; each depth of rules is one join with the
host's own suffix of that many labels, so a host is looked up as often as the rules are deep. Up to ``BROADCAST`` rules are broadcast and no row
moves; with more, distinct hosts are joined by shuffles and then joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import authority

#: Rules that are broadcast, of some 60 bytes each.
BROADCAST = 200_000
PRIVATE = "===BEGIN PRIVATE DOMAINS==="


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), "^.*@", ""), r"(:[0-9]*)?\.*$", "")


def rule_table(lines: DataFrame) -> DataFrame:
    """(suffix, depth, plain, wild, but) of rules (column rule): empty lines and comments (//) don't count, rules that repeat are one."""
    rule = F.lower(F.regexp_extract("rule", r"^\s*(\S+)", 1))
    suffix = F.regexp_replace(rule, r"^(\*\.|!)", "")
    kept = lines.select(rule.alias("rule"), suffix.alias("suffix")).where("rule <> '' and not startswith(rule, '//') and suffix <> '*'")
    has = lambda test: F.max(F.expr(test)).alias
    by = kept.groupBy("suffix").agg(has("not startswith(rule, '*.') and not startswith(rule, '!')")("plain"), has("startswith(rule, '*.')")("wild"), has("startswith(rule, '!')")("but"))
    return by.withColumn("depth", F.size(F.split("suffix", r"\.")))


def suffix_list(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """The rules of a public suffix list's file; those of private parties only where they are asked for."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", PRIVATE).alias("parts"))
    text = F.array_join(F.when(F.lit(private), F.col("parts")).otherwise(F.slice("parts", 1, 1)), "\n")
    return rule_table(lines.select(F.explode(F.split(text, r"\r?\n")).alias("rule")))


def with_registrable(df: DataFrame, host: str, rules: DataFrame, name: str = "registrable", subdomain: str = "subdomain", most: int = BROADCAST) -> DataFrame:
    """``df`` with the registrable name of a host column and what stands before it.

    The name is empty where no rule fits or nothing lies before the suffix; then the subdomain is what stands before the last label, or empty in the second case. Null hosts give nulls.
    """
    size = rules.count()
    depths = sorted(r.depth for r in rules.select("depth").distinct().collect())  # a number for each depth, of which there are few
    if size > most:
        key = F.col(host)
        found = _matched(df.select(key.alias(host)).where(key.isNotNull()).distinct(), host, rules, depths, False, name, subdomain)
        return df.join(found, host, "left").select(*df.columns, name, subdomain)
    return _matched(df, host, rules, depths, True, name, subdomain)


def _matched(df: DataFrame, host: str, rules: DataFrame, depths: list[int], small: bool, name: str, subdomain: str) -> DataFrame:
    columns = df.columns
    out = df.withColumn("_l", F.split(F.col(host), r"\."))
    n = F.size("_l")
    for d in depths:
        own = rules.where(F.col("depth") == d).select(F.col("suffix").alias("_s"), F.struct("plain", "wild", "but").alias(f"_r{d}"))
        tail = F.when(n >= d, F.array_join(F.slice("_l", F.greatest(F.lit(1), n - d + 1), d), "."))
        out = out.withColumn("_k", tail)
        out = out.join(F.broadcast(own) if small else own, F.col("_k") == F.col("_s"), "left").drop("_s", "_k")  # counted above
    # labels of the public suffix
    r = lambda d, kind: F.coalesce(F.col(f"_r{d}.{kind}"), F.lit(False))
    none = F.lit(None).cast("int")
    but = F.coalesce(*[F.when(r(d, "but"), d - 1) for d in reversed(depths)], none)
    most = F.coalesce(*[F.when(r(d, "wild") & (n > d), d + 1).when(r(d, "plain"), d) for d in reversed(depths)], none)
    out = out.withColumn("_n", F.coalesce(but, most))
    part = lambda start, size: F.array_join(F.slice("_l", start, F.greatest(F.lit(0), size)), ".")
    whole = F.col("_n") < n
    named = F.when(F.col(host).isNull(), None).when(whole, part(F.greatest(F.lit(1), n - F.col("_n")), F.col("_n") + 1)).otherwise("")
    before = F.when(F.col(host).isNull(), None).when(whole, part(F.lit(1), n - F.col("_n") - 1)).when(F.col("_n").isNull(), part(F.lit(1), n - 1)).otherwise("")
    return out.select(*columns, named.alias(name), before.alias(subdomain))


def with_internal(df: DataFrame, url: str, base_host: str, rules: DataFrame, include_subdomains: bool = False, allowlist=(), name: str = "internal", most: int = BROADCAST) -> DataFrame:
    """``df`` with a column that tells whether a url is internal: of the base's registrable name, and a subdomain only the base's own, an allowed one or any if they are included."""
    base = with_registrable(df.sparkSession.createDataFrame([(base_host.lower().rstrip("."),)], "_h string"), "_h", rules, "_name", "_sub", most).first()
    got = with_registrable(df.withColumn("_h", F.coalesce(host_of(F.col(url)), F.lit(""))), "_h", rules, "_name", "_sub", most)
    sub = F.col("_sub")
    fits = (sub == "") | (sub == base["_sub"]) | F.lit(include_subdomains) | sub.isin(*[a.lower() for a in allowlist] or [""])
    return got.withColumn(name, (F.col("_name") == base["_name"]) & fits).select(*df.columns, name)
