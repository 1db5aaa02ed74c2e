"""Derived columns of pages, texts, dates, vectors and settings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Legal forms at the end of a company's name.
LEGAL_FORMS = ["ab", "hb", "kb", "as", "inc", "ltd", "gmbh", "llc", "bv", "oy"]
#: Good and fair limits of the web vitals.
VITALS = {"lcp": (2500, 4000), "cls": (0.1, 0.25), "inp": (200, 500)}
#: What marks a page that scripts fill.
SPA_MARKS = ['id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"', "ng-app", "data-reactroot", "data-v-"]
#: The formats of dates, read from the first 19 characters without a zone at their end.
DATE_FORMATS = ["yyyy-M-d'T'H:m:s", "yyyy-M-d"]


def blank(c: Column) -> Column:
    """Missing in the loose sense: null or empty."""
    return c.isNull() | (c == "")


def is_indexed(p=F.col) -> Column:
    return F.coalesce(p("is_indexable"), F.lit(True)) & (F.coalesce(p("status_code"), F.lit(0)) == 200)


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


# pages


def indexability_reason(noindex: Column, robots_allowed: Column, status: Column, canonical: Column, url: Column) -> Column:
    return (
        F.when(noindex, "noindex")
        .when(~robots_allowed, "robots_blocked")
        .when(F.coalesce(status, F.lit(0)) != 200, F.concat(F.lit("http_"), F.coalesce(status, F.lit(0)).cast("string")))
        .when(~blank(canonical) & (canonical != url), "canonical_other")
    )


def is_indexable(noindex: Column, robots_allowed: Column, status: Column) -> Column:
    return ~F.coalesce(noindex, F.lit(False)) & F.coalesce(robots_allowed, F.lit(True)) & (F.coalesce(status, F.lit(0)) == 200)


def content_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def header_charset(header: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(header), r"charset=\s*\"?([^;\"\s]+)", 1), F.lit(""))


def retryable(status: Column) -> Column:
    return status.isin(429, 500, 502, 503, 504)


def needs_render(html: Column, h1: Column, title: Column, internal_links: Column, word_count_: Column, framework: Column) -> Column:
    """Whether a page's own HTML seems to be a shell that scripts fill."""
    low = F.lower(html)
    body = F.regexp_extract(low, r"(?s)<body[^>]*>(.*?)</body>", 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<(script|style)[^>]*>.*?</\1>", ""), "<[^>]+>", ""))
    marked = F.exists(F.array(*[F.lit(m) for m in SPA_MARKS]), lambda m: F.contains(low, m))
    noscript = F.regexp_extract(low, r"(?s)<noscript[^>]*>(.*?)</noscript>", 1)
    shell = marked & low.rlike(r"(?s)<body[^>]*>.*?</body>") & (F.length(bare) < 100)
    return (
        blank(html)
        | (F.length(html) < 2000)
        | shell
        | (F.contains(low, F.lit("<noscript>")) & (F.length(F.trim(noscript)) > 100))
        | (blank(h1) & blank(title))
        | (F.coalesce(internal_links, F.lit(0)) == 0)
        | (F.coalesce(word_count_, F.lit(0)) < 50)
        | ~blank(framework)
    )


def render_diff(raw, rendered) -> Column:
    """What rendering changed; ``raw`` and ``rendered`` give the columns of either side by name."""
    text = lambda side, c: F.trim(F.coalesce(side(c), F.lit("")))
    changed = {c: text(raw, c) != text(rendered, c) for c in ("title", "h1_text", "canonical_url", "meta_robots")}
    links = F.greatest(F.lit(0), F.coalesce(rendered("internal_links_count"), F.lit(0)) - F.coalesce(raw("internal_links_count"), F.lit(0)))
    more = F.coalesce(rendered("word_count"), F.lit(0)) - F.coalesce(raw("word_count"), F.lit(0))
    some = changed["title"] | changed["h1_text"] | changed["canonical_url"] | changed["meta_robots"]
    return F.struct(
        changed["title"].alias("title_changed"),
        changed["h1_text"].alias("h1_changed"),
        changed["canonical_url"].alias("canonical_changed"),
        changed["meta_robots"].alias("robots_changed"),
        links.alias("links_added"),
        more.alias("word_count_diff"),
        (some | (links > 5) | (F.abs(more) > 100)).alias("has_significant_changes"),
    )


def mobile_diff(desktop, mobile) -> Column:
    n = lambda side, c: F.coalesce(side(c), F.lit(0))
    return F.struct(
        n(desktop, "word_count").alias("desktop_words"),
        n(mobile, "word_count").alias("mobile_words"),
        n(desktop, "internal_links_count").alias("desktop_links"),
        n(mobile, "internal_links_count").alias("mobile_links"),
    )


def differ(raw: Column, rendered: Column) -> Column:
    """Different, and one of the two not empty."""
    a, b = F.coalesce(raw, F.lit("")), F.coalesce(rendered, F.lit(""))
    return (a != b) & ((a != "") | (b != ""))


def text_ratio(text: Column, html: Column) -> Column:
    return F.bround(F.length(text) / F.greatest(F.length(html), F.lit(1)), 3)


def is_thin_text(text: Column) -> Column:
    return F.length(text) < 300


def tag_signals(html: Column) -> Column:
    low = F.lower(html)
    gtm, gtag = F.contains(low, F.lit("googletagmanager.com/gtm.js")), F.contains(low, F.lit("gtag("))
    return F.struct(gtm.alias("gtm"), gtag.alias("gtag"), F.contains(low, F.lit("fbq(")).alias("pixel"), (gtm & gtag).alias("double_fire"))


def vitals_signals(html: Column) -> Column:
    return F.struct(html.rlike(r"(?i)<link[^>]+rel=[\"']?preload").alias("preload"), html.rlike(r"(?i)<script[^>]+\bdefer\b").alias("defer"), F.regexp_count(html, F.lit(r"(?i)<img\b")).alias("images"))


# texts


@F.pandas_udf(LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """Sign votes of 64-bit hashes of the lower-cased text's character trigrams, the same in every process; under three characters: 0."""
    import numpy as np

    out = np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        for k, t in enumerate(texts):
            c = np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            if len(c) < 3:
                continue
            h = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h ^= h >> np.uint64(31)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[k] = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h), bitorder="little").view(np.int64)[0]
    return pd.Series(out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v.cast("array<double>"), F.lit(1), n)
    return F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def cosine_eps(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-10))


def brand_tokens(name: Column) -> Column:
    """Spellings that count as a mention."""
    bare = F.trim(F.regexp_replace(name, r"(?i)\s+(" + "|".join(LEGAL_FORMS) + r")\.?$", ""))
    two = F.slice(words(bare), 1, 2)
    parts = [F.lower(name), F.lower(bare), F.when(F.size(two) == 2, F.lower(F.array_join(two, " ")))]
    return F.array_distinct(F.filter(F.array(*parts), lambda t: t.isNotNull()))


def authority_bonus(rating: Column) -> Column:
    return F.when(rating <= 0, 1).otherwise(F.least(F.lit(10), (F.floor(rating / 10) + 1).cast("int"))).cast("int")


def vital_grade(metric: str, value: Column) -> Column:
    low, high = VITALS[metric]
    return F.when(value.isNull(), "unknown").when(value <= low, "good").when(value <= high, "needs-improvement").otherwise("poor")


def similarity_label(v: Column) -> Column:
    return F.when(v >= 0.45, "High").when(v >= 0.25, "Medium").otherwise("Low")


def rate_class(rate: Column) -> Column:
    return F.when(rate >= 0.5, "good").when(rate >= 0.3, "medium").otherwise("poor")


def crawl_due(cron: Column, last: Column, now: Column) -> Column:
    """Monthly after 28 days, weekly 7, daily 1, anything else 30; never run: due."""
    parts = F.split(F.trim(cron), r"\s+")
    days = F.floor((now.cast("timestamp").cast("long") - last.cast("timestamp").cast("long")) / 86400)
    least = F.when(F.size(parts) != 5, 30).when(F.get(parts, F.lit(2)) != "*", 28).when(F.get(parts, F.lit(4)) != "*", 7).otherwise(1)
    return last.isNull() | (days >= least)


def reward(before, after) -> Column:
    """Gain in click rate plus a twentieth of the places won."""
    ctr = F.coalesce(after("gsc_ctr"), F.lit(0.0)) - F.coalesce(before("gsc_ctr"), F.lit(0.0))
    place = F.coalesce(before("gsc_position"), F.lit(100.0)) - F.coalesce(after("gsc_position"), F.lit(100.0))
    return F.bround(ctr + place * 0.05, 4)


def issue_score(p=F.col) -> Column:
    one = lambda c: c.cast("int")
    return one(blank(p("title"))) + one(blank(p("h1_text"))) + one(blank(p("meta_description"))) + 2 * F.coalesce(p("broken_links"), F.lit(0)) + one(F.coalesce(p("is_noindex"), F.lit(False)))


def parse_date(text: Column) -> Column:
    """Null where no format fits; a time is one of UTC, whatever zone it names."""
    cut = F.regexp_replace(F.substring(text, 1, 19), r"(:\d+)(Z|[+-]\d\d:?\d\d)$", "$1")
    return F.coalesce(*[F.from_utc_timestamp(F.try_to_timestamp(cut, F.lit(f)), F.current_timezone()) for f in DATE_FORMATS])


def is_stale(text: Column, now: Column, days: int = 365) -> Column:
    """More than so many whole days ago."""
    return F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(parse_date(text))) / 86400) > days


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def first_json_object(text: Column) -> Column:
    """The text from the first brace to the last, where it parses."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def divergence(target: Column, actual: Column) -> Column:
    """(by key, distance, off): target minus actual by key, root mean square, over 0.35."""
    by_key = F.map_zip_with(target, actual, lambda k, a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    values = F.map_values(by_key)
    far = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / F.greatest(F.size(values), F.lit(1)))
    return F.struct(by_key.alias("by_key"), far.alias("distance"), (far > 0.35).alias("off"))


def rewrite_bounds(n: Column) -> Column:
    return F.struct(F.greatest(F.lit(20), F.floor(n * 0.8).cast("int")).alias("least"), F.floor(n * 1.3).cast("int").alias("most"))


@F.pandas_udf(StringType())
def inject_link(html: pd.Series, anchor: pd.Series, href: pd.Series) -> pd.Series:
    """The first whole-word occurrence of the anchor outside tags becomes a link, unless the address is linked already."""

    def one(h, a, u):
        if h is None or not a or u is None or f'href="{u}"' in h or f"href='{u}'" in h:
            return h
        m = re.search(rf"(?<![\w<])(?:{re.escape(a)})(?!\w)(?![^<>]*>)", h, re.IGNORECASE)
        return h if m is None else f'{h[: m.start()]}<a href="{u}">{m[0]}</a>{h[m.end() :]}'

    return pd.Series([one(*x) for x in zip(html, anchor, href)], dtype=object)


def lead_parts(line: Column) -> Column:
    p = F.transform(F.split(line, ","), lambda x: F.trim(x))
    return F.struct(*[F.coalesce(F.get(p, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(("name", "email", "company"))])


def url_or_keyword(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^(https?://|www\.)|^[^\s]+\.[a-z]{2,}(/|$)"), "url").otherwise("keyword")


def file_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_extract(url, r"^([^?#]*)", 1), "/"), -1)


def entity_list(text: Column, most: int) -> Column:
    """A JSON list, or the list under ``entities``, or the keys of an object; no more than ``most``."""
    listed = F.from_json(text, "array<string>")
    inner = F.from_json(F.get_json_object(text, "$.entities"), "array<string>")
    keys = F.json_object_keys(text)
    return F.slice(F.coalesce(listed, inner, keys, F.array().cast("array<string>")), 1, most)


def split_list(text: Column, most: int) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def clamp(n: Column, low: int = 5, high: int = 30) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), n))


def or_default(c: Column, default) -> Column:
    """The default for null, empty and zero."""
    empty = c == F.lit("" if isinstance(default, str) else 0)
    return F.when(c.isNull() | empty, F.lit(default)).otherwise(c)


def report_sections(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.struct(
        F.trim(F.regexp_extract(text, r"(?s)^(.*?)(?:\n#+\s|\n\d+[.)]\s|$)", 1)).alias("summary"),
        F.filter(lines, lambda x: x.rlike(r"^\d+[.)]")).alias("priorities"),
        F.filter(lines, lambda x: x.rlike(r"(?i)^#+\s.*competitor")).alias("competitors"),
    )
