"""The audit: one rule is a severity, a confidence and a predicate; row rules run in a single scan.

Every check yields violations (issue_type, severity, confidence, url, pos); ``rollup`` makes one issue row of each
(issue_type, severity): first page, number of pages and the first ten in the order of ``pos``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.scalars import blank, hamming, is_indexed, is_stale, simhash64, strip, words
from webloom.functions.urls import base_path, graph_key, query, strip_slashes
from webloom.sources.shared import keep

#: Properties that rich results need, by type.
REQUIRED_PROPERTIES = {
    "Product": ["name", "image", "offers"],
    "Article": ["headline", "author", "datePublished"],
    "NewsArticle": ["headline", "author", "datePublished"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "FAQPage": ["mainEntity"],
    "LocalBusiness": ["name", "address"],
    "Organization": ["name", "url"],
    "BreadcrumbList": ["itemListElement"],
}
#: Language codes.
LANGUAGES = (
    "aa", "ab", "af", "ak", "am", "an", "ar", "as", "av", "ay", "az", "ba", "be", "bg", "bh", "bi", "bm", "bn", "bo", "br", "bs", "ca", "ce", "ch",
    "co", "cr", "cs", "cu", "cv", "cy", "da", "de", "dv", "dz", "ee", "el", "en", "eo", "es", "et", "eu", "fa", "ff", "fi", "fj", "fo", "fr", "fy",
    "ga", "gd", "gl", "gn", "gu", "gv", "ha", "he", "hi", "ho", "hr", "ht", "hu", "hy", "hz", "ia", "id", "ie", "ig", "ii", "ik", "io", "is", "it",
    "iu", "ja", "jv", "ka", "kg", "ki", "kj", "kk", "kl", "km", "kn", "ko", "kr", "ks", "ku", "kv", "kw", "ky", "la", "lb", "lg", "li", "ln", "lo",
    "lt", "lu", "lv", "mg", "mh", "mi", "mk", "ml", "mn", "mr", "ms", "mt", "my", "na", "nb", "nd", "ne", "ng", "nl", "nn", "no", "nr", "nv", "ny",
    "oc", "oj", "om", "or", "os", "pa", "pi", "pl", "ps", "pt", "qu", "rm", "rn", "ro", "ru", "rw", "sa", "sc", "sd", "se", "sg", "si", "sk", "sl",
    "sm", "sn", "so", "sq", "sr", "ss", "st", "su", "sv", "sw", "ta", "te", "tg", "th", "ti", "tk", "tl", "tn", "to", "tr", "ts", "tt", "tw", "ty",
    "ug", "uk", "ur", "uz", "ve", "vi", "vo", "wa", "wo", "xh", "yi", "yo", "za", "zh", "zu",
)
SEVERITIES = ["critical", "high", "medium", "low"]
NEAR_WINDOW = 200
NEAR_BITS = 6

VIOLATION = ["issue_type", "severity", "confidence", "url", "pos"]


@dataclass(frozen=True)
class Rule:
    severity: str
    test: Callable[[], Column]
    confidence: float = 1.0
    needs: tuple[str, ...] = ()


def _n(c: str, default: int = 0) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _flag(c: str, default: bool = False) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _status(default: int = 0) -> Column:
    return _n("status_code", default)


def _https() -> Column:
    return F.startswith("url", F.lit("https://"))


def _two(a: int, b: int) -> Column:
    code = lambda k: F.exists("redirect_chain", lambda h: h["status_code"] == k)
    return (F.size("redirect_chain") > 1) & code(a) & code(b)


def _hops() -> Column:
    return F.coalesce(F.size("redirect_chain"), F.lit(0))


def _tags() -> Column:
    return F.coalesce(F.size("hreflang_tags"), F.lit(0)) > 0


def _tag(test) -> Column:
    return F.exists("hreflang_tags", lambda t: test(F.lower(strip(t["lang"])), t["href"]))


def _blocks() -> Column:
    return F.coalesce(F.size("structured_data"), F.lit(0))


def _fails(block: Column) -> Column:
    """The block's _error is there and not empty in Python's sense."""
    e = F.get_json_object(block, "$._error")
    return e.isNotNull() & ~e.isin("", "false", "0", "[]", "{}")


def _error_block() -> Column:
    return F.exists("structured_data", lambda b: F.json_object_keys(b).isNotNull() & _fails(b))


def _missing_fields() -> Column:
    def lacks(b: Column) -> Column:
        kind = F.coalesce(F.get_json_object(b, "$['@type'][0]"), F.get_json_object(b, "$['@type']"), F.lit(""))
        have = F.json_object_keys(b)
        some = F.lit(False)
        for name, fields in REQUIRED_PROPERTIES.items():
            some = some | ((kind == name) & (F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), have)) > 0))
        return have.isNotNull() & ~_fails(b) & some

    return F.exists("structured_data", lacks)


def _length(c: str) -> Column:
    """A page's own figure, as its extraction gave it."""
    return F.coalesce(F.col(f"{c}_length"), F.lit(0))


def _stripped(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def _has(c: str) -> Column:
    return ~blank(F.col(c))


_IDX = is_indexed

#: (issue_type, rule), each on one page's own columns.
ROW_RULES: list[tuple[str, Rule]] = [
    ("robots_blocks_important", Rule("high", lambda: ~_flag("robots_txt_allowed", True), needs=("robots_txt_allowed",))),
    ("sitemap_url_error", Rule("high", lambda: (F.col("source") == "sitemap") & (_status(200) >= 400), needs=("source",))),
    ("sitemap_robots_conflict", Rule("high", lambda: (F.col("source") == "sitemap") & _flag("is_noindex"), needs=("source", "is_noindex"))),
    ("http_4xx", Rule("high", lambda: (_status() >= 400) & (_status() < 500))),
    ("http_5xx", Rule("critical", lambda: _status() >= 500)),
    ("soft_404", Rule("medium", lambda: (_status() == 200) & (_n("word_count", 999) < 50) & F.lower(F.coalesce("title", F.lit(""))).rlike("not found|404|page not found|error"), 0.7, ("word_count", "title"))),
    ("redirect_chain", Rule("medium", lambda: _hops() > 1, needs=("redirect_chain",))),
    ("redirect_loop", Rule("critical", lambda: _flag("redirect_loop"), needs=("redirect_loop",))),
    ("redirect_to_error", Rule("high", lambda: (_hops() > 0) & (_status(200) >= 400), needs=("redirect_chain",))),
    ("mixed_redirect_chain", Rule("medium", lambda: _two(301, 302), needs=("redirect_chain",))),
    ("canonical_missing", Rule("medium", lambda: _IDX() & blank(F.col("canonical_url")), needs=("canonical_url",))),
    ("canonical_multiple", Rule("high", lambda: _n("canonical_count") > 1, needs=("canonical_count",))),
    ("canonical_mismatch", Rule("medium", lambda: _IDX() & _has("canonical_url") & (strip_slashes(F.col("canonical_url")) != strip_slashes(F.coalesce(F.nullif("final_url", F.lit("")), "url"))), 0.8, ("canonical_url", "final_url"))),
    ("noindex_should_index", Rule("critical", lambda: _flag("is_noindex") & (_status() == 200) & (_n("internal_links_count") > 5) & (_n("word_count") > 200), 0.7, ("is_noindex", "internal_links_count", "word_count"))),
    ("robots_noindex_conflict", Rule("high", lambda: ~_flag("robots_txt_allowed", True) & _flag("is_noindex"), needs=("robots_txt_allowed", "is_noindex"))),
    ("title_missing", Rule("high", lambda: _IDX() & blank(F.col("title")), needs=("title",))),
    ("title_too_short", Rule("medium", lambda: _IDX() & _has("title") & (_length("title") < 15), needs=("title",))),
    ("title_too_long", Rule("low", lambda: _IDX() & (_length("title") > 70), needs=("title",))),
    ("meta_desc_missing", Rule("low", lambda: _IDX() & blank(F.col("meta_description")), needs=("meta_description",))),
    ("meta_desc_too_short", Rule("low", lambda: _IDX() & _has("meta_description") & (_length("meta_description") < 70), needs=("meta_description",))),
    ("meta_desc_too_long", Rule("low", lambda: _IDX() & (_length("meta_description") > 160), needs=("meta_description",))),
    ("h1_missing", Rule("high", lambda: _IDX() & (_n("h1_count") == 0), needs=("h1_count",))),
    ("h1_multiple", Rule("low", lambda: _IDX() & (_n("h1_count") > 1), needs=("h1_count",))),
    ("h1_too_short", Rule("low", lambda: _IDX() & _has("h1_text") & (F.length(_stripped("h1_text")) < 10), needs=("h1_text",))),
    ("h1_too_long", Rule("low", lambda: _IDX() & (F.length(_stripped("h1_text")) > 70), needs=("h1_text",))),
    ("h1_matches_title", Rule("low", lambda: _IDX() & _has("h1_text") & _has("title") & (F.lower(_stripped("h1_text")) == F.lower(_stripped("title"))), 0.6, ("h1_text", "title"))),
    ("heading_hierarchy_gap", Rule("low", lambda: _IDX() & (F.coalesce(F.size("heading_hierarchy_gaps"), F.lit(0)) > 0), needs=("heading_hierarchy_gaps",))),
    ("thin_content", Rule("medium", lambda: _IDX() & (_n("word_count") < 100), 0.6, ("word_count",))),
    ("high_click_depth", Rule("low", lambda: (_n("depth") > 5) & _flag("is_indexable", True), needs=("depth",))),
    ("internal_nofollow", Rule("low", lambda: _n("internal_nofollow_count") > 0, needs=("internal_nofollow_count",))),
    ("img_missing_alt", Rule("medium", lambda: _n("img_missing_alt") > 0, needs=("img_missing_alt",))),
    ("img_lazy_broken", Rule("medium", lambda: _n("img_lazy_broken") > 0, needs=("img_lazy_broken",))),
    ("img_missing_dimensions", Rule("medium", lambda: _n("img_missing_dimensions") > 0, needs=("img_missing_dimensions",))),
    ("structured_data_invalid", Rule("medium", lambda: _error_block(), needs=("structured_data",))),
    ("structured_data_missing", Rule("low", lambda: _IDX() & (_n("word_count") > 200) & (_blocks() == 0), 0.5, ("structured_data", "word_count"))),
    ("structured_data_missing_fields", Rule("medium", lambda: _missing_fields(), needs=("structured_data",))),
    ("js_render_errors", Rule("medium", lambda: _flag("was_rendered") & (F.coalesce(F.size("console_errors"), F.lit(0)) > 0), needs=("was_rendered", "console_errors"))),
    ("js_content_parity", Rule("high", lambda: _flag("was_rendered") & (F.coalesce(F.col("raw_vs_rendered_diff.h1_changed"), F.lit(False)) | F.coalesce(F.col("raw_vs_rendered_diff.title_changed"), F.lit(False))), needs=("was_rendered", "raw_vs_rendered_diff"))),
    ("js_link_parity", Rule("medium", lambda: _flag("was_rendered") & (F.coalesce(F.col("raw_vs_rendered_diff.links_added"), F.lit(0)) > 10), needs=("was_rendered", "raw_vs_rendered_diff"))),
    ("slow_ttfb", Rule("high", lambda: _n("ttfb_ms") > 2000, needs=("ttfb_ms",))),
    ("slow_ttfb", Rule("medium", lambda: (_n("ttfb_ms") > 600) & (_n("ttfb_ms") <= 2000), needs=("ttfb_ms",))),
    ("large_page", Rule("low", lambda: _n("response_bytes") > 3_000_000, needs=("response_bytes",))),
    ("hreflang_missing_self", Rule("medium", lambda: _tags() & ~_tag(lambda lang, href: strip_slashes(href) == strip_slashes(F.col("url"))), needs=("hreflang_tags",))),
    ("hreflang_canonical_conflict", Rule("high", lambda: _tags() & _has("canonical_url") & (strip_slashes(F.col("canonical_url")) != strip_slashes(F.col("url"))), needs=("hreflang_tags", "canonical_url"))),
    ("hreflang_invalid_lang", Rule("medium", lambda: _tag(lambda lang, href: (lang != "x-default") & ~F.split_part(lang, F.lit("-"), F.lit(1)).isin(*LANGUAGES)), needs=("hreflang_tags",))),
    ("hreflang_x_default_missing", Rule("low", lambda: _tags() & ~_tag(lambda lang, href: lang == "x-default"), needs=("hreflang_tags",))),
    ("mobile_content_parity", Rule("high", lambda: _flag("mobile_checked") & (F.col("mobile_diff.desktop_words") > 100) & (F.col("mobile_diff.mobile_words") < F.col("mobile_diff.desktop_words") * 0.7), needs=("mobile_checked", "mobile_diff"))),
    ("mobile_link_parity", Rule("medium", lambda: _flag("mobile_checked") & (F.col("mobile_diff.desktop_links") > 10) & (F.col("mobile_diff.mobile_links") < F.col("mobile_diff.desktop_links") * 0.5), needs=("mobile_checked", "mobile_diff"))),
    ("cls_risk", Rule("medium", lambda: (_n("img_missing_dimensions") > 0) & (_status() == 200), needs=("img_missing_dimensions",))),
    ("render_blocking_resource", Rule("medium", lambda: (_n("response_bytes") > 100_000) & (_status() == 200), 0.4, ("response_bytes",))),
    ("og_tags_missing", Rule("low", lambda: _IDX() & blank(F.col("og_title")), needs=("og_title",))),
    ("twitter_card_missing", Rule("low", lambda: _IDX() & blank(F.col("twitter_card")), needs=("twitter_card",))),
    ("viewport_missing", Rule("medium", lambda: (_status() == 200) & ~_flag("has_viewport"), needs=("has_viewport",))),
    ("charset_missing", Rule("low", lambda: (_status() == 200) & blank(F.col("charset_declared")), needs=("charset_declared",))),
    ("mixed_content", Rule("high", lambda: _https() & (_status() == 200) & _flag("has_mixed_content"), needs=("has_mixed_content",))),
    ("missing_hsts", Rule("medium", lambda: _https() & (_status() == 200) & ~F.coalesce(F.exists(F.map_keys("headers"), lambda k: F.lower(k) == "strict-transport-security"), F.lit(False)), needs=("headers",))),
    ("insecure_form_action", Rule("high", lambda: _https() & F.exists("form_actions", lambda a: F.startswith(a, F.lit("http://"))), needs=("form_actions",))),
    ("missing_html_lang", Rule("medium", lambda: (_status() == 200) & blank(F.col("html_lang")), needs=("html_lang",))),
    ("empty_link_text", Rule("medium", lambda: (_status() == 200) & (_n("empty_link_count") > 0), needs=("empty_link_count",))),
    ("missing_form_label", Rule("low", lambda: (_status() == 200) & (_n("form_inputs_without_label") > 0), needs=("form_inputs_without_label",))),
    ("missing_skip_nav", Rule("low", lambda: (_status() == 200) & ~_flag("has_skip_nav"), needs=("has_skip_nav",))),
]


def _analysed(pages: DataFrame, test: Column) -> bool:
    """Whether a test can be said of the pages; one that can't is left out, and the others go on."""
    try:
        pages.select(test)
    except AnalysisException:
        return False
    return True


def _with_lengths(pages: DataFrame) -> DataFrame:
    """Figures that an extraction gives beside its texts, where the table has the texts alone."""
    return pages.withColumns({f"{c}_length": F.length(c) for c in ("title", "meta_description") if c in pages.columns and f"{c}_length" not in pages.columns})


def row_violations(pages: DataFrame, only: set[str] | None = None) -> DataFrame:
    """One scan over the pages; rules whose columns are absent, or of another type, contribute nothing."""
    pages = _with_lengths(pages)
    usable = [(t, r, F.coalesce(r.test(), F.lit(False))) for t, r in ROW_RULES if set(r.needs) <= set(pages.columns) and (only is None or t in only)]
    if not _analysed(pages, F.array(*[test for *_, test in usable])):
        usable = [u for u in usable if _analysed(pages, u[2])]
    if not usable:
        usable = [("none", Rule("low", lambda: F.lit(False)), F.lit(False))]
    entry = lambda t, r, test: F.when(test, F.struct(F.lit(t).alias("issue_type"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).cast("double").alias("confidence")))
    found = F.filter(F.array(*[entry(*u) for u in usable]), lambda x: x.isNotNull())
    return pages.select("url", F.col("pos").cast("long").alias("pos"), F.explode_outer(found).alias("v")).select("v.*", "url", "pos").where("issue_type is not null").select(*VIOLATION)


def _violation(df: DataFrame, issue: str, severity: str, confidence: float = 1.0) -> DataFrame:
    return df.select(F.lit(issue).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(confidence).cast("double").alias("confidence"), "url", F.col("pos").cast("long").alias("pos"))


@dataclass(frozen=True)
class Shared:
    """A rule on pages that have a key in common."""

    severity: str
    base: Callable[[], Column]
    key: Callable[[], Column]
    having: str
    confidence: float = 1.0
    needs: tuple[str, ...] = ()


_SEVERAL = "n > 1"
#: Groups are told by their pages' number n and by the least and largest content hash: with null as a value of its own (a, b), or left out (c, d).
SHARED_RULES: dict[str, Shared] = {
    "title_duplicate": Shared("medium", lambda: _IDX() & _has("title"), lambda: F.lower(_stripped("title")), _SEVERAL, needs=("title",)),
    "meta_desc_duplicate": Shared("low", lambda: _IDX() & _has("meta_description"), lambda: F.lower(_stripped("meta_description")), _SEVERAL, needs=("meta_description",)),
    "duplicate_content": Shared("high", lambda: _IDX() & _has("content_hash"), lambda: F.col("content_hash"), _SEVERAL, needs=("content_hash",)),
    "duplicate_title": Shared(
        "medium",
        lambda: _IDX() & ((_stripped("title") != "") | (_stripped("h1_text") != "")),
        lambda: F.concat(F.lower(_stripped("title")), F.lit("\0"), F.lower(_stripped("h1_text"))),
        "n > 3 and a <> b",
        0.6,
        ("title", "h1_text", "content_hash"),
    ),
    "param_duplicate": Shared("medium", lambda: _IDX() & (query(F.col("url")) != ""), lambda: base_path(F.col("url")), "n > 1 and coalesce(c = d, true)", needs=("content_hash",)),
}


def shared_violations(pages: DataFrame, only: set[str] | None = None) -> DataFrame:
    """All rules on common keys at once: a row for each page and key, counted by (rule, key), and the rows whose group counts."""
    usable = {t: r for t, r in SHARED_RULES.items() if set(r.needs) <= set(pages.columns) and (only is None or t in only) and _analysed(pages, r.base() & (r.key() == ""))}
    key = lambda t, r: F.when(F.coalesce(r.base(), F.lit(False)), F.struct(F.lit(t).alias("rule"), r.key().alias("key")))
    keys = F.filter(F.array(*[key(t, r) for t, r in usable.items()]), lambda x: x.isNotNull()) if usable else F.expr("array(named_struct('rule', '', 'key', ''))")
    hashed = F.col("content_hash") if "content_hash" in pages.columns else F.lit(None).cast("string")
    each = pages.select("url", F.col("pos").cast("long").alias("pos"), hashed.alias("hash"), F.inline_outer(keys)).where("rule is not null")
    whole, some = F.coalesce("hash", F.lit("\0")), F.nullif("hash", F.lit(""))
    groups = each.groupBy("rule", "key").agg(F.count("*").alias("n"), F.min(whole).alias("a"), F.max(whole).alias("b"), F.min(some).alias("c"), F.max(some).alias("d"))
    counts = F.lit(False)
    for t, r in usable.items():
        counts = counts | ((F.col("rule") == t) & F.expr(r.having))
    found = each.join(groups.where(counts).select("rule", "key"), ["rule", "key"])
    pick = lambda f, kind: F.coalesce(*[F.when(F.col("rule") == t, F.lit(f(r)).cast(kind)) for t, r in usable.items()], F.lit(None).cast(kind))
    return found.select(F.col("rule").alias("issue_type"), pick(lambda r: r.severity, "string").alias("severity"), pick(lambda r: r.confidence, "double").alias("confidence"), "url", "pos")


def near_duplicates(pages: DataFrame, window: int = NEAR_WINDOW, bits: int = NEAR_BITS) -> DataFrame:
    """Pages with another near them in order whose simhash differs in few bits: buckets of ``window`` places, then the exact distance.

    The text is main_text, else the content hash. Places are counted over all indexed pages of more than 50 words; those whose text
    is too short for a simhash then drop out. A page meets its own and the next bucket only, so the work grows with pages times ``window``.
    """
    some = pages.where(is_indexed() & (F.coalesce("word_count", F.lit(0)) > 50))
    text = F.coalesce(F.nullif("main_text", F.lit("")), "content_hash", F.lit(""))
    # places in order without a global sort: ranks within ranges of pos, plus the sizes of the ranges before
    some = ranked(keep(some.select("url", F.col("pos").cast("long").alias("pos"), "content_hash", simhash64(text).alias("sim"))), "pos", "url").where("sim <> 0")
    left = some.select(F.col("url").alias("a_url"), F.col("pos").alias("a_pos"), F.col("content_hash").alias("a_hash"), F.col("sim").alias("a_sim"), F.col("i").alias("a_i"), F.explode(F.array((F.col("i") / window).cast("long"), (F.col("i") / window).cast("long") + 1)).alias("bucket"))
    right = some.withColumn("bucket", (F.col("i") / window).cast("long"))
    apart = F.col("i") - F.col("a_i")
    pairs = left.join(right, "bucket").where((apart > 0) & (apart < window) & ~F.col("content_hash").eqNullSafe(F.col("a_hash")) & (hamming(F.col("sim"), F.col("a_sim")) < bits))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a_url").alias("url"), F.col("a_pos").alias("pos")), F.struct("url", "pos"))).alias("p"))
    return both.select("p.url", "p.pos").distinct()


def ranked(df: DataFrame, by: str, tie: str, ranges: int = 2048) -> DataFrame:
    """``df`` with i, the place of each row in the order of ``by`` (a bigint, null first), then of ``tie``.

    The span of ``by`` is cut into no more than ``ranges`` ranges; a range's rows are ranked apart, the ranges' sizes added up.
    """
    ends = df.agg(F.min(by).alias("lo"), F.max(by).alias("hi")).first()
    low, step = ends.lo or 0, ((ends.hi or 0) - (ends.lo or 0)) // ranges + 1
    part = F.coalesce(F.expr(f"({by} - {low}L) div {step}L"), F.lit(-1))
    own = df.withColumn("_part", part)
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = own.withColumn("i", F.row_number().over(Window.partitionBy("_part").orderBy(by, tie)) - 1)
    return placed.join(F.broadcast(before), "_part").withColumn("i", F.col("i") + F.col("_before")).drop("_part", "_before")  # ranges + 1 rows


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: as a lambda's variable the optimizer can't repeat it in its places."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyword_stuffing(pages: DataFrame, share: float = 0.05) -> DataFrame:
    """Indexed pages of 100 words and more of whose three commonest words (ties by first place) one of over three letters has too large a share.

    Only words above the share are compared with each other: those before one of them in the order are above it too.
    """

    def stuffed(w: Column, s: Column, heads: Column) -> Column:
        """w: words, s: the same sorted, heads: where each word begins in s."""
        runs = F.transform(heads, lambda i, k: F.struct((F.coalesce(F.get(heads, k + 1), F.size(s)) - i).alias("n"), F.get(s, i).alias("word")))
        often = F.filter(runs, lambda r: r["n"] / F.size(s) > share)
        top = F.slice(F.array_sort(F.transform(often, lambda r: F.struct((-r["n"]).alias("n"), F.array_position(w, r["word"]).alias("at"), F.length(r["word"]).alias("size")))), 1, 3)
        return F.exists(top, lambda r: r["size"] > 3)

    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    found = let(words(F.lower("main_text")), lambda w: F.when(F.size(w) >= 100, let(F.array_sort(w), lambda s: let(begins(s), lambda heads: stuffed(w, s, heads)))))
    return pages.where(is_indexed() & F.coalesce(found, F.lit(False))).select("url", "pos")


def stale_content(pages: DataFrame, now: Column) -> DataFrame:
    """Indexed pages with a structured block whose date of change, else of publication, is over a year old."""

    def old(b: Column) -> Column:
        when = F.coalesce(F.nullif(F.get_json_object(b, "$.dateModified"), F.lit("")), F.get_json_object(b, "$.datePublished"))
        return F.json_object_keys(b).isNotNull() & is_stale(when, now)

    return pages.where(is_indexed() & F.exists("structured_data", lambda b: F.coalesce(old(b), F.lit(False)))).select("url", "pos")


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct sources of internal links to pages of status 400 and more."""
    bad = pages.where(F.coalesce("status_code", F.lit(200)) >= 400).select(graph_key(F.col("url"), F.col("url_normalized")).alias("to")).distinct()
    inside = links.where(F.coalesce("is_internal", F.lit(False))).select("source_url", graph_key(F.col("dest_url"), F.col("dest_url_normalized")).alias("to"))
    return inside.join(bad, "to", "left_semi").select(F.col("source_url").alias("url")).distinct()


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Indexed pages below the start that no internal link leads to."""
    inside = links.where(F.coalesce("is_internal", F.lit(False))).select(graph_key(F.col("dest_url"), F.col("dest_url_normalized")).alias("to")).distinct()
    some = pages.where(is_indexed() & (F.coalesce("depth", F.lit(0)) > 0))
    return some.withColumn("to", graph_key(F.col("url"), F.col("url_normalized"))).join(inside, "to", "left_anti")


def hreflang_without_return(pages: DataFrame) -> DataFrame:
    """Pages one of whose targets doesn't name them; a target is looked up as it is, then with a slash."""
    tags = pages.where(F.coalesce(F.size("hreflang_tags"), F.lit(0)) > 0).select("url", "pos", F.transform("hreflang_tags", lambda t: strip_slashes(t["href"])).alias("to"))
    asked = tags.select("url", "pos", strip_slashes(F.col("url")).alias("me"), F.explode(F.array_distinct("to")).alias("target")).where("target <> '' and target <> me")
    own = tags.groupBy("url").agg(F.flatten(F.collect_list("to")).alias("back"))
    a, b = own.withColumnsRenamed({"url": "u1", "back": "b1"}), own.withColumnsRenamed({"url": "u2", "back": "b2"})
    met = asked.join(a, F.col("target") == F.col("u1"), "left").join(b, F.concat("target", F.lit("/")) == F.col("u2"), "left")
    back = F.coalesce("b1", "b2", F.array().cast("array<string>"))
    return met.where(~F.array_contains(back, F.col("me"))).select("url", "pos").distinct()


def hreflang_to_error(pages: DataFrame) -> DataFrame:
    known = pages.where(F.col("status_code").isNotNull() & (F.col("status_code") != 200)).select(strip_slashes(F.col("url")).alias("to")).distinct()
    asked = pages.select("url", "pos", F.explode(F.transform("hreflang_tags", lambda t: strip_slashes(t["href"]))).alias("to"))
    return asked.join(known, "to", "left_semi").select("url", "pos").distinct()


def robots_violations(robots: DataFrame, sitemap_urls: int | None) -> DataFrame:
    """Of the one-row robots table (exists, status_code, parse_error, sitemap_urls) and the number of sitemap urls."""
    there, status = F.coalesce("exists", F.lit(False)), F.coalesce("status_code", F.lit(0))
    rules = [
        ("robots_txt_error", "high", 1.0, ~there & (status >= 500)),
        ("robots_txt_missing", "medium", 1.0, ~there & (status < 500)),
        ("robots_txt_error", "medium", 1.0, ~blank(F.col("parse_error"))),
        ("sitemap_missing", "low", 0.8, there & (F.coalesce(F.size("sitemap_urls"), F.lit(0)) == 0)),
        ("sitemap_missing", "medium", 1.0, F.lit(sitemap_urls == 0)),
    ]
    entry = lambda t, s, c, test: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), F.lit(c).alias("confidence")))
    found = F.filter(F.array(*[entry(*r) for r in rules]), lambda x: x.isNotNull())
    return robots.select(F.explode_outer(found).alias("v")).where("v is not null").select("v.*", F.lit(None).cast("string").alias("url"), F.lit(0).cast("long").alias("pos"))


#: The checks, and the issue types that each of them tells of.
CHECKS: dict[str, tuple[str, ...]] = {
    "robots": ("robots_txt_error", "robots_txt_missing", "robots_blocks_important", "sitemap_missing"),
    "sitemap": ("sitemap_missing", "sitemap_url_error", "sitemap_robots_conflict"),
    "status_codes": ("http_4xx", "http_5xx", "soft_404"),
    "redirects": ("redirect_chain", "redirect_loop", "redirect_to_error", "mixed_redirect_chain"),
    "canonicals": ("canonical_missing", "canonical_multiple", "canonical_mismatch"),
    "indexing": ("noindex_should_index", "robots_noindex_conflict"),
    "on_page": (
        "title_missing", "title_too_short", "title_too_long", "title_duplicate", "meta_desc_missing", "meta_desc_duplicate", "meta_desc_too_short", "meta_desc_too_long",
        "h1_missing", "h1_multiple", "h1_too_short", "h1_too_long", "h1_matches_title", "heading_hierarchy_gap", "thin_content",
    ),
    "links": ("broken_internal_link", "orphan_page", "high_click_depth", "internal_nofollow"),
    "images": ("img_missing_alt", "img_lazy_broken", "img_missing_dimensions"),
    "structured_data": ("structured_data_invalid", "structured_data_missing", "structured_data_missing_fields"),
    "js_parity": ("js_render_errors", "js_content_parity", "js_link_parity"),
    "performance": ("slow_ttfb", "large_page"),
    "hreflang": ("hreflang_missing_self", "hreflang_missing_return", "hreflang_canonical_conflict", "hreflang_invalid_lang", "hreflang_x_default_missing", "hreflang_to_error"),
    "duplicate_content": ("duplicate_content", "near_duplicate_content", "duplicate_title", "param_duplicate"),
    "mobile_parity": ("mobile_content_parity", "mobile_link_parity"),
    "meta_tags": ("og_tags_missing", "twitter_card_missing", "viewport_missing", "charset_missing"),
    "content_quality": ("keyword_stuffing", "stale_content"),
    "performance_hints": ("cls_risk", "render_blocking_resource"),
    "security": ("mixed_content", "missing_hsts", "insecure_form_action"),
    "accessibility": ("missing_html_lang", "empty_link_text", "missing_form_label", "missing_skip_nav"),
}


def audit(pages: DataFrame, links: DataFrame | None = None, robots: DataFrame | None = None, sitemap_urls: int | None = None, now: Column | None = None, checks: set[str] | None = None) -> DataFrame:
    """The violations of all checks, or of some by name, whose columns are there.

    A check whose columns are absent or of another type is left out, and the others go on. Row rules share one scan, and rules on
    common keys one grouping.
    """
    have, only = set(pages.columns), None if checks is None else {t for c in checks for t in CHECKS[c]}
    out = [row_violations(pages, only), shared_violations(pages, only)]

    def add(needs: list[str], make: Callable[[], DataFrame], issue: str, *what) -> None:
        if set(needs) <= have and (only is None or issue in only):
            try:
                out.append(_violation(make(), issue, *what))
            except AnalysisException:
                pass

    add(["main_text", "content_hash", "word_count"], lambda: near_duplicates(pages), "near_duplicate_content", "medium", 0.7)
    add(["main_text"], lambda: keyword_stuffing(pages), "keyword_stuffing", "medium", 0.5)
    add(["hreflang_tags"], lambda: hreflang_without_return(pages), "hreflang_missing_return", "high")
    add(["hreflang_tags"], lambda: hreflang_to_error(pages), "hreflang_to_error", "high")
    add(["structured_data"], lambda: stale_content(pages, now if now is not None else F.current_timestamp()), "stale_content", "low", 0.5)
    if links is not None:
        # sources are urls of the links, without a place among the pages
        add(["url_normalized"], lambda: broken_links(pages, links).withColumn("pos", F.xxhash64("url")), "broken_internal_link", "high")
        add(["url_normalized", "depth"], lambda: orphans(pages, links), "orphan_page", "medium")
    if robots is not None:
        told = robots_violations(robots, sitemap_urls).select(*VIOLATION)
        if checks is not None:
            # both checks tell of a missing sitemap, with severities of their own
            of = {"robots": "issue_type like 'robots%' or severity = 'low'", "sitemap": "issue_type = 'sitemap_missing' and severity = 'medium'"}
            told = told.where(" or ".join(f"({of[c]})" for c in of if c in checks) or "false")
        out.append(told)
    total = out[0]
    for v in out[1:]:
        total = total.unionByName(v)
    return total


def details(pages: DataFrame) -> DataFrame:
    """(issue_type, name, value): the figures over all pages that issue rows carry beside their pages; those of absent columns are left out."""
    html = _status() == 200
    sums = [
        ("img_missing_alt", "total_images_missing_alt", F.col("img_missing_alt"), F.lit(True)),
        ("img_missing_dimensions", "total_images_missing_dimensions", F.col("img_missing_dimensions"), F.lit(True)),
        ("empty_link_text", "total_empty_links", F.col("empty_link_count"), html),
    ]
    usable = [(t, n, F.sum(F.when(on, F.coalesce(c, F.lit(0))))) for t, n, c, on in sums if _analysed(pages, c)]
    own = pages.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(t) for t, _, c in usable] or [F.lit(0).cast("long").alias("_")])
    rows = F.array(*[F.struct(F.lit(t).alias("issue_type"), F.lit(n).alias("name"), F.col(t).alias("value")) for t, n, _ in usable] or [F.expr("named_struct('issue_type', '', 'name', '', 'value', 0L)")])
    named = {"title_duplicate": "duplicate_groups", "meta_desc_duplicate": "duplicate_groups", "duplicate_content": "duplicate_clusters"}
    keys = {t: r for t, r in SHARED_RULES.items() if t in named and set(r.needs) <= set(pages.columns)}
    entries = [F.when(F.coalesce(r.base(), F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(named[t]).alias("name"), r.key().alias("key"))) for t, r in keys.items()]
    total = own.select(F.inline(rows)).where("issue_type <> ''")
    if entries:
        each = pages.select(F.inline_outer(F.filter(F.array(*entries), lambda x: x.isNotNull()))).where("issue_type is not null")
        groups = each.groupBy("issue_type", "name", "key").agg(F.count("*").alias("n")).where("n > 1")
        total = total.unionByName(groups.groupBy("issue_type", "name").agg(F.count("*").alias("value")))
        total = total.unionByName(groups.where("issue_type = 'duplicate_content'").groupBy("issue_type").agg(F.sum("n").alias("value")).select("issue_type", F.lit("total_duplicate_pages").alias("name"), "value"))
    return total.where("value > 0")


def rollup(violations: DataFrame, sample: int = 10) -> DataFrame:
    """One row for each (issue_type, severity); the sample keeps the first pages by place, then url, without gathering a whole group.

    The violations are read twice, so their table is kept: the checks run once.
    """
    violations = keep(violations)
    order = Window.partitionBy("issue_type", "severity").orderBy("pos", "url")
    first = violations.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample)
    firsts = first.groupBy("issue_type", "severity").agg(F.sort_array(F.collect_list(F.struct("_r", "url"))).alias("s"))
    counted = violations.groupBy("issue_type", "severity").agg(F.max("confidence").alias("confidence"), F.count("url").alias("affected_urls_count"))
    return counted.join(firsts, ["issue_type", "severity"]).select(
        "issue_type", "severity", "confidence", F.get(F.col("s.url"), F.lit(0)).alias("affected_url"), "affected_urls_count", F.filter("s.url", lambda u: u.isNotNull()).alias("sample_urls")
    )


def severity_order(c: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c), F.lit(0)), F.lit(9))
