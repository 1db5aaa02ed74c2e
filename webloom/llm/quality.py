r"""Quality rules, line first, in DataFrame functions only.

Words are stretches without ASCII white space. A text that has under ``LEAST_WORDS`` words, or whose words stand to over ``MOST_REPEATED`` percent in
windows of three words that it repeats, fails as a whole. All others are cleaned line by line: a line goes that fails one of three rules,

* punctuation: signs that prose hardly has make over an eighth of its characters other than white space, or it has ``LONG_LINE`` words and no end mark;
* navigation: two and more separators stand alone as words and are a fourth of its words, or it has ``MENU_WORDS`` words at most and begins like a menu;
* boilerplate: it holds a phrase of ``BOILERPLATE``;

and a text that loses more than ``MOST_LOST`` percent of the characters of its lines (those with a word) is rejected. Repeated windows are found on the
sorted windows of the row itself, by hash and then by their exact words, so no text is spread over rows.

Null texts count as empty: no words, no lines, rejected. Texts without words likewise. Very long texts are taken whole; a task holds the windows of one at a
time, some 150 bytes for each word. Each row is judged alone: ties don't arise and repeated rows each get their row; empty tables give none. The key is cast
to long; other columns aren't read by ``judge``, and ``clean`` returns them, whatever their names but ``_wl_``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import ascii_lower
from webloom.operators.rules import let

#: ASCII white space, the characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED = 50
MOST_LOST = 30
LONG_LINE = 10
MENU_WORDS = 6

#: Signs that prose hardly has, and end marks in a row.
SIGNS = r"[#*$%&|<>{}~^=_\\]+|[!?]{2,}"
ENDS = (".", "!", "?", ":", ";", "…", "。", "！", "？", '"', "'", "”", "’", "»", ")", "]")
SEPARATORS = ("|", ">", ">>", "»", "›", "·", "•", "/", "-", "::")
MENU = r"^[ \t\x0B-\x0D]*(home|menu|main menu|search|log ?in|log ?out|sign (in|up|out)|next|previous|prev|back to|share|tweet|skip to|read more|view all|load more|contact us|about us|site ?map)([ \t,.:;|>/!?]|$)"
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "enable javascript",
    "javascript is disabled",
    "subscribe to our",
    "sign up for our",
    "click here to",
    "powered by",
    "lorem ipsum",
    "follow us on",
    "leave a reply",
    "this site is protected by",
)


def _words(t: Column) -> Column:
    t = F.btrim(t, F.lit(BLANKS))
    return F.when(t != "", F.split(t, r"[ \t\x0A-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _repeated(w: Column) -> Column:
    """How many words stand in windows of three words that occur twice and more."""
    # 32 bits of a window's hash and its place in one number: windows that share the bits are next to each other once sorted
    low = F.lit((1 << 32) - 1)
    places = F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 3)
    key = lambda i: F.shiftleft(F.xxhash64(*[F.get(w, (i + k).cast("int")) for k in range(3)]), 32).bitwiseOR(i)
    near = lambda x, y: F.coalesce(x.bitwiseXOR(y).between(0, low), F.lit(False))
    alike = lambda s: F.filter(s, lambda x, j: near(x, F.get(s, j + 1)) | near(x, F.get(s, j - 1)))
    # what is left are repeated windows and a few others: their words tell
    window = lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("w"), i.alias("i"))
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    twice = lambda s: F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1))), lambda x: x["i"])
    told = lambda c: F.sort_array(F.transform(c, lambda x: window(x.bitwiseAND(low).cast("int"))))
    total = lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get(at, j - 1), p - 3))), F.lit(0), lambda a, x: a + x)
    found = let(F.sort_array(F.transform(places, key)), lambda s: let(told(alike(s)), lambda c: let(F.sort_array(twice(c)), total)))
    return F.when(F.size(w) >= 4, found).otherwise(F.lit(0))


def failing(line: Column) -> Column:
    """The rule that a line with a word fails, else null; steps that few lines need come last."""
    n = F.size(_words(line))
    apart = F.size(F.filter(_words(line), lambda x: x.isin(*SEPARATORS)))
    signs = F.length(line) - F.length(F.regexp_replace(line, SIGNS, ""))
    unended = ~F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1).isin(*ENDS) & (n >= LONG_LINE)

    def told(low: Column) -> Column:
        parted = F.rlike(line, F.lit(r"[|>»›·•/\-:][ \t\x0B-\x0D]")) & (apart >= 2) & (apart * 4 >= n)
        menu = F.rlike(low, F.lit(MENU)) & (n <= MENU_WORDS)
        phrase = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE])
        return F.when((signs * 8 > F.length(line)) | unended, "punctuation").when(parted | menu, "navigation").when(phrase, "boilerplate")

    return let(ascii_lower(line), told)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def measures(docs: DataFrame, column: str = "text", before: list[Column | str] | None = None) -> DataFrame:
    """For each row the columns of ``before``, the base measures, what its lines lose, and the verdicts."""
    t = F.coalesce(F.col(column), F.lit(""))

    def words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words"))

    def lines(x: Column) -> Column:
        chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, y: n + F.length(y["line"]))
        count = lambda rule: F.size(F.filter(x, lambda y: y["rule"] == rule)).cast("long")
        return F.struct(
            (F.size(x) - F.size(F.array_distinct(F.transform(x, lambda y: y["line"])))).cast("long").alias("n_dup_lines"),
            F.size(x).cast("long").alias("n_lines"),
            chars(x).alias("n_line_chars"),
            chars(F.filter(x, lambda y: y["rule"].isNotNull())).alias("n_lost_chars"),
            *[count(r).alias(f"n_{r}") for r in ("punctuation", "navigation", "boilerplate")],
        )

    own = F.transform(F.filter(F.split(t, "\n", -1), _has_word), lambda x: F.struct(x.alias("line"), failing(x).alias("rule")))
    got = docs.select(
        *(before or []),
        let(_words(t), words).alias("_wl_w"),
        let(own, lines).alias("_wl_l"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n, lost = F.col("_wl_w.n_words"), F.col("_wl_l.n_lost_chars")
    failed = (n < LEAST_WORDS) | (F.col("_wl_w.n_repeat_words") * 100 > n * MOST_REPEATED)
    got = got.select(*[c for c in got.columns if c not in ("_wl_w", "_wl_l")], "_wl_w.*", "_wl_l.*", failed.alias("base_failed"), (~failed & (lost * 100 <= F.col("_wl_l.n_line_chars") * MOST_LOST)).alias("kept"))
    return got


def judge(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and what the lines lose by rule."""
    got = measures(docs, column, [F.col(key).cast("long").alias("_wl_id")])
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return got.select(F.col("_wl_id").alias(key), *first, *[c for c in got.columns if c not in [*first, "_wl_id"]])


def clean(docs: DataFrame, column: str = "text", removed: str | None = None) -> DataFrame:
    """The rows that are kept, their texts without the lines that fail; ``removed``: a column for those lines (number from 0, line, rule)."""
    row = F.struct("*").alias("_wl_row")
    got = measures(docs, column, [row]).where("kept")
    t = F.coalesce(F.col(f"_wl_row.`{column}`"), F.lit(""))
    every = F.transform(F.split(t, "\n", -1), lambda x, i: F.struct(i.cast("long").alias("number"), x.alias("line"), F.when(_has_word(x), failing(x)).alias("rule")))
    got = got.select("_wl_row", let(every, lambda a: F.struct(F.array_join(F.transform(F.filter(a, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("text"), F.filter(a, lambda x: x["rule"].isNotNull()).alias("removed"))).alias("_wl_got"))
    columns = [F.col("_wl_got.text").alias(c) if c == column else F.col(f"_wl_row.`{c}`").alias(c) for c in docs.columns]
    return got.select(*columns, *([F.col("_wl_got.removed").alias(removed)] if removed else []))
