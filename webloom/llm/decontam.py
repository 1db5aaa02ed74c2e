"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are lower-cased in A-Z and cut into words. A window is ``WINDOW`` consecutive words of an item; an item of
fewer words, but not none, is one window. Words get 64-bit hashes, each ``K`` consecutive words one of those;
of every ``WINDOW - K + 1`` consecutive k-gram hashes the least is the fingerprint of the ``WINDOW`` words that they
cover. Equal windows have equal fingerprints, so every shared span of ``WINDOW`` words is found: a document's
runs of equal fingerprints are joined with the items' fingerprints, and what meets is extended to whole
windows and compared with the items' windows by a 128-bit hash of their exact words. For shorter items the documents' spans of each
length that occurs are looked up as they are.

The fingerprint hashes use ``lower``, which maps more letters together than A-Z: that can only add candidates,
and the comparison of windows has the exact words.

The items' fingerprints and windows are broadcast while they are ``BROADCAST`` rows or fewer, of some 60 bytes each whatever number of items
share a window, else joined by shuffles; the items are joined to the windows that were found. Very long texts are taken whole. Other columns aren't read. Null and empty texts have no words. Rows that repeat doc_id and text each get their row; items that
share an item_id are one item; items without an id take part and count under the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import ascii_lower, materialise, text_digest

#: A word's characters, before lower-casing and after it.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
K = 5
BROADCAST = 1_000_000
#: The fingerprint of the row that each document has besides its hits.
_ROW = 0


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def _grams(hashes: str, n: int, salt: int) -> Column:
    """For each place the hash of n consecutive word hashes."""
    h = F.col(hashes)
    places = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.transform(places, lambda i: F.xxhash64(F.lit(salt), *[_at(h, i + k) for k in range(n)])))


def _least(grams: str, n: int) -> Column:
    """For each place the least of n consecutive grams."""
    g = F.col(grams)
    places = F.sequence(F.lit(0), F.size(g) - n)
    return F.when(F.size(g) >= n, F.transform(places, lambda i: F.least(*[_at(g, i + k) for k in range(n)])))


_RUN = "struct<from:int,to:int,print:bigint,n:int>"


def _run(start: Column, end: Column, print_: Column, n: int) -> Column:
    return F.struct(start.alias("from"), end.alias("to"), print_.cast("long").alias("print"), F.lit(n).alias("n"))


def _heads(prints: str) -> Column:
    """Places where a stretch of equal fingerprints begins."""
    f = F.col(prints)
    return F.when(f.isNotNull(), F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: (i == 0) | (_at(f, i) != _at(f, i - 1))))


def _window_hash(words: Column, start: Column, n: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.transform(F.slice(words, start + 1, n), ascii_lower), " ")))


def _hashed(df: DataFrame) -> DataFrame:
    """words, their hashes and the fingerprints of all windows of ``WINDOW`` words."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    df = df.withColumn("grams", _grams("hashes", K, 1))
    return df.withColumn("prints", _least("grams", WINDOW - K + 1))


def windows(items: DataFrame) -> DataFrame:
    """The items' windows: print, n (words), hash and the sorted ids of the items that hold it."""
    read = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    read = _hashed(read.where(F.size("words") > 0))
    long = read.where(F.size("words") >= WINDOW).select("item", "words", F.posexplode_outer("prints").alias("start", "print"), F.lit(WINDOW).alias("n"))
    n = F.size("hashes")
    short = read.where(F.size("words") < WINDOW).select("item", "words", F.lit(0).alias("start"), F.xxhash64(n, "hashes").alias("print"), n.alias("n"))
    every = long.unionByName(short).select("item", "n", "print", _window_hash(F.col("words"), F.col("start"), F.col("n")).alias("hash"))
    return every.groupBy("print", "n", "hash").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _spans(n: int) -> Column:
    """A run for each n consecutive words, by the hash of an item's only window."""
    at = F.sequence(F.lit(0), F.size("hashes") - n)
    one = F.transform(at, lambda i: _run(i, i + 1, F.xxhash64(F.lit(n), F.slice("hashes", i + 1, n)), n))
    return F.when(F.size("hashes") >= n, one).otherwise(F.array().cast(f"array<{_RUN}>"))


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def hits(docs: DataFrame, known: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """For each distinct (doc_id, mark) of ``docs``: copies, n_words, spans (start, end) of the found windows, and their hashes; known: the items' windows, kept."""
    size = known.count()
    short = sorted(r.n for r in known.where(F.col("n") < WINDOW).select("n").distinct().collect())
    prints = known.select("print").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(_ROW).cast("long").alias("print")))

    read = docs.select(F.col(key).cast("long").alias("id"), text_digest(F.col(column)).alias("mark"), words_of(F.col(column)).alias("words"))
    read = _hashed(read).withColumn("heads", _heads("prints"))
    # a stretch of equal fingerprints is one row; one more row stands for the document. No array that is spread
    # out here is ever empty: the outer forms only keep the optimizer from testing that ahead of the arrays' steps.
    prints_, heads = F.col("prints"), F.col("heads")
    long = F.transform(heads, lambda i, j: _run(i, F.coalesce(_at(heads, j + 1), F.size(prints_)), _at(prints_, i), WINDOW))
    none = F.array().cast(f"array<{_RUN}>")
    parts = [F.array(_run(F.lit(-1), F.lit(0), F.lit(_ROW), 0)), F.coalesce(long, none)]
    parts += [_spans(n) for n in short]
    read = read.select("id", "mark", "words", F.size("words").cast("long").alias("n_words"), F.concat(*parts).alias("runs"))
    if size <= BROADCAST:
        met = read.select("id", "mark", "words", "n_words", F.inline_outer("runs")).join(F.broadcast(prints), "print", "left_semi")
    else:
        asked = read.select("id", "mark", F.inline_outer("runs")).join(prints, "print", "left_semi").distinct()
        by_doc = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("from", "to", "print", "n")).alias("runs"))
        met = read.select("id", "mark", "words", "n_words").join(by_doc.withColumnsRenamed({"id": "id_", "mark": "mark_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")))
        met = met.select("id", "mark", "words", "n_words", F.inline_outer("runs"))
    # only the words of a run go on: a long text with many runs would be copied with each of them. The generator of one row
    # keeps the optimizer from putting the whole words back into the next step
    part = F.slice("words", F.greatest(F.lit(1), F.col("from") + 1), F.greatest(F.lit(0), F.col("to") - F.col("from") + F.col("n") - 1))
    met = met.select("id", "mark", "n_words", "print", "n", "from", "to", F.explode(F.array(part)).alias("part"))
    each = F.transform(F.sequence("from", F.col("to") - 1), lambda i: F.struct(i.alias("start"), F.when(i >= 0, _window_hash(F.col("part"), i - F.col("from"), F.col("n"))).alias("hash")))
    met = met.select("id", "mark", "n_words", "print", "n", each.alias("each"))
    spread = met.select("id", "mark", "n_words", "print", "n", F.inline_outer("each"))
    found = spread.join(_sized(known.select("print", "n", "hash", F.lit(True).alias("there")), size), ["print", "n", "hash"], "left")
    found = found.where("start < 0 or there")
    span = F.when(F.col("start") >= 0, F.struct("start", (F.col("start") + F.col("n")).alias("end")))
    by_doc = found.groupBy("id", "mark").agg(
        F.count(F.when(F.col("start") < 0, 1)).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.collect_set(F.when(F.col("there"), F.col("hash"))).alias("windows"),
    )
    return by_doc


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def judge(docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """For each row its key, n_words, n_hit, n_items, items_sha256, contaminated."""
    known = materialise(windows(items))
    by_doc = materialise(hits(docs, known, key, column))
    # a window's hash, of its exact words, names it
    hit = by_doc.where(F.size("windows") > 0).select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), F.explode("windows").alias("hash"))
    named = hit.join(known.select("hash", F.explode("items").alias("item")), "hash").groupBy("id_", "mark_").agg(F.array_sort(F.collect_set("item")).alias("items_"))
    got = by_doc.join(named, F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left")
    got = got.withColumn("items", F.coalesce("items_", F.array().cast("array<string>"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    n_hit = covered(F.col("spans"))
    return got.select(
        F.col("id").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    bad = hits(docs, materialise(windows(items))).where(F.size("spans") > 0).select(F.col("id").alias("_wl_id"), F.col("mark").alias("_wl_mark"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_wl_id")) & (text_digest(docs["text"]) == F.col("_wl_mark")), "left_anti")
