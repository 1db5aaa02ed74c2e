"""Near-duplicates of similarity 0.8 or more: MinHash fingerprints propose pairs, exact shingle sets decide.

A text is lower-cased in A-Z, cut into words at ASCII white space and into the set of its shingles of five words (a
text of fewer words is one shingle, one without words has none). Texts link if the Jaccard similarity of their sets is
``SIMILARITY`` or more. Equal sets are one node. A node has ``BANDS`` fingerprints of ``ROWS`` minima each; nodes that
share one are compared. A pair of similarity s shares none with a chance of (1 - s^ROWS)^BANDS: 3 in a million at 0.8,
less above. No pair that is less similar links.

In each group of nodes with a common fingerprint, all are first compared with that of the smallest doc_id; what that links is one
component. Then all pairs of a group of up to ``GROUP`` nodes that lie in different components are compared. The nodes of
larger groups get ``FINER`` more fingerprints of more minima, which pairs of less similarity seldom share; of the pairs
of different components in those groups, those are compared of which no more than so many of ``BITS`` bits of the minima differ as
all but 1 in 4000 pairs of similarity 0.8 have, and so the work doesn't grow with the square of a crowded group. In
crowded groups alone, a pair that only its own link would join is missed with a chance of 1 in 100 at a similarity of 0.8, 1 in
1000 at 0.82 and 1 in a million at 0.85. A component's lead is its row of the smallest doc_id (null last, ties by the text's digest).

Null texts are empty. Texts without words, and empty ones, are one node. Repeated rows are in one component. Very long texts are taken whole. doc_id
must be an integer or cast to one; other columns aren't read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import few, lean, materialise, text_digest, written
from webloom.llm.simhash import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: Nodes of a group whose pairs are all compared; fingerprints and minima for the nodes of larger groups, and nodes of a block of those.
GROUP = 32
FINER = (256, 18)
BLOCK = 256
#: One bit each of so many minima, and how many standard deviations beyond the expected ones may differ.
BITS = 2048
SPREAD = 3.5
#: Rows of a batch that are worked on together.
SLICE = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=8)
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, w), np.uint64, len(w))
    size = min(size, len(w))
    x = np.zeros(max(0, len(w) - size + 1) if w else 0, np.uint64)
    for k in range(size):
        x = _mixed(x * _MIX + h[k : len(h) - size + 1 + k])
    return np.unique(x)


def minima(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The mixed minima of n permutations."""
    a, least = _odd(n, seed), np.full(n, np.iinfo(np.uint64).max)
    step = max(1, 65536 // n)
    for lo in range(0, len(x), step):
        least = np.minimum(least, (x[lo : lo + step, None] * a).min(axis=0))
    return _mixed(least)


def sketch(x: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A fingerprint for each band: a hash of the minima of ``rows`` permutations."""
    return _banded(minima(x, bands * rows, rows), bands, rows)


def _banded(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = (least.reshape(bands, rows) * _odd(rows, 2)).sum(axis=1, dtype=np.uint64)
    return _mixed(key + np.arange(1, bands + 1, dtype=np.uint64) * _MIX).view(np.int64)


def most_bits(similarity: float) -> int:
    """Differing bits that a pair of the similarity may have."""
    p = (1 - similarity) / 2
    return math.floor(BITS * p + SPREAD * math.sqrt(BITS * p * (1 - p)))


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (digest of the text), node (hash of the set) and keys (the fingerprints) for each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, SLICE):
                p = b.slice(at, SLICE)
                node, keys = np.zeros(p.num_rows, np.int64), np.zeros((p.num_rows, bands), np.int64)
                for k, t in enumerate(p.column(2)):
                    x = shingles(t.as_py(), shingle)
                    node[k], keys[k] = np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64), sketch(x, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(p.num_rows + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(node), lists], names=["doc_id", "mark", "node", "keys"])

    read = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("mark"), "text")
    return read.mapInArrow(run, "doc_id long, mark binary, node long, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of some nodes (node, lead), from their leads' texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, SLICE):
                p = b.slice(at, SLICE)
                sets = pa.array([shingles(t.as_py(), shingle).view(np.int64) for t in p.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([p.column(0), sets], names=["node", "set"])

    lead = nodes.select("node", F.col("lead.doc_id").alias("_id"), F.col("lead.mark").alias("_mark"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = texts.join(lead, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_digest(F.col("text")) == F.col("_mark")))
    # rows that repeat doc_id and text give a set more than once
    return met.select("node", "text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar enough."""
    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("x")), sets.select(F.col("node").alias("v"), F.col("set").alias("y"))
    m, n = F.size("x"), F.size("y")
    near = F.least(m, n) >= F.lit(similarity) * F.greatest(m, n) - 1e-9
    # shared >= similarity * (m + n - shared)
    alike = F.size(F.array_intersect("x", "y")) * F.lit(1 + similarity) >= F.lit(similarity) * (m + n) - 1e-9
    return pairs.join(left, "u").join(right, "v").where(near & alike).select("u", "v")


def _across(rows: DataFrame, block: int, bits: DataFrame | None = None, most: int = 0) -> DataFrame:
    """(u, v), u > v, of the nodes of a key that lie in different components; rows: (key, node, root); bits: (node, bits) of which no more than ``most`` may differ."""
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    some = rows.join(size.select("key", blocks.alias("blocks")), "key").select("key", "node", "root", "blocks", own.alias("own"))
    some = some.withColumn("bits", F.array().cast("array<long>")) if bits is None else some.join(bits, "node")
    # each two blocks of a group meet once
    dealt = some.select("key", "node", "root", "own", "bits", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct("node", "root", "own", "bits").alias("x"))
    lists = dealt.groupBy("key", "i", "j").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    differ = lambda x, y: F.aggregate(F.zip_with(x["bits"], y["bits"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    near = (lambda x, y: F.lit(True)) if bits is None else lambda x, y: differ(x, y) <= most
    fits = lambda x, y: (y["node"] < x["node"]) & (y["root"] != x["root"]) & ((F.col("i") == F.col("j")) | (x["own"] != y["own"])) & near(x, y)
    of = lambda x: F.transform(F.filter("xs", lambda y: fits(x, y)), lambda y: F.struct(x["node"].alias("u"), y["node"].alias("v")))
    pairs = lists.select(F.flatten(F.transform("xs", of)).alias("pairs")).select(F.inline_outer("pairs")).where("u is not null")
    return pairs.distinct()


def _finer(rows: DataFrame, bands: int, per: int) -> DataFrame:
    """(node, root, keys, bits) of (node, root, set): more fingerprints, and bits of their minima."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, SLICE):
                p = b.slice(at, SLICE)
                keys, bits = np.zeros((p.num_rows, bands), np.int64), np.zeros((p.num_rows, BITS // 64), np.int64)
                for k, x in enumerate(p.column(2)):
                    least = minima(np.array(x.values.to_numpy()).view(np.uint64), max(bands * per, BITS), per)
                    keys[k], bits[k] = _banded(least[: bands * per], bands, per), np.packbits(least[:BITS] & np.uint64(1) > 0).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(p.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (keys, bits)]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), *lists], names=["node", "root", "keys", "bits"])

    return rows.mapInArrow(run, "node long, root long, keys array<long>, bits array<long>")


def _joined(marked: DataFrame, also: DataFrame) -> DataFrame:
    """(u, v), u > v: the nodes of each other component (mark, lead_mark), each linked to the smallest; a text has one mark, one node and one such component."""
    own = marked.select("mark", "node").distinct().join(also.select("mark", "lead_mark").distinct(), "mark").select("lead_mark", "node").distinct()
    low = own.groupBy("lead_mark").agg(F.min("node").alias("v"))
    return own.join(low, "lead_mark").where("node <> v").select(F.col("node").alias("u"), "v")


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, group: int = GROUP, finer: tuple[int, int] = FINER, also: DataFrame | None = None) -> DataFrame:
    """doc_id, mark and component_id for each row of ``docs``, with its component's first row (lead_mark). also: other components of the same rows
    (mark, lead_mark), as those of ``simhash.groups``; rows that one of both links, directly or through others, are one component."""
    marked = written(sketches(docs, shingle, bands, rows), "sketches")
    lead = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    nodes = written(marked.groupBy("node").agg(F.min(lead).alias("lead"), F.first("keys").alias("keys")), "nodes")
    marked = marked.drop("keys")
    size = nodes.count()
    # the node of texts without words has no shingle in common with any
    rank = F.coalesce(F.col("lead.doc_id"), F.lit((1 << 63) - 1)).alias("rank")
    keyed = nodes.where(F.col("node") != _empty()).select("node", rank, F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min(F.struct("rank", "node"))["node"].alias("low"), F.count("*").alias("n")).where("n > 1")
    met = written(few(keyed.join(low, "key").select("key", "node", "low", (F.col("n") > group).alias("crowded")), size, 2000), "met")
    most = met.count()
    sets = written(few(_sets(docs, nodes.join(met.select("node").distinct(), "node"), shingle), size, 2000), "sets")
    if also is not None:
        joined = materialise(few(_joined(marked, also), size, 20_000))
    links = materialise(few(_linked(met.where("node <> low").select(F.greatest("node", "low").alias("u"), F.least("node", "low").alias("v")).distinct(), sets, similarity), most, 5000))
    if also is not None:
        links = links.unionByName(joined)
    roots = components(links)
    rooted = materialise(few(met.select("key", "node", "crowded").join(roots, "node", "left").select("key", "node", "crowded", F.coalesce("root", "node").alias("root")), most, 20_000))
    pairs = _across(rooted.where("not crowded"), group)
    apart = rooted.where("crowded").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    crowd = materialise(few(rooted.where("crowded").join(apart, "key", "left_semi").select("node", "root").distinct(), most, 20_000))
    if not crowd.isEmpty():
        # thousands of minima each: dealt evenly
        even = crowd.join(sets, "node").select("node", "root", "set").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        fine = materialise(_finer(even, *finer))
        pairs = pairs.unionByName(_across(fine.select(F.explode("keys").alias("key"), "node", "root"), BLOCK, fine.select("node", "bits"), most_bits(similarity))).distinct()
    more = materialise(few(_linked(pairs, sets, similarity), most, 5000))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    node = nodes.select("node", "lead").join(roots, "node", "left").select("node", "lead", F.coalesce("root", "node").alias("root"))
    first = node.groupBy("root").agg(F.min("lead").alias("lead"))
    named = node.select("node", "root").join(first, "root").select("node", "lead")
    return marked.join(named, "node").select("doc_id", "mark", F.col("lead.doc_id").alias("component_id"), F.col("lead.mark").alias("lead_mark"))


def _empty() -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b"")).view(np.int64))
