"""SimHash near-dedup: fingerprints, pigeonhole blocks, exact Hamming links, components.

A text is lower-cased in A-Z, cut into words at ASCII white space and into shingles of three words, repeats
included (a text of fewer words is one shingle); a fingerprint bit is 1 if it is set in over half of the shingles'
XXH64 hashes (seed 42). A text without words has fingerprint zero. Fingerprints link at ``DISTANCE`` = 2 or fewer differing bits.

Equal fingerprints are one node. Of four blocks of 16 bits, two nodes that link agree in two at least, so nodes
are grouped by each of the six pairs of blocks and compared within a group only. A group of more than ``GROUP``
nodes is cut again: its open bits are four smaller blocks, of which two must agree; after two such cuts, 8 bits are
open, so no group has over 256 nodes, and none is dropped. Links become components by large-star and
small-star steps, whose tables are kept in the shared folder.

A component's id is its smallest doc_id (null if all its doc_ids are null). Null texts count as empty;
repeated rows each get their row; ties of doc_id go to the text's digest. Very long texts are taken whole, 65,536 shingles at a time. doc_id must be an
integer or cast to one; other columns aren't read, and ``keep_one`` returns them, whatever their names but ``_wl_``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import few, lean, materialise, text_digest

SHINGLE = 3
SEED = 42
DISTANCE = 2
GROUP = 256


def fingerprint(text: str | None) -> int:
    """As a signed integer of 64 bits."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_digest
    n = max(1, len(w) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)))) if n > 1 or len(w) == SHINGLE else [b" ".join(w)]
    votes = np.zeros(64, np.int64)
    while part := list(itertools.islice(shingles, 65536)) if not isinstance(shingles, list) else shingles:
        bits = np.frombuffer(b"".join([digest(s, SEED) for s in part]), np.uint8).reshape(-1, 8)
        # a byte's bits, counted from a table of the byte values
        for k in range(8):
            votes[8 * k : 8 * k + 8] += np.bincount(bits[:, k], minlength=256) @ _BITS
        if isinstance(shingles, list):
            break
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


#: The bits of each byte value, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, mark (digest of the text) and fp for each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = pa.array([fingerprint(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], names=["doc_id", "mark", "fp"])

    read = lean(docs).select(F.col(key).cast("long").alias("doc_id"), text_digest(F.col("text")).alias("mark"), "text")
    return read.mapInArrow(run, "doc_id long, mark binary, fp long")


def _masks(fixed: list[int], width: int) -> list[int]:
    """For each mask, those that also fix two of four blocks of its open bits; blocks of ``width`` bits."""
    out = []
    for m in fixed:
        free = [b for b in range(64) if not m >> b & 1]
        parts = [sum(1 << b for b in free[k * width : (k + 1) * width]) for k in range(4)]
        out += [m | x | y for x, y in itertools.combinations(parts, 2)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(u, v), u > v, of all distinct fingerprints that differ in at most two bits; ``nodes`` has distinct fp."""
    found, masks = None, [0]
    rows = nodes.select("fp", F.lit(0).alias("kind"))
    for width in (16, 8, 4):
        masks = _masks(masks, width)
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        kinds = F.explode(F.sequence(F.col("kind") * 6, F.col("kind") * 6 + 5))
        keyed = rows.select("fp", kinds.alias("kind")).select("fp", "kind", F.col("fp").bitwiseAND(F.element_at(table, F.col("kind") + 1)).alias("block"))
        size = keyed.groupBy("kind", "block").agg(F.count("*").alias("size")).where("size > 1")
        last = width == 4
        small = size if last else size.where(F.col("size") <= group)
        lists = keyed.join(small.select("kind", "block"), ["kind", "block"]).groupBy("kind", "block").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        close = lambda x: F.transform(F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)), lambda y: F.struct(y.alias("u"), x.alias("v")))
        pairs = lists.select(F.flatten(F.transform("fps", close)).alias("pairs")).select(F.inline_outer("pairs")).where("u is not null")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        large = size.where(F.col("size") > group).select("kind", "block")
        if large.isEmpty():
            break
        rows = keyed.join(large, ["kind", "block"]).select("fp", "kind")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with links; root is the smallest node that it reaches. Edges: (u, v), u > v."""
    edges = materialise(edges.select("u", "v"))
    size = edges.count()
    if not size:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(few(small.where("u <> v").distinct(), size, 50_000))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp, component_id for each row of ``docs``, with its component's first row (lead_id, lead_mark)."""
    marked = materialise(fingerprints(docs))
    lead = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    nodes = materialise(marked.groupBy("fp").agg(F.min(lead).alias("lead")))
    roots = components(links(nodes.select("fp")))
    node = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    first = node.groupBy("root").agg(F.min("lead").alias("lead"))
    named = node.select("fp", "root").join(first, "root").select("fp", "lead")
    return marked.join(named, "fp").select("doc_id", "mark", "fp", F.col("lead.doc_id").alias("component_id"), F.col("lead.mark").alias("lead_mark"))


def keep_one(docs: DataFrame, got: DataFrame | None = None) -> DataFrame:
    """One row of each component: that of the smallest doc_id, ties by the text's digest; of rows that repeat both, one. got: other components than those of ``groups``."""
    got = groups(docs) if got is None else got
    lead = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("lead_mark"))
    kept = got.where(lead).groupBy(F.col("doc_id").alias("_wl_id"), F.col("mark").alias("_wl_mark")).agg(F.count("*").alias("_wl_n"))
    left = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_wl_id")) & (text_digest(docs["text"]) == F.col("_wl_mark")))
    once = left.where("_wl_n = 1").select(*docs.columns)
    return once.unionByName(left.where("_wl_n > 1").dropDuplicates(["_wl_id", "_wl_mark"]).select(*docs.columns))
