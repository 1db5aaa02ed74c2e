"""Cross-tokenizer alignment: two tokenizers' tokens of the same text, cut into groups and linked where they overlap.

Tasks take some texts at a time. A, byte-level BPE, encodes a space and the text; B, byte-pair pieces with byte fallback, encodes the text, before
which it puts the space itself. A's file is that of the tokenizers library; tiktoken, which takes its vocabulary as ranks, gives the same ids in a fourth of the time (compared
for every code point). Each token's end is the number of bytes up to it. Where ends of A lie among those of B gives cuts, groups and links (``overlaps``, in numpy for some hundred
texts at once: Spark's array functions took twice as long for it as both tokenizers). All that is counted over documents is Spark's.

Null and empty texts have no tokens, nor have texts whose joined bytes differ from the space and the text in either (B turns U+2581 into a space): zeros, and an
empty string for the groups. Repeated rows each get their row and each count as a document; rows of null key take part. Texts are taken whole; very long
texts take memory for their arrays, some 40 bytes for each token. Other columns aren't read. An empty table gives none.

Counts of id pairs are made over all documents and kept in the shared folder. Up to ``BROADCAST`` pairs, of some 60 bytes each, they are broadcast; more are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import lean, worker_cache, written

BROADCAST = 1_000_000
#: Bytes of text whose tokens are handed back together.
PART_BYTES = 256 << 10
_SPACE = "▁"


class _Pair:
    """Both tokenizers, made on a worker from what the driver sends."""

    def __init__(self, a: str, b: bytes, pattern: str):
        import sentencepiece

        from webloom.llm.bpe import byte_characters, encoder

        spec = json.loads(a)
        model = spec["model"]
        back = {c: n for n, c in enumerate(byte_characters())}
        made = {t: i for t, i in model["vocab"].items() if all(c in back for c in t) and t not in {x["content"] for x in spec["added_tokens"]}}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [made["".join(m)] for m in pairs]
        if order != sorted(order):
            raise ValueError("A's ids aren't in the order of its merges")
        ranks = {bytes(back[c] for c in t): i for t, i in made.items()}
        self.a = encoder(ranks, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([*map(len, x)], np.int32) for x in (self.bytes_a, self.bytes_b))
        # each id's digits in eight bytes, the last of which is for what follows it
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(8, b"\0") for i in range(max(len(self.bytes_a), len(self.bytes_b)))), "<u8")

    def encode(self, text: str | None) -> list[np.ndarray]:
        """ids and ends of A, ids and ends of B; empty where there are no tokens."""
        if not text:
            return [np.empty(0, np.int32)] * 4
        a, b, want = np.array(self.a(" " + text), np.int32), self.b.encode(text), (" " + text).encode("utf-8", "replace")
        # A has a token for each byte and loses none
        if int(self.sizes_a[a].sum()) != len(want) or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return [np.empty(0, np.int32)] * 4
        b = np.array(b, np.int32)
        return [a, np.cumsum(self.sizes_a[a], dtype=np.int32), b, np.cumsum(self.sizes_b[b], dtype=np.int32)]


def _pair(sent) -> _Pair:
    kept, (a, b, pattern) = worker_cache(), sent.value
    name = hashlib.sha256(a.encode() + b + pattern.encode()).digest()
    if name not in kept:
        kept.clear()
        kept[name] = _Pair(a, b, pattern)
    return kept[name]


def models(a: str | None = None, b: str | None = None) -> tuple[str, bytes, str]:
    """The files of both tokenizers, and the pattern by which A cuts a text."""
    import public_tokenizers

    with open(a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read(), public_tokenizers.PATTERN


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending ends over the same bytes: the last places of A and of B in each group, and the places of A and B of each link with how many each token of A has."""
    reach = np.searchsorted(ends_b, ends_a)  # B's token with A's last byte
    cut = ends_b[reach] == ends_a
    first = np.concatenate([np.zeros(1, reach.dtype), (reach + cut)[:-1]])[: len(reach)]
    n = reach - first + 1
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first, n)
    to_a = np.flatnonzero(cut)
    return to_a, reach[to_a], i, j, n


class _Part:
    """Tokens, groups and links of some texts, one after the other; the texts' places in each are ``of_a`` and so on."""

    def __init__(self, rows: list[list[np.ndarray]]):
        starts = lambda sizes: np.cumsum([0, *sizes], dtype=np.int64)
        self.of_a, self.of_b = (starts(len(r[k]) for r in rows) for k in (0, 2))
        self.a, self.ends_a, self.b, self.ends_b = (np.concatenate([r[k] for r in rows]) for k in range(4))
        base = starts(int(r[1][-1]) if len(r[1]) else 0 for r in rows)[:-1]
        every_a, every_b = (e + np.repeat(base, np.diff(of)) for e, of in ((self.ends_a, self.of_a), (self.ends_b, self.of_b)))
        self.to_a, self.to_b, self.i, self.j, n = overlaps(every_a, every_b)
        self.of_links = np.concatenate([[0], np.cumsum(n)])[self.of_a]
        self.of_groups = np.searchsorted(self.to_a, self.of_a)

    def links(self) -> pa.Array:
        """Pairs of ids, each as one number."""
        return _lists(self.of_links, self.a[self.i].astype(np.int64) << 32 | self.b[self.j], pa.int64())

    def group_texts(self, digits: np.ndarray) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of A and B in each group, in order."""
        end_a, end_b = self.to_a + 1, self.to_b + 1
        before = np.concatenate([[0], end_b])[:-1]  # tokens of B in earlier groups
        at_a = np.arange(len(self.a)) + np.repeat(before, np.diff(end_a, prepend=0))
        at_b = np.arange(len(self.b)) + np.repeat(end_a, np.diff(end_b, prepend=0))
        words, after = np.empty(len(self.a) + len(self.b), "<u8"), np.full(len(self.a) + len(self.b), ord(","), np.uint64)
        words[at_a], words[at_b] = digits[self.a], digits[self.b]
        after[at_a[self.to_a]], after[at_b[self.to_b]] = ord("|"), ord(";")
        raw = (words | after << np.uint64(56)).astype("<u8").tobytes()
        of = (8 * (self.of_a + self.of_b)).tolist()
        return (raw[x:y].translate(None, b"\0")[:-1] for x, y in zip(of, of[1:]))


def _lists(of: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(values, kind))


def _in_parts(docs: DataFrame, a: str | None, b: str | None, key: str, column: str, columns: Callable[[_Pair, _Part], list], fields: list[T.StructField]) -> DataFrame:
    """key and what ``columns`` makes of some texts at a time."""
    sent = lean(docs).sparkSession.sparkContext.broadcast(models(a, b))
    names = ["key", *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(sent)
        part = lambda keys, rows: pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns(pair, _Part(rows))], names=names)
        for batch in batches:
            keys, rows, size = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py()
                keys.append(k.as_py())
                rows.append(pair.encode(t))
                size += len(t or "")
                if size > PART_BYTES:
                    yield part(keys, rows)
                    keys, rows, size = [], [], 0
            if keys:
                yield part(keys, rows)

    read = docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    return read.mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), *fields]))


def _arrays(*names: str, of: T.DataType = T.IntegerType()) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(of, False)) for n in names]  # of elements that are never null steps need less care


def align(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, a, ends_a, b, ends_b (in bytes of the space and the text), groups (from and to places of A and B, inclusive) and links (a, b) of each row."""

    def columns(pair: _Pair, p: _Part) -> list:
        int32 = lambda of, x: _lists(of, x.astype(np.int32), pa.int32())
        of_a, of_b = (np.repeat(of[:-1], np.diff(p.of_groups)) for of in (p.of_a, p.of_b))
        tokens = [int32(p.of_a, p.a), int32(p.of_a, p.ends_a), int32(p.of_b, p.b), int32(p.of_b, p.ends_b)]
        return [*tokens, int32(p.of_groups, p.to_a - of_a), int32(p.of_groups, p.to_b - of_b), p.links()]

    got = _in_parts(docs, a, b, key, column, columns, _arrays("a", "ends_a", "b", "ends_b", "to_a", "to_b") + _arrays("pairs", of=T.LongType()))
    start = lambda c, g: F.coalesce(F.get(c, g - 1), F.lit(-1)) + 1
    group = F.transform("to_a", lambda x, g: F.struct(start("to_a", g).alias("from_a"), x.alias("to_a"), start("to_b", g).alias("from_b"), F.get("to_b", g).alias("to_b")))
    links = F.transform("pairs", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("a"), x.bitwiseAND(0x7FFFFFFF).cast("int").alias("b")))
    return got.select(F.col("key").alias(key), "a", "ends_a", "b", "ends_b", group.alias("groups"), links.alias("links"))


def digests(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", column: str = "text", most: int = BROADCAST) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""

    def columns(pair: _Pair, p: _Part) -> list:
        sizes = [pa.array(np.diff(of), pa.int64()) for of in (p.of_a, p.of_b, p.of_groups)]
        return [*sizes, pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in p.group_texts(pair.digits)], pa.string()), p.links()]

    fields = [*(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")), T.StructField("groups_sha256", T.StringType()), *_arrays("links", of=T.LongType())]
    got = _in_parts(docs, a, b, key, column, columns, fields).withColumn("row", F.monotonically_increasing_id())
    got = written(got, "links")
    counts = written(got.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count("*").alias("n")), "pairs")
    first = F.shiftright("link", 32)
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    pairs = counts.join(best, first == F.col("a")).select("link", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    each = got.select("row", F.explode("links").alias("link"))
    if counts.count() <= most:
        met = each.join(F.broadcast(pairs), "link").withColumn("times", F.lit(1).cast("long"))
    else:
        met = each.groupBy("row", "link").agg(F.count("*").alias("times")).join(pairs, "link")
    sums = met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return got.drop("links").join(sums, "row", "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
