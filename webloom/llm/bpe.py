"""Byte-level BPE encoding and decoding with tiktoken over Arrow batches.

The ranks of a .tiktoken file go to the workers, where tiktoken splits whole texts by the pattern and merges each piece by rank; there are no special tokens. Offsets are
characters of the text: a token that holds a part of a character's bytes covers the whole character. Decoding joins the bytes of the ids; a character that tokens split comes
together again there.

Pieces aren't remembered: invented words are mostly new ones, and looking each piece up took longer than merging it again.

Null texts count as empty: no ids, hashes of the empty string. Repeated rows each get their row. Very long texts are encoded whole, with memory
for their ids. The key may be of any type; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import lean, worker_cache

#: White space of this length takes more stack than tiktoken's split has (some million places); such texts are split here.
LONG_SPACE = 100_000


def byte_characters() -> list[str]:
    """For each byte its printable character: itself where Latin-1 prints it, else the next of those from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    """Gives the ids of whole texts, whatever their length."""
    import regex
    import tiktoken

    model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    split, spaces = regex.compile(pattern).findall, regex.compile(rf"\s{{{LONG_SPACE}}}").search

    def encode(text: str) -> list[int]:
        if len(text) > LONG_SPACE and spaces(text):
            return [i for p in split(text) for i in model._encode_single_piece(p)]
        return model.encode_ordinary(text)

    return encode


class Codec:
    """Encodes and decodes texts; made on a worker from what the driver sends."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = parse_ranks(raw)
        self.ids = encoder(ranks, pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of 32 bits."""
        return np.array(self.ids(text), "<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: Iterable[int]) -> list[tuple[int, int]]:
        """For each id the (start, end) characters that its bytes belong to."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids]).astype(int)
        starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else ends
        return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip(starts, ends)]


def _codec(sent) -> Codec:
    kept, (raw, pattern) = worker_cache(), sent.value
    name = hashlib.sha256(pattern.encode() + b"\n" + raw).digest()
    if name not in kept:
        kept.clear()
        kept[name] = Codec(raw, pattern)
    return kept[name]


def codec_parts(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return f.read(), pattern


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", column: str = "text", offsets: bool = False) -> DataFrame:
    """Key and ids (array of long) of each row; with ``offsets`` also starts and ends, in characters."""
    sent = lean(docs).sparkSession.sparkContext.broadcast(codec_parts(path, pattern))
    more = ["starts", "ends"] if offsets else []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(sent)
        for b in parts:
            for at in range(0, b.num_rows, 64):
                p = b.slice(at, 64)
                texts = [t.as_py() or "" for t in p.column(1)]
                ids = [np.frombuffer(c.encode(t), "<u4") for t in texts]
                columns = [pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))]
                if offsets:
                    spans = [c.offsets(t, i.tolist()) for t, i in zip(texts, ids)]
                    columns += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([p.column(0), *columns], names=["key", "ids", *more])

    out = docs.select(F.col(key).alias("key"), F.col(column).alias("text"))
    fields = "".join(f", {c} array<long>" for c in ["ids", *more])
    return out.mapInArrow(run, f"key {dict(out.dtypes)['key']}{fields}").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """Key, data (the bytes of the ids) and text (those bytes as UTF-8, what is broken replaced)."""
    sent = lean(rows).sparkSession.sparkContext.broadcast(codec_parts(path, pattern))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(sent)
        for b in parts:
            for at in range(0, b.num_rows, 64):
                p = b.slice(at, 64)
                data = [c.decode(i.as_py() or ()) for i in p.column(1)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data])], names=["key", "data", "text"])

    out = rows.select(F.col(key).alias("key"), F.col(column).cast("array<long>").alias("ids"))
    return out.mapInArrow(run, f"key {dict(out.dtypes)['key']}, data binary, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Key, n_tokens and the hashes of the ids and of the bytes that they decode to; ids never leave the worker."""
    sent = lean(docs).sparkSession.sparkContext.broadcast(codec_parts(path, pattern))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = _codec(sent), hashlib.sha256
        for b in parts:
            n, ids, back = [], [], []
            for t in b.column(1):
                raw = c.encode(t.as_py() or "")
                n.append(len(raw) // 4)
                ids.append(sha(raw).hexdigest())
                back.append(sha(c.decode(np.frombuffer(raw, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(key).alias("key"), F.col(column).alias("text"))
    return out.mapInArrow(run, f"key {dict(out.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
