"""Substring search over a table of trigrams: a search reads the lists of its rarest trigrams and verifies what they share.

The index is two tables in one folder: for each trigram of each text in small letters the keys of its rows, and how many rows each trigram has. Keys stand in lists, one for each trigram of
some million characters of text: numpy finds those lists, Spark shuffles and sorts them by trigram; a row for each trigram of each text would be twenty times as many. Both tables lie in folders by a
checksum of the trigram, so that a search reads the folders of its own trigrams only (``PartitionFilters`` in the plan). A common trigram's lists are spread over several
files. A search of under three characters has no trigram and scans the texts. Results are those of ``contains(lower(text), lower(needle))``.

Rows of null text are found by nothing; rows that repeat a key are all found if one is a candidate and each is verified on its own text. An empty needle finds all rows with a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.sources.shared import fresh_dir

FOLDERS = 64
#: Trigrams of a needle whose lists are read.
READ = 3
#: Characters of texts whose trigrams are found together, some 60 bytes of memory for each.
PART = 1 << 20
#: Candidate keys that are broadcast to the texts, of some 40 bytes each.
BROADCAST = 100_000


def postings(keys: pa.Array, at: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """For each trigram of some texts the keys of those that have it (``at``: the texts' places among the keys), and how many."""
    codes, docs = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), len(texts)
    letters = np.flatnonzero(np.bincount(codes)) if len(codes) else codes
    size = len(letters)
    if docs > 1 and size**3 * docs >= 1 << 63:  # a trigram and a text must be one number
        for half in (slice(docs // 2), slice(docs // 2, docs)):
            yield from postings(keys, at[half], texts[half])
        return
    doc = np.repeat(np.arange(docs), [len(t) for t in texts])
    inside = doc[:-2] == doc[2:]
    if not inside.any():
        return
    place = np.zeros(int(letters[-1]) + 1, np.int64)
    place[letters] = np.arange(size)
    c = place[codes]
    each = np.unique((((c[:-2] * size + c[1:-1]) * size + c[2:]) * docs + doc[:-2])[inside])
    gram, doc = np.divmod(each, docs)
    heads = np.flatnonzero(np.diff(gram, prepend=-1))
    three = np.stack(np.unravel_index(gram[heads], (size, size, size)), 1)
    chars = letters[three].astype("<u4").tobytes().decode("utf-32-le")
    cuts = np.append(heads, len(each))
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), keys.take(pa.array(np.array(at)[doc])))
    yield pa.RecordBatch.from_arrays([pa.array([chars[i : i + 3] for i in range(0, len(chars), 3)], pa.string()), lists, pa.array(np.diff(cuts), pa.int64())], names=["gram", "keys", "n"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``postings`` of ``PART`` characters at a time; longer texts are cut into pieces, which share a trigram's two characters."""
    for b in batches:
        at, texts, size = [], [], 0
        for i, t in enumerate(b.column(1)):
            t = t.as_py()
            for start in range(0, max(len(t) - 2, 1), PART):
                at.append(i)
                texts.append(t[start : start + PART + 2])
                size += len(texts[-1])
                if size >= PART:
                    yield from postings(b.column(0), at, texts)
                    at, texts, size = [], [], 0
        if texts:
            yield from postings(b.column(0), at, texts)


class Trigrams:
    """The index of a table's text column."""

    def __init__(self, rows: DataFrame, key: str, column: str, path: str | None = None, folders: int = FOLDERS):
        self.rows, self.key, self.column, self.folders = rows, key, column, folders
        self.path = path or fresh_dir(rows.sparkSession, "trigrams")
        kind = rows.schema[key].dataType.simpleString()
        each = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.lower(column).alias("text")).mapInArrow(_postings, f"gram string, keys array<{kind}>, n long")
        each = each.withColumn("folder", (F.crc32(F.encode("gram", "utf-8")) % folders).cast("int"))
        # by a key besides: the lists of a common trigram are several partitions
        lists = each.repartition("folder", (F.xxhash64(F.get("keys", F.lit(0))) % 4)).sortWithinPartitions("folder", "gram")
        lists.write.partitionBy("folder").parquet(f"{self.path}/lists")
        kept = rows.sparkSession.read.schema(f"gram string, keys array<{kind}>, n long, folder int").parquet(f"{self.path}/lists")
        kept.groupBy("folder", "gram").agg(F.sum("n").alias("n")).repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{self.path}/counts")
        self.lists, self.counts = kept, rows.sparkSession.read.schema("gram string, n long, folder int").parquet(f"{self.path}/counts")

    def _of(self, table: DataFrame, grams: list[str]) -> DataFrame:
        """The rows of some trigrams, from their folders alone."""
        return table.where(F.col("folder").isin(*{zlib.crc32(g.encode()) % self.folders for g in grams}) & F.col("gram").isin(*grams))

    def candidates(self, needle: str) -> tuple[DataFrame, int] | None:
        """Keys of rows that hold the needle's rarest trigrams, and at most how many there are; None where the needle has no trigram."""
        low = needle.lower()
        grams = list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))
        if not grams:
            return None
        known = {r.gram: r.n for r in self._of(self.counts, grams).collect()}  # a row for each trigram of the needle
        rare = sorted(grams, key=lambda g: (known.get(g, 0), g))[:READ]
        if rare[0] not in known:
            return self.lists.select(F.explode("keys").alias("key")).limit(0), 0
        met = self._of(self.lists, rare).select("gram", F.explode("keys").alias("key")).groupBy("key").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(rare))
        return met.select("key"), known[rare[0]]

    def search(self, needle: str) -> DataFrame:
        """The rows whose text holds the needle, whatever the case."""
        holds = F.contains(F.lower(self.column), F.lit(needle.lower()))
        got = self.candidates(needle)
        if got is None:
            return self.rows.where(holds)
        keys, most = got
        keys = keys.withColumnRenamed("key", "_key")
        side = F.broadcast(keys) if most <= BROADCAST else keys  # counted in the index
        return self.rows.where(F.col(self.column).isNotNull()).join(side, F.col(self.key) == F.col("_key"), "left_semi").where(holds)
