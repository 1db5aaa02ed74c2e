"""Hard-negative mining: exact searches over one-dimensional distance keys.

Components become integers, ``floor(scale * x)``. With M the largest norm, a vector x gets one more component, the root of M^2 - |x|^2, and a query q a zero:
then |q - x|^2 = |q|^2 + M^2 - 2<q, x>, so the highest products are the shortest distances. A bounded sample gives pivots; a vector's key is its nearest pivot
and its distance from it. All vectors are stored sorted by (pivot, distance), in shards of a bounded number of bytes that know the range of their
distances. A query at distance d from a pivot can have a vector within r of it only where the key lies in the annulus [d - r, d + r]. The k-th best product known so
far gives r, the distance bound that is left; the first bounds come from the sample. Intervals are scanned with a growing part of r (``STEPS``), the last time with all of it, which
certifies the result; each scan shortens r for the next. Pairs of shards and blocks of queries that an earlier scan has met aren't met again.

First each anchor's positives are searched, among the rows of its label. Then, for each positive, negatives: rows of other labels whose product lies in the
positive's band; the band's upper end leaves out what is nearer, also whole shards.

Rows with a null label or vector, or with null or non-finite components, take no part. Equal products go to the smaller vec_id, rows of null vec_id last; those are
candidates and no anchors. An anchor's own row is left out, not rows that repeat it; repeated anchor rows each get their rows. Vectors of different lengths don't meet, and lengths that the sample
lacks are searched whole. Products beyond the range of long are held at its ends. Anchors without positives, or positives whose band is empty (a negative product), give no rows. Very long vectors make
shards of fewer rows. vec_id and label must be integers or cast to them; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import lean, materialise, written
from webloom.llm.topk import NO_FLOOR, NO_ID, integers, products

EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: Percent of the positive's product: a negative's least and most.
LEAST, MOST = 50, 95
#: Bounds of the sample that gives pivots and first bounds: rows, bytes.
SAMPLE_ROWS = 2048
SAMPLE_BYTES = 8 << 20
PIVOTS = 64
SHARD_BYTES = 2 << 20
BLOCK_ROWS = 512
#: Parts of the distance bound that the scans reach; the last must be 1.
STEPS = (0.7, 1.0)
#: Above all products.
NO_CEILING = 2**63 - 1


class Pivots:
    """The sample of one length of vectors: its rows, pivots and the largest norm of all rows."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, square: float, pivots: int = PIVOTS):
        self.rids, self.ids, self.labels, self.v, self.square = rids, ids, labels, vectors, square
        x = self.augmented(vectors)
        p = x[: max(1, min(pivots, len(x) // 8))]
        for _ in range(5):
            near = ((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)).argmin(1)
            p = np.stack([x[near == k].mean(0) if (near == k).any() else p[k] for k in range(len(p))])
        self.p, self.p2 = p, (p**2).sum(1)

    def augmented(self, v: np.ndarray) -> np.ndarray:
        f = v.astype(np.float64)
        return np.concatenate([f, np.sqrt(np.maximum(0, self.square - (f**2).sum(1)))[:, None]], 1)

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and the distance from it."""
        x = self.augmented(v)
        near = (self.p2 - 2 * x @ self.p.T).argmin(1)
        return near, np.sqrt(((x - self.p[near]) ** 2).sum(1))

    def annuli(self, q: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, part: float) -> tuple[np.ndarray, np.ndarray]:
        """For each pivot the range of keys that any of the queries needs; floor, ceiling: bounds of the products that count."""
        f = q.astype(np.float64)
        q2 = (f**2).sum(1)
        room = 1e-6 * (np.sqrt(self.square) + np.sqrt(q2)) + 1e-9  # for what rounding takes
        away = np.sqrt(np.maximum(0, q2[:, None] + self.p2 - 2 * f @ self.p[:, :-1].T))
        far = np.sqrt(np.maximum(0, q2 + self.square - 2 * floor.astype(np.float64)))
        r = np.where(floor == NO_FLOOR, np.inf, part * far) + room
        near = np.where(ceiling == NO_CEILING, 0, np.sqrt(np.maximum(0, q2 + self.square - 2 * ceiling.astype(np.float64))) - room)
        low = np.maximum(away - r[:, None], near[:, None] - away - room[:, None])
        return low.min(0), (away + r[:, None]).max(0)


def best(s: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row's products that fit, ties by the lower id; ids ascend."""
    if not fits.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if s.shape[1] > k:
        held = np.where(fits, s, NO_FLOOR)
        kth = np.partition(held, -k, axis=1)[:, -k][:, None]
        over = fits & (held > kth)
        ties = fits & (held == kth)
        fits = over | ties & (np.cumsum(ties, axis=1) <= k - over.sum(1)[:, None])
    return np.nonzero(fits)


def _small(v: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A matrix of lists of the same length."""
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def rows_of(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """rid, id, label, v, dim, square of all rows that take part, kept."""
    v = integers(F.col(column), scale)
    read = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v")).where("v is not null and label is not null")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return written(read.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "v", F.size("v").alias("dim"), square.alias("square")), "vectors")


def sample(rows: DataFrame, most: int = SAMPLE_ROWS, pivots: int = PIVOTS) -> dict[int, Pivots]:
    """The sample's pivots by length; bounded by ``most`` rows and ``SAMPLE_BYTES``."""
    longest = rows.agg(F.max("dim")).first()[0] or 0
    n = max(1, min(most, SAMPLE_BYTES // (8 * longest + 32)))
    drawn = rows.orderBy(F.xxhash64("id", "v"), "rid").limit(n).select("rid", "id", "label", "v", "dim").collect()
    squares = {r.dim: r.m for r in rows.where(F.col("dim").isin(*{r.dim for r in drawn})).groupBy("dim").agg(F.max("square").alias("m")).collect()} if drawn else {}  # as many as the sample has lengths
    out = {}
    for d, square in squares.items():
        own = sorted((r for r in drawn if r.dim == d), key=lambda r: NO_ID if r.id is None else r.id)
        v = np.array([r.v for r in own], np.int64).reshape(len(own), d)
        out[d] = Pivots(*(np.array(x, np.int64) for x in ([r.rid for r in own], [NO_ID if r.id is None else r.id for r in own], [r.label for r in own])), v, square, pivots)
    return out


def _keyed(rows: DataFrame, sent) -> DataFrame:
    """Adds pivot and away; the pivot of a length that the sample lacks is -1."""

    @F.pandas_udf("struct<pivot:int,away:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        pivot, away = np.full(len(v), -1, np.int32), np.zeros(len(v))
        size = v.map(len).to_numpy() if len(v) else np.zeros(0)
        for d, p in sent.value.items():
            at = np.flatnonzero(size == d)
            if len(at):
                pivot[at], away[at] = p.keys(np.stack([np.asarray(x, np.int64) for x in v.iloc[at]]))
        return pd.DataFrame({"pivot": pivot, "away": away})

    return rows.withColumn("at", place("v")).select(*rows.columns, "at.*")


def shards_of(rows: DataFrame, sent, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """dim, pivot, lo, hi, shard, data: the rows sorted by (pivot, distance), packed; kept. Equal keys are dealt over shards too."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            dim, pivot, away = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            ids = b.column(4).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(dim) | np.diff(pivot)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                step = max(1, shard_bytes // (8 * int(dim[lo]) + 24)) if hi > lo else 1
                for at in range(lo, hi, step):
                    end = min(at + step, hi)
                    order = np.argsort(ids[at:end], kind="stable")
                    rid, label = (b.column(k).to_numpy(zero_copy_only=False)[at:end][order] for k in (3, 5))
                    v = _small(_matrix(b.column(6).slice(at, end - at))[order])
                    data = pickle.dumps((rid, ids[at:end][order], label, v))
                    one = ([dim[at]], [pivot[at]], [away[at:end].min()], [away[at:end].max()], [made], [data])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary()))], names=["dim", "pivot", "lo", "hi", "shard", "data"])
                    made += 1

    keyed = _keyed(rows, sent).select("dim", "pivot", "away", "rid", "id", "label", "v")
    # the hash last: so many equal keys don't make one range
    ranged = keyed.repartitionByRange("dim", "pivot", "away", F.xxhash64("rid")).sortWithinPartitions("dim", "pivot", "away")
    return written(lean(ranged).mapInArrow(pack, "dim int, pivot int, lo double, hi double, shard long, data binary"), "shards")


_ASKED = "dim int, rid long, label long, v array<long>, targets array<struct<place:int,upper:bigint,floor:bigint>>"


class _Block:
    """A block of queries of one length: their targets flat, with each one's query."""

    def __init__(self, asked: pa.StructArray):
        self.rid, self.label = (asked.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        self.q = _matrix(asked.field(2))
        targets = asked.field(3)
        sizes = targets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = targets.flatten()
        self.of = np.repeat(np.arange(len(self.rid)), sizes)
        self.place, self.upper, self.floor = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))

    def found(self, rids, ids, labels, v, k: int, same: bool):
        """(target's place in the block, product, id) of the k best of each target."""
        s = products(self.q, v.astype(np.int64))
        alike = (self.label[:, None] == labels) == same
        alike &= self.rid[:, None] != rids
        for t, (q, upper, floor) in enumerate(zip(self.of, self.upper, self.floor)):
            fits = alike[q] & (s[q] >= floor) & (s[q] <= upper)
            if fits.any():
                _, x = best(s[q][None], ids, fits[None], k)
                yield t, s[q][x], ids[x]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each query the least product that a target wants, and the greatest."""
        floor, upper = np.full(len(self.rid), NO_CEILING), np.full(len(self.rid), NO_FLOOR)
        np.minimum.at(floor, self.of, self.floor)
        np.maximum.at(upper, self.of, self.upper)
        return floor, upper


def scan(queries: DataFrame, shards: DataFrame, sent, k: int, same: bool, steps: tuple[float, ...] = STEPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rid, place, id, score: for each target of each query the k highest products from floor to upper among the rows of the same label, or of others.

    queries: rid, label, v, dim, targets (place, upper, floor).
    """

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th best of the sample is a first floor."""
        for b in batches:
            dims, targets = b.column(0).to_numpy(zero_copy_only=False), b.column(4).to_pylist()
            for d in np.unique(dims):
                p, at = sent.value.get(int(d)), np.flatnonzero(dims == d)
                if p is not None:
                    own = b.take(pa.array(at))
                    block = _Block(pa.StructArray.from_arrays([own.column(k) for k in (1, 2, 3, 4)], ["rid", "label", "v", "targets"]))
                    start = np.flatnonzero(np.diff(block.of, prepend=-1))
                    for t, s, _ in block.found(p.rids, p.ids, p.labels, p.v, k, same):
                        if len(s) == k:
                            q = block.of[t]
                            targets[at[q]][t - start[np.searchsorted(block.of[start], q)]]["floor"] = int(s.min())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(targets, b.schema.field(4).type)], names=b.schema.names)

    def annuli(part: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, n, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    block, p = _Block(asked.values), sent.value.get(d)
                    low, high = (np.array([-np.inf]), np.array([np.inf])) if p is None else p.annuli(block.q, *block.ranges(), part)
                    pivots = np.array([-1]) if p is None else np.arange(len(low))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), d, np.int32)), pa.array(pivots.astype(np.int32)), pa.array(low), pa.array(high), pa.array(np.full(len(low), n, np.int64))], names=["dim", "pivot", "a", "b", "block"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, asked in zip(b.column(0), b.column(1)):
                block = _Block(asked.values)
                got = list(block.found(*pickle.loads(data.as_py()), k, same))
                t = np.repeat([t for t, *_ in got], [len(s) for _, s, _ in got]).astype(np.int64)
                s, i = (np.concatenate([g[n] for g in got]) if got else np.empty(0, np.int64) for n in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(block.rid[block.of[t]], pa.int64()), pa.array(block.place[t], pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["rid", "place", "id", "score"])

    seeded = lean(queries.select("dim", "rid", "label", "v", "targets")).mapInArrow(seed, _ASKED)
    # queries near each other share a block: their intervals are alike
    near = _keyed(seeded, sent).repartitionByRange("dim", "pivot", "away", F.xxhash64("rid")).sortWithinPartitions("dim", "pivot", "away")
    place = F.monotonically_increasing_id()
    block = F.shiftleft(F.shiftright(place, 33), 33) + F.shiftright(place.bitwiseAND((1 << 33) - 1), int(block_rows).bit_length() - 1)
    now = written(near.select("dim", "rid", "label", "v", "targets", block.alias("block")), "queries")
    meta = shards.select("dim", "pivot", "lo", "hi", "shard")
    order = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "id")
    found = visited = None
    for part in steps:
        asked = F.collect_list(F.struct("rid", "label", "v", "targets")).alias("asked")
        blocks = written(now.groupBy("dim", "block").agg(asked), "blocks")
        wanted = lean(blocks).mapInArrow(annuli(part), "dim int, pivot int, a double, b double, block long")
        pairs = meta.join(wanted, ["dim", "pivot"]).where("lo <= b and hi >= a").select("dim", "shard", "block")
        pairs = pairs if visited is None else pairs.join(visited, ["dim", "shard", "block"], "left_anti")
        pairs = written(pairs, "pairs")
        visited = pairs if visited is None else visited.unionByName(pairs)
        # a block's queries go to each shard that they need, and no vector goes anywhere but in its own shard
        met = pairs.join(blocks, ["dim", "block"]).select("shard", "asked").join(shards.select("shard", "data"), "shard").select("data", "asked")
        got = met.mapInArrow(meet, "rid long, place int, id long, score long")
        found = got if found is None else found.unionByName(got)
        found = materialise(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k))
        kth = found.where(F.col("n") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("kth"))
        raised = F.transform("targets", lambda t: F.struct(t["place"].alias("place"), t["upper"].alias("upper"), F.greatest(t["floor"], F.try_element_at("kth", t["place"])).alias("floor")))
        now = now.join(kth, "rid", "left").select("dim", "rid", "label", "v", raised.alias("targets"), "block")
        found = found.drop("n")
    return found


def mine(table: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, key: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = 256, least: int = LEAST, most: int = MOST, shard_bytes: int = SHARD_BYTES, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS, pivots: int = PIVOTS, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors: rows whose key is divisible by ``every``."""
    rows = rows_of(table, key, column, label, scale)
    sent = rows.sparkSession.sparkContext.broadcast(sample(rows, sample_rows, pivots))
    shards = shards_of(rows, sent, shard_bytes)
    anchors = rows.where(F.col("id") % every == 0)
    target = lambda place, upper, floor: F.struct(place.cast("int").alias("place"), upper.cast("long").alias("upper"), floor.cast("long").alias("floor"))
    asked = anchors.withColumn("targets", F.array(target(F.lit(0), F.lit(NO_CEILING), F.lit(NO_FLOOR))))
    found = scan(asked, shards, sent, positives, True, steps, block_rows)
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "id")
    first = materialise(found.withColumn("place", F.row_number().over(order)).select("rid", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    # percents of a long without leaving its range; negative products have no band
    hundreds, rest = F.expr("positive_score div 100"), F.expr("positive_score % 100")
    upper = hundreds * most + F.floor(rest * most / 100)
    floor = hundreds * least + F.ceil(rest * least / 100)
    bands = first.where("positive_score >= 0").select("rid", target(F.col("place"), upper, floor).alias("t")).where("t.floor <= t.upper")
    asked = anchors.join(bands.groupBy("rid").agg(F.collect_list("t").alias("targets")), "rid")
    found = scan(asked, shards, sent, negatives, False, steps, block_rows)
    order = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = ranked.join(first, ["rid", "place"]).join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return out.select("anchor_id", name("positive").alias("positive_id"), "rank", name("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(table: DataFrame, key: str = "vec_id", label: str = "label", shift: int = 7, classes: int = 10, **how) -> DataFrame:
    """``mine`` after the labels of rows whose key is divisible by ``shift`` have become (label + 1) % ``classes``."""
    moved = F.when(F.col(key).cast("long") % shift == 0, (F.col(label).cast("long") + 1) % classes).otherwise(F.col(label).cast("long"))
    return mine(table.withColumn(label, moved), key=key, label=label, **how)
