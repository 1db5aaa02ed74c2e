"""Exact top-k by inner product: ball trees over shards, searched by branch and bound in rounds that share the k-th scores.

Components become integers, ``floor(scale * x)``. A bounded draw of rows (``PILOT``) is cut into leaves, halves along the widest axis, and
every row goes to the leaf that its components lead to; a leaf of many rows is several shards. Each shard becomes a ball tree once, kept in the
shared folder. A leaf's ball is the pilot's mean in it and the distance of its furthest row; its bound for a query is
``<q, centre> + |q| * radius``. The draw's own k-th best score is each query's first lower bound. Then, round by round (``ROUNDS``), a query
visits the leaves of the highest bounds that it hasn't visited yet, and the k-th score that it has found by then leaves out those whose bound is lower;
the last round visits all that remain. In a shard, nodes are searched in the order of their upper bounds, and left out when these are
under the query's current k-th score. So vectors are shuffled once to build the trees, and a tree moves only to blocks of queries whose bounds reach it.

Equal scores go to the smaller vec_id; a node at exactly the k-th score is searched. A query's own row is the row of the same vec_id and vector; of
repeated rows only one is its own, the others are candidates. The search keeps k + 1 rows and drops the own one at the end. Vectors that are null, or hold
null or non-finite components, take no part. Vectors of different lengths don't meet. Rows of null vec_id are candidates, placed last among equal
scores, and no queries. Repeated query rows each get their ranks. Scores are exact in the range of long; beyond it they are held at its ends. Very long
vectors make shards of fewer rows (``SHARD_BYTES``). vec_id must be an integer or cast to one; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import materialise, written

SCALE = 256
K = 5
LEAF = 128
PILOT = 2048
#: Leaves of the pilot, at most: with a centre each they are broadcast.
MOST_LEAVES = 256
LEAST_LEAVES = 16
SHARD_BYTES = 2 << 20
BLOCK_ROWS = 1024
#: Leaves that a query visits in each round; after these, all that remain.
ROUNDS = (1, 3)
#: Stands for a null vec_id: after all others.
NO_ID = 2**63 - 1
NO_FLOOR = -(2**63)


def integers(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    d = v.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(d, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for integer rows, exact: in doubles while they hold it, else in Python's integers."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    big = a.astype(object) @ b.astype(object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64) if big.size else big.astype(np.int64)


def _upper(f: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius) -> np.ndarray:
    """Upper bounds of the inner products of queries with a ball's points; a little more, for what rounding takes."""
    b = f @ centre + norm * radius
    return b + 1e-9 * (1 + np.abs(b) + norm * (np.sqrt((centre**2).sum(0)) + radius))


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.v, self.f = ids, vectors, vectors.astype(np.float64)
        self.root = self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> tuple:
        x = self.f[rows]
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        if len(rows) <= leaf or radius == 0 and len(rows) <= 16 * leaf:
            return centre, radius, rows, None
        axis = int(np.argmax(x.max(0) - x.min(0))) if x.shape[1] else 0
        order = np.argsort(x[:, axis], kind="stable") if x.shape[1] else np.arange(len(rows))
        half = len(rows) // 2
        return centre, radius, None, (self._build(rows[order[:half]], leaf), self._build(rows[order[half:]], leaf))

    def packed(self) -> bytes:
        return pickle.dumps((self.ids, self.v, self.root))

    @classmethod
    def unpacked(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.ids, tree.v, tree.root = pickle.loads(data)
        return tree

    def search(self, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, score, id) of the k best rows of each query, from the best; floor: known lower bounds of its k-th score."""
        n, f = len(q), q.astype(np.float64)
        norm = np.sqrt((f**2).sum(1))
        kth = floor.astype(np.int64).copy()
        none = np.empty(0, np.int64)
        kept, pending, waiting = (none, none, none), [], 0

        def settle() -> None:
            nonlocal kept, pending, waiting
            at, s, i = (np.concatenate(x) for x in zip(kept, *pending))
            order = np.lexsort((i, ~s, at))
            at, s, i = at[order], s[order], i[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            last = place == k - 1
            kth[at[last]] = np.maximum(kth[at[last]], s[last])
            kept, pending, waiting = tuple(x[place < k] for x in (at, s, i)), [], 0

        def visit(node: tuple, live: np.ndarray, b: np.ndarray) -> None:
            nonlocal waiting
            live = live[b >= kth[live]]
            if not len(live):
                return
            if node[3] is None:
                s = products(q[live], self.v[node[2]])
                x, y = np.nonzero(s >= kth[live][:, None])
                pending.append((live[x], s[x, y], self.ids[node[2]][y]))
                waiting += len(x)
                if waiting > 2 * n * k:
                    settle()
                return
            left, right = node[3]
            bl, br = (_upper(f[live], norm[live], c[0], c[1]) for c in (left, right))
            for child, upper in ((left, bl), (right, br)) if bl.sum() >= br.sum() else ((right, br), (left, bl)):
                visit(child, live, upper)

        if n and len(self.ids):
            visit(self.root, np.arange(n), _upper(f, norm, self.root[0], self.root[1]))
            settle()
        return kept


def _matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, np.int64) for v in vectors]
    return np.stack(rows) if rows else np.zeros((0, 0), np.int64)


class Leaves:
    """The pilot's cut: a tree of (axis, threshold), its leaves in order, and their centres."""

    def __init__(self, vectors: np.ndarray, most: int):
        f = vectors.astype(np.float64)
        self.centres: list[np.ndarray] = []
        self.root = self._cut(f, f.mean(0), most)
        self.centre = np.stack(self.centres)

    def _cut(self, x: np.ndarray, above: np.ndarray, most: int):
        spread = x.max(0) - x.min(0) if len(x) and x.shape[1] else np.zeros(1)
        if most < 2 or len(x) < 4 or not spread.max() > 0:
            self.centres.append(x.mean(0) if len(x) else above)
            return len(self.centres) - 1
        axis = int(np.argmax(spread))
        edge = float(np.median(x[:, axis]))
        edge = edge if (x[:, axis] > edge).any() else float(x[:, axis].min())
        low = x[:, axis] <= edge
        return axis, edge, self._cut(x[low], x.mean(0), most // 2), self._cut(x[~low], x.mean(0), most - most // 2)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        f, out = vectors.astype(np.float64), np.zeros(len(vectors), np.int64)

        def go(node, rows: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] = node
                return
            low = f[rows, node[0]] <= node[1]
            go(node[2], rows[low])
            go(node[3], rows[~low])

        go(self.root, np.arange(len(vectors)))
        return out


def search(
    table: DataFrame,
    k: int = K,
    every: int = 50,
    key: str = "vec_id",
    column: str = "embedding",
    scale: int = SCALE,
    shard_bytes: int = SHARD_BYTES,
    block_rows: int = BLOCK_ROWS,
    pilot: int = PILOT,
    rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose key is divisible by ``every``."""
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), integers(F.col(column), scale).alias("v")).where("v is not null")
    rows = rows.withColumns({"dim": F.size("v"), "at": F.xxhash64("id", "v")})

    n = rows.count()
    drawn = rows.orderBy("at").limit(pilot).select("dim", "id", "v").collect()
    cuts: dict[int, tuple[Leaves, BallTree]] = {}
    for d in {r.dim for r in drawn}:
        own = [r for r in drawn if r.dim == d]
        m = _matrix(r.v for r in own)
        # about two leaves for a shard's bytes, so that a leaf is seldom more than one tree
        leaves_ = max(LEAST_LEAVES, 2 * n * len(own) // len(drawn) * (8 * d + 8) // shard_bytes)
        cuts[d] = Leaves(m, min(MOST_LEAVES, leaves_, max(1, len(own) // 8))), BallTree(np.array([NO_ID if r.id is None else r.id for r in own], np.int64), m)
    sent = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("struct<leaf:int,away:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        leaf, away = np.full(len(v), -1, np.int32), np.zeros(len(v))
        size = v.map(len).to_numpy() if len(v) else np.zeros(0)
        for d, (cut, _) in sent.value.items():
            at = np.flatnonzero(size == d)
            if len(at):
                m = _matrix(v.iloc[at])
                leaf[at] = cut.of(m)
                away[at] = np.sqrt(((m.astype(np.float64) - cut.centre[leaf[at]]) ** 2).sum(1))
        return pd.DataFrame({"leaf": leaf, "away": away})

    # rows that repeat are told apart, so that they can be dealt over the shards of their leaf
    placed = written(rows.select("id", "v", "dim", "at", place("v").alias("p"), F.xxhash64("at", F.monotonically_increasing_id()).alias("deal")), "placed")
    placed = placed.select("id", "v", "dim", "at", "deal", "p.*")
    # a row for each leaf: no more than the pilot has rows, and one for all lengths that it lacks
    known = placed.where("leaf >= 0").groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    parts = {(r.dim, r.leaf): 1 + r.n * (8 * r.dim + 8) // shard_bytes for r in known}
    radius = {(r.dim, r.leaf): r.radius for r in known}
    shards = spark.sparkContext.broadcast(parts)

    @F.pandas_udf("int")
    def part(dim: pd.Series, leaf: pd.Series, deal: pd.Series) -> pd.Series:
        return pd.Series([x % shards.value.get((d, n), 64) for d, n, x in zip(dim, leaf, deal)], dtype="int32")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].fillna(NO_ID) if rows["id"].isna().any() else rows["id"]
        tree = BallTree(ids.to_numpy(np.int64), _matrix(rows["v"]))
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "leaf": rows["leaf"].iloc[:1], "part": rows["part"].iloc[:1], "tree": [tree.packed()]})

    held = placed.select("id", "v", "dim", "leaf", part("dim", "leaf", "deal").alias("part"))
    trees = written(held.groupBy("dim", "leaf", "part").applyInPandas(build, "dim int, leaf int, part int, tree binary"), "trees")

    @F.pandas_udf("long")
    def floor_of(v: pd.Series) -> pd.Series:
        out = np.full(len(v), NO_FLOOR, np.int64)
        size = v.map(len).to_numpy() if len(v) else np.zeros(0)
        for d, (_, tree) in sent.value.items():
            at = np.flatnonzero(size == d)
            if len(at) and len(tree.ids) > k:
                _, s, _ = tree.search(_matrix(v.iloc[at]), k + 1, np.full(len(at), NO_FLOOR, np.int64))
                out[at] = s[k :: k + 1]
        return pd.Series(out)

    def wanted(first: int, last: int | None):
        """The leaves of a query's highest bounds from place ``first`` to ``last``, without those whose bound is under its floor."""

        @F.pandas_udf("array<int>")
        def leaves(v: pd.Series, least: pd.Series) -> pd.Series:
            out: list = [[-1] if first == 0 else [] for _ in range(len(v))]
            size = v.map(len).to_numpy() if len(v) else np.zeros(0)
            for d, (cut, _) in sent.value.items():
                at, own = np.flatnonzero(size == d), [n for x, n in radius if x == d]
                if not len(at) or not own:
                    continue
                q = _matrix(v.iloc[at]).astype(np.float64)
                norm = np.sqrt((q**2).sum(1))
                b = _upper(q, norm[:, None], cut.centre[own].T, np.array([radius[d, n] for n in own])[None, :])
                order = np.argsort(-b, axis=1, kind="stable")[:, first:last]
                fits = np.take_along_axis(b, order, 1) >= least.iloc[at].to_numpy()[:, None]
                for x, o, f in zip(at, order, fits):
                    out[x] = [own[i] for i in o[f]]
            return pd.Series(out)

        return leaves

    queries = placed.where(F.col("id") % every == 0).groupBy("id", "v", "dim", "at").agg(F.count("*").alias("copies"))
    queries = written(queries.select("id", "v", "dim", "at", "copies", floor_of("v").alias("least")), "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, asked in zip(b.column(0), b.column(1)):
                asked = asked.as_py()
                at, s, i = BallTree.unpacked(tree.as_py()).search(_matrix(a["v"] for a in asked), k + 1, np.array([a["least"] for a in asked], np.int64))
                columns = [np.array([a[c] for a in asked], np.int64)[at] for c in ("at", "id")] + [i, s]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["at", "query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id", "at").orderBy(F.desc("score"), "vec_id")
    found, first = None, 0
    now = queries
    for last in [*np.cumsum(rounds).tolist(), None]:
        asked = now.select("id", "v", "dim", "at", "least", F.explode(wanted(first, last)("v", "least")).alias("leaf"))
        # queries meet a tree in blocks; a leaf's trees are joined to them
        sizes = {(r.dim, r.leaf): -(-r.n // block_rows) for r in asked.groupBy("dim", "leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
        numbered = asked.withColumn("block", _block(spark, sizes)("dim", "leaf", "at"))
        blocks = numbered.groupBy("dim", "leaf", "block").agg(F.collect_list(F.struct("id", "v", "at", "least")).alias("asked"))
        got = trees.join(blocks, ["dim", "leaf"]).select("tree", "asked").mapInArrow(meet, "at long, query_id long, vec_id long, score long")
        found = got if found is None else found.unionByName(got)
        found = materialise(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"))
        kth = found.withColumn("place", F.row_number().over(best)).where(F.col("place") == k + 1).select("at", F.col("query_id").alias("id"), F.col("score").alias("kth"))
        now = queries.join(kth, ["id", "at"], "left").select("id", "v", "dim", "at", "copies", F.greatest("least", "kth").alias("least"))
        first = last
    # k + 1 best of all shards, without one own row, then the first k
    itself = queries.select(F.col("id").alias("query_id"), "at", "copies", "v")
    return _ranked(found, itself, k)


def _block(spark, sizes: dict[tuple[int, int], int]):
    """A query's block among those of its leaf."""
    sent = spark.sparkContext.broadcast(sizes)

    @F.pandas_udf("long")
    def block(dim: pd.Series, leaf: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([x % sent.value.get((d, n), 1) for d, n, x in zip(dim, leaf, at)], dtype="int64")

    return block


def _ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query without one row of its own; each query row gets them."""

    @F.pandas_udf("long")
    def square(v: pd.Series) -> pd.Series:
        return pd.Series([int(products(r[None], r[None])[0, 0]) for r in (np.asarray(x, np.int64) for x in v)], dtype="int64")

    own = queries.select("query_id", "at", "copies", square("v").alias("self"))
    best = Window.partitionBy("query_id", "at").orderBy(F.desc("score"), "vec_id")
    placed = found.join(own, ["query_id", "at"]).withColumn("place", F.row_number().over(best))
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
    placed = placed.withColumn("own", F.min(F.when(mine, F.col("place"))).over(Window.partitionBy("query_id", "at")))
    kept = placed.where(F.col("own").isNull() | (F.col("place") != F.col("own")))
    kept = kept.withColumn("rank", (F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return kept.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
