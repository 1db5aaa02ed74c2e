"""The link graph: click depth, orphans, PageRank and what-if changes. Tables of each round are kept in the checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import strip_slashes
from webloom.operators.joins import score_delta
from webloom.sources.shared import discard, fresh_dir, keep

DAMPING = 0.85
ITERATIONS = 50
AUTHORITY_SHARE = 0.3
#: Rounds that are one job.
TOGETHER = 4
#: Edges of a bucket, buckets that a graph has at least where it has an edge for each, and how many Spark allows. A round shuffles a row for each bucket and
#: node, or for each edge if those are fewer.
BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 8_000_000, 12, 100_000
#: Edges of a bucket below which there are fewer than the least.
FULL = 500_000
#: Sources whose edges are read by their buckets alone; edited sources that are broadcast, of some 60 bytes each.
FEW, SMALL = 200, 200_000
#: Nodes of a block, by bits of their numbers: what a task sums at once, in 8 MB for each rank.
BLOCK_BITS = 20
#: Lists that a task sums at once.
BATCH = "8m"


def build(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): page keys and internal edges, parallel ones kept."""
    nodes = pages.select(strip_slashes(F.col("url")).alias("node")).distinct()
    key = F.coalesce(F.nullif("dest_url_normalized", F.lit("")), "dest_url") if "dest_url_normalized" in links.columns else F.col("dest_url")
    return nodes, links.where("is_internal").select(strip_slashes(F.col("source_url")).alias("src"), strip_slashes(key).alias("dst"))


def click_depths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, most: int | None = None, together: int = 16) -> DataFrame:
    """(node, depth): breadth first from the starts over edges into known nodes, to the last level; unreached nodes are absent.

    Each level is kept once; every ``together`` levels become one table, so that the plan stays small. A graph of more than ``most`` levels
    is refused, where that is given.
    """
    inner = keep(edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    front = keep(starts.select("node").distinct().join(nodes, "node", "left_semi").withColumn("depth", F.lit(0)))
    levels, depth = [front], 0
    while True:
        depth += 1
        if most is not None and depth > most:
            raise RuntimeError(f"more than {most} levels")
        step = inner.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        for level in levels:
            step = step.join(level.select("node"), "node", "left_anti")
        front = keep(step.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        levels.append(front)
        if len(levels) > together:
            levels = [keep(_union(levels))]
    return _union(levels)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def with_unreached(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    return nodes.join(depths, "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("depth"))


def orphan_pages(pages: DataFrame, edges: DataFrame, seeds: list[str] = ()) -> DataFrame:
    """Indexable pages of status 200 without any internal link to them (one from themselves counts), seeds left out."""
    key = strip_slashes(F.col("url"))
    some = pages.where(F.coalesce("is_indexable", F.lit(True)) & (F.coalesce("status_code", F.lit(0)) == 200)).withColumn("_k", key)
    some = some.where(~F.col("_k").isin(*[s.rstrip("/") for s in seeds] or [""]))
    return some.join(edges.select(F.col("dst").alias("_k")).distinct(), "_k", "left_anti").select("url")


def plain_orphans(pages: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """Crawled less linked less the start."""
    return pages.select(strip_slashes(F.col("url")).alias("node")).subtract(edges.select(F.col("dst").alias("node"))).where(F.col("node") != start.rstrip("/"))


def simple_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between known, different nodes."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def teleport(nodes: DataFrame, authority: DataFrame | None = None) -> DataFrame:
    """(node, p): uniform, or 70 % uniform and 30 % by external authority (node, authority), made to sum to one."""
    n = nodes.count()
    if authority is None or authority.isEmpty():
        return nodes.select("node", F.lit(1.0 / max(n, 1)).alias("p"))
    top = authority.agg(F.max("authority")).first()[0] or 1.0
    a = authority.groupBy("node").agg(F.max("authority").alias("a"))
    raw = nodes.join(a, "node", "left").select("node", (F.lit((1 - AUTHORITY_SHARE) / n) + AUTHORITY_SHARE * F.coalesce("a", F.lit(0.0)) / top).alias("p"))
    total = raw.agg(F.sum("p")).first()[0] or 1.0
    return raw.select("node", (F.col("p") / total).alias("p"))


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, block, at): a row for each run of a source's targets in a block of nodes, of edges sorted by (src, dst). A run ends with its batch at the latest."""
    for b in batches:
        src, dst = (b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst"))
        block = dst >> BLOCK_BITS
        first = _firsts(src, block)
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(src)), pa.int32()), pa.array(dst - (block << BLOCK_BITS), pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(src[first]), pa.array(block[first]), at], names=["src", "block", "at"])


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, and a sum of each column of shares) of rows (block, at, shares), block by block as they come; nodes that get nothing are left out."""
    held, sums, names = None, np.zeros((0, 0)), []

    def out() -> pa.RecordBatch:
        some = np.flatnonzero(sums.any(axis=0))
        return pa.RecordBatch.from_arrays([pa.array(some + (held << BLOCK_BITS)), *(pa.array(v[some]) for v in sums)], names=["node", *names])

    for b in batches:
        names = b.schema.names[2:]
        block, at = b.column("block").to_numpy(zero_copy_only=False), b.column("at")
        shares, sizes, places = [b.column(c).to_numpy(zero_copy_only=False) for c in names], at.value_lengths().to_numpy(zero_copy_only=False), at.flatten().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
        first = _firsts(block)
        for i, j in zip(first, np.append(first[1:], len(block))):
            if held != block[i]:
                if held is not None:
                    yield out()
                held, sums = int(block[i]), np.zeros((len(names), 1 << BLOCK_BITS))
            for total, share in zip(sums, shares):
                np.add.at(total, places[ends[i] : ends[j]], np.repeat(share[i:j], sizes[i:j]))
    if held is not None:
        yield out()


class Ranks:
    """Power iteration over stored edges, with what it takes to tell what an edit of the edges changes.

    Edges are stored once, as lists of a source's targets in a block of nodes with w = damping / out-degree, bucketed by src and sorted by block; a round joins them
    where they lie with the shares that come in and numpy sums each block, so only sums of shares are shuffled, once a round. An edit that is known beforehand
    (``added``, ``removed``) goes through the same rounds: y are the shares of the edited graph, v its weights, and edited sources have lists for either. With x_0 the teleport vector p and x_k = w x_(k-1), and the mass of nodes without edges dealt out by p,
    the ranks of round t are r_t = c_(t-1) x_0 + ... + c_0 x_(t-1) + x_t, where c_t makes their sum one: c_t = 1 - (c_(t-1) s_1 + ... + c_0 s_t + s_(t+1)), s_k the sum of
    x_k. So no round waits for a sum over all nodes; ``together`` rounds are one job, whose tables go to the shared folder. The graph's size changes no plan.
    Nodes have numbers of eight bytes, which stand for their names in edges, shares and rounds.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, personal: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS, together: int = TOGETHER, *, added: DataFrame | None = None, removed: DataFrame | None = None):
        self.spark, self.damping, self.iterations, self.together = nodes.sparkSession, damping, iterations, together
        self.names = _numbers(nodes.select(F.col("node").alias("name")).distinct())
        plain = keep(self._numbered(edges).where("src <> dst").repartition("src").distinct())
        # rounds have as many partitions as the edges have buckets: nothing to plan anew while they run
        size = plain.count()
        buckets = min(MOST_BUCKETS, max(1 + size // BUCKET, min(LEAST_BUCKETS, 1 + size // FULL)))
        self.fixed = self.spark.newSession()
        for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", str(buckets)), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)):
            self.fixed.conf.set(key, value)
        lists, self.kinds = self._lists(plain), ["x"]
        if added is not None or removed is not None:
            self.kinds = ["x", "y"]
            hit, before, now = self._edit(plain, added, removed)
            same = lists.join(hit.withColumn("_on", F.lit(True)), "src", "left").withColumn("v", F.when(F.col("_on"), 0.0).otherwise(F.col("w"))).drop("_on")
            lists = same.unionByName(self._lists(now).withColumns({"v": F.col("w"), "w": F.lit(0.0)}))
        self.name, self.path = f"webloom_edges_{uuid.uuid4().hex}", fresh_dir(self.spark, "edges")
        lists.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("block", "src").option("path", self.path).saveAsTable(self.name)
        self.edges = _spread(self.spark.table(self.name))
        led = teleport(self.names) if personal is None else personal.select(F.col("node").alias("_of"), "p").join(self.names, F.col("_of").eqNullSafe(F.col("name")))
        rounds = self._rounds(self._stored(led.select("node", *[F.col("p").alias(c) for c in self.kinds])))
        self.shares, self.edited = (self._by_node(rounds.select("node", "k", F.col(c).alias("x"))) if c in self.kinds else None for c in ("x", "y"))

    def _lists(self, plain: DataFrame) -> DataFrame:
        """(src, block, at, w) of distinct edges, whose partitions have whole sources or most of them."""
        path = fresh_dir(self.spark, "lists")
        plain.select("src", "dst").sortWithinPartitions("src", "dst").mapInArrow(packed, "src long, block long, at array<int>").write.parquet(path)
        lists = self.spark.read.parquet(path)
        degree = lists.groupBy("src").agg(F.sum(F.size("at")).alias("n"))
        return lists.join(degree, "src").select("src", "block", "at", (F.lit(self.damping) / F.col("n")).alias("w"))

    def _edit(self, plain: DataFrame, added: DataFrame | None, removed: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the sources of an edit, their edges before, their edges after)."""
        added, removed = (None if t is None else self._numbered(t) for t in (added, removed))
        touched = keep(_union([t.select("src") for t in (added, removed) if t is not None]).distinct())
        hit = F.broadcast(touched) if touched.count() <= SMALL else touched
        before = keep(plain.join(hit, "src", "left_semi"))
        return hit, before, edit_edges(before, added, removed).repartition("src")

    def _numbered(self, edges: DataFrame) -> DataFrame:
        """Edges (src, dst) between known nodes, by the nodes' numbers."""
        of = lambda c: self.names.select(F.col("name").alias(c), F.col("node").alias(f"_{c}"))
        return edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))

    def _stored(self, df: DataFrame) -> DataFrame:
        """The table in the shared folder, for rounds."""
        path = fresh_dir(self.spark, "round")
        df.write.parquet(path)
        return self.fixed.read.parquet(path)

    def _by_node(self, rounds: DataFrame) -> DataFrame:
        """(node, x): a map from round to share."""
        path = fresh_dir(self.spark, "shares")
        rounds.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("x")).write.parquet(path)
        return self.spark.read.parquet(path)

    def _flow(self, x: DataFrame, edges: DataFrame) -> DataFrame:
        # hashed where the edges lie: they are never sorted, sent or held
        return edges.join(x.select(F.col("node").alias("src"), "x").hint("shuffle_hash"), "src").select(F.col("dst").alias("node"), (F.col("x") * F.col("w")).alias("x"))

    def _rounds(self, start: DataFrame) -> DataFrame:
        """(node, k, and the shares) of all rounds from 0 on."""
        tables, x, lists = [start.select("node", F.lit(0).alias("k"), *self.kinds)], start, self.fixed.table(self.name)
        sums, kind = [F.sum(c).alias(c) for c in self.kinds], ", ".join(["node long", *(f"{c} double" for c in self.kinds)])
        weights = dict(zip("xy", "wv"))
        for first in range(1, self.iterations + 1, self.together):
            last, own = min(first + self.together, self.iterations + 1) - 1, []
            for k in range(first, last + 1):
                # hashed where the lists lie: they are never sorted, sent or held
                met = lists.join(x.withColumnRenamed("node", "src").hint("shuffle_hash"), "src").select("block", "at", *[(F.col(c) * F.col(weights[c])).alias(c) for c in self.kinds])
                x = met.mapInArrow(summed, kind).groupBy("node").agg(*sums).persist(StorageLevel.MEMORY_AND_DISK)  # exchanges of Arrow functions aren't reused
                own.append(x)
            tables.append(self._stored(_union([r.select("node", F.lit(k).alias("k"), *self.kinds) for k, r in enumerate(own, first)])))
            for r in own:
                r.unpersist()
            x = tables[-1].where(F.col("k") == last).select("node", *self.kinds)
        return _union(tables)

    def _differences(self, change: DataFrame, comes: DataFrame, least: float) -> DataFrame:
        """(node, k, x): what an edit makes of the shares, from round 1 on."""
        tables: list[DataFrame] = []
        edges, few = _spread(self.fixed.table(self.name)), True
        for k in range(1, self.iterations + 1):
            flow = comes.where(F.col("k") == k).select("node", "x")
            if tables:
                x, near = tables[-1].select("node", "x"), edges
                some = [r.node for r in x.select("node").limit(FEW + 1).collect()] if few else []  # bounded
                few = few and len(some) <= FEW
                if few:  # their buckets alone are read
                    near = edges.where(F.col("src").isin(some))
                flow = flow.unionByName(self._flow(x, near)).unionByName(self._flow(x, change))
            x = flow.groupBy("node").agg(F.sum("x").alias("x")).where(F.abs("x") > least)
            tables.append(self._stored(x.select("node", F.lit(k).alias("k"), "x")))
        return _union(tables)

    def ranks(self, shares: DataFrame | None = None) -> DataFrame:
        """(node, rank) of all nodes."""
        shares = self.shares if shares is None else shares
        each = [F.sum(F.coalesce(F.element_at("x", F.lit(k)), F.lit(0.0))).alias(f"s{k}") for k in range(self.iterations + 1)]
        s = [v or 0.0 for v in shares.agg(*each).first()]  # a number for each round
        c: list[float] = []
        for t in range(self.iterations):
            c.append(1 - sum(c[t - 1 - j] * s[j + 1] for j in range(t)) - s[t + 1])
        of = [*reversed(c), 1.0]
        rank = F.aggregate(F.map_entries("x"), F.lit(0.0), lambda a, e: a + F.get(F.array(*map(F.lit, of)), e["key"]) * e["value"])
        return shares.select("node", rank.alias("rank")).join(self.names, "node").select(F.col("name").alias("node"), "rank")

    def after(self, added: DataFrame | None = None, removed: DataFrame | None = None, least: float = 1e-14) -> DataFrame:
        """(node, rank) once edges have come and gone: what the edit disturbs is propagated, and nothing else.

        Where sources' edges change by D, the shares' differences are d_k = w d_(k-1) + D (x_(k-1) + d_(k-1)); they start at the edited sources and go as
        far as they reach. Differences below ``least`` are dropped.
        """
        if added is None and removed is None:
            return self.ranks()
        hit, before, now = self._edit(self.edges.select("src", "dst"), added, removed)
        change = weighted(now, self.damping).unionByName(weighted(before, self.damping).withColumn("w", -F.col("w")))
        change = self._stored(change.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w <> 0"))
        known = self.shares.join(hit.withColumnRenamed("src", "node"), "node", "left_semi").select("node", F.explode("x").alias("k", "x"))
        comes = self._stored(self._flow_by_round(self._stored(known), change))
        less = self._by_node(self._differences(change, comes, least)).withColumnRenamed("x", "d")
        none = F.create_map().cast("map<int,double>")
        every = F.map_zip_with(F.coalesce("x", none), F.coalesce("d", none), lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
        return self.ranks(keep(self.shares.join(less, "node", "full").select("node", every.alias("x"))))

    def _flow_by_round(self, x: DataFrame, change: DataFrame) -> DataFrame:
        met = change.join(x.select(F.col("node").alias("src"), "k", "x"), "src")
        return met.groupBy(F.col("dst").alias("node"), (F.col("k") + 1).alias("k")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))

    def close(self) -> None:
        """Drops the stored edges; results that aren't kept can't be read after it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def _numbers(names: DataFrame) -> DataFrame:
    """The rows with numbers from 0 on, without gaps, as ``node``; kept, so that the numbers stay."""
    kept = keep(names.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = {r.p: r["n"] for r in kept.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each partition
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]).tolist()
    return kept.select(*names.columns, (F.get(F.array(*[F.lit(v).cast("long") for v in starts]), part.cast("int")) + F.col("_m") - F.shiftleft(part, 33)).alias("node"))


def _spread(lists: DataFrame) -> DataFrame:
    """(src, dst, w) of stored lists, as they are before an edit."""
    return lists.where("w > 0").select("src", "w", "block", F.explode("at").alias("_at")).select("src", (F.shiftleft("block", BLOCK_BITS) + F.col("_at")).alias("dst"), "w")


def weighted(edges: DataFrame, damping: float) -> DataFrame:
    """(src, dst, w): damping over the source's number of edges."""
    degree = edges.groupBy("src").agg(F.count("*").alias("n"))
    return edges.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("n")).alias("w"))


def pagerank(nodes: DataFrame, edges: DataFrame, personal: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(node, rank): power iteration; the mass of nodes without edges is dealt out by the teleport vector."""
    own = Ranks(nodes, edges, personal, damping, iterations)
    got = keep(own.ranks())
    own.close()
    return got


def internal_pagerank(nodes: DataFrame, edges: DataFrame, authority: DataFrame | None = None, **how) -> DataFrame:
    """(node, ipr 0 to 10, ipr_inbound, ipr_outbound)."""
    got = pagerank(nodes, edges, teleport(nodes, authority), **how)
    top = got.agg(F.max("rank")).first()[0] or 1.0
    e = keep(simple_edges(nodes, edges))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    met = got.join(into, "node", "left").join(out, "node", "left")
    return met.select("node", F.bround(F.col("rank") * 10 / top, 4).alias("ipr"), F.coalesce("i", F.lit(0)).alias("ipr_inbound"), F.coalesce("o", F.lit(0)).alias("ipr_outbound"))


def _scores(got: DataFrame) -> DataFrame:
    top = max(got.agg(F.max("rank")).first()[0] or 0.0, 1e-9)
    return got.select(F.col("node").alias("url"), (F.col("rank") / top).alias("score"))


def sandbox_pagerank(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """(url, score): ranks over the largest, not rounded."""
    return _scores(pagerank(nodes, edges, **how))


def edit_edges(edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    out = edges.select("src", "dst")
    if added is not None:
        out = out.unionByName(added.select("src", "dst"))
    if removed is not None:
        out = out.join(removed.select("src", "dst"), ["src", "dst"], "left_anti")
    return out.where("src <> dst").distinct()


def what_if(nodes: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, **how) -> DataFrame:
    """url, before, after, delta, delta_pct of the scores when edges change; the rounds of both graphs are the same passes over the edges."""
    own = Ranks(nodes, edges, **how, added=added, removed=removed)
    before = keep(own.ranks())
    after = before if own.edited is None else keep(own.ranks(own.edited))
    own.close()
    return score_delta(_scores(before), _scores(after))


def link_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each source the targets that come and go."""
    b, a = before.select("src", "dst").distinct(), after.select("src", "dst").distinct()
    listed = lambda df, name: df.groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("dst")), " | ").alias(name))
    return listed(a.subtract(b), "added").join(listed(b.subtract(a), "removed"), "src", "full")


def redirect_chains(hops: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """(url, chain, final_url, looped): follows (url, location, status_code) from each start, at most ``most`` hops; a seen address is a loop."""
    table = hops.select(F.col("url").alias("_u"), "location", "status_code").dropDuplicates(["_u"])
    hop = "struct<url:string,status_code:int>"
    live = starts.select("url", F.col("url").alias("at"), F.array().cast(f"array<{hop}>").alias("chain"), F.lit(False).alias("looped"))
    done = None
    for _ in range(most):
        # merged: a broadcast for each hop would pass through the driver
        met = live.join(table.hint("merge"), F.col("at") == F.col("_u"), "left")
        ended = met.where("location is null or looped").select("url", "chain", F.col("at").alias("final_url"), "looped")
        done = ended if done is None else done.unionByName(ended)
        step = F.struct(F.col("at").alias("url"), F.col("status_code").cast("int").alias("status_code"))
        seen = F.exists("chain", lambda h: h["url"] == F.col("location")) | (F.col("location") == F.col("at"))
        live = keep(met.where("location is not null and not looped").select("url", F.col("location").alias("at"), F.array_append("chain", step).alias("chain"), seen.alias("looped")))
        if live.isEmpty():
            return done
    return done.unionByName(live.select("url", "chain", F.col("at").alias("final_url"), "looped"))


def resolved_redirects(hops: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(url, final_url, hops, looped) of every address that redirects, for chains of any length, by pointer doubling.

    After k rounds an address points to where 2^k hops lead, so a chain of n hops takes log2(n) joins. An address inside or ahead of a loop never ends: chains that end have
    successors of every shorter length, so once a round ends none, all that are left loop; these have no final url. Of an address with several targets the least counts.
    """
    step = hops.where("url is not null and location is not null").groupBy("url").agg(F.min("location").alias("at"))
    ends = step.select(F.col("url").alias("at")).distinct()
    # an address that redirects no further is an end
    now = keep(step.join(ends.withColumn("_on", F.lit(True)), "at", "left").select("url", "at", F.lit(1).cast("long").alias("hops"), F.col("_on").isNull().alias("done")))
    left = now.where("not done").count()
    for _ in range(most_rounds):
        if not left:
            break
        far = now.select(F.col("url").alias("at"), F.col("at").alias("_to"), F.col("hops").alias("_n"), F.col("done").alias("_end"))
        ended, open_ = now.where("done"), now.where("not done")
        moved = open_.join(far, "at").select("url", F.col("_to").alias("at"), (F.col("hops") + F.col("_n")).alias("hops"), F.col("_end").alias("done"))
        now = keep(ended.unionByName(moved))
        before, left = left, now.where("not done").count()
        if left == before:
            break
    return now.select("url", F.when(F.col("done"), F.col("at")).alias("final_url"), F.when(F.col("done"), F.col("hops")).alias("hops"), (~F.col("done")).alias("looped"))


def crawl(seeds: DataFrame, outlinks: DataFrame, max_pages: int = 10_000, max_depth: int = 50, batch: int = 1000) -> DataFrame:
    """The order of a priority crawl over known pages: (url, depth, batch). outlinks (src, dst) is what fetching each page finds."""
    queue = seeds.select("url", F.lit(2).alias("priority"), F.lit(0).alias("depth"))
    done = None
    taken = 0
    for n in range(max_pages):
        some = queue if done is None else queue.join(done.select("url"), "url", "left_anti")
        some = some.groupBy("url").agg(F.min("priority").alias("priority"), F.min("depth").alias("depth")).where(F.col("depth") <= max_depth)
        now = keep(some.orderBy("priority", "url").limit(min(batch, max_pages - taken)).withColumn("batch", F.lit(n)))
        got = now.count()
        if not got:
            break
        taken += got
        done = keep(now if done is None else done.unionByName(now))
        if taken >= max_pages:
            break
        more = now.select(F.col("url").alias("src"), "depth").join(outlinks, "src").select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))
        more = more.select("url", F.when(F.col("depth") <= 1, 4).when(F.col("depth") == 2, 5).when(F.col("depth") <= 5, 6).otherwise(7).alias("priority"), "depth")
        queue = keep(some.select("url", "priority", "depth").unionByName(more.distinct()))
    return done.select("url", "depth", "batch")


def by_domain(pages: DataFrame, domains: list[str], most: int = 6) -> DataFrame:
    """Pages of a client and up to five competitors; a domain without pages has its empty row."""
    if len(domains) > most:
        raise ValueError(f"at most {most - 1} competitors")
    every = pages.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    return every.join(pages, "domain", "left")
