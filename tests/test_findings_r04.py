"""What the finding of round 4 was about, on small tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.operators import graph


def ranks(nodes, edges, rounds):
    to = {n: {b for a, b in edges if a == n and b != n and b in nodes} for n in nodes}
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(r[n] for n in nodes if not to[n])
        r = {n: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(r[a] / len(to[a]) for a in nodes if n in to[a])) for n in nodes}
    return r


@pytest.fixture
def edit(spark):
    """(nodes, edges, added, removed), as lists and as tables: a node gets its first edges, one loses all, some targets are unknown or the source itself."""
    nodes = [f"n{k}" for k in range(12)]
    edges = [(f"n{a}", f"n{b}") for a, b in np.random.default_rng(4).integers(0, 13, (30, 2)) if a not in (3, 4)]
    added = [("n3", "n0"), ("n3", "n5"), ("n1", "n7"), ("n1", "n1"), ("n2", "unknown"), ("n99", "n1"), edges[0]]
    removed = [x for x in edges if x[0] == edges[1][0]] + [edges[5], ("n7", "n98")]
    lists = nodes, edges, added, removed
    return lists, [spark.createDataFrame([(n,) for n in nodes], "node string"), *(spark.createDataFrame(x, "src string, dst string") for x in lists[1:])]


def test_an_edit_goes_through_the_same_rounds(edit, monkeypatch):
    """what_if_ranks made fifty more rounds for the edit, a job each, over all edges."""
    (nodes, edges, added, removed), (n, e, more, gone) = edit
    stored, whole = [], graph.Ranks._stored
    monkeypatch.setattr(graph.Ranks, "_stored", lambda self, df: stored.append(df.columns) or whole(self, df))
    got = {r.url: r for r in graph.what_if(n, e, more, gone, iterations=8).collect()}
    assert stored == [["node", "x", "y"], *[["node", "k", "x", "y"]] * 2]  # the start, and two jobs of four rounds
    before, after = ranks(nodes, edges, 8), ranks(nodes, [x for x in {*edges, *added} if x not in removed], 8)
    for k in nodes:
        b, a = before[k] / max(before.values()), after[k] / max(after.values())
        assert (got[k].before, got[k].after, got[k].delta) == (pytest.approx(b, abs=1e-12), pytest.approx(a, abs=1e-12), pytest.approx(a - b, abs=1e-12))


@pytest.mark.parametrize("which", ["added", "removed", "none"])
def test_edits_of_one_kind_and_none(edit, which, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 0)
    (nodes, edges, added, removed), (n, e, more, gone) = edit
    now = {"added": [*edges, *added], "removed": [x for x in edges if x not in removed], "none": edges}[which]
    got = {r.url: r.after for r in graph.what_if(n, e, more if which == "added" else None, gone if which == "removed" else None, iterations=3).collect()}
    want = ranks(nodes, now, 3)
    assert got == {k: pytest.approx(want[k] / max(want.values()), abs=1e-12) for k in nodes}


def test_edges_are_stored_as_lists(spark):
    """an edge was a row, met and summed one by one."""
    n = spark.createDataFrame([(f"n{k}",) for k in range(30)], "node string")
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(30) for b in range(30)], "src string, dst string")
    own = graph.Ranks(n, e, iterations=2)
    rows = own.spark.table(own.name).agg(F.count("*").alias("n"), F.sum(F.size("at")).alias("edges")).first()
    assert (rows["n"], rows["edges"]) == (30, 870) and own.edges.count() == 870
    assert sorted(r.node for r in own.names.collect()) == list(range(30))  # without gaps
    own.close()


def test_lists_and_sums_go_by_blocks(monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_BITS", 3)
    rng = np.random.default_rng(9)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))})
    batches = [pa.RecordBatch.from_pydict({"src": pa.array([a for a, _ in part], pa.int64()), "dst": pa.array([b for _, b in part], pa.int64())}) for part in (edges[:100], [], edges[100:])]
    rows = [r for b in graph.packed(batches) for r in b.to_pylist()]
    assert [(r["src"], (r["block"] << 3) + at) for r in rows for at in r["at"]] == edges and max(at for r in rows for at in r["at"]) < 8
    rows.sort(key=lambda r: r["block"])
    kind = pa.schema([("block", pa.int64()), ("at", pa.list_(pa.int32())), ("x", pa.float64()), ("y", pa.float64())])
    met = pa.RecordBatch.from_pylist([r | {"x": 1.0 + r["src"], "y": 0.0} for r in rows if r["block"] != 2], kind)
    got = [r for b in graph.summed([met.slice(0, 7), met.slice(0, 0), met.slice(7)]) for r in b.to_pylist()]
    want = {k: sum(1.0 + a for a, b in edges if b == k) for k in range(40) if k >> 3 != 2}
    assert {r["node"]: r["x"] for r in got} == want and len(got) == len(want) and not any(r["y"] for r in got)
    assert list(graph.summed([])) == []


def test_a_graph_without_edges_or_nodes(spark):
    n, e = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([], "src string, dst string")
    assert {r.node: r["rank"] for r in graph.pagerank(n, e, iterations=3).collect()} == {"a": 0.5, "b": 0.5}
    assert graph.pagerank(n.where("false"), e, iterations=1).collect() == []
