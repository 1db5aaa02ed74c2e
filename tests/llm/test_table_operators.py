"""URL rules, top-k, WARC, transcripts and the pipeline against brute force on small tables."""

import gzip
import hashlib
import itertools

import numpy as np
import pytest

from webloom.llm import simhash, topk, transcripts, urlrules, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], "page_id long, url string, html string, host string, rule string, key long")


def naive_rule(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(h + p, v) for h, p, v in rules if h and p and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    most = max(len(r) for r, _ in fit)
    rule = min(r for r, _ in fit if len(r) == most)
    return host, path, rule, "block" if (rule, "block") in fit else "allow"


@pytest.mark.parametrize("ranges,bound", [(None, 20_000), (1, 0), (5, 20_000)])
def test_url_rules_are_those_of_all_pairs(spark, monkeypatch, ranges, bound):
    monkeypatch.setattr(urlrules, "BROADCAST", bound)
    rng = np.random.default_rng(0)
    labels, tops, heads = ["a", "b", "www", "x1"], ["com", "net", "b.com"], ["/", "/en/", "/en/x", "", "/e"]
    host = lambda: ".".join([*rng.choice(labels, rng.integers(0, 3)), rng.choice(tops)])
    rules = [(host(), str(rng.choice(["/", "/en/", "/e"])), str(rng.choice(["allow", "block"]))) for _ in range(12)] + [("com", "/", "allow"), ("com", "/", "block"), ("", "/", "block"), ("net", "", "block")]
    rows = [(i, f"http://{host().upper() if i % 3 == 0 else host()}{rng.choice(heads)}{'?q=/' if i % 5 == 0 else ''}", "") for i in range(150)]
    rows += [(500, None, None), (501, "", ""), (502, "no scheme", ""), (None, "https://a.com/en/", ""), (503, "http://com", ""), (503, "http://com", ""), (504, "x://a://b.com/en/", ""), (505, "http://a.com" + "/e" * 5000, "")]
    got = urlrules.judge(pages(spark, rows), urlrules.rule_table(spark, rules), ranges=ranges).collect()
    want = sorted(repr((i, *naive_rule(u, rules))) for i, u, _ in rows)
    assert sorted(repr(tuple(r)) for r in got) == want


def test_url_rules_of_empty_tables(spark):
    none = urlrules.rule_table(spark).limit(0)
    assert urlrules.judge(pages(spark, []), urlrules.rule_table(spark)).count() == 0
    got = urlrules.judge(pages(spark, [(1, "http://a.com/", "")]), none).collect()
    assert [tuple(r) for r in got] == [(1, "a.com", "/", None, "allow")]


def naive_topk(rows, k=5, every=50):
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for at, (i, q) in enumerate(v):
        if i is None or i % every:
            continue
        s = [(-sum(a * b for a, b in zip(q, e)), 2**63 if j is None else j) for n, (j, e) in enumerate(v) if n != at and len(e) == len(q)]
        out += [(i, r + 1, None if j == 2**63 else j, -x) for r, (x, j) in enumerate(sorted(s)[:k])]
    return sorted(map(repr, out))


def embeddings(spark, rows):
    return spark.createDataFrame([(i, e, 1, "s", "v") for i, e in rows], "vec_id long, embedding array<float>, score int, id string, dim string")


def test_topk_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(260)]
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [(0, rows[0][1]), (50, rows[3][1]), (50, rows[50][1])]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 8), (103, [float("inf")] * 8), (None, rows[1][1]), (150, [1.0, 2.0]), (151, [2.0, 2.0]), (200, []), (201, [])]
    rows += [(1000 + 50 * i, [float(i)] * 3000) for i in range(4)]  # very long vectors
    for pilot, rounds in ((20, (1, 1)), (200, (2,))):
        got = topk.search(embeddings(spark, rows), shard_bytes=2000, block_rows=3, pilot=pilot, rounds=rounds)
        assert sorted(repr(tuple(r)) for r in got.collect()) == naive_topk(rows)
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert sorted(repr(tuple(r)) for r in topk.search(embeddings(spark, few)).collect()) == naive_topk(few)
    assert topk.search(embeddings(spark, [])).count() == 0


def test_ball_tree_of_equal_points():
    v = np.ones((5000, 4), np.int64)
    at, s, i = topk.BallTree(np.arange(5000), v).search(v[:2], 3, np.full(2, topk.NO_FLOOR))
    assert s.tolist() == [4] * 6 and i.tolist() == [0, 1, 2] * 2


def naive_warc(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in data:
        same = [j for j, c in data if c == b and j is not None] if len(b) >= 100 else []
        origin = min(same, default=None)
        revisit = origin is not None and i != origin
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", origin if revisit else None))
    return sorted(map(repr, out))


def test_warc_round_trip(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, None, "y" * 99), (4, "u\r\nv", "y" * 99), (5, "http://a/5", None), (6, "", ""), (7, "http://a/7", long), (9, "http://a/9", long), (None, "http://n", "x" * 100), (None, "http://n", "z" * 200), (2, "http://a/2", "x" * 100), (8, "http://a/8", "<html>" * 5000)]
    got = warc.round_trip(pages(spark, rows), segment=4096)
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == naive_warc(rows)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_reader_reports_damage(spark):
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [b for _, b in warc.parse(data + data)] == [b"hello"] * 2
    assert [b for _, b in warc.parse(gzip.compress(data) + gzip.compress(data))] == [b"hello"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(data[:40]))
    for payload in (b"", b"a", bytes(range(256)) * 100):
        assert warc.unchunked(warc.chunked(payload)) == payload
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")


def naive_path(model, seen):
    best = None
    for states in itertools.product(range(transcripts.STATES), repeat=len(seen)):
        p = model.first[states[0]] + sum(model.move[a, b] for a, b in zip(states, states[1:])) + sum(model.show[s, o] for s, o in zip(states, seen))
        if best is None or p > best + 1e-12:
            best = p
    return best


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    n = transcripts.STATES
    model = transcripts.Model(rng.integers(1, 9, n), rng.integers(1, 9, (n, n)), rng.integers(0, 9, (n, transcripts.OBSERVATIONS)))
    for _ in range(5):
        seen = rng.integers(0, transcripts.OBSERVATIONS, 5).tolist()
        path = model.path(seen, True, 0, None)
        p = model.first[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(model.show[s, o] for s, o in zip(path, seen))
        assert abs(p - naive_path(model, seen)) < 1e-9


def naive_fit(rows):
    """The counts of a single pass over each conversation."""
    n = transcripts.STATES
    starts, moves, shows = np.zeros(n), np.zeros((n, n)), np.zeros((n, transcripts.OBSERVATIONS))
    for c in {r[0] for r in rows}:
        last, fresh = None, True
        for _, _, role, text in sorted({r for r in rows if r[0] == c}, key=lambda r: (r[1] is not None, r[1] or 0, r[3] or "", r[2] or "")):
            if role not in transcripts.ROLES:
                last, fresh = None, False
                continue
            for k, o in enumerate(transcripts.observations(text)):
                s = 2 * transcripts.ROLES.index(role) + (k > 0)
                shows[s, o] += 1
                if last is not None:
                    moves[last, s] += 1
                elif fresh:
                    starts[s] += 1
                last, fresh = s, False
    return transcripts.Model(starts, moves, shows)


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, before int")


@pytest.mark.parametrize("chunk,fan", [(4, 3), (256, 256)])
def test_long_conversations_are_decoded_as_one(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(transcripts, "CHUNK", chunk)
    monkeypatch.setattr(transcripts, "FAN", fan)
    rng = np.random.default_rng(3)
    rows = []
    for c, n in ((1, 90), (2, 3), (3, 1)):
        for t in range(n):
            role = ["user", "assistant"][t % 2]
            mark = {"user": "User: ", "assistant": "Bot: "}[role] if rng.random() < 0.6 else ""
            rows.append((c, t, role, mark + "\n".join(["a line?" if role == "user" else "b" * 90] * int(rng.integers(1, 4)))))
    rows += [(4, 0, "user", None), (4, 1, None, ""), (4, 1, None, ""), (None, None, "user", "Q: hi"), (5, -3, "tool", "x\n" * 300)]
    # a conversation without numbers, in the order of its texts
    unnumbered = [(7, None, ["user", "assistant"][t % 2], f"{t:03d} {'User' if t % 2 == 0 else 'Bot'}: {'ab' * 50}") for t in range(21)]
    rows += unnumbered
    parts = transcripts.numbered(transcripts.materialise(transcripts.chunks(talks(spark, rows))))
    model = transcripts.fit(parts)
    want = naive_fit(rows)
    for name in ("first", "move", "show"):
        assert np.allclose(getattr(model, name), getattr(want, name))
    every = transcripts.decode(parts, model).collect()
    got = {(r.conv_id, r.turn): r for r in every}
    assert len(every) == len(rows) - 1
    seen = [o for r in unnumbered for o in transcripts.observations(r[3])]
    path = [transcripts.ROLES[s // 2] for s in model.path(seen, True, 0, None)]
    found = sorted((r.rendered, r.found) for r in every if r.conv_id == 7)
    assert len(found) == 21 and sorted(f for _, f in found) == sorted(path)
    for c in (1, 2, 3):
        own = [r for r in rows if r[0] == c]
        seen = [o for r in own for o in transcripts.observations(r[3])]
        path = [transcripts.ROLES[s // 2] for s in model.path(seen, True, 0, None)]
        assert [x for r in own for x in got[c, r[1]].roles] == path
    right = sum(got[1, t].found == ["user", "assistant"][t % 2] for t in range(90))
    assert right >= 80
    assert got[1, 0].rendered.startswith("<|") and got[1, 0].rendered.endswith("<|end|>\n") and "User:" not in got[1, 0].rendered
    assert transcripts.format_chats(talks(spark, [])).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in "bcdfglmn" for b in ("ala", "ore", "iti", "une", "esk")]
    text = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    clean = [(i, text(80)) for i in range(120)]
    leak = text(30)
    toxic = [(200 + i, f"{text(40)} vilescum {text(40)}") for i in range(40)]
    passage = ". ".join(text(12)[:-1] for _ in range(6)) + "."
    copies = [(300, clean[0][1]), (301, clean[1][1].upper())]
    shared = [(400, f"{text(60)} {passage} {text(60)}"), (401, f"{text(60)} {passage} {text(60)}")]
    leaks = [(500, f"{text(20)} {leak} {text(20)}")]
    rows = clean + toxic + copies + shared + leaks + [(600, None), (601, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(200 <= i < 300)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state, after = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        state.write.parquet(f"{tmp_path}/{name}")
        state = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = {r.doc_id: r for r in state.collect()}
        if name != "bpe":
            assert state.columns == docs.columns
    ids = {k: set(v) for k, v in after.items()}
    assert not ids["toxicity"] & {i for i, _ in toxic} and {i for i, _ in clean} <= ids["toxicity"]
    kept = {600: simhash.fingerprint(None)}
    assert not ids["neardup"] & {300, 301} and (601 in ids["neardup"]) + (600 in ids["neardup"]) == len(kept)
    assert passage in after["linededup"][400].text and passage not in after["linededup"][401].text
    assert ids["decontam"] == ids["linededup"] - {500}
    assert {i for i, _ in clean} <= ids["bpe"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in after["bpe"].values()}


def test_pipeline_of_nothing_and_of_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, id long, mark string, node long, rank long, score string, n_chars int, removed string"
    for name, rows in (("none", []), ("some", [(1, "a text of five words", 1, "m", 2, 3, "s", 20, "r"), (2, None, 1, "m", 2, 3, "s", None, "r"), (None, "a text of five words", 1, "m", 2, 3, "s", 20, "r")])):
        docs = spark.createDataFrame(rows, kind)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns[0] == "doc_id" and got.count() == (2 if rows else 0)
        state = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, f"{tmp_path}/{name}")
            assert state.columns == docs.columns and dict(state.dtypes) == dict(docs.dtypes)
