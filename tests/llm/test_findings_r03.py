"""What the findings of round 3 were about, on small tables."""

import numpy as np
import pytest

import corpus_pipeline
from webloom.llm import align, bpe, neardup, simhash


def test_the_pipeline_joins_fingerprints_and_similar_sets(spark, monkeypatch):
    """a pair that SimHash alone links was kept twice; and chains go through links of both kinds."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rng.choice(words, 60))
    near = a.split()
    near[-1] = "other"
    # of long repeats, whose fingerprint is that of the repeated part, but whose sets of shingles differ
    tail = " ".join(rng.choice(words, 40))
    rep = " ".join(["one two three"] * 400)
    texts = {1: rep, 2: f"{rep} {tail}", 3: a, 4: " ".join(near), 5: " ".join(rng.choice(words, 50)), 6: f"{rep} {tail} x"}
    assert (simhash.fingerprint(texts[1]) ^ simhash.fingerprint(texts[2])).bit_count() <= simhash.DISTANCE
    x, y = (set(neardup.shingles(texts[k]).tolist()) for k in (1, 2))
    assert len(x & y) < 0.8 * len(x | y)
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in texts.items()], "doc_id long, text string, n_chars int")
    kept = corpus_pipeline.keep_one_of_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]


def by_rank(ranks, piece):
    """The ids of a piece: the lowest pair is merged, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        low, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if low == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_bpe_takes_words_that_never_come_again(spark):
    """op8_bpe over its budget: each new piece was looked up, encoded alone and remembered; ids are those of merging by rank."""
    public = pytest.importorskip("public_tokenizers")
    import regex

    path = public.path("byte_bpe_50k.tiktoken")
    ranks, rng = bpe.read_ranks(path), np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdeéß日🎉  \n\x85\x1c1½'s"), 300)) for _ in range(20)] + ["", " " * 50 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs).collect()}
    assert got == {i: [t for p in regex.findall(public.PATTERN, x) for t in by_rank(ranks, p.encode())] for i, x in enumerate(texts)}
    codec = bpe.Codec(*bpe.codec_parts())
    codec.encode(" ".join(texts))
    assert not hasattr(codec, "known")


def test_bpe_takes_millions_of_spaces():
    """op8_bpe: tiktoken's own split stops at some million spaces in a row."""
    pytest.importorskip("public_tokenizers")
    codec = bpe.Codec(*bpe.codec_parts())
    for text in (" " * 2_000_000 + "x", "a\n" + "\n" * 1_500_000):
        assert codec.decode(np.frombuffer(codec.encode(text), "<u4").tolist()) == text.encode()
    near = " " * (bpe.LONG_SPACE - 1)
    assert codec.encode(near + " x")[-8:] == codec.encode(near + "x")[-8:]


def test_overlaps_are_those_of_all_pairs():
    """op12_align over its budget: groups and links are found for some texts at once, not by array functions for each."""
    rng = np.random.default_rng(12)
    for n in (1, 2, 7, 40, 200):
        a, b = (np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n) for _ in range(2))
        to_a, to_b, i, j, counts = align.overlaps(a, b)
        assert a[to_a].tolist() == b[to_b].tolist() == sorted({*a.tolist()} & {*b.tolist()})
        start = lambda e, k: e[k - 1] if k else 0
        assert [*zip(i, j)] == [(x, y) for x in range(len(a)) for y in range(len(b)) if start(a, x) < b[y] and start(b, y) < a[x]]
        assert counts.tolist() == [(i == x).sum() for x in range(len(a))]
    assert [len(x) for x in align.overlaps(*[np.empty(0, np.int64)] * 2)] == [0] * 5
