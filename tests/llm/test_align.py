"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from webloom.llm import align

FIELDS = "doc_id long, text string, a string, b string, ends_a string, got string, row long, key long, links string, link string, n long"
SPECIAL = "a <|endoftext|> b </s> <s> c <0x41> <unk>"
CASES = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "Hello world, the quick brown foxes' don't jump 1234 times."),
    (4, "Hello world, the quick brown foxes' don't jump 1234 times."),
    (None, "Hello world"),
    (5, "  two  spaces \n\n and\ttabs \r\n at   the end  "),
    (6, "naïve Übermaß ciónesbo éèçü 日本語のテキスト 🎉👩‍👩‍👧 ́x   y　z  q"),
    (7, "a literal ▁ mark, and▁joined"),
    (8, SPECIAL),
    (9, "x" * 5000 + " " + "ab" * 3000),
    (10, "erthtionst onenheit schlichau quequeque " * 400),
    (11, "\x00 null \x1f and \x85 others﻿"),
    (12, "!!!??? ### $$$%%% -- ... ' s 's 're n't (a) [b]"),
    (13, "one\ntwo\nthree four\n five"),
    (14, "the cat"),
    (15, "the dog the cat"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["s"] * 4, 1, 2, "l", "m", 3) for i, t in rows], FIELDS)


@pytest.fixture(scope="module")
def plain():
    """Ids and byte strings of whole texts, by both libraries' own ways."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = {i: x for x, i in t.get_vocab().items()}
    printed = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    back = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}

    def encode(text):
        if not text:
            return [], []
        a = [(i, bytes(back[c] for c in names[i])) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in sp.encode(text):
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    return encode


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def naive(rows, encode):
    read = []
    for i, t in rows:
        a, b = map(spans, encode(t))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, s, e in side if lo <= s and e <= c) for side in (a, b)))
            lo = c
        links, first = [], 0
        for x, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        read.append((i, a, b, groups, links))
    count = Counter(p for *_, links in read for p in set(links))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for i, a, b, groups, links in read:
        text = ";".join(groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(map(repr, out))


@pytest.mark.parametrize("most", [align.BROADCAST, 0])
def test_digests_are_those_of_the_plain_version(spark, plain, most):
    got = align.digests(docs(spark, CASES), most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = got.collect()
    assert sorted(repr(tuple(r)) for r in rows) == naive(CASES, plain)
    assert {r.doc_id for r in rows if not r.n_a} == {1, 2, 7}
    assert align.digests(docs(spark, []), most=most).count() == 0


def test_ids_and_ends_are_those_of_both_libraries(plain):
    pair = align._Pair(*align.models())
    rng = np.random.default_rng(2)
    # letters, digits, marks, blanks and unassigned characters of all planes
    points = [c for c in [*range(0x3400), *rng.integers(0x3400, 0x110000, 4000).tolist()] if not 0xD800 <= c < 0xE000]
    odd = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)} " for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    for t in [t for _, t in CASES] + odd:
        a, ends_a, b, ends_b = (x.tolist() for x in pair.encode(t))
        want_a, want_b = plain(t)
        assert a == [i for i, _ in want_a] and b == [i for i, _ in want_b]
        assert ends_a == [e for *_, e in spans(want_a)] and ends_b == [e for *_, e in spans(want_b)]


def test_groups_and_links_of_each_row(spark, plain):
    row = align.align(docs(spark, [(1, "Übermaß ciónesbo"), (2, None)])).orderBy("doc_id").collect()
    a, b = map(spans, plain("Übermaß ciónesbo"))
    assert sorted((x.a, x.b) for x in row[0].links) == sorted((i, j) for i, s, e in a for j, u, v in b if s < v and u < e)
    for g in row[0].groups:
        assert (a[g.from_a][1], a[g.to_a][2]) == (b[g.from_b][1], b[g.to_b][2])
    assert row[1].groups == [] and row[1].links == []
