"""Toxicity, licenses, line dedup, BPE, decontamination and SimHash against brute force on small tables."""

import hashlib
import itertools
import math
import re
import textwrap
import time

import numpy as np
import pytest
import xxhash

from webloom.llm import bpe, decontam, licenses, linededup, neardup, simhash, toxicity

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, words string, id long, mark string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve."


def docs(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "s", "f", "w", 1, "m") for i, t in rows], FIELDS)


ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "alpha beta gamma delta"), (4, "É'tait   naïve 🎉 émue"), (4, "É'tait   naïve 🎉 émue"), (5, "x" * 20000), (6, "a b"), (7, "ti " * 3000)]


def test_toxicity_on_words_that_mark_a_class(spark):
    rng = np.random.default_rng(0)
    words = ["lake", "river", "stone", "green", "cloud", "window", "paper", "train"]
    text = lambda bad: " ".join([*rng.choice(words, 30), *(["vilescum"] if bad else [])])
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    table = docs(spark, rows + ODD[:4])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.classify(table, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id >= 200)
    assert right == 200
    kept = toxicity.reject(table, labels)
    assert kept.columns == table.columns and 300 <= kept.count() <= 304


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)
    assert toxicity.classify(docs(spark, []), none).count() == 0


def cut_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def naive_blocks(w, templates, threshold=licenses.THRESHOLD, stretch=licenses.STRETCH):
    """(template, start, end, share, size) of all stretches of words that meet a template and end at one of its words."""
    out = []
    for k, (*_, t) in enumerate(templates):
        t = cut_words(t)
        room, t = math.ceil(stretch * len(t) - 1e-9), set(t)
        for end in range(1, len(w) + 1):
            block = w[max(0, end - room) : end]
            if block[-1] in t and (n := len(t & set(block))) >= threshold * len(t) - 1e-9:
                out.append((k, max(0, end - room), end, n / len(t), len(t)))
    return out


def naive_licenses(text):
    w = cut_words(text)
    places, base = [], set()
    for p, label in licenses.PHRASES.items():
        q = p.split()
        at = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        places += at
        base |= {label} if at else set()
    blocks = naive_blocks(w, licenses.TEMPLATES)
    family = lambda x: licenses.TEMPLATES[x[0]][2]
    kept = [x for x in blocks if not any(family(x) == family(y) and y[1] < x[2] and x[1] < y[2] and y[3:] > x[3:] for y in blocks)]
    labels = base | {licenses.TEMPLATES[x[0]][1] for x in kept}
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max((x[3] for x in blocks), default=0.0))


def wrapped(name, width=50, lead="# "):
    """A template as it stands in the head of a file."""
    text = next(t for n, *_, t in licenses.TEMPLATES if n == name)
    return "\n".join(lead + x for x in textwrap.wrap(f"Copyright (c) 2020 Some One. {text}", width))


def test_licenses_are_those_of_all_stretches(spark):
    rows = ODD + [
        (10, "Released under the MIT License. Released under the MIT License."),
        (11, "this work, licensed under gnu\ngeneral public license version 3\nplain"),
        (12, "Permission granted free of charge to any person obtaining a copy of this software"),
        (13, "apache\nlicense version 2 apache license version 2.0 and CC BY-NC"),
        (14, "copy software person charge free"),
        (15, "Licensed under CC BY 4.0. " + "far " * 30 + "Licensed under CC BY-NC 4.0."),
    ]
    rows += [(20 + k, f"own words\n\n{wrapped(n)}\n\nand more") for k, n in enumerate(("mit", "bsd-2", "bsd clause", "apache notice", "gpl notice", "lgpl notice", "agpl notice"))]
    got = licenses.scan(docs(spark, rows)).collect()
    key = lambda r: repr(r)
    want = sorted([(i, *naive_licenses(t)) for i, t in rows], key=key)
    assert sorted([tuple(r)[:8] for r in got], key=key) == want
    labels = {r.doc_id: r.labels for r in got}
    assert [labels[k] for k in range(20, 27)] == ["mit", "bsd", "bsd", "apache-2", "gpl", "lgpl", "agpl-3"] and labels[15] == "cc-by,cc-by-nc"
    assert licenses.scan(docs(spark, [])).count() == 0
    # a template table of one's own, and its blocks
    own = licenses.template_table(spark, [("n", "own", "f", "one two three four")])
    (r,) = licenses.scan(docs(spark, [(1, "x one\ntwo; THREE four x x x four three one two")]), phrases={}, templates=own).collect()
    assert r.labels == "own" and [(x.start, x.end, x.share) for x in r.blocks] == [(0, 5, 1.0), (7, 12, 1.0)]


def test_license_filters_lose_no_block():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [(f"t{n}{k}", "l", f"f{k}", " ".join(rng.choice(vocabulary, n))) for n in (1, 2, 4, 6, 9) for k in range(3)]
    for threshold, stretch in ((0.5, 1.0), (0.8, 1.25), (1.0, 1.5)):
        index = licenses.Index(templates, {w.encode(): int(rng.integers(9)) for w in vocabulary}, threshold, stretch)
        for _ in range(150):
            w = list(rng.choice([*vocabulary, "x", "y"], rng.integers(0, 25)))
            got = index.matches([x.encode() for x in w])
            assert sorted((k, a, b, n / len(index.sorted[k])) for k, a, b, n in got) == sorted(x[:4] for x in naive_blocks(w, templates, threshold, stretch))


def test_license_places_in_linear_time():
    w = licenses.words("under the mit license " * 200_000)
    began = time.perf_counter()
    found = licenses.places(w, [(b" under the mit license ", "mit")])
    assert len(found) == 200_000 and found[-1] == (799_996, "mit") and time.perf_counter() - began < 5


def test_later_passages_are_cut_and_offsets_fit(spark):
    first = f"Intro of the first. {PASSAGE} More words here."
    second = f"Other start. {PASSAGE} And an end of its own."
    third = f"A line.\n{PASSAGE}"
    rows = [(25, second), (22, first), (29, third), (31, "No copy at all. Yes."), (32, "Yes. No.")] + ODD
    table = docs(spark, rows)
    got = {r.doc_id: r for r in linededup.apply(table, places="removed").collect() if r.doc_id not in (None, 4)}
    assert got[22].text == first and got[22].removed == []
    for i, t in ((25, second), (29, third)):
        assert PASSAGE not in got[i].text
        assert "".join(t[a.start : a.end] for a in got[i].removed).strip() == PASSAGE
        assert got[i].n_chars == len(got[i].text)
    assert got[31].text == "No copy at all. Yes." and got[32].text == "Yes. No."
    out = linededup.apply(table)
    assert out.columns == table.columns and out.count() == len(rows)
    assert linededup.apply(docs(spark, [])).count() == 0
    # rows that repeat id and text keep their text; a third copy under another id loses it
    twice = linededup.apply(docs(spark, [(1, PASSAGE), (1, PASSAGE), (3, PASSAGE), (None, PASSAGE)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in twice) == [(0, ""), (1, PASSAGE), (1, PASSAGE), (3, "")]


def test_later_short_lines_are_cut(spark):
    rows = [(1, "Released here.\nFirst of all. Yes."), (2, "Own words\nReleased   HERE.\nand more"), (3, "Released here. But not alone."), (4, "Go on. Now.\nx"), (5, "y\nGo on. Now.\nGo on. Here."), (6, "again\nagain\nend")]
    got = {r.doc_id: r.text for r in linededup.apply(docs(spark, rows)).collect()}
    assert [got[i].split("\n") for i in (1, 2, 3)] == [["Released here.", "First of all. Yes."], ["Own words", "and more"], ["Released here. But not alone."]]
    assert got[4] == rows[3][1] and [x for x in got[5].split("\n") if x] == ["y", "Go on. Here."] and got[6] == "again\nend"


def naive_units(text):
    """(words, characters, place, whole) of a text's units and short lines, by the words of the docstring."""
    out, place, at = [], 0, 0
    for line in text.split("\n"):
        units, first = [], at
        for m in re.finditer(r"\S+", line):
            units = units or [[]]
            units[-1].append((m[0].lower(), {at + k for k in range(m.start(), m.end())}))
            if m[0][-1] in ".!?":
                units.append([])
        units = [u for u in units if u]
        for u in units:
            out.append((tuple(w for w, _ in u), set().union(*(c for _, c in u)), place, len(units) == 1))
            place += 1
        if len(units) > 1 and sum(map(len, units)) < linededup.MIN_WORDS:
            out.append((tuple(w for u in units for w, _ in u), set().union(*(c for u in units for _, c in u)), -1, True))
        at = first + len(line) + 1
    return out


def naive_window_hash(words):
    """The order of windows: polynomials over characters and words, in plain integers."""

    def mixed(h):
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) % 2**64
        return h ^ (h >> 29)

    codes = []
    for w in words:
        a, b = (sum((ord(c) + 1) * pow(f, k, 2**31 - 1) for k, c in enumerate(w)) % (2**31 - 1) for f in (0x2F0B4C47, 0x59E3A1B5))
        codes.append(mixed(a << 31 | b) % (2**61 - 1))
    return mixed(sum(c * pow(0x1B873593CC9E2D51, k, 2**61 - 1) for k, c in enumerate(codes)) % (2**61 - 1))


def naive_windows(text):
    w = [(m[0].lower(), set(range(m.start(), m.end()))) for m in re.finditer(r"\S+", text)]
    each = [(tuple(x for x, _ in w[i : i + 8]), set().union(*(c for _, c in w[i : i + 8]))) for i in range(len(w) - 7)]
    if not each:
        return []
    h = [naive_window_hash(x) for x, _ in each]
    size = min(linededup.CHOICE, len(h))
    chosen = sorted({k for i in range(len(h) - size + 1) for k in range(i, i + size) if h[k] == min(h[i : i + size])})
    out, last = [], {}
    for k in chosen:
        if k >= last.get(each[k][0], -8) + 8:
            out.append(each[k])
            last[each[k][0]] = k
    return out


def naive_repeats(rows):
    """The removed characters, blanks left out, of each text."""
    earliest, pieces = {}, []
    for rank, text in rows:
        got = [("u", *u) for u in naive_units(text)] + [("w", *x, -1, True) for x in naive_windows(text)]
        pieces.append(got)
        for kind, words, *_ in got:
            earliest[kind, words] = min(rank, earliest.get((kind, words), rank))
    out = []
    for (rank, _), got in zip(rows, pieces):
        had, gone, later = set(), set(), []
        for kind, words, chars, place, whole in got:
            if rank > earliest[kind, words] or (kind, words) in had:
                gone |= chars if whole else set()
                later += [(place, len(words), chars)] if place >= 0 else []
            had.add((kind, words))
        run = []
        for k, x in enumerate(later):
            run.append(x)
            if k + 1 == len(later) or later[k + 1][0] != x[0] + 1:
                if sum(n for _, n, _ in run) >= linededup.MIN_WORDS:
                    gone = gone.union(*(c for *_, c in run))
                run = []
        out.append(gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(11)
    lines = [" ".join(rng.choice(["a", "B", "c.", "Éa", "d!", "İ", "e\tf"], rng.integers(1, 14))) for _ in range(30)]
    long = " ".join(f"w{x}" for x in rng.integers(400, size=3000))
    rows = []
    for i in range(150):
        cut = int(rng.integers(2500))
        some = [*rng.choice(lines, rng.integers(0, 6)), long[cut : cut + int(rng.integers(400))], *rng.choice(lines, rng.integers(0, 3))]
        rng.shuffle(some)
        rows.append((i * 3, str(rng.choice(["", "\n", "  "])) + str(rng.choice(["\n", "\n\n", "\n  "])).join(some)))
    want = naive_repeats(rows)
    got = {r.doc_id: r for r in linededup.apply(docs(spark, rows), places="removed").collect()}
    assert any(want)
    for (i, text), gone in zip(rows, want):
        removed = {k for a in got[i].removed for k in range(a.start, a.end)}
        assert {k for k in removed if not text[k].isspace()} == gone, i
        assert "".join(x for k, x in enumerate(text) if k not in removed) == got[i].text


def test_line_dedup_tells_patterns_apart_that_sums_modulo_powers_of_two_do_not(spark):
    """Complements of the sequence of bit counts cancel out in polynomials modulo 2^64, whatever their odd factor."""
    odd = [k.bit_count() % 2 for k in range(2048)]
    for n in (1024, 2048):
        words = [" ".join(("red", "blue")[x ^ y] for x in odd[:n]) for y in (0, 1)]
        chars = ["".join("ab"[x ^ y] for x in odd[:n]) for y in (0, 1)]
        rows = [(1, words[0]), (2, words[1]), (3, f"one.\n{chars[0]}"), (4, f"two.\n{chars[1]}")]
        row, _, _, h1, h2 = linededup._pieces([*words, *chars])
        whole = [(a, b) for r in range(4) for a, b in [(h1[row == r][0], h2[row == r][0])]]
        assert len({a for a, _ in whole}) == len({b for _, b in whole}) == 4
        got = {r.doc_id: r.text for r in linededup.apply(docs(spark, rows)).collect()}
        assert got[3] == rows[2][1] and got[4] == rows[3][1]


def test_line_dedup_of_a_text_of_megabytes(spark):
    rng = np.random.default_rng(12)
    long = "\n".join(" ".join(f"w{x}" for x in rng.integers(10**6, size=20)) for _ in range(10_000))
    got = {r.doc_id: r.text for r in linededup.apply(docs(spark, [(1, long), (2, "own words\n" + long + "\nmore of them")])).collect()}
    assert len(long) > 10**6 and got[1] == long and got[2] == "own words\nmore of them"


def test_later_passages_inside_sentences_are_cut(spark):
    rng = np.random.default_rng(6)
    draw = lambda n: [f"w{x}" for x in rng.integers(10**6, size=n)]
    passage, rows = draw(50), []
    for i in range(20):
        before, after = draw(3 + i), draw(4 + i)
        rows.append((i + 1, f"{' '.join(before)} {' '.join(passage)}\n{' '.join(after)}. Ünd  so🎉 on.", set(before + after)))
    got = {r.doc_id: r for r in linededup.apply(docs(spark, [r[:2] for r in rows]), places="removed").collect()}
    assert got[1].text == rows[0][1]
    for i, text, own in rows[1:]:
        left = got[i].text.split()
        assert own <= {w.strip(".") for w in left}
        assert len(set(passage) & set(left)) <= 2 * (linededup.CHOICE - 1)
        # places are offsets of the original
        at, kept = 0, ""
        for a in got[i].removed:
            kept, at = kept + text[at : a.start], a.end
        assert kept + text[at:] == got[i].text
    # a text that repeats itself keeps its first words
    again = linededup.apply(docs(spark, [(1, "ti " * 100), (2, " ".join(passage * 3))])).collect()
    left = {r.doc_id: r.text.split() for r in again}
    assert 8 <= len(left[1]) < 24 and left[2][:50] == passage and len(left[2]) < 80


def test_bpe_is_tiktokens(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = ODD + [(20, "Hello  world's <|endoftext|> 12345 \r\n\r\n 日本語 ½ \x85 \x1c"), (21, "🎉🏳️‍🌈" * 5)]
    ids = lambda t: enc.encode_ordinary(t or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(repr((i, len(ids(t)), sha(np.array(ids(t), "<u4").tobytes()), sha((t or "").encode()))) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in bpe.digests(docs(spark, rows)).collect()) == want
    full = bpe.encode(docs(spark, rows), offsets=True)
    for r in full.collect():
        text = {i: t or "" for i, t in rows}[r.doc_id]
        assert list(r.ids) == ids(text)
        data = text.encode()
        at = 0
        for token, a, b in zip(r.ids, r.starts, r.ends):
            piece = enc.decode_single_token_bytes(token)
            assert piece in text[a:b].encode()
            at += len(piece)
        assert at == len(data)
    back = {r.doc_id: r.text for r in bpe.decode(full).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert bpe.digests(docs(spark, [])).count() == 0


def naive_hits(text, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = cut(text), set(), set()
    for i, t in items:
        v = cut(t)
        n = min(10, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add("" if i is None else str(i))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontamination_is_that_of_all_windows(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST", bound)
    rng = np.random.default_rng(2)
    draw = lambda n: " ".join(rng.choice(["a", "b", "É", "é", "c"], n))
    items = [(1, draw(30)), (2, "ti " * 40), (3, "alpha Beta"), (4, None), (5, "..."), (None, "É'tait naïve"), (10, draw(12)), (10, draw(11)), (7, "x y z " * 3)]
    rows = ODD + [(30 + k, draw(60) + " " + items[0][1] + " " + draw(5)) for k in range(6)] + [(50, items[6][1].upper()), (51, "ALPHA, beta"), (52, "x y z x y z x y z x y")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.judge(docs(spark, rows), bench)
    want = sorted(repr((i, *naive_hits(t, items))) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    clean = decontam.clean(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns
    assert clean.count() == sum(not naive_hits(t, items)[4] for _, t in rows)
    assert decontam.judge(docs(spark, []), bench).count() == 0
    assert decontam.judge(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def naive_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(b)] = find(a)
    return {f: find(f) for f in root}


def test_simhash_components_are_those_of_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 4
    rows = ODD + [(40, base), (41, base.upper()), (42, base + "now"), (43, base.replace("lazy", "idle", 1)), (44, "")]
    got = simhash.groups(docs(spark, rows)).collect()
    fps = {naive_fingerprint(t) for _, t in rows}
    part = naive_components(fps)
    least = {}
    for i, t in rows:
        r = part[naive_fingerprint(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(repr((i, naive_fingerprint(t), least[part[naive_fingerprint(t)]])) for i, t in rows)
    assert sorted(repr((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == want
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(set(part.values()))
    assert simhash.groups(docs(spark, [])).count() == 0


def test_links_of_crowded_blocks(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(2**63))
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(max(a, b), min(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 2}
    assert {tuple(r) for r in simhash.links(nodes, group=8).collect()} == want
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, group=8)).collect()}
    part = naive_components([x % 2**64 for x in signed])
    groups = {}
    for x in signed:
        groups.setdefault(part[x % 2**64], set()).add(x)
    assert roots == {x: min(g) for g in groups.values() for x in g if x != min(g)}


def similar(a, b):
    """Whether the five-word shingles' Jaccard similarity is 0.8 or more."""
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return a == b or len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("group", [256, 4])
def test_pipeline_copies_are_those_of_similarity_four_fifths(spark, group):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for size in (60, 200, 300):
        for _ in range(4):
            base = list(rng.choice(vocabulary, size))
            texts.append(base)
            for edits in (1, 2, 3, 5, 8):
                t = list(base)
                for at in rng.choice(size, edits, replace=False):
                    t[at] = "new"
                texts.append(t)
    rows = [(100 + i, " ".join(t)) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, "A b"), (4, "a  B"), (5, "a c"), (None, "a b")]
    lead = {}
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if similar(rows[i][1], rows[j][1]):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    for (i, _), r in zip(rows, root):
        lead[r] = min(lead.get(r, 1e9), 1e9 if i is None else i)
    table = docs(spark, rows)
    got = {r.doc_id: r.component_id for r in neardup.groups(table, group=group).collect()}
    assert got == {i: lead[r] for (i, _), r in zip(rows, root)}
    if group == 256:
        assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_copies(spark, table, "").collect()) == sorted(lead.values())


def test_near_copies_of_one_text(spark):
    rng = np.random.default_rng(15)
    base = [f"w{i}" for i in rng.integers(10**4, size=200)]
    rows = []
    for i in range(150):
        t = list(base)
        for at in rng.choice(200, int(rng.integers(0, 13)), replace=False):
            t[at] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    root = list(range(150))
    for i, j in itertools.combinations(range(150), 2):
        if root[i] != root[j] and similar(rows[i][1], rows[j][1]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert 5 < len(set(root)) < 140
    assert {r.doc_id: r.component_id for r in neardup.groups(docs(spark, rows)).collect()} == dict(enumerate(root))


def test_very_long_texts(spark):
    words = [f"w{k % 5000}" for k in range(200_000)]
    long = " ".join(words)
    assert len(long) > 10**6
    table = docs(spark, [(1, long), (2, long + " released under the mit license"), (3, "short")])
    fp = {r.doc_id: r.fp for r in simhash.fingerprints(table).collect()}
    assert fp[1] == simhash.fingerprint(long)
    tokens = {r.doc_id: r for r in bpe.digests(table).collect()}
    assert tokens[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and tokens[1].n_tokens > 200_000
    found = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert found[1].n_words == 200_000 and found[1].labels == "" and (found[2].first_word, found[2].labels) == (200_001, "mit")
    item = spark.createDataFrame([(7, " ".join(words[100_000:100_030]))], "item_id long, text string")
    hit = {r.doc_id: r for r in decontam.judge(table, item).collect()}
    assert (hit[1].n_words, hit[1].n_hit, hit[1].n_items) == (200_000, 40 * 30, 1) and not hit[3].contaminated
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.classify(table, labels).collect())
    assert {r.doc_id: r.component_id for r in neardup.groups(table).collect()} == {1: 1, 2: 1, 3: 3}
