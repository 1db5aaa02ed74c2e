"""Quality rules against a plain version."""

import re
from collections import Counter

from webloom.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
FIELDS = "doc_id long, text string, kept string, n_words long, rule string, line string, h long, w string"
GOOD = "The river runs past the old mill and turns below the bridge every morning again.\n"
PROSE = "".join(GOOD.replace("river", f"river{k}").replace("mill", f"mill{k}").replace("below", f"below{k}").replace("bridge", f"bridge{k}").replace("past", f"past{k}") for k in range(6))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "r", "l", 2, "w") for i, t in rows], FIELDS)


def naive(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars = lost = 0
    for x in lines:
        own, low = WORD.findall(x), "".join(c.lower() if c.isascii() else c for c in x)
        bad = 8 * sum(len(m[0]) for m in re.finditer(quality.SIGNS, x)) > len(x) or len(own) >= 10 and x.rstrip(quality.BLANKS)[-1] not in quality.ENDS
        apart = sum(y in quality.SEPARATORS for y in own)
        bad |= apart >= 2 and 4 * apart >= len(own) or len(own) <= 6 and bool(re.search(quality.MENU.replace("$", r"\Z"), low)) or any(p in low for p in quality.BOILERPLATE)
        chars, lost = chars + len(x), lost + len(x) * bad
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed, not failed and 100 * lost <= 30 * chars)


CASES = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r\n"),
    (None, PROSE),
    (4, PROSE),
    (4, PROSE),
    (5, PROSE + "home | about | contact\nHome\n© All rights reserved by the mill.\n"),
    (6, PROSE + "word### " * 40 + "\n"),
    (7, PROSE + "a b c d e f g h i j k\n" * 30),
    (8, PROSE + "WHAT!! IS!! THIS!! NOW!!\n" * 12),
    (9, "a a a a " * 30),
    (10, "x y z " + PROSE + " x y z  é ü 🎉 x y z\r\nİstanbul Kelvin K\nhomeé\nhome.\nLOG IN now\n"),
    (11, "one two"),
    (12, "one two three one two three"),
    (13, "w " * 30_000 + PROSE),
    (14, " ".join(f"w{k % 7001}q{k % 13}" for k in range(60_000))),
    (15, PROSE.replace("\n", "\r\n")),
    (16, PROSE + "-\n|\n> >\n" + "x" * 200_000 + "\n"),
    (17, "\n".join(f"line {k} of a list that has no mark at its own end {k}" for k in range(40))),
]


def test_measures_are_those_of_the_plain_version(spark):
    got = quality.judge(docs(spark, CASES))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(repr((i, *naive(t))) for i, t in CASES)
    assert sorted(repr(tuple(r)[:8]) for r in got.collect()) == want
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert 4 in kept and 5 in kept and 15 in kept and not kept & {1, 2, 3, 6, 7, 8, 9, 11, 12, 17}
    assert quality.judge(docs(spark, [])).count() == 0


def test_windows_that_share_a_hash_are_told_by_their_words(spark, monkeypatch):
    real = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: real(*c) * 0)
    rows = [(1, "a b c d e f a b c x y z a b"), (2, "a b c d"), (3, PROSE)]
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(docs(spark, rows)).collect()}
    assert got == {1: 6, 2: 0, 3: naive(PROSE)[4]}


def test_lines_that_fail_are_removed(spark):
    table = docs(spark, CASES)
    got = quality.clean(table, removed="gone")
    assert got.columns == [*table.columns, "gone"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[5].text == PROSE and [(x.number, x.rule) for x in by[5].gone] == [(6, "navigation"), (7, "navigation"), (8, "boilerplate")]
    assert by[4].text == PROSE and by[4].gone == [] and (by[4].kept, by[4].n_words, by[4].h) == ("k", 1, 2)
    assert 6 not in by and quality.clean(docs(spark, [])).count() == 0
