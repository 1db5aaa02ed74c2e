"""License scans: an exact set-similarity join of text blocks with license templates.

A text is lower-cased in A-Z and cut into words, whatever lines and paragraphs they stand in. Its blocks for a template of m words
are all stretches of ``STRETCH`` times m consecutive words (the whole text, if it has fewer). A block and a template meet if the
block holds at least ``THRESHOLD`` of the template's distinct words. The join orders the templates' words by how many texts hold
them, rarest first (ties by the word), and finds every such pair with

* a prefix filter: a text that shares none of a template's first ``size - need + 1`` words has no block that meets it;
* a length filter: a text with fewer distinct words of all templates than needed has none;
* a positional filter: the first shared word's place in both orders bounds what may still be shared.

What is left is verified by a window that moves over the places of the template's words, in time linear in them. Words outside all
templates never count, so only the others are ordered. Word frequencies come from a first pass over all texts; they number no more than the
templates' words. Where templates of one family match overlapping blocks, those with the largest share (then the most words) give the labels.

Templates are a table (name, label, family, text) of at most ``MOST_TEMPLATES`` rows; more are refused. Fixed phrases are found apart
from that, as consecutive words anywhere in the text.

Null and empty texts have no words: no labels, score 0 and null places. Repeated rows are each judged. Very long texts are judged whole, in time
linear in their length and with memory for their list of words. Other columns of the input aren't read, and their names don't matter.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import lean
from webloom.llm.license_texts import TEMPLATES

#: The phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
THRESHOLD = 0.85
#: Words of a block for each word of its template: room for names, dates and comments in between.
STRETCH = 1.25
MOST_TEMPLATES = 10_000

#: Bytes to bytes: A-Z in lower case, digits, a-z and all bytes of other characters kept, the rest as blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in templates], "name string, label string, family string, text string")


def listed(templates: DataFrame) -> list[tuple[str, str, str, str]]:
    """The rows of a template table, bounded."""
    rows = templates.select("name", "label", "family", "text").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return [tuple(r) for r in rows]


class Index:
    """The templates' prefixes, words ordered from the rarest."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float = THRESHOLD, stretch: float = STRETCH):
        self.templates = [(name, label, family, words(text)) for name, label, family, text in templates if words(text)]
        vocabulary = sorted({w for *_, t in self.templates for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.sorted = [sorted({self.rank[w] for w in t}) for *_, t in self.templates]
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in self.sorted]
        self.room = [math.ceil(stretch * len(t) - 1e-9) for *_, t in self.templates]
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.sorted):
            for place, r in enumerate(t[: len(t) - self.need[k] + 1]):
                self.prefix[r].append((k, place))
        self.first = {w for w, r in self.rank.items() if r in self.prefix}
        self.least = min(self.need, default=1)

    def matches(self, text: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, shared words) of the blocks that meet a template: those that end at one of its words and begin as late as they may."""
        if self.first.isdisjoint(text):
            return []
        rank = self.rank
        at = [(i, rank[w]) for i, w in enumerate(text) if w in rank]
        own = sorted({r for _, r in at})
        if len(own) < self.least:
            return []
        seen, out = set(), []
        for place_own, r in enumerate(own):
            for k, place in self.prefix.get(r, ()):
                if k in seen:
                    continue
                # r is the first word that both have: no later one can be the first
                seen.add(k)
                if min(len(own) - place_own, len(self.sorted[k]) - place) >= self.need[k]:
                    out += [(k, *x) for x in self._blocks(k, at)]
        return out

    def _blocks(self, k: int, at: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        mine, need, room = set(self.sorted[k]), self.need[k], self.room[k]
        places = [x for x in at if x[1] in mine]
        have: Counter = Counter()
        lo = 0
        for i, r in places:
            have[r] += 1
            while places[lo][0] <= i - room:
                old = places[lo][1]
                have[old] -= 1
                if not have[old]:
                    del have[old]
                lo += 1
            if len(have) >= need:
                yield max(0, i + 1 - room), i + 1, len(have)

    def best(self, blocks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """The blocks that no overlapping block of the family beats in share of words, then in words."""
        by_family = defaultdict(list)
        for b in blocks:
            by_family[self.templates[b[0]][2]].append((b[3] / len(self.sorted[b[0]]), len(self.sorted[b[0]]), b))
        out = []
        for rows in by_family.values():
            rows.sort(key=lambda x: x[:2], reverse=True)
            taken: list[tuple[int, int]] = []  # the union of better blocks
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j][:2] == rows[i][:2]:
                    j += 1
                ends = [e for _, e in taken]
                free = [b for *_, b in rows[i:j] if (n := bisect_left(ends, b[1] + 1)) == len(taken) or taken[n][0] >= b[2]]
                out += free
                taken, i = merged(taken + [(b[1], b[2]) for *_, b in rows[i:j]]), j
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def frequencies(docs: DataFrame, templates, column: str = "text") -> dict[bytes, int]:
    """How many texts hold each of the templates' words."""
    wanted = {w for *_, t in templates for w in words(t)}

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for b in parts:
            for t in b.column(0):
                got.update(wanted.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(got), pa.binary()), "n": pa.array(list(got.values()), pa.int64())})

    counted = docs.select(column).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}  # a row for each of the templates' words


def places(text: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """(first word, label) of all places of the phrases, given as words between blanks; a text's blanks are counted once for each phrase."""
    flat, out = b" " + b" ".join(text) + b" ", []
    for p, label in phrases:
        at, word, before = flat.find(p), 0, 0
        while at >= 0:
            word += flat.count(b" ", before, at)
            before = at
            out.append((word, label))
            at = flat.find(p, at + 1)
    return out


_BLOCK = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "template": pa.string(), "share": pa.float64()}))


def scan(docs: DataFrame, key: str = "doc_id", column: str = "text", phrases: dict[str, str] | None = None, templates: DataFrame | None = None, threshold: float = THRESHOLD, stretch: float = STRETCH) -> DataFrame:
    """For each row its key, n_words, places of the phrases, labels, score and blocks: the stretches of words (start, end) that meet a template, overlapping ones as one with their largest share."""
    phrases = PHRASES if phrases is None else phrases
    table = listed(template_table(docs.sparkSession) if templates is None else templates)
    docs = lean(docs).select(F.col(key).alias("key"), F.col(column).alias("text"))
    index = Index(table, frequencies(docs, table), threshold, stretch)
    fixed = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items() if words(p)]

    def judge(text: str | None) -> dict:
        w = words(text)
        found = places(w, fixed) if w else []
        blocks = index.matches(w)
        base, labels = {x for _, x in found}, {index.templates[k][1] for k, *_ in index.best(blocks)}
        size = lambda k: len(index.sorted[k])
        spans: list[dict] = []
        for k, start, end, n in sorted(blocks):
            if spans and spans[-1]["template"] == index.templates[k][0] and start <= spans[-1]["end"]:
                spans[-1] |= {"end": max(end, spans[-1]["end"]), "share": max(n / size(k), spans[-1]["share"])}
            else:
                spans.append({"start": start, "end": end, "template": index.templates[k][0], "share": n / size(k)})
        return {
            "n_words": len(w),
            "n_base": len(found),
            "first_word": min((i for i, _ in found), default=None),
            "last_word": max((i for i, _ in found), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | labels)),
            "score": 1.0 if base else max((n / size(k) for k, *_, n in blocks), default=0.0),
            "blocks": spans,
        }

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start:long,end:long,template:string,share:double>>"
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "blocks": _BLOCK}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, 512):
                p = b.slice(at, 512)
                got = [judge(t.as_py()) for t in p.column(1)]
                yield pa.RecordBatch.from_arrays([p.column(0), *(pa.array([g[c] for g in got], kind) for c, kind in kinds.items())], names=["key", *kinds])

    out = docs.mapInArrow(run, f"key {dict(docs.dtypes)['key']}, {fields}")
    return out.withColumnRenamed("key", key)
