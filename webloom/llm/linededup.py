"""Substring dedup: line hashing with the original offsets kept.

A text's units are its lines, cut further after sentence ends. As a repeated passage may begin and end inside a
sentence, windows of ``WINDOW`` words are added, whatever lines and sentences they cross: of each ``CHOICE`` neighbouring
windows the one with the least hash, so a passage of WINDOW + CHOICE - 1 words always holds a chosen one, and
at most CHOICE - 1 words at each of its ends lie outside of them. Units and windows are normalised (lower case, runs of
white space as one blank, no blanks at the ends) and hashed to 96 bits, as polynomials modulo primes with two factors each. The digests are grouped over all texts; each
keeps its earliest occurrence, ranked by doc_id (null last, by the text's hash), then place in the text. Later
windows are removed. Consecutive later units of a text form a run, and a run of at least ``MIN_WORDS`` words is removed;
of shorter ones, whole lines go and pieces of a line stay, as chance repeats of a few words within lines are no copies.
A removed line takes its line feed along. Removed places are given as character offsets of the original text.

All texts are read twice: once for the digests that several documents share, and once for the places that hold one of
them, after a bitmap of bounded size has left out most that don't. The later places are sorted by document and folded as
they come, so no group of them is ever held but one document's own.

Rows that share a doc_id are of one rank: none of them loses a unit to another, only to lower ids and to its own
text, so rows that repeat both doc_id and text all get the same result. Null and empty
texts stay as they are. Very long texts are hashed whole, with some 100 bytes of memory a character. doc_id must be an integer or cast to one.
Extra columns of the input are kept by ``apply``, whatever their names but ``_wl_``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import lean, written

MIN_WORDS = 8
#: Words of a window, and how many neighbouring windows one is chosen of.
WINDOW = 8
CHOICE = 10
#: Bits of the table of repeated digests that each worker holds: 16 MB.
MOST_BITS = 1 << 27
#: Characters that are hashed together; a longer text is hashed alone.
TOGETHER = 1 << 16

_SPACES = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_LAST = np.uint64((1 << 64) - 1)
#: Primes of the hashes of a word's characters and of a stretch's words, and two factors for each.
_P31, _P61 = (1 << 31) - 1, (1 << 61) - 1
_CHARS = (0x2F0B4C47, 0x59E3A1B5)
_WORDS = (0x1B873593CC9E2D51, 0x09E3779B97F4A7C1)
#: Keep the hashes of units and windows apart.
_UNIT, _WIN = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0)


def _times31(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^31 - 1, but for a multiple of it; of numbers below 2^32."""
    x = a * b
    return (x & np.uint64(_P31)) + (x >> np.uint64(31))


def _times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, but for a multiple of it; of numbers little above it at most, by their halves."""
    low, s = np.uint64(_P31), np.uint64(31)
    a1, a0, b1, b0 = a >> s, a & low, b >> s, b & low
    mid = a0 * b1
    mid += a1 * b0
    a1 *= b1
    a1 += a1
    a1 += mid >> np.uint64(30)
    mid &= np.uint64((1 << 30) - 1)
    mid <<= s
    a1 += mid
    a0 *= b0
    a1 += a0
    return (a1 & np.uint64(_P61)) + (a1 >> np.uint64(61))


@functools.lru_cache(maxsize=24)
def _powers(factor: int, size: int, prime: int) -> np.ndarray:
    out, times = np.ones(1, np.uint64), _times31 if prime == _P31 else _times61
    while len(out) < size:
        out = np.concatenate([out, times(out, np.full(len(out), pow(factor, len(out), prime), np.uint64)) % np.uint64(prime)])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Sums:
    """Hashes of stretches of a sequence as polynomials modulo a prime, from running sums; values below the prime.

    Two different stretches of n values share a hash for at most n of the prime's factors, whatever their pattern; modulo a power of two, some patterns would for all.
    """

    def __init__(self, values: np.ndarray, factor: int, prime: int):
        self.prime, self.room = np.uint64(prime), 1 << max(16, len(values).bit_length())
        self.back = pow(factor, -1, prime)
        self.times = _times31 if prime == _P31 else _times61
        terms = self.times(values, _powers(factor, self.room, prime)[: len(values)])
        # sums of halves stay in range; they are brought below the prime where they are needed
        self.low, self.high = np.zeros(len(values) + 1, np.uint64), None
        if prime == _P61:
            self.high = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(terms >> np.uint64(31), out=self.high[1:])
            terms &= np.uint64(_P31)
        np.cumsum(terms, out=self.low[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.low[end] - self.low[start]
        if self.high is not None:
            high = self.high[end] - self.high[start]
            x += (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31))
        return self.times(x % self.prime, _powers(self.back, self.room, int(self.prime))[start]) % self.prime


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of a text, and where its words start and end."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[True], _SPACES[np.minimum(chars, 0x3001)], [True]]).view(np.int8))
    return chars, np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The least or greatest of each ``size`` neighbours."""
    of, have = np.minimum if least else np.maximum, 1
    while have < size:
        step = min(have, size - have)
        x, have = of(x[:-step], x[step:]), have + step
    return x


def _chosen(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places that hold the least of some CHOICE neighbours of their owner (of all, if fewer), so that the same words choose the same windows wherever they stand."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    group = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]).astype(np.int64)]))
    count = np.diff(np.append(first, len(h)))
    # owners are set apart by CHOICE places that no window has
    at = np.arange(len(h)) + group * CHOICE
    apart = np.full(at[-1] + 1 + CHOICE, _LAST)
    apart[at] = h
    low = _sliding(apart, CHOICE, True)
    # a stretch that runs over its owner's end counts only where the owner has fewer than CHOICE
    inner = np.arange(len(h)) - first[group]
    counts = inner <= np.maximum(0, count[group] - CHOICE)
    kept = np.zeros(len(apart) + CHOICE - 1, np.uint64)
    kept[at[counts] + CHOICE - 1] = low[at[counts]]
    return np.flatnonzero(_sliding(kept, CHOICE, False)[at] == h)


def _first_again(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the owner has had the hash at an earlier place of the arrays."""
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return again


def _apart(owner: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows stay, and which are there again: one that overlaps the last of its own kind adds nothing."""
    again, keep = _first_again(owner, h), np.ones(len(h), bool)
    if again.any():
        kinds = {x for x in zip(owner[again].tolist(), h[again].tolist())}
        last: dict = {}
        for i, (o, x, kind) in enumerate(zip(owner.tolist(), at.tolist(), h.tolist())):
            if (o, kind) in kinds:
                if x < last.get((o, kind), -WINDOW) + WINDOW:
                    keep[i] = again[i] = False
                else:
                    last[o, kind] = x
    return keep, again


def _pieces(texts: list[str]) -> tuple[np.ndarray, ...]:
    """row (place in ``texts``), span, info, h1, h2 of the texts' units, short lines of several units and chosen windows.

    span: start and end, in the halves of a long. info: the unit's place (-1: none, it goes on its own), words, whether a
    whole line, whether its text has had it before.
    """
    joined = "\n".join(texts) + "\n"
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    chars, start, end = _tokens(joined)
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    low = joined.lower()
    # small letters may take more characters
    lows, low_start, low_end = (chars, start, end) if low == joined else _tokens(low)
    high, rest = (_Sums(lows.astype(np.uint64) + np.uint64(1), f, _P31).of(low_start, low_end) for f in _CHARS)
    code = _mixed(high << np.uint64(31) | rest) % np.uint64(_P61)
    one, two = (_Sums(code, f, _P61) for f in _WORDS)

    def digests(a: np.ndarray, b: np.ndarray, kind: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return _mixed(one.of(a, b) ^ kind), _mixed(two.of(a, b) ^ kind) >> np.uint64(32)

    owner = np.searchsorted(begin, start, side="right") - 1
    text_end = np.append(owner[1:] != owner[:-1], True)
    # the places after a word up to the next one, at most up to the text's end
    stop = np.where(text_end, (begin + sizes)[owner], np.append(start[1:], 0))
    feeds = np.flatnonzero(chars == 10)
    feed = feeds[np.searchsorted(feeds, end)]  # the next one; the last word has that of the end
    fed = feed < stop
    line_end = fed | text_end
    unit_end = line_end | np.isin(chars[end - 1], np.frombuffer(".!?".encode("utf-32-le"), np.uint32))

    b = np.flatnonzero(unit_end)
    a = np.concatenate([[0], b[:-1] + 1])
    unit_owner = owner[a]
    place = np.arange(len(a)) - np.searchsorted(unit_owner, unit_owner)
    # a line begins after the feed before it
    opens = np.concatenate([[True], line_end[b[:-1]]])
    before = np.concatenate([[-1], feeds])[np.searchsorted(feeds, start[a])]
    unit_start = np.where(opens, np.maximum(before + 1, begin[unit_owner]), start[a])
    unit_stop = np.where(fed[b], feed[b] + 1, stop[b])
    line = np.cumsum(opens) - 1
    units = np.bincount(line)
    first, last = np.flatnonzero(opens), np.flatnonzero(line_end[b])
    n_words = b[last] + 1 - a[first]
    short = np.flatnonzero((units > 1) & (n_words < MIN_WORDS))
    f, g = first[short], last[short]

    # units, then lines: a line comes after its own units, and is never equal to one of them
    ua, ub = np.concatenate([a, a[f]]), np.concatenate([b, b[g]]) + 1
    h1, h2 = digests(ua, ub, _UNIT)
    row = np.concatenate([unit_owner, unit_owner[f]])
    place = np.concatenate([place, np.full(len(f), -1)])
    whole = np.concatenate([units[line] == 1, np.ones(len(f), bool)])
    order = np.lexsort((ub, row))
    again = np.zeros(len(row), bool)
    again[order] = _first_again(row[order], h1[order])
    info = place << 24 | np.minimum(ub - ua, (1 << 22) - 1) << 2 | whole << 1 | again
    lo, hi = np.concatenate([unit_start, unit_start[f]]) - begin[row], np.concatenate([unit_stop, unit_stop[g]]) - begin[row]
    out = [(row, lo << 32 | hi, info, h1.view(np.int64), h2.view(np.int64))]

    at = np.arange(max(0, len(start) - WINDOW + 1))
    at = at[owner[at] == owner[at + WINDOW - 1]]
    if len(at):
        w1 = _mixed(one.of(at, at + WINDOW) ^ _WIN)
        some = _chosen(w1, owner[at])
        at, w1 = at[some], w1[some]
        keep, again = _apart(owner[at], at, w1)
        at, w1, again = at[keep], w1[keep], again[keep]
        row, e = owner[at], at + WINDOW - 1
        # the blanks up to the next word go along if it is on the same line
        lo, hi = start[at] - begin[row], np.where(fed[e], end[e], stop[e]) - begin[row]
        out.append((row, lo << 32 | hi, (-1 << 24) + (WINDOW << 2 | 2) + again, w1.view(np.int64), digests(at, at + WINDOW, _WIN)[1].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _together(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Stretches of a batch of texts (first row, texts), of about TOGETHER characters."""
    texts, first, have = [], 0, 0
    for r, t in enumerate(column):
        text = t.as_py() or ""
        if texts and (have + len(text) > TOGETHER or len(texts) == 256):
            yield first, texts
            texts, first, have = [], r, 0
        texts.append(text)
        have += len(text) + 1
    if texts:
        yield first, texts


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, h1, h2) of each distinct digest of a text."""
    for p in parts:
        for first, texts in _together(p.column(2)):
            row, _, info, h1, h2 = _pieces(texts)
            new = info & 1 == 0
            yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(row[new] + first)), pa.array(h1[new]), pa.array(h2[new])], names=["rank", "h1", "h2"])


def _places(parts: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(rank, mark, span, info, h1, h2) of the pieces whose text has had them before, or whose h1 has its bit."""
    for p in parts:
        for first, texts in _together(p.column(2)):
            row, *rest = _pieces(texts)
            some = (rest[1] & 1 > 0) | _has_bit(bits, rest[2])
            at = pa.array(row[some] + first)
            yield pa.RecordBatch.from_arrays([p.column(0).take(at), p.column(1).take(at), *(pa.array(x[some]) for x in rest)], names=["rank", "mark", "span", "info", "h1", "h2"])


def _mark(text: Column) -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _rank(doc_id: Column, mark: Column) -> Column:
    """doc_id; documents without one come last, by their mark."""
    return F.coalesce(doc_id.cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(mark, 2))


def _bits(rows: DataFrame, key: str) -> np.ndarray:
    """A bit for each key by its last bits, at most ``MOST_BITS`` in all: spares a join most of the rows that meet nothing."""
    size = min(MOST_BITS, 1 << max(16, (16 * rows.count()).bit_length()))
    place = F.col(key).bitwiseAND(F.lit(size - 1))
    words = rows.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def _has_bit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key & (64 * len(bits) - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 > 0


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rank, mark and the removed places (start, end) of each document that loses some."""
    mark = _mark(F.col("text"))
    texts = lean(docs).select(_rank(F.col("doc_id"), mark).alias("rank"), mark.alias("mark"), "text")
    # kept apart, so that both sides of the join are dealt anew and a digest that very many units share can be split
    shared = texts.mapInArrow(_digests, "rank long, h1 long, h2 long").groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    first = written(shared.where("first < last").select("h1", "h2", "first"), "digests")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(first, "h1"))
    found = texts.mapInArrow(lambda parts: _places(parts, bits.value), "rank long, mark long, span long, info long, h1 long, h2 long")
    later = found.join(first, ["h1", "h2"], "left").where("info % 2 <> 0 or rank > first").select("rank", "mark", "info", "span")
    # rows that repeat give the same places more than once, side by side: most of them go before they are dealt out
    once = later.mapInArrow(_once, later.schema)
    by_doc = once.repartition("rank", "mark").sortWithinPartitions("rank", "mark", "info", "span")
    return by_doc.mapInArrow(lambda parts: _fold(parts, min_words), "rank long, mark long, removed array<struct<start:int,end:int>>")


def _once(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch without those that repeat."""
    for p in parts:
        yield pa.Table.from_batches([p]).group_by(p.schema.names).aggregate([]).combine_chunks().to_batches(max_chunksize=max(1, p.num_rows))[0] if p.num_rows else p


def _fold(parts: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The removed places of each document whose later pieces (rank, mark, info, span) come sorted; the last one of a batch waits for the next."""
    waiting: list[np.ndarray] = []

    def cut(rows: np.ndarray) -> pa.RecordBatch:
        rank, mark, info, span = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))]
        at = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1]) | (mark[1:] != mark[:-1])))
        owner, start, end = _cuts(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(rank)))), info, span, min_words)
        pairs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(at) + 1)), pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array(rank[at]), pa.array(mark[at]), lists], names=["rank", "mark", "removed"])

    for p in parts:
        if not p.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in p.columns])
        # where the batch's last document begins
        same = (rows[:2] == rows[:2, -1:]).all(axis=0)
        at = len(same) - int(same[::-1].cumprod().sum())
        if at or (waiting and (waiting[0][:2, 0] != rows[:2, 0]).any()):
            done = np.concatenate([*waiting, rows[:, :at]], axis=1)
            yield cut(done)
            waiting = [rows[:, at:]]
        else:
            waiting.append(rows)
    if waiting:
        yield cut(np.concatenate(waiting, axis=1))


def _cuts(owner: np.ndarray, info: np.ndarray, span: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, start, end of what goes: of each owner's later pieces in order of info, the unions that touch each other."""
    place, n, whole = info >> 24, info >> 2 & (1 << 22) - 1, info & 2 > 0
    start, end = span >> 32, span & (1 << 32) - 1
    unit = np.flatnonzero(place >= 0)
    o, q = owner[unit], place[unit]
    fresh = np.append(True, (o[1:] != o[:-1]) | (q[1:] != q[:-1] + 1))[: len(unit)]
    run = np.cumsum(fresh) - 1
    long = np.bincount(run, n[unit]) >= min_words if len(unit) else np.zeros(0, bool)
    goes = whole.copy()
    goes[unit] |= long[run]
    owner, start, end = owner[goes], start[goes], end[goes]
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    reach = np.maximum.accumulate(owner << 32 | end) if len(owner) else end
    new = np.append(True, (owner[1:] << 32 | start[1:]) > reach[:-1])[: len(owner)]
    at = np.flatnonzero(new)
    return owner[at], start[at], (reach & (1 << 32) - 1)[np.append(at[1:], len(owner)) - 1] if len(at) else end[at]


def _without(text: Column, removed: Column) -> Column:
    """The text between the removed places."""
    after = lambda i: F.coalesce(F.get(removed, i - 1)["end"], F.lit(0))
    before = lambda i: F.coalesce(F.get(removed, i)["start"], F.length(text))
    kept = F.transform(F.sequence(F.lit(0), F.size(removed)), lambda i: F.substring(text, after(i) + 1, before(i) - after(i)))
    return F.array_join(kept, "")


def apply(docs: DataFrame, min_words: int = MIN_WORDS, places: str | None = None) -> DataFrame:
    """``docs`` with the later occurrences cut from text (and n_chars counted anew); places: name of a column that gets the removed offsets."""
    cuts = repeats(docs, min_words).select(F.col("rank").alias("_wl_rank"), F.col("mark").alias("_wl_mark"), F.col("removed").alias("_wl_removed"))
    mark = _mark(docs["text"])
    joined = docs.join(cuts, (_rank(docs["doc_id"], mark) == F.col("_wl_rank")) & (mark == F.col("_wl_mark")), "left")
    removed = F.when(F.size("_wl_removed") > 0, F.col("_wl_removed"))
    out = joined.withColumn("text", F.when(removed.isNull(), F.col("text")).otherwise(_without(F.col("text"), removed)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    extra = [F.coalesce(removed, F.array().cast("array<struct<start:int,end:int>>")).alias(places)] if places else []
    return out.select(*docs.columns, *extra)
