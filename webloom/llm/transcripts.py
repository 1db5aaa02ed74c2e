"""Chat formatting: a hidden Markov model over lines recovers who speaks, then turns are rendered canonically.

A transcript is a sequence of blocks, each of one or more lines. A line shows a speaker marker (of the user, the
assistant, the system, or none), a length class, whether it ends in a question mark and whether it opens its block. The model's
states are role times (first line of a turn, later line of a turn). Its probabilities are counted, with
one added to each count, over labelled transcripts, all of them. Viterbi finds the likeliest states of a whole conversation; ties go to
the state listed first.

A conversation is cut into chunks of ``CHUNK`` turns. A chunk is summed up as a matrix of the best log-probability
from each state before it to each state at its end; the products of up to ``FAN`` matrices are taken level by level, the states
at the borders are then fixed from the top down, and each chunk is decoded between its borders. So one long
conversation never comes into one task, and the path is that of a single pass.

Turns are ordered by turn (null first), then text. Rows that repeat conversation, turn, role and text are one turn. Null and
empty texts are one empty line. Negative turns, and turns without a number, are in the first stretch of CHUNK numbers; a stretch of more turns
is cut again by their order. Very long texts are whole, a class for each line. conv_id and turn must be integers or cast to such; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import materialise

ROLES = ["system", "user", "assistant"]
#: (role, later line): state = 2 * role + later.
STATES = 2 * len(ROLES)
CHUNK = 256
FAN = 256
#: Words that mark a speaker.
MARKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "q", "question", "customer"],
    "assistant": ["assistant", "ai", "bot", "a", "answer", "agent"],
}
_MARKER = re.compile(r"^\s*(?:[#>*\-\[(<|]+\s*)?(" + "|".join(sorted({w for x in MARKERS.values() for w in x}, key=len, reverse=True)) + r")\s*(?:[\])>|*]+\s*)?:\s*", re.IGNORECASE)
_ROLE_OF = {w: k for k, r in enumerate(ROLES) for w in MARKERS[r]}
#: marker (none or a role) x length class x question mark x opens its block
OBSERVATIONS = (len(ROLES) + 1) * 3 * 2 * 2


def observe(line: str, opens: bool) -> int:
    """The class of a line."""
    m = _MARKER.match(line)
    marker = 1 + _ROLE_OF[m[1].lower()] if m else 0
    body = line[m.end() :] if m else line
    size = 0 if not body.strip() else 1 if len(body) < 80 else 2
    return ((marker * 3 + size) * 2 + body.rstrip().endswith("?")) * 2 + opens


def observations(text: str | None) -> list[int]:
    return [observe(x, k == 0) for k, x in enumerate((text or "").split("\n"))]


def unmarked(line: str) -> str:
    return _MARKER.sub("", line, count=1)


# the model


class Model:
    """Log-probabilities: first (state), move (state, state), show (state, observation)."""

    def __init__(self, starts: np.ndarray, moves: np.ndarray, shows: np.ndarray):
        share = lambda x: np.log((x + 1.0) / (x + 1.0).sum(-1, keepdims=True))
        # a conversation begins with the first line of a turn; a later line has its turn's role
        first = np.where(np.arange(STATES) % 2 == 0, 0.0, -np.inf)
        legal = np.array([[t % 2 == 0 or t // 2 == s // 2 for t in range(STATES)] for s in range(STATES)])
        self.first = share(starts) + first
        self.move = np.where(legal, share(moves), -np.inf)
        self.show = share(shows)

    def matrix(self, seen: list[int], opening: bool) -> np.ndarray:
        """Best log-probability from a state before to a state at the end; before an opening chunk all states are the same."""
        m = np.broadcast_to(self.first, (STATES, STATES)) if opening else self.move
        m = m + self.show[:, seen[0]]
        for o in seen[1:]:
            m = (m[:, :, None] + self.move[None]).max(1) + self.show[:, o]
        return m

    def path(self, seen: list[int], opening: bool, before: int, end: int | None) -> list[int]:
        """The likeliest states between a state before and the state at the end (None: the best)."""
        d = (self.first if opening else self.move[before]) + self.show[:, seen[0]]
        back = []
        for o in seen[1:]:
            x = d[:, None] + self.move
            back.append(x.argmax(0))
            d = x.max(0) + self.show[:, o]
        s = int(d.argmax()) if end is None else end
        out = [s]
        for b in reversed(back):
            s = int(b[s])
            out.append(s)
        return out[::-1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    m = matrices[0]
    for x in matrices[1:]:
        m = (m[:, :, None] + x[None]).max(1)
    return m


def borders(matrices: list[np.ndarray], before: int, end: int | None) -> list[int]:
    """The state at the end of each of the matrices' stretches."""
    d, back = matrices[0][before], []
    for x in matrices[1:]:
        y = d[:, None] + x
        back.append(y.argmax(0))
        d = y.max(0)
    s = int(d.argmax()) if end is None else end
    out = [s]
    for b in reversed(back):
        s = int(b[s])
        out.append(s)
    return out[::-1]


# tables


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as transcripts (conv_id, turn, role, text): markers in the style of the conversation, left out in every fifth of its styles."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    names = [["System", "User", "Assistant"], ["INSTRUCTIONS", "Human", "AI"], ["### System", "### User", "### Assistant"], ["Context", "Q", "A"]]
    pick = lambda x: F.when(F.col("role") == "system", x[0]).when(F.col("role") == "assistant", x[2]).otherwise(x[1])
    marker = F.when(style == 0, pick(names[0])).when(style == 1, pick(names[1])).when(style == 2, pick(names[2])).when(style == 3, pick(names[3]))
    text = F.coalesce("text", F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.when(marker.isNotNull(), F.concat(marker, F.lit(": "), text)).otherwise(text).alias("text"))


def _chunk(turn: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.coalesce(turn.cast("long"), F.lit(0)) / CHUNK)).cast("long")


#: Room for the parts of a stretch of numbers that holds more turns than CHUNK.
PARTS = 1 << 20


def chunks(blocks: DataFrame) -> DataFrame:
    """conv_id, chunk and its turns in order, at most CHUNK of them."""
    rows = blocks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    turn = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), "role")
    placed = rows.select("conv_id", _chunk(F.col("turn")).alias("chunk"), turn.alias("t"))
    order = Window.partitionBy("conv_id", "chunk").orderBy("t")
    placed = placed.withColumn("part", F.floor((F.row_number().over(order) - 1) / CHUNK).cast("long"))
    return placed.groupBy("conv_id", "chunk", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def numbered(parts: DataFrame) -> DataFrame:
    """conv_id, chunk and turns of kept chunks, with the parts of a stretch as chunks of their own where there are any."""
    several = parts.where("part > 0").limit(1).count() > 0
    return parts.select("conv_id", (F.col("chunk") * PARTS + F.col("part") if several else F.col("chunk")).alias("chunk"), "turns")


_COUNTS = ["kind", "a", "b", "n", "conv_id", "chunk", "first", "last"]


def fit(parts: DataFrame) -> Model:
    """Counts over all labelled chunks and across their borders; roles outside ``ROLES`` break the chain and are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, moves, shows, edges = np.zeros(STATES, np.int64), np.zeros((STATES, STATES), np.int64), np.zeros((STATES, OBSERVATIONS), np.int64), []
        for p in batches:
            for conv, chunk, opening, turns in zip(p["conv_id"], p["chunk"], p["opening"], p["turns"]):
                last, first, fresh = None, None, True
                for t in turns:
                    if t["role"] not in ROLES:
                        last, fresh = None, False
                        continue
                    r = 2 * ROLES.index(t["role"])
                    for k, o in enumerate(observations(t["text"])):
                        s = r + (k > 0)
                        shows[s, o] += 1
                        if last is not None:
                            moves[last, s] += 1
                        elif fresh:
                            if opening:
                                starts[s] += 1
                            first = s
                        last, fresh = s, False
                edges.append((conv, chunk, first, last))
            if edges:
                yield pd.DataFrame([("edge", None, None, None, *e) for e in edges], columns=_COUNTS).astype({c: "Int64" for c in _COUNTS[1:]})
                edges = []
        for kind, x in (("start", starts[:, None]), ("move", moves), ("show", shows)):
            a, b = np.nonzero(x)
            yield pd.DataFrame({"kind": kind, "a": a, "b": b, "n": x[a, b], "conv_id": None, "chunk": None, "first": None, "last": None}).astype({c: "Int64" for c in _COUNTS[1:]})

    opened = parts.groupBy("conv_id").agg(F.min("chunk").alias("least")).withColumnRenamed("conv_id", "c_")
    told = parts.join(opened, F.col("conv_id").eqNullSafe(F.col("c_"))).select("conv_id", "chunk", (F.col("chunk") == F.col("least")).alias("opening"), "turns")
    counted = materialise(told.mapInPandas(count, "kind string, a long, b long, n long, conv_id long, chunk long, first long, last long"))
    total = counted.where("kind <> 'edge'").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # the last state of a chunk and the first of the next one: two numbers for CHUNK turns
    order = Window.partitionBy("conv_id").orderBy("chunk")
    borders_ = counted.where("kind = 'edge'").select("first", F.lag("last").over(order).alias("before")).where("first is not null and before is not null")
    total = total.unionByName(borders_.groupBy(F.lit("move").alias("kind"), F.col("before").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("n")))
    x = {"start": np.zeros((STATES, 1)), "move": np.zeros((STATES, STATES)), "show": np.zeros((STATES, OBSERVATIONS))}
    for r in total.collect():  # no more rows than the model has numbers, twice
        x[r.kind][r.a, r.b] += r.n
    return Model(x["start"][:, 0], x["move"], x["show"])


def _seen(turns) -> list[int]:
    return [o for t in turns for o in observations(t["text"])]


def decode(parts: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, role (given), found (role of the block's first line), roles (of its lines), begun (turns that begin in it), rendered."""
    sent = parts.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for p in batches:
            got = [m.matrix(_seen(t), bool(o)).ravel() for t, o in zip(p["turns"], p["opening"])]
            yield pd.DataFrame({"conv_id": p["conv_id"], "chunk": p["chunk"], "matrix": got})

    # only conversations of several chunks need borders; a conversation's first chunk opens it
    span = parts.groupBy("conv_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    parts = parts.join(span.withColumnsRenamed({"conv_id": "conv_"}), F.col("conv_id").eqNullSafe(F.col("conv_"))).withColumn("opening", F.col("chunk") == F.col("first"))
    several = parts.where("first < last")
    levels = [materialise(several.select("conv_id", "chunk", "turns", "opening").mapInPandas(sums, "conv_id long, chunk long, matrix array<double>"))]
    most = levels[0].agg(F.max("chunk")).first()[0]
    while most:
        most //= FAN
        levels.append(materialise(_product(levels[-1])))
    ends = None
    for level in reversed(levels[:-1]):
        ends = _borders(level, ends)
    if ends is None:
        ends = parts.sparkSession.createDataFrame([], "conv_id long, chunk long, before int, end int")
    ends = ends.withColumnsRenamed({"conv_id": "c_", "chunk": "k_"})
    return parts.join(ends, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("chunk") == F.col("k_")), "left").select("conv_id", "opening", "before", "end", "turns").mapInPandas(
        _decoder(sent), "conv_id long, turn long, role string, found string, roles array<string>, begun long, rendered string"
    )


def _product(level: DataFrame) -> DataFrame:
    """The matrices of ``FAN`` neighbouring stretches as one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [product([np.reshape(x["matrix"], (STATES, STATES)) for x in g]).ravel() for g in p["g"]]
            yield pd.DataFrame({"conv_id": p["conv_id"], "chunk": p["up"], "matrix": got})

    up = level.groupBy("conv_id", F.expr(f"chunk div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("g"))
    return up.mapInPandas(run, "conv_id long, chunk long, matrix array<double>")


def _borders(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """before and end of each stretch, from those of the stretches above it."""
    up = level.groupBy("conv_id", F.expr(f"chunk div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("g"))
    if above is None:
        up = up.withColumns({"before": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
    else:
        a = above.withColumnsRenamed({"conv_id": "a_", "chunk": "b_"})
        up = up.join(a, F.col("conv_id").eqNullSafe(F.col("a_")) & (F.col("up") == F.col("b_"))).select("conv_id", "up", "g", "before", "end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for c, g, before, end in zip(p["conv_id"], p["g"], p["before"], p["end"]):
                s = 0 if pd.isna(before) else int(before)
                states = borders([np.reshape(x["matrix"], (STATES, STATES)) for x in g], s, None if pd.isna(end) else int(end))
                for x, e in zip(g, states):
                    out.append((c, x["chunk"], s, e))
                    s = e
            yield pd.DataFrame(out, columns=["conv_id", "chunk", "before", "end"])

    return up.mapInPandas(run, "conv_id long, chunk long, before int, end int")


def _decoder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for p in batches:
            out = []
            for c, opening, before, end, turns in zip(p["conv_id"], p["opening"], p["before"], p["end"], p["turns"]):
                lines = [(t["text"] or "").split("\n") for t in turns]
                path = m.path([observe(x, k == 0) for y in lines for k, x in enumerate(y)], bool(opening), 0 if pd.isna(before) else int(before), None if pd.isna(end) else int(end))
                at = 0
                for t, y in zip(turns, lines):
                    states = path[at : at + len(y)]
                    at += len(y)
                    out.append((c, t["turn"], t["role"], ROLES[states[0] // 2], [ROLES[s // 2] for s in states], sum(s % 2 == 0 for s in states), render(y, states)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "found", "roles", "begun", "rendered"]).astype({"conv_id": "Int64", "turn": "Int64"})

    return run


def render(lines: list[str], states: list[int]) -> str:
    """A block's lines in canonical form: each turn that begins here is opened, one that is open before it is closed."""
    out = []
    for k, (x, s) in enumerate(zip(lines, states)):
        if s % 2 == 0:
            out.append(("<|end|>\n" if k else "") + f"<|{ROLES[s // 2]}|>\n{unmarked(x)}\n")
        else:
            out.append(f"{x}\n")
    return "".join(out) + "<|end|>\n"


def format_chats(blocks: DataFrame, model: Model | None = None, train: Column | None = None) -> DataFrame:
    """Recovers the roles of transcripts; without a model it is fitted on the blocks' own roles, of the conversations that ``train`` takes (else of all)."""
    parts = numbered(materialise(chunks(blocks)))
    return decode(parts, model or fit(parts if train is None else parts.where(train)))


def held_out(conv_id: Column) -> Column:
    """A quarter of the conversations, whose roles the fit of the query doesn't see."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
