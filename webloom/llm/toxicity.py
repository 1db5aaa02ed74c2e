"""Toxicity: a linear classifier on character n-grams whose features carry naive Bayes log-count ratios.

Fitting uses a bounded sample of the labelled rows (``SAMPLE`` of each label, drawn by a hash of their ids, of any length);
scoring reads every whole text. A text is lower-cased, its 4- and 5-grams of characters are hashed into ``2**BITS`` bins, a bin counts
once for a text, and its weight is the log-count ratio times a coefficient of an L2-regularised
logistic regression. The margin becomes a probability by Platt scaling on margins of models that haven't seen the row. The sampled texts become
bins on the executors; the driver gets bits, at most ``2**BITS`` for a row whatever its length.

Null and empty texts have no n-grams: their score is that of the intercept, which rows without n-grams in the fit keep low. Repeated rows are scored
each. Labels that are null, or whose document is missing, take no part in the fit; a document with labels of both kinds counts as 1, and one
with several texts gives the least of them. Without labels of both kinds every score is the share of label 1 among the labels (0 without any).
doc_id must be an integer or cast to one; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import lean

BITS = 18
ORDERS = (4, 5)
#: The fit's bound: rows of each label.
SAMPLE = 1500
THRESHOLD = 0.3
#: Parts of the sample for the calibration; weight of the penalty, against so many rows.
FOLDS = 2
L2 = 30.0


def bins(text: str | None, bits: int = BITS) -> list[np.ndarray]:
    """The bins of a text's n-grams, one array for each order, repeats included."""
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(c) < n:
                continue
            m = len(c) - n + 1
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= c[k : k + m]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            out.append(h >> np.uint32(32 - bits))
    return out


def distinct_bins(text: str | None) -> np.ndarray:
    found = bins(text)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    weights: np.ndarray  # by bin: ratio times coefficient
    intercept: float
    slope: float
    shift: float

    def margin(self, text: str | None, seen: np.ndarray) -> float:
        seen[:] = 0
        for h in bins(text):
            seen[h] = 1
        return self.intercept + float(seen @ self.weights)

    def scores(self, texts) -> np.ndarray:
        seen = np.zeros(len(self.weights), np.float32)
        z = np.array([self.margin(t, seen) for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float = L2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Full-batch gradient steps with momentum on features ``scale[bin]``."""
    w, b, vw, vb = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    norm = np.mean([(scale[r] ** 2).sum() for r in rows]) + 1
    rate = 3.0 / norm
    parts = [range(at, min(at + 100, len(rows))) for at in range(0, len(rows), 100)]  # bounds what is in memory beside the rows
    for _ in range(steps):
        gw, gb = l2 * w / len(y), 0.0
        for part in parts:
            idx = np.concatenate([rows[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            x = scale[idx]
            z = b + np.bincount(row, w[idx] * x, len(part))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part.start : part.stop]) / len(y)
            gw += np.bincount(idx, g[row] * x, len(scale))
            gb += g.sum()
        vw, vb = 0.9 * vw - rate * len(y) ** 0.5 * gw, 0.9 * vb - rate * len(y) ** 0.5 * gb
        w, b = w + vw, b + vb
    return w, b


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit in one variable, by damped Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    start, penalty = np.array([a, b]), np.array([1e-2, 1e-3])
    t = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -40, 40)))
        g = x.T @ (weight * (p - y)) + penalty * (t - start)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        t -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(t[0], 1e-3)), float(t[1])


def _weights(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight by bin, ratio times coefficient, and intercept."""
    count = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for r, label in zip(rows, y):
        count[int(label)][r] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    w, b = _logistic(rows, y, ratio)
    return w * ratio, b


def fit_rows(rows: list[np.ndarray], labels: list[int], prior: float) -> Model:
    """A model from the distinct bins of texts; scores are calibrated on the margins that rows get from models of the other ``FOLDS`` - 1 parts, weighed to the share ``prior`` of label 1."""
    y, n = np.array(labels, np.float64), 1 << BITS
    if not len(y) or y.min() == y.max():
        p = min(max(prior, 1e-6), 1 - 1e-6) if len(y) else 1e-6
        return Model(np.zeros(n, np.float32), float(np.log(p / (1 - p))), 1.0, 0.0)
    # rows without n-grams, label 0: a text that shows nothing isn't toxic
    more = 1 + len(rows) // 20
    rows, y = [*rows, *[np.empty(0, np.uint32)] * more], np.concatenate([y, np.zeros(more)])
    weights, b = _weights(rows, y)
    margin = lambda w, b, i: b + w[rows[i]].sum()
    fold = np.arange(len(y)) % FOLDS
    if all(y[fold != k].min() != y[fold != k].max() for k in range(FOLDS)) and len(y) >= 50:
        z = np.zeros(len(y))
        for k in range(FOLDS):
            part = _weights([r for r, f in zip(rows, fold) if f != k], y[fold != k])
            for i in np.flatnonzero(fold == k):
                z[i] = margin(*part, i)
    else:
        z = np.array([margin(weights, b, i) for i in range(len(y))])
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    return Model(weights.astype(np.float32), float(b), *_platt(z, y, weight))


def packed(bins_: np.ndarray) -> bytes:
    """Distinct bins as themselves, or as bits where those are shorter."""
    if 4 * len(bins_) <= 1 << BITS - 3:
        return b"i" + bins_.astype("<u4").tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[bins_] = True
    return b"b" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"i":
        return np.frombuffer(data, "<u4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1))).astype(np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Model:
    """The model of a bounded sample of labelled rows; ``train`` tells from doc_id which labels may be seen."""
    seen = labels.where(train) if train is not None else labels
    known = seen.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    usable = known.join(docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_semi")
    ids = [r for k in (0, 1) for r in usable.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not ids:
        return fit_rows([], [], 0.0)

    def of_texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(distinct_bins(t.as_py())) for t in b.column(2)], pa.binary())], names=["id", "y", "bins"])

    wanted = docs.sparkSession.createDataFrame([(r.id, r.y) for r in ids], "id long, y int")
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(wanted), "id")  # 2 * SAMPLE rows
    got = texts.groupBy("id", "y").agg(F.min("text").alias("text")).mapInArrow(of_texts, "id long, y int, bins binary")
    rows = sorted(got.collect(), key=lambda r: ((r.id * 0x9E3779B97F4A7C15) & (2**64 - 1), r.id))
    return fit_rows([unpacked(bytes(r.bins)) for r in rows], [r.y for r in rows], total.get(1, 0) / max(1, sum(total.values())))


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of each text as a column."""
    sent = lean(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic_score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for s in parts:
            yield pd.Series(m.scores(s), dtype="float64")

    return toxic_score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, train)
    scored = docs.select("doc_id", score_column(docs, model).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns; the fit sees all labels."""
    model = fit(docs.select("doc_id", "text"), labels)
    return docs.where(score_column(docs, model) < THRESHOLD)
