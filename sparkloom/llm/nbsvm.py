"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

A text's features are the indicators of its token n-grams (words and runs of other characters; one and two tokens),
hashed into ``BUCKETS``. Two more indicators stand in for a whole class of n-grams each: that some token comes twice in a
row, and that some pair does, whatever the token (repetition is what many bad texts share, and no two of them repeat the
same words). Each is scaled by the log of how much more of the good texts' features it makes up than of the
bad ones'. Dual coordinate descent fits the hinge-loss model, and a logistic curve over margins from models that had not
seen the text turns margins into scores.

Fitted on at most about ``MAX_TRAIN`` labelled texts with ``TRAIN_BYTES`` of text, by a hash of the row: that bounds what
reaches the driver. Whole texts are read, however long. A document with several labels has their mean, rounded up at a
half.

Null and empty texts have no features and get the score of the intercept. With no labels, or of one class only, every
score is that class's share (a half if there is none). A score at the threshold counts as good. Equal rows teach once and
get equal results; an empty table gives an empty one; columns besides those named are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import bounded, pieces
from sparkloom.llm.langid import held_out
from sparkloom.llm.sampling import bounded_sample
from sparkloom.storage import scratch

MAX_TRAIN, TRAIN_BYTES, BUCKETS, TABLE_ENTRIES = 8_000, 48 << 20, 1 << 20, 100_000
EPOCHS, COST, SMOOTHING = 12, 1.0, 1.0
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Stands for any token that comes twice in a row, and 2 ** 60 more for any pair.
REPEATED = np.uint64(0x27D4EB2F165667C5)
_HASHES: dict[str, int] = {}


def features(text: str | None) -> np.ndarray:
    """Buckets of the text's n-grams, each once, in order."""
    from xxhash import xxh32_intdigest

    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.uint32)
    if len(_HASHES) > TABLE_ENTRIES:
        _HASHES.clear()
    known = _HASHES
    at = [known.get(t) for t in tokens]
    if None in at:
        for i, x in enumerate(at):
            if x is None:
                t = tokens[i]
                # capitals matter as such, not by word
                at[i] = known[t] = xxh32_intdigest(t.lower().encode(), 1 if len(t) > 3 and t.isupper() else 0)
    one = np.array(at, np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    two[one[:-1] == one[1:]] = REPEATED  # whatever the token
    pairs = (one[:-3] == one[2:-1]) & (one[1:-2] == one[3:])
    two[: len(pairs)][pairs] = REPEATED + np.uint64(1 << 60)
    return np.unique(np.concatenate([one * np.uint64(0x165667B19E3779F9), two]) >> np.uint64(44)).astype(np.uint32)


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bucket; 0 for those in fewer than two texts."""
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good, strict=True) if g == k] or [np.zeros(0, np.uint32)]), minlength=BUCKETS) for k in (True, False)]
    p, q = (c + SMOOTHING for c in counts)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(counts[0] + counts[1] >= 2, ratio, 0.0)


def descend(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights of the indicators, and the intercept. Texts are scaled to
    length 1 beside a constant feature, and a class's errors cost more the fewer texts it has."""
    w, bias = np.zeros(BUCKETS), 0.0
    values = [ratio[r] for r in rows]
    norm = np.array([max(1e-12, float(np.sqrt((v * v).sum()))) for v in values])
    y = np.where(good, 1.0, -1.0)
    limit = np.where(good, cost, cost * np.sqrt(max(1, good.sum()) / max(1, (~good).sum())))
    dual = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            v = values[i] / norm[i]
            g = y[i] * (float(w[rows[i]] @ v) + bias) - 1
            new = min(max(dual[i] - g / 2.0, 0.0), limit[i])  # the squared length is 2, with the constant
            step = (new - dual[i]) * y[i]
            if step:
                w[rows[i]] += step * v
                bias += step
                dual[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def _margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for r in rows:
        v = ratio[r]
        out.append(float(w[r] @ v) / max(1e-12, float(np.sqrt((v * v).sum()))) + bias)
    return np.array(out)


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hessian = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Scorer:
    """What is sent to the workers."""

    ratio: np.ndarray
    w: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        margin = _margins([features(text)], self.ratio, self.w, self.bias)[0]
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def train(rows: list[np.ndarray], good: np.ndarray) -> Scorer:
    none = np.zeros(BUCKETS, np.float32)
    if not len(good) or good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        return Scorer(none, none, 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fold = np.arange(len(rows)) % 2
    margins = np.zeros(len(rows))
    for k in (0, 1):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        own = [rows[i] for i in inside]
        ratio = log_ratios(own, good[inside])
        margins[outside] = _margins([rows[i] for i in outside], ratio, *descend(own, good[inside], ratio))
    slope, shift = logistic(margins, good)
    ratio = log_ratios(rows, good)
    w, bias = descend(rows, good, ratio)
    return Scorer(ratio.astype(np.float32), w.astype(np.float32), bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, train_bytes: int = TRAIN_BYTES) -> Scorer:
    """Learns from the labelled documents, all if they are at most max_train with train_bytes of text, else as large a share
    of them. Features take fewer bytes than texts do, so train_bytes bounds what the driver collects."""
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).alias("good"))
    n = known.count()
    if n > max_train:
        known = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    # about max_train rows of a few bytes, so they may be sent to all; rows that share an id are told apart below
    rows = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "good", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession):
        chosen = bounded_sample(rows.select("doc_id", "text", "good"), "text", max_train, train_bytes, "nbsvm-sample")
        got = sorted(((r["doc_id"], bytes(r["features"]), r["good"]) for r in chosen.mapInArrow(run, f"doc_id {kind}, good boolean, features binary").toLocalIterator()))
    return train([np.frombuffer(f, np.uint32) for _, f, _ in got], np.array([g for *_, g in got], bool))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted on labelled rows that are not held out."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.filter(~held_out(F.col("doc_id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
