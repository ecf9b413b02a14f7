"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; what else the corpus holds is unlabelled. A linear model on hashed
features minimises the non-negative unbiased risk: with class prior p, loss l, positives P and unlabelled U,
p * E_P[l(+)] + max(0, E_U[l(-)] - p * E_P[l(-)]). The prior is estimated from the labels of the training rows.

E_U is over all documents: a first fit takes it from a sample; one pass over all of them then gives value and gradient
of E_U at that fit, and a second fit minimises the sample's risk tilted so that both are those of the whole corpus
there. A last step, on training rows only, moves scale and threshold of the scores so that 0.5 separates the labels;
it takes the negative labels too, which the risk does without.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mixed, parts, utf8

#: Hashed features: 4-grams of character shapes, and words with their neighbours. Documents in the sample: about so many labelled and unlabelled.
BITS, LABELLED, UNLABELLED = 11, 3000, 4000
#: Bytes that a row of features counts for.
ROW = 1024
EPOCHS, RATE, DECAY = 250, 0.02, 1e-4

#: Shapes: lower and upper case letters, digits, bytes of other letters, each other ASCII character by itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1], _SHAPE[ord("A") : ord("Z") + 1], _SHAPE[ord("0") : ord("9") + 1], _SHAPE[128:] = 1, 2, 3, 1


def features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies: a row for each text."""
    rows, size = len(at) - 1, 1 << BITS
    out = np.zeros((rows, size + 4), np.float32)
    n = np.diff(at)
    out[:, size] = np.log1p(n) / 10
    if not len(buf):
        return out
    shape = _SHAPE[buf]
    # Upper case of two-byte Latin letters.
    second = np.zeros(len(buf), bool)
    second[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    shape[second] = 2
    row = np.repeat(np.arange(rows), n)
    if len(buf) >= 4:
        s = shape.astype(np.uint64)
        gram = s[:-3] | s[1:-2] << np.uint64(8) | s[2:-1] << np.uint64(16) | s[3:] << np.uint64(24)
        inside = row[:-3] == row[3:]
        slot = (mixed(gram) >> np.uint64(64 - BITS)).astype(np.int64)
        out[:, :size] = np.bincount((row[:-3] * size + slot)[inside], minlength=rows * size).reshape(rows, size)
    out[:, :size] = np.sqrt(out[:, :size] / np.maximum(n, 1)[:, None])
    # Words: how many equal the one before, and how many are upper case.
    blank = (buf == 32) | (buf == 10) | (buf == 9)
    begin = ~blank
    begin[1:] &= blank[:-1] | (row[1:] != row[:-1])
    if (first := np.flatnonzero(begin)).size:
        power = np.cumsum(mixed(buf.astype(np.uint64) + np.uint64(256) * (np.arange(len(buf)) - np.maximum.accumulate(np.where(begin, np.arange(len(buf)), 0))).astype(np.uint64)) * (~blank))
        last = np.concatenate([first[1:], [len(buf)]]) - 1
        word = power[last] - np.where(first > 0, power[first - 1], np.uint64(0))
        of = row[first]
        same = np.zeros(len(first), bool)
        same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        count = np.bincount(of, minlength=rows)
        words = np.maximum(count, 1)
        out[:, size + 1] = np.sqrt(np.bincount(of[same], minlength=rows) / words)
        out[:, size + 2] = np.sqrt(np.bincount(of[(shape[first] == 2) & (shape[np.minimum(first + 1, len(buf) - 1)] == 2)], minlength=rows) / words)
        out[:, size + 3] = count / np.maximum(n, 1)
    return out


class Model:
    """Weights and bias; a model without weights gives everything 0.5, which is accepted."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.weights, self.bias = weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40).astype(np.float64)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def moments(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over rows, at some weights: gradient of l(-) by weights and by bias, l(-), and rows."""
    f = (x @ w + b).astype(np.float64)
    s = sigmoid(f)
    return np.concatenate([s.astype(np.float32) @ x, [s.sum(), np.logaddexp(0, f).sum(), len(x)]]).astype(np.float64)


def pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1, at: tuple[np.ndarray, float] | None = None, whole: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under the logistic loss, by Adam on all rows.

    With `whole`, moments() of all unlabelled documents over their number, at the weights and bias `at`, E_U is tilted to have those there.
    """
    rng = np.random.default_rng(seed)
    mean = unlabelled.mean(0)
    p, u = positive, unlabelled  # rows less the mean, which is never taken off a copy of them
    w, b = rng.normal(0, 1e-3, p.shape[1]).astype(np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    tilt, lift, w0, b0 = np.zeros(len(w) + 1), 0.0, w, b
    if at is not None and whole is not None:
        w0, b0 = at[0].astype(np.float32), at[1] + float(mean @ at[0])
        w, b = w0.copy(), b0
        off = whole[:-1] - moments(unlabelled, *at)[:-1] / len(unlabelled)
        tilt, lift = np.append(off[:-2] - mean * off[-2], off[-2]), off[-1]
    for t in range(1, EPOCHS + 1):
        low = b - float(mean @ w)
        fp, fu = p @ w + low, u @ w + low
        # l(+) = log(1 + exp(-f)), l(-) = log(1 + exp(f))
        negative = np.logaddexp(0, fu).mean() + lift + tilt[:-1] @ (w - w0) + tilt[-1] * (b - b0) - prior * np.logaddexp(0, fp).mean()
        gp, gu = -prior * sigmoid(-fp) / len(fp), np.zeros(len(fu))
        away = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        if negative >= 0:
            gp, gu, gt = gp + away[0], away[1], tilt
        else:  # the risk of negatives must not fall below zero: a step back
            gp, gu, gt = gp - away[0], -away[1], -tilt
        total = gp.sum() + gu.sum()
        g = np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u - total * mean + DECAY * w, total) + gt
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b - mean @ w)


def calibrated(f: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Scale and shift of raw scores, so that 0.5 lies where most training labels fall on their side."""
    if good.all() or not good.any():
        return 1.0, 0.0
    order = np.argsort(f)
    f, good = f[order], good[order]
    # Errors of each class count alike.
    wrong = np.concatenate([[0], np.cumsum(good)]) / good.sum() + (1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum())
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cuts = np.concatenate([[f[0] - 1], (f[1:] + f[:-1]) / 2, [f[-1] + 1]])
    spread = max(float(np.std(f)), 1e-6)
    return 2 / spread, -2 / spread * float(cuts[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """The model from documents (doc_id, text) and labels (doc_id, quality 0 or 1), of which null ones are ignored.

    About `labelled` and `unlabelled` documents are sampled by hash; of all others only sums over all rows reach the driver.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    n = docs.select("doc_id").count()
    if not counts.get(1) or not n:
        return Model()
    good_share = counts[1] / sum(counts.values())
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(F.col("quality") == 1, min(1.0, labelled * 2 / 3 / counts[1])).otherwise(min(1.0, labelled / 3 / max(1, counts.get(0, 1))))
    some = F.broadcast(marks.where(draw < part))  # about `labelled` ids, whatever the input
    sampled = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, unlabelled / n))
    parts_of = F.explode(F.array_compact(F.array(F.col("quality").cast("int"), F.when(sampled, F.lit(-1)))))
    chosen = docs.select("doc_id", "text").join(some, "doc_id", "left").select("text", parts_of.alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, row=ROW):
            x = features(*utf8(b.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "x"])

    found = sorted(zip(*chosen.mapInArrow(run, "quality int, x binary").toArrow().to_pydict().values()))  # an order that doesn't depend on tasks
    if not any(k == 1 for k, _ in found):
        return Model()
    kind = np.array([k for k, _ in found])
    x = np.frombuffer(b"".join(v for _, v in found), np.float16).reshape(len(kind), -1).astype(np.float32)
    del found
    # Rows are in the order of their kind, so these are no copies.
    none, good = int((kind == -1).sum()), int((kind == 1).sum())
    some, positive = x[:none] if none else x, x[len(x) - good :]
    first = pu_fit(positive, some, good_share)
    w, b = pu_fit(positive, some, good_share, at=first, whole=whole_moments(docs, *first))
    scale, shift = calibrated(x[none:] @ w + b, kind[none:] == 1)
    return Model((w * scale).astype(np.float32), b * scale + shift)


def whole_moments(docs: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """moments() of all documents, over their number."""
    shared = docs.sparkSession.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((moments(features(*utf8(p.column("text"))), *shared.value) for p in parts(batches, row=ROW)), np.zeros(len(w) + 3))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "value"])

    rows = docs.select("text").mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(w) + 3)
    for slot, value in rows:
        out[slot] = value
    # Sums in any order differ in their last digits; the model should not.
    return np.round(out / max(1.0, out[-1]), 9)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in parts(batches, row=ROW):
        yield b, model.score(features(*utf8(b.column("text"))))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of each document.

    A null text counts as empty and gets a score like any other; equal texts get equal scores; repeated rows come out
    repeated. A model that had no trusted positives gives 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in _scored(batches, shared.value):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with all their columns.

    Null and empty texts are scored like any other; repeated rows stay or go together; a model without trusted
    positives keeps all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in _scored(batches, shared.value):
            yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
