"""Toxicity: a factorization machine over hashed terms.

A document's terms are its folded words and their stems (first 4, 5 and 6 bytes), hashed to 2^20 slots.
The machine adds a bias, one weight per term and the inner products of the terms' factors, so a pair such
as an insult and a group mention can count for more than both apart. It is fitted on a bounded sample of
labelled rows over all slots that the sample holds; scoring is one pass over the text, with the pair sums taken as (sum of factors)^2 - sum of squares, linear in the terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .quality import labelled

#: Labelled rows used for fitting, at most.
SAMPLE = 12_000
SLOT_BITS, FACTORS, BATCHES, ROWS, STEP = 20, 4, 120, 256, 0.1
#: Pull to zero; rows, and deviations from the classes' share, at which a slot counts for half; least spread of gradients that is told; most weight of the rarer class.
DECAY, RARE, TELLING, FLOOR, MOST = 1e-4, 200.0, 4.0, 1e-2, 4.0
STEMS = (4, 5, 6)
_NEVER = np.uint64(1) << np.uint64(SLOT_BITS)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs, in that order."""
    w = C.Words(data, offsets, C.FOLDED, fold=True)
    long_ = w.end - w.start
    slots = [w.hash] + [C.mixed(w.ranges(w.start[m], w.start[m] + k) + np.uint64(k)) for k in STEMS for m in [long_ >= k]]
    docs = [w.doc] + [w.doc[long_ >= k] for k in STEMS]
    key = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(SLOT_BITS)) | (np.concatenate(slots) >> np.uint64(64 - SLOT_BITS)))
    return (key >> np.uint64(SLOT_BITS)).astype(np.int64), (key & (_NEVER - np.uint64(1))).astype(np.int64)


@dataclass
class Machine:
    """Bias, and one weight and ``FACTORS`` factors for each of the 2^SLOT_BITS slots."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, slot = terms(data, offsets)
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        z = self.bias + np.bincount(doc, self.weights[slot], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slot, f].astype(float)
            z += (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n)) / (2 * size)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def blank(bias: float) -> Machine:
    return Machine(bias, np.zeros(1 << SLOT_BITS, np.float32), np.zeros((1 << SLOT_BITS, FACTORS), np.float32))


def fit(doc: np.ndarray, slot: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Sparse mini-batches over all slots of the sample's (text, slot) pairs; deterministic for the same rows in the same order.

    A step moves only the slots that its rows hold, each by its own running mean and spread of gradients. A slot of few
    rows that tells little by itself counts for less, so what is seen once or twice stays near zero; none is left out.
    """
    n = len(y)
    share = min(max(float(y.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
    model = blank(float(np.log(share / (1 - share))))
    if share in (1e-3, 1 - 1e-3) or not len(slot):
        return model
    used, col = np.unique(slot, return_inverse=True)
    col = col.astype(np.int32)
    held = np.bincount(col).astype(np.float32)
    toxic = np.bincount(col, y[doc])
    off = (toxic - held * share) ** 2 / (held * share * (1 - share) + 1)  # squared deviations from the share
    trust = np.maximum(held / (held + RARE), off / (off + TELLING**2)).astype(np.float32)
    edge = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    k = FACTORS + 1  # the weight, then the factors
    p = np.concatenate([np.zeros((len(used), 1)), rng.normal(0, 0.02, (len(used), FACTORS))], 1).astype(np.float32)
    m, s = np.zeros_like(p), np.zeros_like(p)
    turns = np.zeros(len(used), np.int32)
    b = np.float32(model.bias)
    balance = np.where(y > 0, min(0.5 / share, MOST), 1.0).astype(np.float32)
    epochs = -(-BATCHES // -(-n // ROWS))
    for epoch in range(epochs):
        step = STEP * (1 - epoch / epochs)
        order = rng.permutation(n)
        for lo in range(0, n, ROWS):
            rows = np.sort(order[lo : lo + ROWS])
            sizes = edge[rows + 1] - edge[rows]
            c = col[C.spread(edge[rows], sizes)]
            of = np.repeat(np.arange(len(rows)), sizes)
            here, at = np.unique(c, return_inverse=True)
            x = (p[here] * trust[here, None])[at]
            sums = np.stack([np.bincount(of, x[:, j], len(rows)) for j in range(k)], 1).astype(np.float32)
            squares = np.bincount(of, (x[:, 1:] ** 2).sum(1), len(rows)).astype(np.float32)
            size = np.maximum(sizes, 1).astype(np.float32)
            z = b + sums[:, 0] + ((sums[:, 1:] ** 2).sum(1) - squares) / (2 * size)
            err = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[rows]) * balance[rows] / len(rows)).astype(np.float32)
            g = np.empty_like(x)
            g[:, 0] = err[of]
            g[:, 1:] = (err / size)[of, None] * (sums[of, 1:] - x[:, 1:])
            g = np.stack([np.bincount(at, g[:, j], len(here)) for j in range(k)], 1).astype(np.float32) * trust[here, None] + DECAY * p[here]
            turns[here] += 1
            t = turns[here, None]
            m[here] = 0.9 * m[here] + 0.1 * g
            s[here] = 0.99 * s[here] + 0.01 * g * g
            p[here] -= step * (m[here] / (1 - 0.9**t)) / (np.sqrt(s[here] / (1 - 0.99**t)) + FLOOR)
            b -= np.float32(step * err.sum())
    model.bias = float(b)
    p *= trust[:, None]
    model.weights[used], model.factors[used] = p[:, 0], p[:, 1:]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: Column | None = None, limit: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Machine:
    """Fit on at most ``limit`` labelled rows outside the held-out fold; their ids are broadcast, their slots come to the driver."""
    C.prepare(docs.sparkSession)
    picked = C.stored(labelled(labels, label, F.lit(False) if held_out is None else held_out, limit, doc_id), "sample")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1)):
                doc, slot = terms(data, offsets)
                edge = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                x = pa.ListArray.from_arrays(pa.array(edge), pa.array(slot.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i).cast(pa.int32()), x], ["doc_id", "y", "x"])

    got = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType()))])).toArrow()
    if not got.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    got = got.sort_by("doc_id")
    x = got.column("x").combine_chunks()
    size = np.diff(x.offsets.to_numpy())
    return fit(np.repeat(np.arange(got.num_rows, dtype=np.int32), size), x.flatten().to_numpy(), (got.column("y").to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Machine, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and its score from 0 to 1 (a column of that name is replaced).

    Null and empty texts have no terms and score as the bias does; repeated rows score alike.
    """
    C.prepare(docs.sparkSession)
    docs = docs.drop(score)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.concatenate([model.score(data, offsets) for _, _, data, offsets in C.slices(b.column(at))])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
