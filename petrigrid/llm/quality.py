"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted from the bytes of the whole text in numpy passes inside the scan's tasks. The trees
are fitted on the statistics of a bounded sample of labelled rows and kept as flat arrays (complete binary
trees), so scoring a batch is ``depth`` vectorised steps per tree. Text is never shuffled.
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

#: Labelled rows used for fitting, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.2, 1.0, 5.0

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "upper", "lower", "digits", "non_ascii", "space", "stops", "commas", "bangs", "bars", "symbols", "quotes",
    "bare_words", "short_words", "long_words", "repeats", "second_repeats", "distinct",
)

_KINDS = ("upper", "lower", "digits", "non_ascii", "space", "stops", "commas", "bangs", "bars", "quotes")
_KIND = np.full(256, len(_KINDS), np.uint8)  # anything else is a symbol
for _i, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), [0x20, *range(9, 14)], b".?;:", b",", b"!", b"|", b"\"'()-")):
    _KIND[list(_bytes)] = _i


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text; all zeros for an empty one."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    w = C.Words(data, offsets, C.PLAIN)
    per = len(_KINDS) + 1
    kinds = np.bincount(np.repeat(np.arange(n) * per, size) + _KIND[data], minlength=n * per).reshape(n, per)
    lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1, minlength=n)[:n]
    sums = lambda mask: np.bincount(w.doc, mask, n)
    length = (w.end - w.start).astype(float)
    letters = np.concatenate([[0], np.cumsum(C.FOLDED[C.LOWER[data]])])
    same = np.zeros(len(w.start), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    second = np.zeros(len(w.start), bool)
    second[2:] = (w.hash[2:] == w.hash[:-2]) & (w.doc[2:] == w.doc[:-2])
    keys = np.sort((w.doc.astype(np.uint64) << np.uint64(44)) | (w.hash >> np.uint64(20)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)
    words, bytes_ = np.maximum(w.count, 1), np.maximum(size, 1)
    at = {k: kinds[:, i] / bytes_ for i, k in enumerate(_KINDS)}
    at |= {"symbols": kinds[:, -1] / bytes_, "log_bytes": np.log1p(size), "log_words": np.log1p(w.count), "log_lines": np.log1p(lines), "mean_word": sums(length) / words}
    at |= {"bare_words": sums(letters[w.end] == letters[w.start]) / words, "short_words": sums(length <= 3) / words, "long_words": sums(length >= 12) / words}
    at |= {"repeats": sums(same) / words, "second_repeats": sums(second) / words, "distinct": distinct / words}
    return np.stack([at[k] for k in STATISTICS], 1)


@dataclass
class Trees:
    """Complete binary trees as flat arrays: node i has children 2i+1 and 2i+2; a node without a split sends all left."""

    bias: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner if len(x) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees under the logistic loss; split gains come from gradient histograms over quantile bins."""
    n, k = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    out = Trees(float(np.log(share / (1 - share))), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    if not n or share in (1e-3, 1 - 1e-3):
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)], 1)
    margin = np.full(n, out.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            lo, wide = 2**level - 1, 2**level
            best = np.zeros(wide)
            for j in range(k):
                cell = (node - lo) * bins + binned[:, j]
                gs = np.bincount(cell, g, wide * bins).reshape(wide, bins).cumsum(1)
                hs = np.bincount(cell, h, wide * bins).reshape(wide, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < LEAST) | (ht - hs < LEAST)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                win = top > best + 1e-9
                best[win] = top[win]
                out.feature[t, lo + np.flatnonzero(win)] = j
                out.limit[t, lo + np.flatnonzero(win)] = edges[j][at[win]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.limit[t, node])
        leaf = node - (2**depth - 1)
        out.leaf[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + RIDGE)
        margin += out.leaf[t, leaf]
    return out


def labelled(labels: DataFrame, label: str, held_out: Column, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, in the order of their hash: ``doc_id, y``.

    Several labels of one id count as 1 if any is; null ids and labels teach nothing.
    """
    known = labels.where(~held_out).select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    h = F.xxhash64("doc_id")
    if n > limit:  # the hash cuts close to the limit before rows are ordered
        known = known.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * limit / n * 1.1) + 1)
    return known.orderBy(h, "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None, limit: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Fit on a bounded sample: its ids (``limit`` at most) are broadcast, its statistics come to the driver."""
    C.prepare(docs.sparkSession)
    held_out = F.lit(False) if held_out is None else held_out
    picked = C.stored(labelled(labels, label, held_out, limit, doc_id), "sample")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    got = got.sort_by("doc_id")  # the same trees whatever order tasks end in
    x = got.column("x").combine_chunks()
    return fit(x.flatten().to_numpy().reshape(got.num_rows, -1), (got.column("y").to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and its score from 0 to 1 (a column of that name is replaced); null texts score as empty ones."""
    C.prepare(docs.sparkSession)
    docs = docs.drop(score)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.concatenate([model.score(statistics(data, offsets)) for _, _, data, offsets in C.slices(b.column(at))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
