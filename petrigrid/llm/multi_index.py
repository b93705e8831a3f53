"""Nearest neighbours by inner product over multi-index hashing.

Codes are learned on a bounded sample: vectors, extended by one coordinate that makes inner products
and distances agree, are projected on their main directions, and a rotation is learned that brings
the projections close to the corners of a cube; signs give the bits. A code splits into substrings, each with an
index of its own. By the pigeonhole principle two codes within a Hamming radius agree up to a smaller radius in one
substring, so probing the buckets of every index within those radii gives every code within the radius; a
pair counts in the first index that finds it. The radius is calibrated on the sample, where neighbours are
farther apart than among all vectors, so it errs to the safe side; queries that find fewer neighbours than asked
go again with a doubled radius until they have them or all codes are within it. What is found is ranked by inner
products of the original vectors in double precision.

An index is cut into cells by leading bits of its substring, and cells and their queries into blocks of bounded size.
Equal vectors are one entry with the ids that can be in a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common as C
from .embedding_dedup import _by_dim

K = 20
#: Vectors that codes are learned and calibrated on, at most; those of them that ask; share of neighbours to be found.
SAMPLE, ASKING, RECALL = 8192, 256, 0.96
#: Bits of a code at most (one machine word), steps of the rotation.
BITS, STEPS = 64, 25
#: Numbers of substrings to choose from.
SPLITS = (2, 3, 4, 6, 8)
#: Vectors of a cell aimed at, rows per side of a block, pairs ranked at once, leading bits at most.
CELL, BLOCK, PAIRS, PREFIX = 4096, 2048, 50_000, 16

_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def ones(x: np.ndarray) -> np.ndarray:
    """Set bits of 64-bit values."""
    return sum(_POP[(x >> np.uint64(s)) & np.uint64(0xFFFF)] for s in (0, 16, 32, 48)).astype(np.int16)


@dataclass
class Coder:
    """Codes of one dimension and how they are searched."""

    scale: float  # length of the longest vector known; longer ones count as that long
    mean: np.ndarray
    turn: np.ndarray  # extended dimensions x bits
    radius: int
    splits: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def codes(self, x: np.ndarray, ask: bool) -> np.ndarray:
        p = (extended(x, self.scale, ask) - self.mean) @ self.turn
        return ((p > 0).astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def parts(self, splits: int | None = None) -> list[tuple[int, int]]:
        """First bit and width of each substring."""
        edge = np.linspace(0, self.bits, (splits or self.splits) + 1).astype(int)
        return [(int(a), int(b - a)) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def radii(self, radius: int, splits: int | None = None) -> list[int]:
        """Radius of each index: any code within ``radius`` is within it in one of them (-1: not probed)."""
        n = splits or self.splits
        each, rest = divmod(radius, n)
        return [each if i <= rest else each - 1 for i in range(n)]


def part(codes: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return (codes >> np.uint64(at[0])) & np.uint64((1 << at[1]) - 1)


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths without overflow in between."""
    top = np.abs(x).max(1)
    return np.minimum(top * np.sqrt(((x / top[:, None]) ** 2).sum(1)), 1e300)


def extended(x: np.ndarray, scale: float, ask: bool) -> np.ndarray:
    """Unit vectors of one more dimension: askers by their direction, others with what their length lacks."""
    n = lengths(x)
    if ask:
        return np.column_stack([x / n[:, None], np.zeros(len(x))])
    y = x / np.maximum(n, scale)[:, None]
    return np.column_stack([y, np.sqrt(np.maximum(1 - (y**2).sum(1), 0))])


def learn(x: np.ndarray, k: int = K, recall: float = RECALL, seed: int = 11) -> Coder:
    scale = float(lengths(x).max())
    e = extended(x, scale, False)
    mean = e.mean(0)
    _, v = np.linalg.eigh((e - mean).T @ (e - mean))
    v = v[:, ::-1][:, : max(1, min(BITS, x.shape[1]))]
    p = (e - mean) @ v
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(p.shape[1], p.shape[1])))[0]
    for _ in range(STEPS):
        u, _, w = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
        turn = (u @ w).T
    coder = Coder(scale, mean, v @ turn, v.shape[1], 1)
    asking = np.linspace(0, len(x) - 1, min(ASKING, len(x))).astype(int)
    codes, asked = coder.codes(x, False), coder.codes(x[asking], True)
    apart, best = [], []
    for i, q in zip(asking, asked, strict=True):
        d = ones(codes ^ q)
        near = x / scale @ (x[i] / scale)
        near[i] = -np.inf
        apart.append(d)
        best.append(d[np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]])
    found = np.concatenate(best)
    if len(x) > 2 * k and len(found):
        coder.radius = max(1, int(np.sort(found)[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]))
    costs = {}
    for n in SPLITS:
        if n <= coder.bits:
            near = [(ones(part(codes[None] ^ asked[:64, None], at)) <= r).mean() for at, r in zip(coder.parts(n), coder.radii(coder.radius, n), strict=True)]
            costs[n] = sum(near) + n / 1000
    coder.splits = min(costs, key=costs.get) if costs else 1
    return coder


def numbers(col: pa.Array) -> np.ndarray:
    """Vectors of one length in double precision."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def train(vectors: DataFrame, k: int, recall: float) -> dict[int, Coder]:
    """Coders per dimension from at most ``SAMPLE`` vectors, taken in the order of their hash."""
    n = vectors.count()
    h = F.xxhash64("h1", F.lit(3))
    few = vectors if n <= SAMPLE else vectors.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n * 1.1) + 1)
    col = few.orderBy(h, "h2").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    return {d: learn(numbers(col.take(pa.array(at))), k, recall) for d, at in _by_dim(col)} if len(col) else {}


def plain(dim: int) -> Coder:
    """For a dimension that the sample does not hold: one bit, every code within the radius."""
    return Coder(1.0, np.zeros(dim + 1), np.zeros((dim + 1, 1)), 1, 1)


def _cells(vectors: DataFrame, coders: dict[int, Coder], ask: bool, wide: int, bits: int) -> DataFrame:
    """``vectors`` with ``dim, code`` and one row per index and cell: where it lies, or where its neighbours within the radius may lie."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))])
    at = vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows in _by_dim(b.column(at)):
                own = b.take(pa.array(rows))
                coder = coders.get(dim) or plain(dim)
                codes = coder.codes(numbers(own.column(at)), ask)
                radius = min(coder.bits, coder.radius << wide)
                row, cell = [], []
                for j, (p, r) in enumerate(zip(coder.parts(), coder.radii(radius), strict=True)):
                    lead = min(p[1], bits)
                    head = part(codes, (p[0] + p[1] - lead, lead))
                    if not ask:
                        row.append(np.arange(len(codes)))
                        cell.append((j << PREFIX) + head.astype(np.int64))
                    elif r >= 0:
                        heads = np.arange(1 << lead, dtype=np.uint64)
                        x, y = np.nonzero(ones(heads[None] ^ head[:, None]) <= r)
                        row.append(x)
                        cell.append((j << PREFIX) + y)
                row, cell = np.concatenate(row), np.concatenate(cell)
                order = np.argsort(row, kind="stable")
                edge = np.searchsorted(row[order], np.arange(len(codes) + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(edge), pa.array(cell[order]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(codes), dim, np.int32)), pa.array(codes.view(np.int64)), cells], schema.names)

    return vectors.mapInArrow(run, schema).withColumn("cell", F.explode("cells")).drop("cells")


_FOUND = "h1 long, h2 long, part long, score array<double>, ids array<array<long>>, own array<boolean>"


def _blocks(df: DataFrame, coders: dict[int, Coder], wide: int, k: int) -> DataFrame:
    """Best entries of each query in each block from ``key, query, h1, h2, v, ids, dim, cell, code`` sorted by key and query."""
    at = df.columns.index

    def near(coder: Coder, radius: int, j: int, q: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) pairs within the radius that this index is the first to find: probed bucket by bucket."""
        parts, radii = coder.parts(), coder.radii(radius)
        value, bucket = np.unique(part(m, parts[j]), return_inverse=True)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(len(value) + 1))
        step = max(1, PAIRS * 4 // max(1, len(value)))
        for i in range(0, len(q), step):
            x, b = np.nonzero(ones(value[None] ^ part(q[i : i + step], parts[j])[:, None]) <= radii[j])
            size = edge[b + 1] - edge[b]
            for lo, hi in _spans(size):
                a, c = np.repeat(x[lo:hi], size[lo:hi]) + i, order[C.spread(edge[b[lo:hi]], size[lo:hi])]
                diff = q[a] ^ m[c]
                ok = ones(diff) <= radius
                for o in range(j):
                    ok &= ones(part(diff, parts[o])) > radii[o]
                yield a[ok], c[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.groups(batches, "key"):
            key = t.column(at("key")).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                g = t.slice(lo, hi - lo).combine_chunks()
                asks = g.column(at("query")).to_numpy(zero_copy_only=False)
                if asks.all() or not asks.any():
                    continue
                dim = g.column(at("dim"))[0].as_py()
                coder = coders.get(dim) or plain(dim)
                radius = min(coder.bits, coder.radius << wide)
                q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
                codes = g.column(at("code")).to_numpy().view(np.uint64)
                v = numbers(g.column(at("v")).combine_chunks())
                vq, vm = v[q], v[m]
                h1, h2 = g.column(at("h1")).to_numpy(), g.column(at("h2")).to_numpy()
                ids = g.column(at("ids")).combine_chunks()
                least = np.array([x[0].as_py() for x in ids.take(pa.array(m))])
                best = _Best(len(q), k + 1)
                for a, c in near(coder, radius, g.column(at("cell"))[0].as_py() >> PREFIX, codes[q], codes[m]):
                    for s in range(0, len(a), PAIRS):
                        x, y = a[s : s + PAIRS], c[s : s + PAIRS]
                        with np.errstate(over="ignore", invalid="ignore"):
                            score = np.einsum("ij,ij->i", vq[x], vm[y])
                        best.add(x, y, np.where(np.isnan(score), -np.inf, score), least)
                x, y, score = best.rows()
                if not len(x):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])).astype(np.int32)
                who = q[x[cut[:-1]]]
                own = (h1[q[x]] == h1[m[y]]) & (h2[q[x]] == h2[m[y]])
                lists = [pa.ListArray.from_arrays(pa.array(cut), z) for z in (pa.array(score), ids.take(pa.array(m[y])), pa.array(own))]
                yield pa.RecordBatch.from_arrays([pa.array(h1[who]), pa.array(h2[who]), pa.array(np.full(len(who), key[lo])), *lists], ["h1", "h2", "part", "score", "ids", "own"])

    return df.mapInArrow(run, _FOUND)


def _spans(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes add up to about PAIRS."""
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 4 * PAIRS, "right")))
        yield i, j
        i = j


class _Best:
    """The best ``k`` members of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.x = self.y = np.zeros(0, np.int64)
        self.score = self.id = np.zeros(0)
        self.floor = np.full(n, -np.inf)

    def add(self, x: np.ndarray, y: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[x]
        x, y, score = np.concatenate([self.x, x[keep]]), np.concatenate([self.y, y[keep]]), np.concatenate([self.score, score[keep]])
        order = np.lexsort((ids[y], -score, x))
        x, y, score = x[order], y[order], score[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        last = rank == self.k - 1
        self.floor[x[last]] = score[last]
        keep = rank < self.k
        self.x, self.y, self.score = x[keep], y[keep], score[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.x, self.y, self.score


def _merged(lists: Column, k: int) -> Column:
    """The first ``k`` of several lists of (minus score, id, own)."""
    return F.slice(F.sort_array(F.flatten(lists)), 1, k)


def _search(asked: DataFrame, index: DataFrame, coders: dict[int, Coder], wide: int, bits: int, k: int) -> DataFrame:
    """``h1, h2, found``: the best entries of each asked vector within the radius, itself included."""
    cell = ["dim", "cell"]
    asks = _cells(asked.withColumn("ids", F.array().cast("array<long>")), coders, True, wide, bits)
    sizes = index.groupBy(*cell).agg(F.count("*").alias("m")).join(asks.groupBy(*cell).agg(F.count("*").alias("q")), cell)
    sizes = C.stored(sizes.select(*cell, F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")), "cells")

    def dealt(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        df = df.join(sizes, cell).withColumn("x", F.pmod(F.xxhash64("h1", F.lit(5)), F.col(own)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("y", "x") if query else ("x", "y")
        return df.select(F.xxhash64(*cell, *pair).alias("key"), F.lit(query).alias("query"), "h1", "h2", "v", "ids", *cell, "code")

    both = dealt(index, "mb", "qb", False).unionByName(dealt(asks, "qb", "mb", True))
    found = _blocks(both.repartition("key").sortWithinPartitions("key"), coders, wide, k)
    entry = F.flatten(F.transform(F.arrays_zip("score", "ids", "own"), lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("below"), i.alias("id"), e["own"].alias("own")))))
    lists = found.select("h1", "h2", F.pmod("part", F.lit(16)).alias("salt"), F.slice(F.sort_array(entry), 1, k + 1).alias("e"))
    return lists.groupBy("h1", "h2", "salt").agg(_merged(F.collect_list("e"), k + 1).alias("e")).groupBy("h1", "h2").agg(_merged(F.collect_list("e"), k + 1).alias("found"))


def nearest(vectors: DataFrame, asking: Column, k: int = K, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner products for each row where ``asking`` holds.

    A row is compared with all rows of its length but itself. Ties go to the smaller id; of repeated rows each is a
    neighbour of the others. Vectors that are null, empty, zero or hold null or non-finite components and rows
    without an id take no part. Products that overflow to no number come last. Other columns are ignored; an empty
    table gives an empty result.
    """
    C.prepare(vectors.sparkSession)
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(asking, F.lit(False)).alias("asks"), F.col(embedding).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # equal vectors: the k + 1 smallest ids, first within parts of a hot vector
    part_ = W.partitionBy("h1", "h2", "salt").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(part_)).where(F.col("n") <= k + 1)
    known = few.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.first("v").alias("v"))
    known = C.stored(known, "vectors")
    coders = train(known, k, recall)
    bits = min(PREFIX, max(0, (known.count() // CELL).bit_length()))
    index = C.stored(_cells(known.select("h1", "h2", "v", "ids"), coders, False, 0, bits), "index")
    queries = rows.where("asks").select("id", "h1", "h2")
    left = known.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")
    totals = known.groupBy(F.size("v").alias("dim")).agg(F.sum(F.size("ids")).alias("rows"))
    left = C.stored(left.withColumn("dim0", F.size("v")).join(totals.withColumnRenamed("dim", "dim0"), "dim0").select("h1", "h2", "v", F.least("rows", F.lit(k + 1)).alias("want")), "queries")
    out, wide, most = None, 0, max((c.bits for c in coders.values()), default=1)
    while True:
        found = C.stored(_search(left.drop("want"), index, coders, wide, bits, k), "found")
        done = left.join(found, ["h1", "h2"], "left")
        short = F.size(F.coalesce("found", F.array().cast(found.schema["found"].dataType))) < F.col("want")
        whole = min((c.radius << wide for c in coders.values()), default=most) >= most
        answered = done.where(~short | F.lit(whole)).where("found is not null").select("h1", "h2", "found")
        out = answered if out is None else out.unionByName(answered)
        left = done.where(short).select(left.columns)
        if whole or not left.limit(1).count():
            break
        left, wide = C.stored(left, "queries"), wide + 1
    same = F.array_position(F.transform("found", lambda e: e["own"] & (e["id"] == F.col("query_id"))), True)
    lists = queries.withColumnRenamed("id", "query_id").join(out, ["h1", "h2"]).withColumn("at", same)
    lists = lists.select("query_id", F.posexplode(F.slice(F.filter("found", lambda e, i: i + 1 != F.col("at")), 1, k)).alias("rank", "e"))
    return lists.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.below")).alias("score"))
