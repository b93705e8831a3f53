"""Near-duplicate embeddings by product quantisation, with exact cosines at the end.

Vectors are normalised; equal ones become one with a multiplicity. Coarse centroids split them into inverted
lists, and the residual to the centroid is coded in sub-spaces. Both code books are fitted on a bounded
sample; every vector is indexed. A query probes a list only if its half-space can hold a vector within the
radius (the distance to the plane between two centroids bounds the distance to all vectors beyond it), reads
approximate distances off per-query tables, and keeps a code whose distance minus the code's own error is
within the radius. Neither step can lose a link, so the exact cosines of what remains give all of them.

Lists and their queries are dealt in blocks of bounded size; a block returns link counts and a parent per
vector, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

THRESHOLD = 0.98
#: Vectors that the code books are fitted on, at most.
SAMPLE = 20_000
#: Vectors per list aimed at, lists at most, sub-spaces, codes per sub-space, steps of k-means.
LIST, LISTS, PARTS, CODES, STEPS = 512, 4096, 8, 64, 8
#: Vectors per side of a block.
BLOCK = 512
_SLACK = 1e-9


@dataclass
class Books:
    """Code books of one dimension."""

    coarse: np.ndarray  # lists x d
    parts: list[np.ndarray]  # columns of each sub-space
    fine: list[np.ndarray]  # codes x columns

    def assign(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = distances(u, self.coarse)
        return d2.argmin(1), d2

    def encode(self, u: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what they leave out."""
        r = u - self.coarse[own]
        codes = np.stack([distances(r[:, p], f).argmin(1) for p, f in zip(self.parts, self.fine, strict=True)], 1).astype(np.uint8)
        left = sum(((r[:, p] - f[codes[:, i]]) ** 2).sum(1) for i, (p, f) in enumerate(zip(self.parts, self.fine, strict=True)))
        return codes, np.sqrt(left)

    def probes(self, d2: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs of all lists that can hold a vector within ``radius``."""
        apart = np.sqrt(np.maximum(distances(self.coarse, self.coarse), 0))[own]
        beyond = d2 - d2[np.arange(len(own)), own][:, None]
        return np.nonzero(beyond <= 2 * apart * (radius + _SLACK) + _SLACK)

    def approximate(self, u: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of queries to coded vectors of one list, summed from tables."""
        r = u - self.coarse[which]
        out = np.zeros((len(u), len(codes)))
        for i, (p, f) in enumerate(zip(self.parts, self.fine, strict=True)):
            out += distances(r[:, p], f)[:, codes[:, i]]
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """Centroids from evenly spread starting rows; deterministic for the same rows in the same order."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(steps):
        own = distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def fit(u: np.ndarray, lists: int) -> Books:
    coarse = kmeans(u, max(1, min(lists, len(u))))
    r = u - coarse[distances(u, coarse).argmin(1)]
    parts = [p for p in np.array_split(np.arange(u.shape[1]), min(PARTS, u.shape[1])) if len(p)]
    return Books(coarse, parts, [kmeans(r[:, p], CODES) for p in parts])


def plain(dim: int) -> Books:
    """Books for a dimension that the sample does not hold: one list, nothing coded."""
    return Books(np.zeros((1, dim)), [np.arange(dim)], [np.zeros((1, dim))])


def units(raw: pa.Array) -> np.ndarray:
    """Unit vectors of lists of one length, in double precision; scaled first, so no square overflows."""
    flat = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _by_dim(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    n = col.value_lengths().to_numpy()
    for d in np.unique(n):
        yield int(d), np.flatnonzero(n == d)


def train(distinct: DataFrame, lists: int) -> dict[int, Books]:
    """Books per dimension from at most ``SAMPLE`` vectors, taken in the order of their hash."""
    n = distinct.count()
    h = F.xxhash64("id", F.lit(3))
    few = distinct if n <= SAMPLE else distinct.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n * 1.05) + 1)
    col = few.orderBy(h, "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    return {d: fit(units(col.take(pa.array(at))), lists) for d, at in _by_dim(col)} if len(col) else {}


def coded(distinct: DataFrame, books: dict[int, Books], radius: float) -> DataFrame:
    """``id, label, mult, v, dim, own, probes, codes, error`` of every distinct vector."""
    schema = T.StructType([*distinct.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("own", T.IntegerType()), T.StructField("probes", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("error", T.DoubleType())])
    at = distinct.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows in _by_dim(b.column(at)):
                part = b.take(pa.array(rows))
                u = units(part.column(at))
                book = books.get(dim) or plain(dim)
                own, d2 = book.assign(u)
                codes, error = book.encode(u, own)
                row, cell = book.probes(d2, own, radius)
                edge = np.searchsorted(row, np.arange(len(u) + 1)).astype(np.int32)
                probes = pa.ListArray.from_arrays(pa.array(edge), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(u), dim, np.int32)), pa.array(own.astype(np.int32)), probes, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], schema.names)

    return distinct.mapInArrow(run, schema)


def _blocks(df: DataFrame, books: dict[int, Books], threshold: float, radius: float) -> DataFrame:
    """``id, links, parent`` from ``key, query, id, mult, v, dim, list, codes, error`` sorted by key."""
    at = df.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.groups(batches, "key"):
            key = t.column(at("key")).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                g = t.slice(i, j - i).combine_chunks()
                asks = g.column(at("query")).to_numpy(zero_copy_only=False)
                if asks.all() or not asks.any():
                    continue
                ids, mult, error = (g.column(at(c)).to_numpy() for c in ("id", "mult", "error"))
                book = books.get(g.column(at("dim"))[0].as_py()) or plain(g.column(at("dim"))[0].as_py())
                u = units(g.column(at("v")).combine_chunks())
                q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
                codes = np.frombuffer(b"".join(g.column(at("codes")).take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
                near = book.approximate(u[q], codes, g.column(at("list"))[0].as_py())
                a, b = np.nonzero(np.sqrt(near) - error[m][None] <= radius + 1e-6)
                ok = ids[q[a]] != ids[m[b]]
                a, b = q[a[ok]], m[b[ok]]
                cos = np.concatenate([np.einsum("ij,ij->i", u[a[x : x + 50_000]], u[b[x : x + 50_000]]) for x in range(0, len(a), 50_000)] or [np.zeros(0)])
                a, b = a[cos >= threshold], b[cos >= threshold]
                if not len(a):
                    continue
                links = np.bincount(a, mult[b], len(ids)).astype(np.int64)
                known, node = np.unique(ids, return_inverse=True)
                root = C.roots(len(known), node[a], node[b])
                hit = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(known[root[node[hit]]])], ["id", "links", "parent"])

    return df.mapInArrow(run, "id long, links long, parent long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``.

    Links join vectors of one label (and length) with a cosine of the threshold or more. Vectors that are null,
    empty, zero or hold null or non-finite components, and those with a null label or id, link with nothing and are
    components of their own. Repeated rows link with each other. Other columns are ignored.
    """
    C.prepare(vectors.sparkSession)
    v = F.col(embedding)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), (F.lit(0) if label is None else F.col(label)).alias("label"), v.alias("v"))
    sound = F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumns({"h1": F.when(sound, F.xxhash64("v")), "h2": F.when(sound, F.xxhash64(F.lit(1), "v"))})
    groups = C.stored(rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")), "vectors")
    distinct = rows.join(groups.withColumnRenamed("id", "vec_id"), ["label", "h1", "h2", "vec_id"]).dropDuplicates(["vec_id", "h1"]).select(F.col("vec_id").cast("long").alias("id"), "label", "mult", "v")
    radius = float(np.sqrt(2 - 2 * threshold))
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    books = train(distinct, min(LISTS, -(-largest // LIST)))
    index = C.stored(coded(distinct, books, radius), "codes")
    asked = index.select("*", F.explode("probes").alias("list"))
    cell = ["label", "dim", "list"]
    held = index.withColumn("list", F.col("own"))
    sizes = held.groupBy(*cell).agg(F.count("*").alias("m")).join(asked.groupBy(*cell).agg(F.count("*").alias("q")), cell)
    sizes = C.stored(sizes.select(*cell, F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")), "cells")
    h = F.xxhash64("id", F.lit(5))

    def dealt(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        df = df.join(sizes, cell).withColumn("x", F.pmod(h, F.col(own)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("y", "x") if query else ("x", "y")
        return df.select(F.xxhash64(*cell, *pair).alias("key"), F.lit(query).alias("query"), "id", "mult", "v", "dim", "list", "codes", "error")

    both = dealt(held, "mb", "qb", False).unionByName(dealt(asked, "qb", "mb", True))
    links = C.stored(_blocks(both.repartition("key").sortWithinPartitions("key"), books, threshold, radius), "links")
    linked = links.groupBy("id").agg(F.sum("links").alias("links"))
    trees = C.components(links, "id", "parent")
    named = groups.select("label", "h1", "h2", F.col("id").cast("long").alias("id"), "mult").join(linked, "id", "left").join(trees, "id", "left")
    named = named.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    out = rows.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
