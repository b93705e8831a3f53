"""Shared helpers of the corpus operators: tables, folders, vectorised words, components.

Words are handled as byte ranges of one flat buffer: separators are ASCII, so UTF-8 needs no decoding,
and every step is a numpy pass over a slice of bounded bytes instead of a Python loop over words.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrigrid.session import checkpoint_dir, tune

#: Bytes of text that one numpy pass works on. A longer text is one slice of its own.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = 1_000

#: Separators of the plain word rule: space, tab to carriage return.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: The folded word rule: 0-9, a-z (A-Z folded) and every byte of a non-ASCII character.
FOLDED = np.zeros(256, bool)
FOLDED[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the corpus operators on a live session."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.master.startswith("local"):  # workers of this machine import the package from where the driver did; a cluster gets it by --py-files
        sc.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, when no later plan reads it."""
    spark = df.sparkSession
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


# ---- words -----------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """The words of some texts: byte ranges ``start:end`` in ``data``, in order; ``first[i]:first[i+1]`` are text i's.

    ``hash`` holds one 64-bit value per word. Equal words have equal values; different words share one
    with the odds of a random 64-bit value.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: np.ndarray, fold: bool = False):
        if fold:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = rule[data]
        n = len(data)
        opens = np.zeros(n + 1, bool)
        opens[offsets[:-1]] = True
        at = inside.copy()
        at[1:] &= ~inside[:-1] | opens[1:n]
        self.start = np.flatnonzero(at)
        opens[offsets[1:]] = True
        at = inside
        at[:-1] &= ~inside[1:] | opens[1:n]
        self.end = np.flatnonzero(at) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        size = 1 << max(20, int(n).bit_length())
        up, self._down = _powers(size)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit values of byte ranges."""
        return mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64) * np.uint64(_GRAM))

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return self.ranges(self.start, self.end)

    @functools.cached_property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the kept words, each followed by one space, and each text's range in them with the last space left out."""
        start, end, count = self.start, self.end, self.count
        if keep is not None:
            start, end = start[keep], end[keep]
            count = np.bincount(self.doc[keep], minlength=len(self.count))
        size = end - start + 1
        stop = np.cumsum(size)
        out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        inside = np.ones(len(out), bool)
        inside[stop - 1] = False
        out[inside] = self.data[spread(start, end - start)]
        edge = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
        lo, hi = edge[:-1], edge[1:]
        return out, np.stack([lo, np.maximum(lo, hi - 1)], 1)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0]+1, ... for each range in turn."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = size > 0
    start, size = start[keep], size[keep]
    step = np.ones(total, np.int64)
    step[0] = start[0]
    ends = np.cumsum(size)[:-1]
    step[ends] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(step)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit values of the runs of k consecutive values (len(h) - k + 1 of them, or none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_GRAM)
        out += h[j : j + n]
    return mixed(out)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (or one longer row): first row, end row, bytes, offsets."""
    data, offsets = buffers(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``: what a batch leaves open waits for the next."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key))
        last = k[b.num_rows - 1]
        if held and held[0].column(held[0].schema.get_field_index(key))[0] == last:
            held.append(b)
            continue
        # the last group of this batch may go on; all before it is complete
        codes = k.to_numpy(zero_copy_only=False)
        cut = b.num_rows - int(np.argmax(codes[::-1] != last.as_py())) if (codes != last.as_py()).any() else 0
        done = [*held, b.slice(0, cut)]
        if held or cut:
            yield pa.Table.from_batches(done)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex reachable from each of 0..n-1 over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ---- components ------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each vertex that has an edge to another and is not the smallest: ``id``, ``root``.

    Alternates two steps. Every vertex hands its larger neighbours to the smallest vertex it knows; then every vertex
    hands its smaller neighbours, and itself, to the smallest of them. Paths halve, so the rounds grow with the
    logarithm of the longest one. A round is one written table. Raises if it has not settled after ``rounds``.
    """
    e = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = big.groupBy("u").agg(F.min("v").alias("m"))  # v is below u after the first step
        small = big.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("s"))
        nxt = stored(small.select(F.col("s.x").alias("u"), F.col("s.y").alias("v")).where("u <> v").distinct(), "stars")
        drop_stored(e)
        # settled: every vertex has one parent, and no parent has a parent
        ends = nxt.select("u", "v", F.lit(0).alias("p")).union(nxt.select("v", F.lit(None).cast("long"), F.lit(1)))
        seen = ends.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("p").alias("p")).where("lo <> hi or (lo is not null and p = 1)")
        if not seen.limit(1).count():
            return nxt.select(F.col("u").alias("id"), F.col("v").alias("root"))
        e = nxt
    raise RuntimeError(f"components did not settle in {rounds} rounds")
