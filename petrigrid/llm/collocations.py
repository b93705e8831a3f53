"""Phrase collocations by prefix-free parsing.

Texts are parsed into chunks that begin where the content says so: at pairs of words whose value falls on
a trigger. A chunk reaches over the first two words of the next, so every run of up to three words lies whole in
the chunk that its first word belongs to. Equal chunks, however many copies of a text or passage there are, become one
entry of the dictionary with the number of times the parse holds it. Runs are then counted in the distinct
chunks only, weighted with that number, and the two words of overlap start nothing.

A phrase is frequent only if its parts are, so each length is counted among the runs whose shorter parts hit a sieve:
a bit table of the frequent shorter ones, sized by their number up to a fixed number of bits. A full sieve lets too much
through and loses nothing. All counts are of texts, not of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

#: Words of a phrase at most; a chunk reaches LONGEST - 1 words into the next.
LONGEST = 3
#: Mean number of words between triggers, and words of a chunk at most.
PERIOD, CHUNK = 32, 512
#: A phrase occurs so often at least.
LEAST = 10
#: A phrase goes if a longer one holds it in this share of its occurrences.
COVERED = 50
TOP = 2000
#: log2 of the bits of a sieve, at most: 32 MB.
SIEVE = 28
#: Distinct runs that a task adds up before it hands them on.
HELD = 400_000
#: Copies of the right side of a look-up, so that one word's phrases are not one task.
SALTS = 8

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAKS
WORD[[0x20, 0x09]] = False
#: In a chunk words are parted by one space or, between pieces, by one line feed.
PART = np.ones(256, bool)
PART[[0x20, 0x0A]] = False


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    picked = data[C.spread(start, end - start)]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(picked)])


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Chunks of some texts, and the text each is of. The last chunk of a text ends with a line feed."""
    w = C.Words(data, offsets, WORD, fold=True)
    n = len(w.start)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    full = np.flatnonzero(w.count)
    head, tail = w.first[full], w.first[full + 1] - 1
    last = np.zeros(n, bool)
    last[tail] = True
    marks = np.concatenate([[0], np.cumsum(BREAKS[w.data])])
    stops = last.copy()
    stops[:-1] |= marks[w.start[1:]] > marks[w.end[:-1]]
    opens = np.zeros(n, bool)
    opens[:-1] = (C.grams(w.hash, 2) & np.uint64(PERIOD - 1)) == 0
    opens[last] = False
    opens[head] = True
    start = np.flatnonzero(opens)
    ends = tail[np.searchsorted(tail, start)]  # last word of each start's text
    nxt = np.append(start[1:], n)
    # a stretch without triggers is cut at even steps; its last two words are never parted
    room = np.maximum(np.minimum(nxt - 1, ends - 1) - start, 0) // CHUNK
    more = np.repeat(start, room) + CHUNK * (C.spread(np.ones(len(room), np.int64), room))
    start = np.sort(np.concatenate([start, more]))
    ends = tail[np.searchsorted(tail, start)]
    nxt = np.append(start[1:], n)
    final = nxt > ends
    stop = np.where(final, ends + 1, nxt + LONGEST - 1)
    stop = np.minimum(stop, ends + 1)
    text, _ = w.joined()
    size = np.cumsum(w.end - w.start + 1)
    text[size[stops] - 1] = 0x0A
    lo = np.concatenate([[0], size])[start]
    return _strings(text, lo, size[stop - 1] - 1 + final), w.doc[start]


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, chunk, freq``: the distinct chunks of the parse and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0)
            for i, _, data, offsets in C.slices(b.column(1)):
                chunks, doc = parse(data, offsets)
                if len(chunks):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(doc + i)), chunks.cast(pa.string())], ["lang", "chunk"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, chunk string").groupBy("lang", "chunk").agg(F.count("*").alias("freq"))


class Sieve:
    """A bit for each value of the frequent phrases; others may share it."""

    def __init__(self, phrases: DataFrame):
        spark = phrases.sparkSession
        n = phrases.count()
        self.bits = bits = min(SIEVE, max(16, (16 * n).bit_length()))
        page = min(bits, 12)

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, data, offsets in C.slices(b.column(0)):
                    h = C.Words(data, offsets, PART).ranges(offsets[:-1], offsets[1:]) >> np.uint64(64 - bits)
                    s = np.unique(h).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((s >> page).astype(np.int32)), pa.array((s & ((1 << page) - 1)).astype(np.int32))], ["page", "slot"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in C.groups(batches, "page"):
                p, s = t.column(0).to_numpy(), t.column(1).to_numpy()
                for k in np.unique(p):
                    on = np.zeros(1 << page, bool)
                    on[s[p == k]] = True
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["page", "bits"])

        pages = phrases.select("phrase").mapInArrow(slots, "page int, slot int").repartition("page").sortWithinPartitions("page").mapInArrow(packed, "page int, bits binary").collect()
        table = np.zeros(1 << (bits - 3), np.uint8)
        for r in pages:
            table[r["page"] << (page - 3) : (r["page"] + 1) << (page - 3)] = np.frombuffer(r["bits"], np.uint8)
        self.table = spark.sparkContext.broadcast(table)


def counts(chunks: DataFrame, n: int, sieve: Sieve | None = None) -> DataFrame:
    """``lang, phrase, f``: occurrences of the runs of n words inside pieces whose runs of n - 1 words hit the sieve."""
    table, bits = (sieve.table, sieve.bits) if sieve else (None, 0)

    def hits(h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        return (table.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    def summed(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        return t.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from t.set_column(1, "phrase", t.column("phrase").cast(pa.string())).to_batches(max_chunksize=100_000)

    def found(b: pa.RecordBatch) -> Iterator[pa.Table]:
        weight = b.column(2).to_numpy()
        for i, j, data, offsets in C.slices(b.column(1)):
            w = C.Words(data, offsets, PART)
            if len(w.start) < n:
                continue
            final = data[offsets[1:] - 1] == 0x0A
            until = w.first[1:] - np.where(final, 0, LONGEST - 1)  # words that start something
            t = np.arange(len(w.start) - n + 1)
            doc = w.doc[: len(t)]
            ok = (t < until[doc]) & (t + n <= w.first[doc + 1])
            stop = data[np.minimum(w.end, len(data) - 1)] == 0x0A
            for x in range(n - 1):
                ok &= ~stop[x : x + len(t)]
            if table is not None:
                short = hits(w.ranges(w.start[: len(w.start) - n + 2], w.end[n - 2 :]))
                ok &= short[:-1] & short[1:]
            t = np.flatnonzero(ok)
            if len(t):
                d = w.doc[t]
                yield summed([pa.table({"lang": b.column(0).take(pa.array(d + i)), "phrase": _strings(data, w.start[t], w.end[t + n - 1]), "f": pa.array(weight[d])})])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            for t in found(b):
                held.append(t)
                rows += t.num_rows
                if rows >= HELD:
                    held = [summed(held)]
                    rows = held[0].num_rows
                    if rows >= HELD // 2:
                        yield from out(held[0])
                        held, rows = [], 0
        if held:
            yield from out(summed(held))

    return chunks.select("lang", "chunk", "freq").mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def looked_up(rows: DataFrame, part: Column, table: DataFrame, columns: dict[str, str], how: str = "inner") -> DataFrame:
    """``rows`` with columns of ``table`` at (lang, ``part``), under new names.

    Neither side is broadcast: Spark sizes them by their compressed files and without the copies.
    """
    right = table.select(F.col("lang").alias("__l"), F.col("phrase").alias("__p"), *(F.col(a).alias(b) for a, b in columns.items()), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    left = rows.withColumns({"__part": part, "__salt": F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")})
    on = (F.col("lang") == F.col("__l")) & (F.col("__part") == F.col("__p")) & (F.col("__salt") == F.col("__s"))
    return left.join(right.hint("merge"), on, how).drop("__l", "__p", "__s", "__part", "__salt")


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) over 38 digits."""
    d = lambda c, p: f"CAST({c} AS DECIMAL({p},0))"
    return F.expr(f"(({d(a, 15)} * {d(a, 15)}) * {d(1000000, 7)}) div ({d(l, 19)} * {d(r, 19)})").cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of two and three words of each language.

    Null texts are empty; null languages are ``und``. Repeated rows count each time. A language without candidates
    gives no row, an empty table an empty result. Other columns are ignored.
    """
    C.prepare(docs.sparkSession)
    chunks = C.stored(dictionary(docs, text, lang), "dictionary")
    words = C.stored(counts(chunks, 1), "words")
    often = words.where(F.col("f") >= least)
    pairs = C.stored(counts(chunks, 2, Sieve(often)).where(F.col("f") >= least).withColumnRenamed("f", "a"), "pairs")
    triples = C.stored(counts(chunks, 3, Sieve(pairs)).where(F.col("f") >= least).withColumnRenamed("f", "a"), "triples")
    C.drop_stored(chunks)
    side = lambda k: F.substring_index("phrase", " ", k)
    pairs = looked_up(looked_up(pairs, side(1), often, {"f": "l"}), side(-1), often, {"f": "r"})
    pairs = C.stored(pairs, "scored")
    inside = triples.select("lang", "a", F.explode(F.array(side(2), side(-2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    two = pairs.join(inside.hint("merge"), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most").withColumn("score", score("a", "l", "r"))
    three = looked_up(looked_up(triples, side(2), pairs, {"a": "l2", "l": "l1"}), side(-2), pairs, {"a": "r1", "r": "r2"})
    three = three.withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    pick = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    three = three.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    both = two.select(*three.columns).unionByName(three).withColumn("__b", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__b").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
