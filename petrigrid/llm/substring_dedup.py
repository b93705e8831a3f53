"""Repeated passages, found with compressed FM-indexes.

Windows of 35 words are dealt to shards by their minimiser: the least value of the word 6-grams in them.
Neighbouring windows share it, so a document is a chain of segments (one minimiser each) that overlap by 34
words, and equal windows meet in one shard. Segments whose minimiser occurs nowhere else cannot hold a
repeated window and stay behind; equal segments become one with a weight.

A shard is an FM-index over the words of its distinct segments: the Burrows-Wheeler transform of their
concatenation in a wavelet matrix of packed bits with rank counters. Segments are streamed against it by
backward search. The longest match to the left of a position that occurs twice (by weight) is its matching
statistic; where it reaches 35 words, the interval is reported, mapped to all documents that hold the segment,
and its words go. A minimiser with very many different segments is dealt anew, window by window, by the
window itself, so no shard grows with it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, GRAM = 35, 6
#: Words of one index; shards are cut between minimisers.
SHARD_WORDS = 500_000
#: Different segments of one minimiser beyond which its windows are dealt one by one.
CROWDED = 2_000
#: Copies of a repeated window that the segments holding it are looked up in.
SALTS = 32
#: Windows per stream, and longest match that is followed before the search starts anew.
STREAM, REACH = 32, 63

_STEP = 0xA24BAED4963EE407 | 1


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def spans(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit values of runs of words."""
    up, down = _powers(1 << max(18, int(len(h)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return C.mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))


def segments(w: C.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and minimiser of each run of windows with one minimiser, and whether that may occur in it more than once."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    least = C.grams(w.hash, gram)
    ordered = np.sort(least)
    twice = np.append(np.unique(ordered[1:][ordered[1:] == ordered[:-1]]), np.uint64(0))
    width, need = 1, window - gram + 1
    while 2 * width <= need:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (need - width)], least[need - width :])[:n]
    inside = w.doc[:n] == w.doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(at)))
    mk = least[at[first]]
    return at[first], runs + window - 1, mk, twice[np.minimum(np.searchsorted(twice[:-1], mk), len(twice) - 1)] == mk


class Index:
    """FM-index over word numbers 1.. with 0 between segments; ``weight`` counts what each position stands for."""

    def __init__(self, words: np.ndarray, weight: np.ndarray, depth: int = REACH):
        self.words, n = words, len(words)
        rank, reach = words.astype(np.int64), 1
        while reach <= depth:  # order by the first 2, 4, 8, ... words
            after = np.concatenate([rank[reach:], np.zeros(min(reach, n), np.int64)])[:n]
            known, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            reach *= 2
            if len(known) == n:
                break
        order = np.argsort(rank, kind="stable")
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        symbols = int(words.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=symbols))])[:-1]
        seq = words[order - 1]  # the word before each suffix; order 0 wraps to the closing 0
        self.bits, self.counts, self.zeros = [], [], []
        self.levels = max(1, (symbols - 1).bit_length())
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1])
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.origin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros, strict=True)):
            block = at >> 6
            ones = counts[block] + np.bitwise_count(bits[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((word >> (self.levels - 1 - i)) & 1, zeros + ones, at - ones)
        return at

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one more word to the left."""
        both = self._down(np.concatenate([word, word]), np.concatenate([lo, hi]))
        base = self.before[word] - self.origin[word]
        return base + both[: len(word)], base + both[len(word) :]

    def repeated(self, start: np.ndarray, size: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (segment, from, to) that occur twice or more and have ``window`` words at least; together they hold every such window of the segments ``start``, ``size``."""
        windows = size - window + 1
        pieces = -(-windows // STREAM)
        seg = np.repeat(np.arange(len(start)), pieces)
        first = C.spread(np.zeros(len(start), np.int64), pieces) * STREAM
        end = np.minimum(first + STREAM, windows[seg]) + window - 1
        base, n = start[seg], len(self.words)
        s, lo, hi = end.copy(), np.zeros(len(seg), np.int64), np.full(len(seg), n)
        live = np.arange(len(seg))
        out = []
        while len(live):
            word = self.words[base[live] + s[live] - 1]
            a, b = self.extend(word, lo[live], hi[live])
            ok = (self.weight[b] - self.weight[a] >= 2) & (end[live] - s[live] < REACH)
            on = live[ok]
            s[on] -= 1
            lo[on], hi[on] = a[ok], b[ok]
            stop = np.concatenate([live[~ok], on[s[on] == first[on]]])  # no longer match, or the stream's first window is reached
            if len(stop):
                long_ = end[stop] - s[stop] >= window
                hit = stop[long_]
                out.append(np.stack([seg[hit], s[hit], end[hit]]))
                end[stop] = np.where(long_, s[stop] + window - 1, end[stop] - 1)
                s[stop], lo[stop], hi[stop] = end[stop], 0, n
                done = np.zeros(len(seg), bool)
                done[stop] = end[stop] < first[stop] + window
                live = live[~done[live]]
        got = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
        return got[0], got[1], got[2]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw).alias("row"), raw.alias("text"))


def _segmented(rows: DataFrame, window: int) -> DataFrame:
    """``mk, sh, n, doc_id, row, start, inner`` per segment."""
    schema = T.StructType([T.StructField("mk", T.LongType()), T.StructField("sh", T.LongType()), T.StructField("n", T.IntegerType()), rows.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("inner", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, offsets in C.slices(b.column(2)):
                w = C.Words(data, offsets, C.PLAIN)
                start, size, mk, inner = segments(w, window)
                if not len(start):
                    continue
                doc = w.doc[start]
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(mk)), pa.array(C.signed(spans(w.hash, start, size))), pa.array(size.astype(np.int32)), b.column(0).take(take), b.column(1).take(take), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(inner)], schema.names)

    return rows.mapInArrow(run, schema)


def _fetched(df: DataFrame) -> DataFrame:
    """``route, mk, sh, n, weight, words`` from rows with the text and the ``wanted`` segments of the document."""
    names = ["route", "mk", "sh", "n", "weight", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(0)):
                w = C.Words(data, offsets, C.PLAIN)
                wanted = b.column(1).slice(i, j - i)
                flat = wanted.flatten()
                start, n, mk, sh, weight = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "mk", "sh", "weight"))
                at = start + w.first[np.repeat(np.arange(j - i), wanted.value_lengths().to_numpy())]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (mk, mk, sh, n, weight)), _cut(w, at, n)], names)

    return df.mapInArrow(run, "route long, mk long, sh long, n int, weight long, words binary")


def _cut(w: C.Words, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of words, joined by one space."""
    text, _ = w.joined()
    ends = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
    raw = text.tobytes()
    return pa.array([raw[x:y] for x, y in np.stack([ends[first], ends[first + size] - 1], 1).tolist()], pa.binary())


def _windows(df: DataFrame, window: int, words: bool) -> DataFrame:
    """Every window of the ``wanted`` segments: its two values ``w1, w2`` with ``weight`` and ``words``, or with ``mk, sh, n, off``."""
    fields = ["start", "n", "mk", "sh", "weight"]
    names = ["w1", "w2", *(["weight", "words"] if words else ["mk", "sh", "n", "off"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(0)):
                w = C.Words(data, offsets, C.PLAIN)
                wanted = b.column(1).slice(i, j - i)
                flat = wanted.flatten()
                start, n, mk, sh, weight = (flat.field(f).to_numpy(zero_copy_only=False) for f in fields)
                at = start + w.first[np.repeat(np.arange(j - i), wanted.value_lengths().to_numpy())]
                which = np.repeat(np.arange(len(n)), n - window + 1)
                off = C.spread(np.zeros(len(n), np.int64), n - window + 1)
                first, size = at[which] + off, np.full(len(which), window)
                own = [pa.array(C.signed(spans(h, first, size))) for h in (w.hash, C.mixed(w.hash ^ np.uint64(_STEP)))]
                own += [pa.array(weight[which]), _cut(w, first, size)] if words else [pa.array(x[which]) for x in (mk, sh, n)] + [pa.array(off.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(own, names)

    return df.mapInArrow(run, "w1 long, w2 long, " + ("weight long, words binary" if words else "mk long, sh long, n int, off int"))


def _matched(df: DataFrame, window: int) -> DataFrame:
    """``mk, sh, n, lo, hi``: repeated intervals of the segments, shard by shard, from rows sorted by route."""
    at = df.columns.index

    def search(t: pa.Table) -> pa.RecordBatch:
        data, offsets = C.buffers(t.column(at("words")).cast(pa.string()))
        w = C.Words(data, offsets, C.PLAIN)
        m = t.num_rows
        _, number = np.unique(w.hash, return_inverse=True)
        words = np.zeros(len(number) + m, np.int64)
        words[np.arange(len(number)) + w.doc] = number + 1
        weight = np.repeat(t.column(at("weight")).to_numpy(), w.count + 1)
        seg, lo, hi = Index(words, weight).repeated(w.first[:-1] + np.arange(m), w.count, window)
        return pa.RecordBatch.from_arrays([*(t.column(at(c)).combine_chunks().take(pa.array(seg)) for c in ("mk", "sh", "n")), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["mk", "sh", "n", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in C.groups(batches, "route"):
            held.append(t)
            size += int(t.column(at("n")).to_numpy().sum())
            if size >= SHARD_WORDS:
                yield search(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield search(pa.concat_tables(held))

    return df.mapInArrow(run, "mk long, sh long, n int, lo int, hi int")


def _cleaned(df: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` and its checksum from rows with the text and the repeated intervals."""
    key = df.schema["doc_id"]
    schema = T.StructType([key, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1)):
                w = C.Words(data, offsets, C.PLAIN)
                keep = kept_words(w, b.column(2).slice(i, j - i))
                text, cut = w.joined(keep)
                raw = memoryview(text.tobytes())
                kept = np.bincount(w.doc[keep], minlength=j - i) if len(keep) else np.zeros(j - i, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(w.count), pa.array(w.count - kept), pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in cut.tolist()], pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def kept_words(w: C.Words, found: pa.Array) -> np.ndarray:
    """Mask of the words outside the intervals ``found`` (a list of lo, hi per text, or null)."""
    flat = found.flatten()
    doc = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
    change = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(change, w.first[doc] + flat.field("lo").to_numpy(zero_copy_only=False), 1)
    np.add.at(change, w.first[doc] + flat.field("hi").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(change)[:-1] == 0


def repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """``doc_id, row, found``: the repeated intervals (lo, hi in words) of each document that has any; ``row`` tells texts of one id apart."""
    C.prepare(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    segs = C.stored(_segmented(rows, window), "segments")
    again = segs.groupBy("mk").agg(F.count("*").alias("all"), F.max("inner").alias("inner")).where("all > 1 or inner").select("mk")
    cand = C.stored(segs.drop("inner").join(again, "mk"), "candidates")
    C.drop_stored(segs)
    each = cand.groupBy("mk", "sh", "n").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "row", "start")).alias("at"))
    each = C.stored(each, "distinct-segments")
    crowd = each.groupBy("mk").agg((F.count("*") > crowded).alias("crowded"))
    wanted = each.join(crowd, "mk").groupBy(F.col("at.doc_id").alias("__id"), F.col("at.row").alias("__row")).agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "n", "mk", "sh", "weight", "crowded")).alias("wanted"))
    texts = rows.dropDuplicates(["doc_id", "row"]) if _doubled(rows) else rows
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))).select("text", "wanted")
    some = lambda yes: held.withColumn("wanted", F.filter("wanted", lambda x: x["crowded"] == F.lit(yes))).where(F.size("wanted") > 0)
    found = _settled(_fetched(some(False)), window)
    if crowd.where("crowded").limit(1).count():
        found = found.unionByName(_crowded(some(True), window))
    hits = cand.join(found, ["mk", "sh", "n"]).select("doc_id", "row", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return hits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))


def _settled(shards: DataFrame, window: int) -> DataFrame:
    return C.stored(_matched(shards.repartition("route").sortWithinPartitions("route"), window), "intervals").distinct()


def _crowded(held: DataFrame, window: int) -> DataFrame:
    """The repeated windows of segments whose minimiser has too many: equal windows are added up before they meet in an index.

    One row a window goes on, with the text of one of them, so a passage is no more work for a shard however many
    documents hold it; the windows found are then looked up in the segments that hold them.
    """
    each = _windows(held, window, True).groupBy("w1", "w2").agg(F.sum("weight").alias("weight"), F.min("words").alias("words"))
    shards = each.select(F.col("w1").alias("route"), F.col("w1").alias("mk"), F.col("w2").alias("sh"), F.lit(window).cast("int").alias("n"), "weight", "words")
    found = _settled(shards, window).select(F.col("mk").alias("w1"), F.col("sh").alias("w2")).distinct()
    # many segments hold one window: copies of its row share them
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    where = _windows(held, window, False).withColumn("salt", F.pmod("sh", F.lit(SALTS)).cast("int"))
    # its file is far smaller than its rows: never broadcast
    return C.stored(where.join(found.hint("merge"), ["w1", "w2", "salt"]).select("mk", "sh", "n", F.col("off").alias("lo"), (F.col("off") + window).alias("hi")), "crowded")


def _doubled(rows: DataFrame) -> bool:
    """Whether any id occurs twice with one text."""
    return bool(rows.groupBy("doc_id", "row").count().where("count > 1").limit(1).count())


def dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row of ``docs``.

    Null texts have no words. A text shorter than the window keeps all. Repeated rows repeat each other and lose
    every window. Other columns of ``docs`` are ignored, so clashing names do no harm.
    """
    found = repeats(docs, window, doc_id, text)
    found = found.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "found")
    rows = _rows(docs, doc_id, text)
    return _cleaned(rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left").select("doc_id", "text", "found"))
