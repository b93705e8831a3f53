"""Benchmark decontamination with a distributed positional inverted index.

The scan turns every slice of documents into one index row: for each test term its sorted word positions
in the slice. The rows are written once; their list lengths add up to the corpus frequencies of the terms.
A phrase is then looked up slice by slice from its rarest term: that list, moved back by the term's offset,
gives the candidate starts, and the lists of the other terms, rarest first, thin them out. Slices need no
shuffle, and a frequent word costs no more than its own list.

Test items are dealt to the tasks in blocks of at most ``BLOCK_WORDS`` words; a larger test set takes
several blocks, whose hits are united per row: the rows are numbered in a written table first.
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

WINDOW = 10
BLOCK_WORDS = 1_000_000
_APART = 64  # positions between documents: more than any window or span reaches

_INDEX = "slice string, doc_id {id}, n_words array<int>, terms array<int>, ends array<int>, steps binary"


@dataclass
class Phrases:
    """Windows of test items as term numbers; ``vocabulary`` holds the sorted word values."""

    vocabulary: np.ndarray
    terms: np.ndarray  # windows x WINDOW, -1 beyond the end
    item: np.ndarray  # windows: position in ids
    ids: list[str | None]

    def by_rarity(self, frequency: np.ndarray) -> np.ndarray:
        """Offsets of each window's terms, rarest first; the padding comes last."""
        cost = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        return np.argsort(cost, axis=1, kind="stable")


def phrases(ids: list, texts: list[str | None], window: int = WINDOW) -> Phrases:
    """All windows of consecutive words of the items; a shorter item is one window, an item without words none."""
    data, offsets = C.buffers(pa.array(texts, pa.string()))
    w = C.Words(data, offsets, C.FOLDED, fold=True)
    vocabulary, term = np.unique(w.hash, return_inverse=True)
    rows, items = [], []
    for i, (lo, n) in enumerate(zip(w.first[:-1], w.count, strict=True)):
        for s in range(max(1, n - window + 1) if n else 0):
            part = term[lo + s : lo + min(s + window, n)]
            rows.append(np.pad(part, (0, window - len(part)), constant_values=-1))
            items.append(i)
    return Phrases(vocabulary, np.array(rows, np.int64).reshape(-1, window), np.array(items, np.int64), [None if x is None else str(x) for x in ids])


def index(docs: DataFrame, vocabulary: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of the vocabulary's terms, one row per slice of documents; null texts have no words."""
    C.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", T.ArrayType(key)), T.StructField("n_words", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("steps", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1)):
                w = C.Words(data, offsets, C.FOLDED, fold=True)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), max(0, len(vocabulary) - 1))
                hit = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
                term, pos = at[hit], hit + w.doc[hit] * _APART
                order = np.argsort(term, kind="stable")
                term, pos = term[order], pos[order]
                known, first = np.unique(term, return_index=True)
                steps = np.diff(pos, prepend=0)
                steps[first] = pos[first]
                one = lambda x, t: pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i)), one(w.count, pa.int32()), one(known, pa.int32()), one(np.append(first[1:], len(term)), pa.int32()), pa.array([steps.astype(np.uint32).tobytes()])],
                    ["doc_id", "n_words", "terms", "ends", "steps"],
                )

    return rows.mapInArrow(run, schema)


def frequencies(indexed: DataFrame, size: int) -> np.ndarray:
    """Corpus frequency of every term: one row per test term reaches the driver."""
    per = indexed.select(F.explode(F.transform("terms", lambda t, i: F.struct(t.alias("t"), (F.get("ends", i) - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("n")))).alias("p"))
    out = np.zeros(size, np.int64)
    for r in per.groupBy("p.t").agg(F.sum("p.n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out


class Postings:
    """One index row: sorted (term, position) keys."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, steps: bytes, n_words: np.ndarray):
        size = np.diff(ends, prepend=0)
        steps = np.frombuffer(steps, np.uint32).astype(np.int64)
        run = np.cumsum(steps)
        starts = ends - size
        self.pos = run - np.repeat(np.concatenate([[0], run])[starts], size) if len(steps) else run
        self.keys = (np.repeat(terms.astype(np.int64), size) << 32) | self.pos
        self.lo = np.zeros(0, np.int64)
        self.terms, self.starts, self.ends = terms, starts, ends
        self.first = np.concatenate([[0], np.cumsum(n_words)[:-1]]) + np.arange(len(n_words)) * _APART if len(n_words) else np.zeros(0, np.int64)

    def list_of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each term's list."""
        if not len(self.terms):
            return np.zeros(len(term), np.int64), np.zeros(len(term), np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        size = np.where(self.terms[at] == term, self.ends[at] - self.starts[at], 0)
        return self.starts[at].astype(np.int64), size.astype(np.int64)

    def has(self, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
        key = (term << 32) | np.maximum(pos, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (pos >= 0) & (self.keys[at] == key)

    def exact(self, p: Phrases, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and start positions of all phrase matches."""
        rows = np.arange(len(p.terms))
        lead = p.terms[rows, order[:, 0]] if len(rows) else rows
        start, size = self.list_of(lead)
        which = np.repeat(rows, size)
        at = self.pos[C.spread(start, size)] - order[which, 0]
        for k in range(1, p.terms.shape[1]):
            if not len(which):
                break
            off = order[which, k]
            term = p.terms[which, off]
            ok = (term < 0) | self.has(term, at + off)
            which, at = which[ok], at[ok]
        return which, at

    def near(self, p: Phrases, order: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and positions of their rarest terms where every other term occurs within ``span`` words in any order."""
        rows = np.arange(len(p.terms))
        start, size = self.list_of(p.terms[rows, order[:, 0]] if len(rows) else rows)
        which, at = np.repeat(rows, size), self.pos[C.spread(start, size)]
        for k in range(1, p.terms.shape[1]):
            if not len(which):
                break
            term = p.terms[which, order[which, k]]
            i = np.searchsorted(self.keys, (term << 32) | np.maximum(at - span, 0))
            found = self.keys[np.minimum(i, len(self.keys) - 1)]
            ok = (term < 0) | ((i < len(self.keys)) & (found >> 32 == term) & ((found & 0xFFFFFFFF) <= at + span))
            which, at = which[ok], at[ok]
        return which, at


def search(indexed: DataFrame, p: Phrases, span: int | None = None) -> DataFrame:
    """Per document: ``doc_id, n_words, hit`` (word positions inside matches), ``items`` (ids with a match) and ``near`` (ids with a proximity match)."""
    order = p.by_rarity(frequencies(indexed, len(p.vocabulary)))
    length = (p.terms >= 0).sum(1)
    ids = np.array(p.ids, object)
    key = indexed.schema["doc_id"].dataType.elementType
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", strings), T.StructField("near", strings)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                docs, n_words, terms, ends, steps = (b.column(i)[r] for i in range(5))
                n_words = n_words.values.to_numpy()
                post = Postings(terms.values.to_numpy(), ends.values.to_numpy().astype(np.int64), steps.as_py(), n_words)
                n = len(n_words)
                hit, items, near = ([None] * n for _ in range(3))

                def listed(which: np.ndarray, at: np.ndarray, into: list, post: Postings = post) -> np.ndarray:
                    doc = np.searchsorted(post.first, at, "right") - 1
                    for d in np.unique(doc):
                        into[d] = sorted({x for x in ids[p.item[which[doc == d]]] if x is not None})
                    return doc

                if len(post.keys) and len(p.terms):
                    which, at = post.exact(p, order)
                    doc = listed(which, at, items)
                    words = np.unique(C.spread(at, length[which]))
                    of = np.searchsorted(post.first, words, "right") - 1
                    for d in np.unique(doc):
                        hit[d] = (words[of == d] - post.first[d]).astype(np.int32)
                    if span is not None:
                        listed(*post.near(p, order, span), near)
                lists = lambda x, t: pa.array([y if y is not None else [] for y in x], pa.list_(t))
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(n_words.astype(np.int64)), lists(hit, pa.int32()), lists(items, pa.string()), lists(near, pa.string())], ["doc_id", "n_words", "hit", "items", "near"])

    return indexed.mapInArrow(run, schema)


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", words: int = BLOCK_WORDS) -> Iterator[tuple[list, list]]:
    """Ids and texts of the test items in blocks of about ``words`` words, each of a proven size."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = int(total // words) + 1
    for k in range(parts):
        got = items.where(F.pmod(F.xxhash64(F.col(item_id), F.col(text)), F.lit(parts)) == k).select(F.col(item_id).alias("i"), F.col(text).alias("t")).orderBy("i", "t").collect()
        yield [g["i"] for g in got], [g["t"] for g in got]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, hit, items, near`` per row of ``docs``.

    Null and empty texts have no words and no hits; an item of fewer words than a window is one window and an
    item without words none; items with a null id hit words but are not listed. Without items nothing is hit.
    Repeated rows and rows of one id or none are answered one by one, however many blocks the items take.
    Other columns of ``docs`` are ignored, so clashing names do no harm. With ``span``, ``near`` lists the items
    of which all words of a window occur within so many words of its rarest one, in any order.
    """
    parts = blocks(items)
    first = next(parts)
    second = next(parts, None)

    def found(rows: DataFrame, part: tuple[list, list], key: str) -> DataFrame:
        p = phrases(*part, window)
        return search(C.stored(index(rows, p.vocabulary, key, text), "postings"), p, span)

    if second is None:
        return found(docs, first, doc_id)
    number = F.struct(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id")).alias("__key")
    rows = C.stored(docs.select(number, F.col(text).cast("string").alias(text)), "numbered")
    both = found(rows, first, "__key").unionByName(found(rows, second, "__key"))
    for part in parts:
        both = both.unionByName(found(rows, part, "__key"))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    one = both.groupBy(F.col("doc_id.row").alias("row")).agg(F.first("doc_id").alias("key"), F.max("n_words").alias("n_words"), merged("hit"), merged("items"), merged("near"))
    return one.select(F.col("key.id").alias("doc_id"), "n_words", "hit", "items", "near")
