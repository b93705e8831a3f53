"""Personal data by bootstrapped contextual extraction.

Emails, IP addresses, payment cards and phone numbers found by their form are the seeds. Their contexts
(neighbouring words, whatever the identifier looks like) are lexical patterns; Spark holds patterns and
identifiers and scores both in turn: a pattern by the share of known identifiers among all places where it
stands, an identifier by its confident patterns and, apart from them, by its shape. What is accepted becomes
known, and the next round starts from more seeds, until nothing new is accepted. Identifiers known at the end
are reported wherever they occur.

An undecided identifier is a run of up to ``TOKENS`` words of any kind. Runs are too many to write down, so a
round reads the text again: once to count the places of the patterns that known identifiers support, and, if
some are confident, once for the runs beside them and once for the places of what is accepted. Tasks sift by a
table of hash slots, which lets nothing wanted fall; Spark joins the exact values afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Rounds after which a graph that still changes is an error.
ROUNDS, CONFIDENCE, SUPPORT, SCORE, PATTERNS = 100, 0.9, 3, 0.95, 2
#: Characters, at least, and words, at most, of an identifier that patterns may discover.
SHORT, TOKENS = 5, 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Places of patterns that a task collects before it counts them.
UNITED = 2_000_000

_EDGE = np.uint64(0x5851F42D4C957F2D)
_SIEVE_BITS = 22


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = (ord(c) - 48) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the @ outwards in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def shape(token: str) -> str:
    """Digits by number, letters by kind, other characters as they are."""
    out = re.sub(r"[0-9]+", lambda m: f"9{{{len(m.group())}}}", token)
    return re.sub(r"[^\W\d_](?:[^\W\d_])*", "a", out)


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return C.mixed(C.mixed(a + np.uint64(salt)) * np.uint64(3) + b)


class Places:
    """The words of some texts and the patterns around runs of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.w = w = C.Words(data, offsets, C.FOLDED, fold=True)
        self.raw, self.offsets = data, offsets
        h, doc, n = w.hash, w.doc, len(w.hash)

        def beside(k: int) -> np.ndarray:
            out = np.full(n, _EDGE, np.uint64)
            at = np.arange(max(0, -k), n - max(0, k))
            at = at[doc[at] == doc[at + k]] if len(at) else at
            out[at] = h[at + k]
            return out

        self.before, self.after = beside(-1), beside(1)
        #: Patterns of the words where a run opens and where it ends.
        self.opens = [C.mixed(self.before + np.uint64(1)), _pair(beside(-2), self.before, 2)]
        self.ends = [C.mixed(self.after + np.uint64(3)), _pair(self.after, beside(2), 4)]

    def around(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Pattern of both neighbours of the runs lo..hi (inclusive)."""
        return _pair(self.before[lo], self.after[hi], 5)

    def patterns(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Runs x five patterns."""
        return np.stack([*(x[lo] for x in self.opens), *(x[hi] for x in self.ends), self.around(lo, hi)], 1)

    def nearest(self, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose neighbours are a wanted pair; of the ends that an opening word has, the nearest."""
        lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left = np.arange(len(self.before))
        for k in range(TOKENS):
            left = left[left + k < len(self.before)]
            left = left[self.w.doc[left] == self.w.doc[left + k]] if len(left) else left
            hit = sifted(sieve, self.around(left, left + k))
            lo.append(left[hit])
            hi.append(left[hit] + k)
            left = left[~hit]
        return np.concatenate(lo), np.concatenate(hi)

    def value(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.w.ranges(self.w.start[lo], self.w.end[hi])

    def text(self, d: int) -> str:
        return self.raw[self.offsets[d] : self.offsets[d + 1]].tobytes().decode("utf-8", "replace")

    def bytes_of(self, d: int, text: str, points: list[int]) -> np.ndarray:
        """Positions in the buffer of code points of text d."""
        if len(text) == self.offsets[d + 1] - self.offsets[d]:
            return np.array(points, np.int64) + self.offsets[d]
        heads = np.flatnonzero((self.raw[self.offsets[d] : self.offsets[d + 1]] & 0xC0) != 0x80)
        return np.append(heads, self.offsets[d + 1] - self.offsets[d])[points] + self.offsets[d]

    def points_of(self, d: int, at: np.ndarray) -> np.ndarray:
        heads = np.cumsum((self.raw[self.offsets[d] : self.offsets[d + 1]] & 0xC0) != 0x80)
        return np.concatenate([[0], heads])[at - self.offsets[d]]

    def seeds(self, d: int, text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, first and last word of the spans of text d; the last is before the first where a span holds no word."""
        s, e = self.bytes_of(d, text, [x[1] for x in spans]), self.bytes_of(d, text, [x[2] for x in spans])
        return self.w.ranges(s, e), np.searchsorted(self.w.end, s, "right"), np.searchsorted(self.w.start, e, "left") - 1

    def free(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, dict[int, str]]:
        """Which runs are long enough and touch no base span; the texts of their documents."""
        size = self.w.end[hi] - self.w.start[lo]
        ok, texts = size >= SHORT, {}
        doc = self.w.doc[lo]
        for d in np.unique(doc[ok]).tolist():
            texts[d] = t = self.text(d)
            spans = base_spans(t)
            if spans:
                _, first, last = self.seeds(d, t, spans)
                mark = np.zeros(self.w.count[d] + 1, np.int64)
                np.add.at(mark, first - self.w.first[d], 1)
                np.add.at(mark, last + 1 - self.w.first[d], -1)
                taken = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
                mine = np.flatnonzero(doc == d)
                ok[mine] &= taken[hi[mine] + 1 - self.w.first[d]] == taken[lo[mine] - self.w.first[d]]
        return ok, texts

    def candidates(self, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs between or beside wanted patterns: from an opening to the nearest end, pairs of neighbours, and,
        where one side alone is wanted, the words with digits or the whole token there."""
        w, doc = self.w, self.w.doc
        n = len(doc)
        opens = np.flatnonzero(sifted(sieve, self.opens[0]) | sifted(sieve, self.opens[1]))
        ends = np.flatnonzero(sifted(sieve, self.ends[0]) | sifted(sieve, self.ends[1]))
        lo, hi = self.nearest(sieve)
        runs = set(zip(lo.tolist(), hi.tolist(), strict=True))
        if n:
            digit = np.concatenate([[0], np.cumsum((w.data >= 0x30) & (w.data <= 0x39))])
            digit = digit[w.end] > digit[w.start]
            white = np.concatenate([[0], np.cumsum(~C.PLAIN[w.data])])
            apart = white[w.start[1:]] > white[w.end[:-1]]  # white space before the next word
        for at, others, way in ((opens, ends, 1), (ends, opens, -1)):
            near = np.searchsorted(others, at, "left" if way > 0 else "right") - (way < 0)
            for i, k in zip(at.tolist(), near.tolist(), strict=True):
                if 0 <= k < len(others) and abs(others[k] - i) < TOKENS and doc[others[k]] == doc[i]:
                    runs.add((min(i, int(others[k])), max(i, int(others[k]))))
                    continue
                j, inner = i, False
                while 0 <= j + way < n and abs(j + way - i) < TOKENS and doc[j + way] == doc[i]:
                    if apart[min(j, j + way)]:
                        if not (digit[i] and digit[j + way]):
                            break
                    else:
                        inner = True
                    j += way
                if digit[i] or inner:
                    runs.add((min(i, j), max(i, j)))
        out = np.array(sorted(runs), np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]


def sieve_of(df: DataFrame, col: str) -> np.ndarray:
    """Packed table of the hash slots of a column."""
    bits = np.zeros(1 << _SIEVE_BITS, bool)
    slots = df.select(F.shiftrightunsigned(col, 64 - _SIEVE_BITS).alias("s")).distinct().toArrow().column("s").to_numpy()
    bits[slots] = True
    return np.packbits(bits)


def sifted(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sieve[(h >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)]


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "stop")])
_SEED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("form", T.LongType()), T.StructField("patterns", T.ArrayType(T.LongType()))])
_ARROW_SPAN = [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]
_ARROW_SEED = pa.struct([("kind", pa.int32()), ("value", pa.int64()), ("form", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _form(values: list[str]) -> np.ndarray:
    data, offsets = C.buffers(pa.array([shape(v) for v in values], pa.string()))
    return C.signed(C.Words(data, offsets, np.ones(256, bool)).ranges(offsets[:-1], offsets[1:]))


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    C.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("row"), "text")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, base, seeds`` per document; ``row`` tells texts of one id apart."""
    rows = rows_of(docs, doc_id, text)
    rows = rows.withColumn("text", F.when(F.col("text").rlike("[0-9@]"), F.col("text")))
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("base", T.ArrayType(_SPAN)), T.StructField("seeds", T.ArrayType(_SEED))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, found = [], []
            for i, j, data, offsets in C.slices(b.column(2)):
                spans = [base_spans(t) if t else [] for t in b.column(2).slice(i, j - i).to_pylist()]
                place = Places(data, offsets) if any(spans) else None
                for d, sp in enumerate(spans):
                    base.append([{"kind": k, "start": s, "stop": e} for k, s, e in sp])
                    if not sp:
                        found.append([])
                        continue
                    t = place.text(d)
                    value, lo, hi = place.seeds(d, t, sp)
                    # a span without words (-@-.-) stands at no word, which may even lie outside the slice: it is no seed
                    worded = lo <= hi
                    of = [x for x, w in zip(sp, worded.tolist(), strict=True) if w]
                    rows_ = zip(of, C.signed(value[worded]).tolist(), _form([t[s:e] for _, s, e in of]).tolist(), place.patterns(lo[worded], hi[worded]).view(np.int64).tolist(), strict=True)
                    found.append([{"kind": k, "value": v, "form": f, "patterns": p} for (k, _, _), v, f, p in rows_])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(pa.struct(_ARROW_SPAN))), pa.array(found, pa.list_(_ARROW_SEED))], ["doc_id", "row", "base", "seeds"])

    return rows.mapInArrow(run, schema)


def sites(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``pattern, n``: places of the wanted patterns (and of some others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(wanted).astype(bool)
        # counts are united within a task while they fit, so that frequent patterns are one row a task
        held, n_held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new, pending = [], 0

        def united() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([held, *new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n_held, np.ones(pending, np.int64)]), len(key))
            return key, n.astype(np.int64)

        row = lambda: pa.RecordBatch.from_arrays([pa.array(C.signed(held)), pa.array(n_held)], ["pattern", "n"])
        for b in batches:
            for _, _, data, offsets in C.slices(b.column(b.schema.get_field_index("text"))):
                place = Places(data, offsets)
                got = [x[sifted(sieve, x)] for x in (*place.opens, *place.ends)]
                got.append(place.around(*place.nearest(sieve)))
                new += got
                pending += sum(map(len, got))
                if pending >= UNITED:
                    held, n_held = united()
                    new, pending = [], 0
                    if len(held) >= UNITED:
                        yield row()
                        held, n_held = held[:0], n_held[:0]
        held, n_held = united()
        yield row()

    return rows.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _runs(rows: DataFrame, pick) -> DataFrame:
    """``doc_id, row, start, stop, value, form, patterns`` of the runs that ``pick`` takes from the words of some texts."""
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), *_SEED.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(2)):
                place = Places(data, offsets)
                lo, hi = pick(place)
                ok, texts = place.free(lo, hi)
                lo, hi = lo[ok], hi[ok]
                doc = place.w.doc[lo]
                order = np.argsort(doc, kind="stable")
                lo, hi, doc = lo[order], hi[order], doc[order]
                start, stop = np.zeros(len(lo), np.int32), np.zeros(len(lo), np.int32)
                for d in np.unique(doc).tolist():
                    start[doc == d], stop[doc == d] = place.points_of(d, place.w.start[lo[doc == d]]), place.points_of(d, place.w.end[hi[doc == d]])
                form = _form([texts[d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True)])
                pats = pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1, dtype=np.int32) * 5), pa.array(place.patterns(lo, hi).view(np.int64).ravel()))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(at), b.column(1).slice(i, j - i).take(at), pa.array(start), pa.array(stop), pa.array(C.signed(place.value(lo, hi))), pa.array(form), pats], schema.names)

    return rows.mapInArrow(run, schema)


def candidates(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    return _runs(rows, lambda place: place.candidates(np.unpackbits(wanted).astype(bool)))


def occurrences(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """All runs that are accepted values, outside base spans, with ``kind``."""
    wanted = sieve_of(accepted, "value")

    def pick(place: Places) -> tuple[np.ndarray, np.ndarray]:
        sieve = np.unpackbits(wanted).astype(bool)
        at = np.arange(len(place.w.doc))
        lo, hi = [at[:0]], [at[:0]]
        for k in range(TOKENS):
            left = at[: max(0, len(at) - k)]
            left = left[place.w.doc[left] == place.w.doc[left + k]]
            left = left[sifted(sieve, place.value(left, left + k))]
            lo.append(left)
            hi.append(left + k)
        return np.concatenate(lo), np.concatenate(hi)

    return _runs(rows, pick).join(accepted, "value")


def bootstrap(found: DataFrame, rows: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, score: float = SCORE, patterns: int = PATTERNS) -> DataFrame | None:
    """Places of the identifiers beyond the seeds: ``doc_id, row, start, stop, kind`` and more; None if there are none.

    A pattern counts for a kind if at least ``support`` known identifiers of the kind stand in it and they hold
    ``confidence`` of all its places; a shape counts if it has as many known values and that share of all values
    that the round looks at. An identifier is accepted with at least ``patterns`` of these, one of them a context,
    and 1 - product(1 - confidence) of ``score`` or more; ties between kinds go to the first listed. Raises if
    identifiers are still found after ``rounds``.
    """
    seeds = C.stored(found.select(F.explode("seeds").alias("m")).select("m.*"), "seeds")
    accepted = places = None
    for _ in range(rounds):
        known = seeds if places is None else seeds.unionByName(places.select(*seeds.columns))
        per = known.select("kind", "value", F.explode("patterns").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.count("*").alias("k"))
        per = C.stored(per.groupBy("pattern", "kind").agg(F.count("*").alias("c"), F.sum("k").alias("k")).where(F.col("c") >= support), "supported")
        counted = per.join(sites(rows, sieve_of(per, "pattern")), "pattern").withColumn("p", F.least(F.lit(1.0), F.col("k") / F.col("n")))
        sure = C.stored(counted.where(F.col("p") >= confidence).select("pattern", "kind", "p"), "sure")
        if sure.isEmpty():
            return places
        seen = C.stored(candidates(rows, sieve_of(sure, "pattern")).select("value", "form", "patterns"), "candidates")
        values = known.select("value", "form", "kind").unionByName(seen.select("value", "form", F.lit(None).cast("int").alias("kind")))
        values = values.groupBy("value", "form").agg(F.min("kind").alias("kind"))
        forms = values.groupBy("form").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"k{k}") for k in range(len(KINDS))))
        forms = forms.select("form", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("c")) for k in range(len(KINDS))))).alias("s"))
        forms = forms.select("form", F.col("s.kind").alias("kind"), F.col("s.c").alias("c"), (F.col("s.c") / F.col("n")).alias("p")).where((F.col("c") >= support) & (F.col("p") >= confidence)).select("form", "kind", "p")
        context = seen.select("value", F.explode("patterns").alias("pattern")).distinct().join(sure, "pattern").select("value", "kind", "p", F.lit(1).alias("context"))
        shaped = seen.select("value", "form").distinct().join(forms, "form").select("value", "kind", "p", F.lit(0).alias("context"))
        scored = context.unionByName(shaped).groupBy("value", "kind").agg(F.count("*").alias("n"), F.max("context").alias("context"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-3)))))).alias("score")).where((F.col("context") == 1) & (F.col("n") >= patterns) & (F.col("score") >= score))
        got = scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("value", (-F.col("b.k")).cast("int").alias("kind"))
        if accepted is not None:
            got = got.join(accepted, "value", "left_anti")
        got = C.stored(got, "new")
        if got.isEmpty():
            return places
        accepted = got if accepted is None else C.stored(accepted.unionByName(got), "accepted")
        more = C.stored(occurrences(rows, got), "places")
        places = more if places is None else places.unionByName(more)
    raise RuntimeError(f"identifiers are still found after {rounds} rounds")


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans`` per row of ``docs``: arrays of (kind, start, stop), by kind as listed, then start.

    Null and empty texts have no spans. Repeated rows are answered one by one. Other columns of ``docs`` are
    ignored, so clashing names do no harm.
    """
    found = C.stored(scan(docs, doc_id, text), "mentions")
    places = bootstrap(found, rows_of(docs, doc_id, text))
    if places is None:
        return found.select("doc_id", "base", F.array_sort("base").alias("spans"))
    more = places.select("doc_id", "row", "kind", "start", "stop").distinct().groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more"))
    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,stop:int>>"))))
    return found.join(more, key, "left").select("doc_id", "base", spans.alias("spans"))
