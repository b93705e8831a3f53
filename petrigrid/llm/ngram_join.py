"""N-gram Jaccard self-join by chosen paths.

Documents become sets of word 5-grams; documents with equal sets are one class. Each class keeps a sketch of
128 tokens (one-permutation minima, densified), so a pair of similarity s agrees in a token with odds s.
A run sends every class down a random tree: in each node it keeps its tokens with a small chance that
depends on the node and the token, and each kept token leads to a child. Pairs above the threshold keep
a common token in the mean, so they meet again and again while unrelated sets part. Buckets that are small
enough, or at the last depth, are compared all against all by their sketches, and small sets, whose sketches say
little, by their grams; a larger bucket's representative takes what lies close to it out of the way. Runs repeat until a pair at the threshold is missed with less than
the allowed odds (``runs_for``).

The pairs found join classes into candidate components. Inside those, and only there, the texts are read
again and every pair whose sizes allow a link is compared exactly, in blocks of bounded size; what leaves a block
is a count of links and a parent per class, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

GRAM, THRESHOLD = 5, 0.8
TOKENS = 128
#: Kept tokens per node of a pair at the threshold, in the mean; odds of missing such a pair; deepest level.
SHARED, MISS, DEPTH = 2.0, 1e-5, 5
#: Buckets of up to so many classes are compared; larger ones part again.
BUCKET = 256
#: Classes per side of an exact comparison.
BLOCK = 256
#: Standard errors by which a sketch may understate a similarity.
ERRORS = 5.0
#: Sets of up to so many grams carry 32 bits of each, which tell a pair's similarity but for the odds that two grams share them.
SMALL = 128
#: Share of a bucket near its representative from which all of it is one candidate group.
DENSE = 0.8

_SMALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def runs_for(threshold: float = THRESHOLD, depth: int = DEPTH, shared: float = SHARED, miss: float = MISS) -> int:
    """Runs after which a pair at the threshold that parts ``depth`` times is missed with odds of at most ``miss``."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-shared * p)
    return math.ceil(math.log(miss) / math.log(1 - p))


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-gram values of each text, flat, and their bounds. A text of fewer words is one gram, one without words none."""
    w = C.Words(data, offsets, C.PLAIN)
    n = len(w.count)
    g = C.grams(w.hash, k)
    doc = w.doc[: len(g)]
    inside = doc == w.doc[k - 1 :] if len(g) else np.zeros(0, bool)
    g, doc = g[inside], doc[inside]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.array([C.grams(w.hash[w.first[i] : w.first[i + 1]], int(w.count[i]))[0] + np.uint64(w.count[i]) for i in short], np.uint64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    order = np.argsort(g)
    order = order[np.argsort(doc[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    g, doc = g[order], doc[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[fresh], np.searchsorted(doc[fresh], np.arange(n + 1))


def sketches(grams: np.ndarray, bounds: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """One 32-bit token per bin and set: the bin's least gram, or that of another bin drawn alike for all sets."""
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    cell = of * tokens + (grams >> np.uint64(65 - tokens.bit_length())).astype(np.int64)  # tokens is a power of two; grams are sorted
    least = np.full(n * tokens, _SMALL)
    if len(cell):
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        least[cell[edge]] = grams[edge]
    least = least.reshape(n, tokens)
    full = least != _SMALL
    row, col = np.nonzero(~full & full.any(1)[:, None])
    turn = 0
    while len(row):  # only bins that are still empty are looked at: a set of one gram takes hundreds of turns
        turn += 1
        source = (C.mixed(np.arange(tokens, dtype=np.uint64) + np.uint64(turn * 1_000_003)) % np.uint64(tokens)).astype(np.int64)[col]
        hit = full[row, source]
        least[row[hit], col[hit]] = least[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return (C.mixed(least + np.arange(tokens, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def brief(sketch: np.ndarray) -> np.ndarray:
    """Tokens cut to 16 bits: enough to compare two sets and to part a bucket; different tokens seldom agree."""
    return (sketch & np.uint32(0xFFFF)).astype(np.uint16)


def _kept(path: np.ndarray, sketch: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths of the tokens that are kept in the rows' nodes."""
    t = sketch.shape[1]
    child = C.mixed(path[:, None] * np.uint64(0x9E3779B97F4A7C15) + C.mixed(sketch.astype(np.uint64) * np.uint64(t) + np.arange(t, dtype=np.uint64)))
    row, col = np.nonzero(C.mixed(child ^ np.uint64(0x5851F42D4C957F2D)) < np.uint64(rate * 2.0**64))
    return row, child[row, col]


def own_grams(g: np.ndarray, bounds: np.ndarray, small: int = SMALL) -> list[bytes | None]:
    """32 bits of each gram of a set of at most ``small``, ascending; null for larger sets and where two of them agree."""
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    n = np.diff(bounds)
    for i in np.flatnonzero((n > 0) & (n <= small)):
        own = np.unique((C.mixed(g[bounds[i] : bounds[i + 1]]) >> np.uint64(32)).astype(np.uint32))
        if len(own) == n[i]:
            out[i] = own.tobytes()
    return out


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of ``own_grams`` and their bounds; null is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint32), (offsets - offsets[0]) // 4


def _shared(left: tuple[np.ndarray, np.ndarray], a: np.ndarray, right: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets a with the right sets b (of ``_flat``, none empty)."""
    values, bounds = left
    there, ends = right
    own = (np.repeat(np.arange(len(ends) - 1), np.diff(ends)).astype(np.uint64) << np.uint64(32)) | there
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 4_000):
        i, j = a[lo : lo + 4_000], b[lo : lo + 4_000]
        n = bounds[i + 1] - bounds[i]
        want = (np.repeat(j, n).astype(np.uint64) << np.uint64(32)) | values[C.spread(bounds[i], n)]
        at = np.minimum(np.searchsorted(own, want), len(own) - 1)
        out[lo : lo + 4_000] = np.add.reduceat((own[at] == want).astype(np.int64), np.cumsum(n) - n)
    return out


def _error(n: np.ndarray, similarity: float) -> np.ndarray:
    """Standard error of a sketch similarity of sets of n grams: as many draws as bins that are filled."""
    filled = np.maximum(TOKENS * (1 - np.exp(-n / TOKENS)), 1)
    return np.sqrt(similarity * (1 - similarity) / filled)


def _matrix(col: pa.Array, kind: type = np.uint16, tokens: int = TOKENS) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, tokens)


def described(docs: DataFrame, doc_id: str, text: str, k: int, tag: str | None = None) -> DataFrame:
    """``doc_id, tag, s1, s2, n, sketch, brief, own`` per row: two values that name the set, its size, its tokens in full and cut (null for an empty set), its grams if they are few."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (F.lit(0) if tag is None else F.col(tag)).cast("long").alias("tag"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("tag", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("s1", "s2", "n")), *(T.StructField(c, T.BinaryType()) for c in ("sketch", "brief", "own"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1)):
                g, bounds = gram_sets(data, offsets, k)
                n = np.diff(bounds)
                s = _sums(g, bounds)
                sk = sketches(g, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *map(pa.array, s), pa.array(n), *(pa.array([x.tobytes() if c else None for x, c in zip(m, n, strict=True)], pa.binary()) for m in (sk, brief(sk))), pa.array(own_grams(g, bounds), pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _roots(df: DataFrame, rate: float, runs: int) -> DataFrame:
    """``path, id`` of the first level of all runs, from ``id, sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, sk = b.column(0).to_numpy(), _matrix(b.column(1), np.uint32)
                for r in range(runs):
                    row, child = _kept(np.full(len(ids), r + 1, np.uint64), sk, rate)
                    yield pa.RecordBatch.from_arrays([pa.array(C.signed(child)), pa.array(ids[row])], ["path", "id"])

    return df.select("id", "sketch").mapInArrow(run, "path long, id long")


def _deeper(df: DataFrame, rate: float) -> DataFrame:
    """``path, id`` one level down, from ``path, id, brief``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, child = _kept(b.column(0).to_numpy().view(np.uint64), _matrix(b.column(2)), rate)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(child)), pa.array(b.column(1).to_numpy()[row])], ["path", "id"])

    return df.select("path", "id", "brief").mapInArrow(run, "path long, id long")


def _similar(df: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` that join each bucket's similar classes, from ``key, id, n, brief, own`` sorted by key."""
    at = df.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.groups(batches, "key"):
            key, ids, n = (t.column(at(c)).to_numpy() for c in ("key", "id", "n"))
            sk, own = _matrix(t.column(at("brief"))), _flat(t.column(at("own")))
            few = np.diff(own[1]) > 0
            a, b = [], []
            for d in range(1, len(key)):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                small = np.minimum(n[i], n[i + d])
                ok = small >= threshold * np.maximum(n[i], n[i + d])
                i, small = i[ok], small[ok]
                alike = (sk[i] == sk[i + d]).mean(1)
                i = i[alike >= threshold - ERRORS * _error(small, threshold)]
                a.append(i)
                b.append(i + d)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            known = few[a] & few[b]
            x, y = a[known], b[known]
            both = _shared(own, x, own, y)
            ok = both >= threshold * (n[x] + n[y] - both) - 1e-9
            a, b = np.concatenate([a[~known], x[ok]]), np.concatenate([b[~known], y[ok]])
            root = C.roots(len(key), a, b)
            low = np.flatnonzero(root != np.arange(len(key)))
            if len(low):
                yield pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(ids[root[low]])], ["a", "b"])

    return df.mapInArrow(run, "a long, b long")


def blocked(df: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows of each group dealt to pairs of blocks of about ``block`` rows, each pair under one ``key``; ``side`` is the row's block, ``low`` the smaller of the two."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(17)), n).cast("int")
    out = df.withColumn("side", own).withColumn("__o", F.explode(F.sequence(F.lit(0), n - 1)))
    low, high = F.least("side", "__o"), F.greatest("side", "__o")
    return out.withColumn("low", low).withColumn("high", high).withColumn("key", F.xxhash64(group, "low", "high")).drop("__o")


def banded(df: DataFrame, threshold: float, block: int) -> DataFrame:
    """``df`` (``id, root, size, n, ...``) with each row's block ``side`` and the blocks that it ``meets``, of its group ``root``.

    A group of more than ``block`` rows is parted by the logarithm of n, so that sizes a link allows lie in one band or
    in neighbouring ones; bands are cut into blocks of about ``block`` rows. A block meets those of its band and of the next ones.
    """
    step = -math.log(min(threshold, 0.9))
    df = df.withColumn("band", F.when(F.col("size") > block, F.floor(F.log("n") / step)).otherwise(0).cast("int"))
    bands = C.stored(df.groupBy("root", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "bands")
    to = bands.select("root", F.explode(F.array(*(F.col("band") + x for x in (-1, 0, 1)))).alias("band"), F.col("band").alias("__b"), F.col("blocks").alias("__n"))
    to = to.groupBy("root", "band").agg(F.collect_list(F.struct("__b", "__n")).alias("__to")).join(bands, ["root", "band"])
    number = lambda band, piece: F.shiftleft(band, 20) + piece
    meets = F.flatten(F.transform("__to", lambda t: F.transform(F.sequence(F.lit(0), t["__n"] - 1), lambda piece: number(t["__b"], piece))))
    out = df.join(to, ["root", "band"]).withColumn("side", number(F.col("band"), F.pmod(F.xxhash64("id", F.lit(17)), F.col("blocks")).cast("int")))
    return out.withColumn("meets", meets).drop("band", "blocks", "__to")


def meeting(df: DataFrame) -> DataFrame:
    """Rows of ``banded`` dealt to pairs of blocks that meet, each pair under one ``key``; ``low`` is the smaller of the two."""
    out = df.withColumn("__o", F.explode("meets"))
    low, high = F.least("side", "__o"), F.greatest("side", "__o")
    return out.withColumn("low", low).withColumn("high", high).withColumn("key", F.xxhash64("root", "low", "high")).drop("__o")


def _beside(df: DataFrame, threshold: float) -> DataFrame:
    """``path, id, rep, near, core`` from ``path, id, n, brief, own, rep, rn, rs, ro``.

    ``core`` is so close to the bucket's representative that whatever is linked with it is ``near``: distances of
    at most 1 - threshold on either side add up.
    """
    at = df.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            each, of = b.column(at("n")).to_numpy(), b.column(at("rn")).to_numpy()
            n = np.minimum(each, of)
            alike = (_matrix(b.column(at("brief"))) == _matrix(b.column(at("rs")))).mean(1)
            far = max(0.0, 2 * threshold - 1)
            near = alike >= far - ERRORS * _error(n, far)
            core = alike >= threshold + 3 * _error(n, threshold)
            own, reps = _flat(b.column(at("own"))), _flat(b.column(at("ro")))
            k = np.flatnonzero((np.diff(own[1]) > 0) & (np.diff(reps[1]) > 0))
            both = _shared(own, k, reps, k)
            near[k], core[k] = (both >= s * (each[k] + of[k] - both) - 1e-9 for s in (far, threshold))
            most = np.maximum(each, of)
            near &= n >= far * most
            core &= n >= threshold * most
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in ("path", "id", "rep")), pa.array(near), pa.array(core)], ["path", "id", "rep", "near", "core"])

    return df.mapInArrow(run, "path long, id long, rep long, near boolean, core boolean")


def candidates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links ``a, b`` between classes (``id, n, sketch, brief, own``) that chosen paths bring together.

    Large buckets part again, but first their representative collects what is near it; classes at its core need
    no further look, and a bucket that is nearly all near it is one group.
    """
    rate = SHARED / (threshold * TOKENS)
    active = classes.select("id", "n", "brief", "own")
    level, found, links = _roots(classes, rate, runs_for(threshold)), None, None
    for depth in range(1, DEPTH + 1):
        level = C.stored(level, "paths")
        each = level.groupBy("path").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("m2"), F.min_by("id", F.xxhash64("id", "path")).alias("rep")).where("size > 1")
        # buckets of the same members need one look, in whichever run they are
        sizes = C.stored(each.groupBy("size", "m1", "m2").agg(F.min(F.struct("path", "rep")).alias("b")).select("b.path", "size", "b.rep"), "buckets")
        large = sizes.where(F.col("size") > BUCKET)
        last = depth == DEPTH
        ready = level.join((sizes if last else sizes.where(F.col("size") <= BUCKET)).drop("rep"), "path")
        found = ready if found is None else found.unionByName(ready)
        if last or not large.limit(1).count():
            break
        inside = C.stored(level.join(large, "path").select("path", "id", "rep"), "large")
        # only what is in a large bucket is looked at again
        active = C.stored(active.join(inside.select("id").distinct(), "id", "left_semi"), "active")
        reps = active.join(large.select("rep").distinct().withColumnRenamed("rep", "id"), "id", "left_semi").select(F.col("id").alias("rep"), F.col("n").alias("rn"), F.col("brief").alias("rs"), F.col("own").alias("ro"))
        beside = inside.join(active, "id").join(reps, "rep").select("path", "id", "n", "brief", "own", "rep", "rn", "rs", "ro")
        beside = C.stored(_beside(beside, threshold), "beside")
        dense = beside.groupBy("path").agg((F.avg(F.col("near").cast("int")) >= DENSE).alias("dense"))
        beside = beside.join(dense, "path")
        near = beside.where("(near or dense) and id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = near if links is None else links.unionByName(near)
        level = _deeper(beside.where("not dense and not core").join(active, "id").select("path", "id", "brief"), rate)
    dealt = blocked(found, "path", "size", BUCKET).join(classes.select("id", "n", "brief", "own"), "id").select("key", "id", "n", "brief", "own")
    small = _similar(dealt.repartition("key").sortWithinPartitions("key", "id"), threshold)
    return (small if links is None else small.unionByName(links)).distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    if m == 2:
        out = np.zeros((2, 2), np.int64)
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    again = times > 1  # what only one set holds is in no intersection
    of, at, values = of[again[at]], (np.cumsum(again) - 1)[at[again[at]]], values[again]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((m, m))
    step = max(1, 4_000_000 // m)
    for lo in range(0, len(values), step):
        i, j = np.searchsorted(at, [lo, lo + step])
        x = np.zeros((m, min(step, len(values) - lo)), np.float32)
        x[of[i:j], at[i:j] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _exact(df: DataFrame, threshold: float) -> DataFrame:
    """``id, links, parent`` per block pair and class, from ``key, id, mult, side, low, high, grams`` sorted by key."""
    at = df.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.groups(batches, "key"):
            key, ids, mult, side, low, high = (t.column(at(c)).to_numpy() for c in ("key", "id", "mult", "side", "low", "high"))
            raw = t.column(at("grams"))
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                # an id may hold several texts of one class: the first stands for it
                once = i + np.flatnonzero(np.concatenate([[True], ids[i + 1 : j] != ids[i : j - 1]]))
                if len(once) < 2:
                    continue
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw.take(pa.array(once))]
                n = np.array([len(s) for s in sets])
                both = _common(sets)
                ok = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
                np.fill_diagonal(ok, False)
                if low[i] != high[i]:
                    ok &= side[once, None] != side[None, once]
                links = ok @ mult[once]
                a, b = np.nonzero(ok)
                root = C.roots(len(once), a, b)
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[once][hit]), pa.array(links[hit]), pa.array(ids[once][root[hit]])], ["id", "links", "parent"])

    return df.mapInArrow(run, "id long, links long, parent long")


def join(docs: DataFrame, threshold: float = THRESHOLD, k: int = GRAM, doc_id: str = "doc_id", text: str = "text", tag: str | None = None) -> DataFrame:
    """``doc_id, class_id, n_links, copy_of, kept`` per row of ``docs``, and the number ``tag`` if a column is named.

    ``class_id`` is the smallest id reachable by links (similarity of the threshold or more), ``n_links`` the other
    rows linked directly, ``copy_of`` the smallest id with the same grams, ``kept`` whether the row stands for its
    class. Texts of fewer than k words are one gram; null and empty texts link with nothing and are kept.
    Repeated rows count one by one; of those of one id and text all are kept or none, while different texts of
    one id are judged apart. Rows with a null id link with nothing. Other columns of
    ``docs`` are ignored, so clashing names do no harm.
    """
    C.prepare(docs.sparkSession)
    rows = C.stored(described(docs, doc_id, text, k, tag), "sets")
    filled = rows.where("n > 0 and doc_id is not null")
    name = ["s1", "s2", "n"]
    sigs = filled.groupBy(*name).agg(F.min("doc_id").cast("long").alias("doc"), F.count("*").alias("mult"))
    sigs = C.stored(sigs.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbered once, when written
    first = filled.withColumnRenamed("doc_id", "doc").join(sigs, [*name, "doc"]).dropDuplicates(name)
    classes = C.stored(first.select("id", "doc", *name, "mult", "sketch", "brief", "own"), "sketches")
    member = C.stored(_members(classes, threshold), "components")
    sized = member.join(member.groupBy("root").agg(F.count("*").alias("size")), "root").join(classes.select("id", "doc", *name, "mult"), "id")
    part = _grams(_texts(docs, rows, doc_id, text).join(banded(sized, threshold, BLOCK), "doc"), k)
    dealt = meeting(part).select("key", "id", "mult", "side", "low", "high", "grams")
    links = C.stored(_exact(dealt.repartition("key").sortWithinPartitions("key", "id"), threshold), "links")
    linked = links.groupBy("id").agg(F.sum("links").alias("links"))
    trees = C.components(links, "id", "parent")
    trees = trees.union(trees.select(F.col("root").alias("id"), "root").distinct())
    docs_of = trees.join(sigs.select("id", "doc"), "id")
    least = docs_of.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = sigs.join(linked, "id", "left").join(docs_of.select("id", "root").join(least, "root"), "id", "left")
    named = named.select(*name, F.col("doc").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("class_id", "doc").alias("class_id"))
    own = [] if tag is None else ["tag"]
    out = rows.select("doc_id", "tag", *name).join(named, name, "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    pick = lambda c, other: F.when(alone, other).otherwise(F.col(c)).alias(c)
    out = out.select("doc_id", pick("class_id", F.col("doc_id")), pick("n_links", F.lit(0)).cast("long").alias("n_links"), pick("copy_of", F.col("doc_id")), "tag")
    return out.withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "class_id", "n_links", "copy_of", "kept", *own)


def _texts(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, text`` of the rows with an id; where ids repeat, each text of an id once."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null")
    again = C.stored(rows.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.count("*").alias("c")).where("c > 1").select("doc"), "repeated")
    if not again.limit(1).count():
        return texts
    return texts.join(again, "doc", "left_anti").unionByName(texts.join(again, "doc", "left_semi").distinct())


def _members(classes: DataFrame, threshold: float) -> DataFrame:
    """``id, root`` of all classes with a candidate."""
    found = C.components(candidates(classes, threshold), "a", "b")
    return found.union(found.select(F.col("root").alias("id"), "root").distinct())


def _sums(g: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two values that name each set."""
    out = []
    for seed in (0x1234567, 0x89ABCDEF):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mixed(g ^ np.uint64(seed)))])
        out.append(C.signed(total[bounds[1:]] - total[bounds[:-1]]))
    return out


def _grams(df: DataFrame, k: int) -> DataFrame:
    """``id, root, side, meets, mult, grams`` from rows of the class's id with their texts; only texts with the class's grams stay."""
    at = df.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(at("text"))):
                g, bounds = gram_sets(data, offsets, k)
                grams = pa.array([g[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                own = [b.column(at(c)).slice(i, j - i) for c in ("id", "root", "side", "meets", "mult")]
                want = [b.column(at(c)).slice(i, j - i).to_numpy() for c in ("s1", "s2", "n")]
                same = np.logical_and.reduce([x == y for x, y in zip([*_sums(g, bounds), np.diff(bounds)], want, strict=True)])
                yield pa.RecordBatch.from_arrays([*own, grams], ["id", "root", "side", "meets", "mult", "grams"]).filter(pa.array(same))

    return df.mapInArrow(run, "id long, root long, side int, meets array<int>, mult long, grams binary")
