"""A Merkle manifest of a table: one hash tree per language, one over their roots, and a proof for every row.

Rows become leaves in the order of their ids; range partitions and partition totals number them. Runs of 256
nodes are hashed eight levels up at a time, so a tree of n leaves takes log256(n) shuffles. The proofs come by
pointer jumping: every node holds its sibling as the segment towards its parent, and a self-join of the nodes
with the nodes they point at doubles the distance and appends the segments, until the leaves reach the root.
After the round for distance d only nodes on levels that 2d divides are pointed at or point on, so
the right side of the join shrinks by squares. From distance 8 on, many leaves share one ancestor: that side is
broadcast where its size is proven small, and copied over salts where it is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petrigrid.session import cut

from . import common as C

#: Columns of a leaf, in the order they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one group is hashed up at a time.
STEP = 8
#: Bytes that are broadcast at most.
SMALL = 32 << 20


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(columns: tuple[Column, ...]) -> Column:
    """Digest of the columns: ``-`` for a null, else UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return digest(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text))


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (with a tree key ``k``) and ``pos``: the place of each row in its tree, from 0, by ``by``.

    Only three figures of each range partition reach the driver. Rows alike in all of ``by`` may swap places.
    """
    order = ["k", *by, "__u"]
    ordered = cut(rows.withColumn("__u", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__part", F.spark_partition_id())
    sizes = ordered.groupBy("__part", "k").agg(F.count("*").alias("n"))
    ends = sizes.groupBy("__part").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max_by("n", "k").alias("n")).orderBy("__part").collect()
    before, open_k, open_n = {}, None, 0
    for p in ends:  # a tree that spans partitions goes on where the one before it stopped
        before[p["__part"]] = open_n if p["first"] == open_k else 0
        open_n = p["n"] + (before[p["__part"]] if p["first"] == p["last"] else 0)
        open_k = p["last"]
    out = T.StructType([*(f for f in ordered.schema.fields if f.name not in ("__u", "__part")), T.StructField("pos", T.LongType())])
    at, part = ordered.columns.index("k"), ordered.columns.index("__part")
    names = out.names
    kept = [i for i, c in enumerate(ordered.columns) if c not in ("__u", "__part")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(at)
            code = k.dictionary_encode().indices.to_numpy()
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            size = np.diff(np.append(start, len(code)))
            base = np.zeros(len(start), np.int64)
            if seen is None:
                base[0] = before[b.column(part)[0].as_py()]
            elif k[0].as_py() == key:
                base[0] = seen
            pos = np.repeat(base - start, size) + np.arange(len(code))
            key, seen = k[len(k) - 1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(pos)], names)

    return ordered.mapInArrow(run, out)


def attached(rows: DataFrame, small: DataFrame, on: list[str], bytes_: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``, which is broadcast if ``bytes_``, a bound of its size, allows that."""
    return rows.join(F.broadcast(small) if bytes_ <= SMALL else small, on, how)


def _paired(level: Column) -> Column:
    """The level above: digests of two neighbours each, of one where the last has none."""
    at = lambda i: F.coalesce(F.get(level, i), F.lit(""))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: digest(at(2 * i), at(2 * i + 1)))


class Trees:
    """Hash trees over ``k, pos, h`` rows. ``tops``: ``k, n, top`` of each tree; ``segments()``: ``k, pos, seg`` of the leaves.

    ``seg`` holds the sibling on each level up to the top as raw bytes, empty where a node has none; the node stands
    right of it where that bit of ``pos`` is set. A tree of one leaf has no segment row and its leaf as the top.
    """

    def __init__(self, leaves: DataFrame):
        spark = leaves.sparkSession
        self.sizes = C.stored(leaves.groupBy("k").agg((F.max("pos") + 1).alias("n")), "trees")
        seen = self.sizes.agg(F.count("*").alias("trees"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(1)).alias("most"), F.coalesce(F.sum(F.octet_length("k")), F.lit(0)).alias("key")).first()
        self.trees, self.rows, self.height, self.key = seen["trees"], seen["rows"], (seen["most"] - 1).bit_length(), seen["key"]
        self.layers = []
        nodes = leaves.select("k", "pos", "h")
        single = attached(nodes.where("pos = 0"), self.sizes.where("n = 1").select("k"), ["k"], self.bound(8), "left_semi")
        tops = [single.select("k", F.col("h").alias("top"))]
        for done in range(0, self.height, STEP):
            width = F.expr(f"shiftright(n + {(1 << done) - 1}L, {done})")  # nodes of the tree on this level
            open_ = self.sizes.select("k", width.alias("c")).where("c > 1")
            depth = F.least(F.lit(STEP), F.length(F.bin(F.col("c") - 1))).alias("depth")
            runs = attached(nodes, open_, ["k"], self.bound(16)).groupBy("k", "c", F.shiftright("pos", STEP).alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("a"))
            levels = F.aggregate(F.sequence(F.lit(1), F.col("depth")), F.array(F.col("a.h")), lambda acc, _: F.concat(acc, F.array(_paired(F.element_at(acc, -1)))))
            layer = C.stored(runs.select("*", depth).select("k", "c", "run", "depth", levels.alias("levels")), "layer")
            self.layers.append((done, layer))
            nodes = layer.select("k", F.col("run").alias("pos"), F.element_at("levels", -1)[0].alias("h"), "c")
            tops.append(nodes.where(F.col("c") <= 1 << STEP).select("k", F.col("h").alias("top")))
            nodes = nodes.drop("c")
        all_tops = tops[0]
        for t in tops[1:]:
            all_tops = all_tops.unionByName(t)
        self.tops = C.stored(attached(all_tops, self.sizes, ["k"], self.bound(16)), "tops")
        self.spark = spark

    def bound(self, width: int) -> int:
        """Bytes of a table of one row a tree at most."""
        return self.key + self.trees * (width + 64)

    def nodes(self) -> DataFrame:
        """``k, level, idx, seg``: every node below a top and its sibling."""
        out = None
        for done, layer in self.layers:
            sib = lambda a, i: F.coalesce(F.get(a, i.bitwiseXOR(1)), F.lit(""))
            rows = F.transform(F.slice("levels", F.lit(1), F.col("depth")), lambda a, lv: F.transform(a, lambda x, i: F.struct((lv + done).alias("level"), (F.call_function("shiftleft", F.col("run"), F.lit(STEP) - lv) + i).alias("idx"), F.array(F.unhex(sib(a, i))).alias("seg"))))  # noqa: B023
            part = layer.select("k", F.explode(F.flatten(rows)).alias("s")).select("k", "s.level", "s.idx", "s.seg")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "k string, level int, idx long, seg array<binary>")

    def segments(self) -> DataFrame:
        held = self.nodes()
        d = 1
        while d < self.height:
            left = held.where(F.col("level") % (2 * d) == 0)
            right = held.where(F.col("level") % (2 * d) == d).select("k", (F.col("level") - d).alias("level"), F.col("idx").alias("up"), F.col("seg").alias("more"))
            left = left.withColumn("up", F.shiftright("idx", d))
            on = ["k", "level", "up"]
            count = sum((self.rows >> v) + self.trees for v in range(d, self.height, 2 * d))
            small = count * (40 * d + 64) + self.key * len(range(d, self.height, 2 * d)) * (count // max(1, self.trees) + 1)
            if d >= STEP and small > SMALL:
                salts = 1 << min(d - 4, 12)
                left = left.withColumn("salt", F.col("idx") % salts)
                right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
                on = [*on, "salt"]
            elif d >= STEP:
                right = F.broadcast(right)
            held = C.stored(left.join(right, on, "left").select("k", "level", "idx", F.concat("seg", F.coalesce("more", F.array().cast("array<binary>"))).alias("seg")), "jump")
            d *= 2
        return held.where("level = 0").select("k", F.col("idx").alias("pos"), "seg")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(start: Column, pos: Column, seg: Column) -> Column:
    """The top that a leaf at ``pos`` leads to over its siblings."""
    steps = F.transform(seg, lambda s, i: F.struct(_hex(s).alias("s"), (F.call_function("shiftright", pos, i) % 2 == 1).alias("after")))
    return F.aggregate(steps, start, lambda acc, x: digest(F.when(x["after"], x["s"]).otherwise(F.lit("")), acc, F.when(x["after"], F.lit("")).otherwise(x["s"])))


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", by: str = "lang") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified`` of every row.

    ``proof`` lists the siblings (hex, empty where a level has none) from the leaf to the root. ``tampered`` is the
    leaf digest of a row as it is checked (default: the leaf itself); ``verified`` tells whether it leads to the root.
    Ids ascend with nulls first; rows of one id follow their leaf digests, repeated rows are leaves one by one. Null
    languages form the first tree; empty texts are values; an empty table gives an empty result. Other columns
    are ignored.
    """
    C.prepare(docs.sparkSession)
    digests = leaf(tuple(F.col(f"`{c}`") for c in columns))
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("k"), F.col(doc_id).alias("doc_id"), digests.alias("h"), (digests if tampered is None else tampered).alias("seen"))
    rows = rows.select("k", "doc_id", "h", F.when(F.col("seen") != F.col("h"), F.col("seen")).alias("seen"))
    leaves = C.stored(placed(C.stored(rows, "digests"), ["doc_id", "h"]), "leaves")
    below = Trees(leaves)
    subroots = C.stored(placed(below.tops.select(F.lit("").alias("k"), F.col("k").alias("tree"), F.col("top").alias("h")), ["tree"]), "subroots")
    above = Trees(subroots)
    root = above.tops.first()
    top = subroots.select("pos", F.col("tree").alias("k"), F.col("h").alias("subroot"))
    none = F.array().cast("array<binary>")
    top = top.join(above.segments().select("pos", F.col("seg").alias("top_seg")), "pos", "left").select("k", F.col("pos").alias("top_pos"), "subroot", F.coalesce("top_seg", none).alias("top_seg"))
    out = attached(leaves.join(below.segments(), ["k", "pos"], "left"), C.stored(top, "top"), ["k"], below.bound(160 + 48 * above.height))
    seg = F.coalesce("seg", none)
    first = folded(F.coalesce("seen", "h"), F.col("pos"), F.col("seg"))
    out = out.withColumn("seg", seg).select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root["top"] if root else None).cast("string").alias("root"), F.transform(F.concat("seg", "top_seg"), _hex).alias("proof"), first.alias("__first"), "top_pos", "top_seg")
    out = out.select("doc_id", "leaf", "subroot", "root", "proof", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"), folded(F.col("__first"), F.col("top_pos"), F.col("top_seg")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
