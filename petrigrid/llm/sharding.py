"""Contiguous shards of near equal bytes from global prefix sums.

Documents are range-sorted by (hash of the text, id), so equal texts are neighbours and a hot text spreads
over as many partitions as it needs. One pass adds up each sorted partition; the prefix sums of those
totals place every partition in the global byte order; a second pass runs the sums inside the partitions.
The order is cut at equal targets. Where a target falls inside a small group of equal texts the cut moves
to the group's nearer end; in a larger group it stays at the nearer document.

Only partition totals, the cut rows (one per shard) and their groups reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petrigrid.session import cut

from . import common as C

SHARDS = 24
#: Bytes added to each document's UTF-8 text.
OVERHEAD = 8
#: A group of equal texts stays whole up to this share of a shard's target.
WHOLE = 0.02


def shards(docs: DataFrame, n: int = SHARDS, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), whole: float = WHOLE) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the carried columns.

    Null texts have size ``OVERHEAD`` and checksum 0. Repeated rows are placed one by one; rows alike in
    id and text may swap slots. An empty table gives an empty result. Columns of ``docs`` that are neither
    named nor carried are ignored, so clashing names do no harm; carried columns must not be result columns.
    """
    spark = C.prepare(docs.sparkSession)
    raw = F.coalesce(F.col(text), F.lit(""))
    carried = [c for c in carry if c != doc_id]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in carried)).alias("__carried"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("__h"),
    )
    ordered = cut(rows.repartitionByRange("__h", "doc_id").sortWithinPartitions("__h", "doc_id"))
    ordered = ordered.withColumn("__part", F.spark_partition_id())
    totals = ordered.groupBy("__part").agg(F.sum("size").alias("b"), F.count("*").alias("r")).orderBy("__part").collect()
    total = sum(t["b"] for t in totals)
    before, b, r = {}, 0, 0
    for t in totals:
        before[t["__part"]] = (b, r)
        b, r = b + t["b"], r + t["r"]

    out = T.StructType([*ordered.drop("__part").schema.fields, T.StructField("__start", T.LongType()), T.StructField("__row", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = r = None
        for x in batches:
            if not x.num_rows:
                continue
            if b is None:
                b, r = before[x.column(x.schema.get_field_index("__part"))[0].as_py()]
            size = x.column(x.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
            ends = b + np.cumsum(size)
            cols = [x.column(i) for i, f in enumerate(x.schema) if f.name != "__part"]
            names = [f.name for f in x.schema if f.name != "__part"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ends - size), pa.array(r + np.arange(len(size)))], [*names, "__start", "__row"])
            b, r = int(ends[-1]), r + len(size)

    placed = ordered.mapInArrow(run, out)
    cuts, first = [], [0]
    if total:
        end = F.col("__start") + F.col("size")
        crossing = placed.where(F.expr(f"(__start * {n}L) div {total}L < ((__start + size) * {n}L) div {total}L")).select("__h", "__start", end.alias("e")).collect()
        crossing = sorted((x for x in crossing), key=lambda x: x["__start"])
        groups = {x["__h"]: (x["s"], x["e"]) for x in placed.where(F.col("__h").isin([x["__h"] for x in crossing])).groupBy("__h").agg(F.min("__start").alias("s"), F.max(end).alias("e")).collect()}
        for k in range(1, n):
            at = next(x for x in crossing if x["__start"] * n < k * total <= x["e"] * n)
            lo, hi = groups[at["__h"]]
            if hi - lo > whole * total / n:
                lo, hi = at["__start"], at["e"]
            cuts.append(lo if k * total - lo * n <= hi * n - k * total else hi)
        cuts = np.maximum.accumulate(cuts).tolist() if cuts else []
        if cuts:
            first += [int(v or 0) for v in placed.select(*(F.sum((F.col("__start") < c).cast("long")).alias(f"c{i}") for i, c in enumerate(cuts))).first()]
    spark_cuts = F.array(*(F.lit(int(c)).cast("long") for c in cuts)) if cuts else F.array().cast("array<long>")
    shard = F.size(F.filter(spark_cuts, lambda c: c <= F.col("__start")))
    starts = F.array(*(F.lit(f).cast("long") for f in first))
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", *(F.col("__carried").getField(c).alias(c) for c in carried), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__row") - F.element_at(starts, F.col("shard") + 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
