"""Ranks and running totals that stay distributed inside one hot key.

``row_number() over (partition by key)`` sends a whole key to one task. Here
rows first fall into chunks that follow the order (ranges of the order
column), so a window never holds more than one chunk. The chunk sizes, a small
map-side-combined aggregate, give each chunk its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WIDTH = 1 << 20  # rows per chunk for a unique integer order column


def _offsets(df: DataFrame, keys: list[str], amount: Column, desc: bool) -> DataFrame:
    """Per chunk, the total of all chunks before it; key columns renamed ``_k0..``."""
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_chunk").alias("_kc")).agg(amount.alias("_n"))
    order = F.col("_kc").desc() if desc else F.col("_kc").asc()
    w = W.partitionBy(*names) if names else W.partitionBy(F.lit(1))
    before = w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(*names, "_kc", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def _shifted(local: DataFrame, off: DataFrame, keys: list[str], columns: list[str], value: Column, out: str) -> DataFrame:
    # null-safe on the keys; both sides are already hashed on (keys, chunk)
    on = F.col("_chunk").eqNullSafe(F.col("_kc"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(off, on).select(*columns, value.alias(out))


def ordered_rank(
    df: DataFrame,
    keys: list[str],
    order: str,
    out: str = "rank",
    *,
    desc: bool = False,
    ties: list[Column] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """1-based position per key by ``order``; equals ``row_number()``.

    ``chunk`` must be a non-decreasing function of ``order`` (default: ranges of an
    integer column).
    """
    c = chunk if chunk is not None else F.floor(F.col(order) / WIDTH)
    tagged = df.withColumn("_chunk", c)
    off = _offsets(tagged, keys, F.count(F.lit(1)), desc)
    by = [F.col(order).desc() if desc else F.col(order).asc(), *(ties or [])]
    local = tagged.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*by)))
    return _shifted(local, off, keys, df.columns, (F.col("_rn") + F.col("_before")).cast("bigint"), out)


def running_total(df: DataFrame, keys: list[str], order: str, amount: str, chunk: Column, out: str = "total") -> DataFrame:
    """Inclusive running sum of ``amount`` per key in ``order`` (unique per key)."""
    tagged = df.withColumn("_chunk", chunk)
    off = _offsets(tagged, keys, F.sum(amount), False)
    w = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = tagged.withColumn("_run", F.sum(amount).over(w))
    return _shifted(local, off, keys, df.columns, F.col("_run") + F.col("_before"), out)
