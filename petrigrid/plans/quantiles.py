"""Exact quantiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a mergeable sketch first brackets each wanted rank; equal values and
everything outside the brackets collapse map-side, and only the few values
inside a bracket are ordered. The result is the exact linear quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (linear interpolation)."""
    names = list(probs)
    eps = 2.0 / ACCURACY
    wanted: list[float] = []
    for n in names:
        wanted += [max(0.0, probs[n] - eps), min(1.0, probs[n] + eps)]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(p) for p in wanted]), F.lit(ACCURACY)).alias("_b")
    )
    joined = rows.join(sketch, keys) if keys else rows.crossJoin(F.broadcast(sketch))
    brackets = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(float(probs[n])).alias("q"), F.col("_b")[2 * i].alias("lo"), F.col("_b")[2 * i + 1].alias("hi"))
            for i, n in enumerate(names)
        ]
    )
    per = joined.select(*keys, "_n", "_v", F.explode(brackets).alias("_br")).where(F.col("_v") <= F.col("_br.hi"))
    # everything below the bracket is one row; equal values inside are one row
    slim = per.groupBy(
        *keys, "_n", F.col("_br.i").alias("_i"), F.col("_br.q").alias("_q"), F.when(F.col("_v") >= F.col("_br.lo"), F.col("_v")).alias("_val")
    ).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys, "_i").orderBy(F.col("_val").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    pos = F.col("_q") * (F.col("_n") - 1)
    cum = slim.withColumns({"_cum": F.sum("_c").over(w), "_k0": F.floor(pos), "_k1": F.ceil(pos), "_t": pos - F.floor(pos)})
    picked = cum.groupBy(*keys, "_i").agg(
        F.min(F.when(F.col("_cum") > F.col("_k0"), F.col("_val"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.col("_k1"), F.col("_val"))).alias("_b"),
        F.first("_t").alias("_t"),
    )
    val = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, val)).alias(n) for i, n in enumerate(names)])


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5})


def scaled_mad(df: DataFrame, keys: list[str], value: str, median: str = "median", mad: str = "mad") -> DataFrame:
    """Median and 1.4826 * median(|v - median|) per key."""
    med = exact_median(df, keys, value, median)
    dev = df.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col(median)))
    out = exact_median(dev, keys, "_dev", "_m")
    return med.join(out, keys).select(*keys, median, (F.lit(1.4826) * F.col("_m")).alias(mad))
