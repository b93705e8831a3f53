"""Mixing sources to target weights by entropy balancing.

Every document gets a rate; the rates stay as close as possible, in relative entropy, to "each document
once" while each source's expected words meet its target and no rate exceeds the cap. The dual of that
problem is convex and splits by source: rate = min(cap, exp(lambda_s * size / mean size of s)). Newton
steps on all lambda_s at once are one aggregation each, over the (source, size) histogram of the documents,
which is written once and stays small however many documents there are. A bracket keeps the steps safe.

Rates become whole copies by carrying the rounding error from the longest documents to the shortest, so a
source misses its target by about half of its shortest documents. Which documents of one size get the
extra copy is decided by a hash of id and text, in buckets with exact quotas, so a hot size never meets in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
CAP = 3
#: Sources are listed on the driver; more than this is refused.
MAX_SOURCES = 100_000
#: Documents of one size that are ranked together.
BUCKET = 5_000
STEPS = 80
TOLERANCE = 1e-12


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of all words by weight; a share above ``cap`` times its source stops there and its excess is shared again."""
    left, share = float(sum(sizes)), [0.0] * len(sizes)
    active = {i for i, s in enumerate(sizes) if s}
    while active:
        w = sum(weights[i] for i in active)
        over = {i for i in active if left * weights[i] / w > cap * sizes[i]}
        for i in over or active:
            share[i] = float(cap * sizes[i]) if over else left * weights[i] / w
        if not over:
            break
        left -= sum(share[i] for i in over)
        active -= over
    return share


def solve(hist: DataFrame, sources: dict[int, tuple[int, int, float]], cap: float) -> dict[int, float]:
    """lambda per source id; ``sources``: words, documents with words and target. One Spark aggregation per Newton step."""
    spark = hist.sparkSession
    lam, lo, hi, done = {}, {}, {}, {}
    for s, (words, n, target) in sources.items():
        if not target or not words:
            continue
        if target >= cap * words:
            done[s] = math.inf
        else:
            lam[s], lo[s], hi[s] = 0.0, -math.inf, math.inf
    for _ in range(STEPS):
        open_ = {s: v for s, v in lam.items() if s not in done}
        if not open_:
            break
        now = spark.createDataFrame([(s, v, sources[s][0] / sources[s][1]) for s, v in open_.items()], "sid int, lam double, scale double")
        x = F.col("size") / F.col("scale")
        free = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        rate = F.least(F.lit(float(cap)), free)
        got = hist.join(now, "sid").groupBy("sid").agg(F.sum(F.col("n") * F.col("size") * rate).alias("f"), F.sum(F.when(free < cap, F.col("n") * F.col("size") * x * free)).alias("d")).collect()
        for g in got:
            s, f, d, target = g["sid"], g["f"], g["d"] or 0.0, sources[g["sid"]][2]
            if abs(f - target) <= TOLERANCE * target:
                done[s] = lam[s]
                continue
            lo[s], hi[s] = (lam[s], hi[s]) if f < target else (lo[s], lam[s])
            step = lam[s] + (target - f) / d if d else math.nan
            if not lo[s] < step < hi[s] or abs(step - lam[s]) > 4 * max(1.0, abs(lam[s])):
                step = (lo[s] + hi[s]) / 2 if math.isfinite(lo[s]) and math.isfinite(hi[s]) else (lam[s] * 2 + 1 if f < target else lam[s] * 2 - 1)
            if step == lam[s]:
                done[s] = step
            lam[s] = step
    # the last bits depend on the order of sums; ten digits do not
    return {s: v if math.isinf(v := done.get(s, lam.get(s, 0.0))) else float(f"{v:.10g}") for s in sources}


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source", tags: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` and the columns ``tags`` per row of ``docs``.

    A null or empty text has size 0 and is kept once: it takes no words. A null source is a source of its
    own, ordered last. Repeated rows are mixed one by one. An empty table gives an empty result. Other
    columns of ``docs`` are ignored, so clashing names do no harm.
    """
    spark = C.prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = C.stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), *(F.col(t) for t in tags)), "sized")
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([p["words"] for p in per], [float(weights[i % len(weights)]) for i in range(len(per))], cap)
    listed = spark.createDataFrame([(i, p["source"], p["words"], goal[i]) for i, p in enumerate(per)], "sid int, source string, source_size long, target double")
    sized = sized.join(F.broadcast(listed) if len(per) <= 10_000 else listed, sized["source"].eqNullSafe(listed["source"])).select("doc_id", "size", "sid", "source_size", "target", "h", *tags)
    hist = C.stored(sized.groupBy("sid", "size").agg(F.count("*").alias("n")), "sizes")
    lam = solve(hist, {i: (p["words"], p["n"], goal[i]) for i, p in enumerate(per)}, cap)
    scale = {i: p["words"] / p["n"] if p["n"] else 1.0 for i, p in enumerate(per)}

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        s = int(pdf["sid"].iloc[0])
        want = taken = 0.0
        copies = []
        for size, n in zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True):
            if not size or goal[s] <= 0:
                copies.append(0 if size else n)
                continue
            z = lam[s] * size / scale[s] if math.isfinite(lam[s]) else math.inf
            want += n * size * (cap if z >= math.log(cap) else math.exp(z))
            k = min(cap * n, max(0, round((want - taken) / size)))
            taken += k * size
            copies.append(k)
        return pdf.assign(copies=copies)[["sid", "size", "n", "copies"]]

    bins = C.stored(hist.groupBy("sid").applyInPandas(rounded, "sid int, size long, n long, copies long").withColumn("m", F.ceil(F.col("n") / BUCKET).cast("int")), "bins")
    spread = sized.join(bins, ["sid", "size"]).withColumn("bucket", F.pmod(F.col("h"), F.col("m")))
    kinds = spread.groupBy("sid", "size", "bucket").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    upto = F.sum("c").over(Window.partitionBy("sid", "size").orderBy("bucket"))
    extra = F.expr("copies % n")
    quota = F.floor(upto * extra / F.col("n")) - F.floor((upto - F.col("c")) * extra / F.col("n"))
    kinds = kinds.select("sid", "size", "bucket", quota.alias("quota"))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "bucket").orderBy("h", "doc_id"))
    ranked = spread.join(kinds, ["sid", "size", "bucket"]).withColumn("r", rank)
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("r") <= F.col("quota")).cast("long")
    return ranked.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *tags)
