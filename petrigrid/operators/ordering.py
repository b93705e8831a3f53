"""List positions, neighbours, unique names and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrigrid.functions.style import GROUP_PALETTE


def neighbours(df: DataFrame, keys: list[str], position: str, item: str) -> DataFrame:
    """Previous and next item by position; the ends keep themselves (WIN3).

    Positions are dense, so the neighbours come by equi-joins on position, which
    stay balanced where a lag window would hold a whole list in one task.
    """
    p = df.select(*keys, (F.col(position) + 1).alias(position), F.col(item).alias("_p"))
    n = df.select(*keys, (F.col(position) - 1).alias(position), F.col(item).alias("_n"))
    on = [*keys, position]
    return df.join(p, on, "left").join(n, on, "left").withColumns(
        {"previous": F.coalesce("_p", item), "next": F.coalesce("_n", item)}
    ).drop("_p", "_n")


def move_items(items: DataFrame, sizes: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """New dense positions after moving one item per list to a clamped index (WIN4)."""
    m = moves.join(sizes, keys).withColumn("to_pos", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("to_pos"))))
    j = items.join(m, keys, "left")
    p, f, t = F.col("position"), F.col("from_pos"), F.col("to_pos")
    new = F.when(p == f, t).when((f < t) & (p > f) & (p <= t), p - 1).when((f > t) & (p >= t) & (p < f), p + 1).otherwise(p)
    return j.withColumn("position", new.cast("bigint")).select(items.columns)


def unique_names(wanted: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """``base``, else ``base 2``, ``base 3`` ... avoiding taken names, case-insensitively (WIN5).

    Only names of the form ``base`` or ``base n`` can be in the way, so each request
    needs its taken suffixes (one row per suffix) and their first gap.
    """
    t = taken.select(*keys, F.lower(F.trim("name")).alias("_t")).distinct()
    # split a taken name into a possible base and a suffix; the plain name is suffix 1
    canonical = F.regexp_extract("_t", r"^(.*) ([1-9][0-9]{0,8})$", 2)
    numbered = t.where(canonical != "").select(*keys, F.regexp_extract("_t", r"^(.*) ([1-9][0-9]{0,8})$", 1).alias("_b"), canonical.cast("bigint").alias("k")).where("k >= 2")
    plain = t.select(*keys, F.col("_t").alias("_b"), F.lit(1).cast("bigint").alias("k"))
    used = plain.unionByName(numbered)
    req = wanted.withColumn("_b", F.lower("base"))
    # a gap exists at k if k is used (or k = 0) and k + 1 is not: the smallest free suffix
    u = req.join(used, [*keys, "_b"])
    start = req.withColumn("k", F.lit(0).cast("bigint"))
    steps = u.select(*wanted.columns, "_b", "k").unionByName(start.select(*wanted.columns, "_b", "k"))
    free = steps.join(used.withColumn("k", F.col("k") - 1), [*keys, "_b", "k"], "left_anti")
    best = free.groupBy(*wanted.columns).agg((F.min("k") + 1).alias("k"))
    return best.withColumn("name", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws(" ", "base", F.col("k").cast("string")))).drop("k")


def next_colours(used: DataFrame, keys: list[str]) -> DataFrame:
    """First palette colour no group of the project uses, else cycle by the number of groups (WIN6)."""
    c = F.lower("colour")
    # only palette colours matter, so the set holds at most eight entries
    listed = F.when(c.isin(*[v for _, v in GROUP_PALETTE]), c)
    per = used.groupBy(*keys).agg(F.collect_set(listed).alias("_t"), F.count(F.lit(1)).alias("_n"))
    palette = F.array(*[F.lit(v) for _, v in GROUP_PALETTE])
    free = F.filter(palette, lambda v: ~F.array_contains("_t", v))
    cycle = F.element_at(palette, (F.col("_n") % len(GROUP_PALETTE) + 1).cast("int"))
    return per.select(*keys, F.when(F.size(free) > 0, F.element_at(free, 1)).otherwise(cycle).alias("colour"))
