"""Spatial equi-joins on a uniform grid.

A radius predicate becomes an equi-join on (keys, cell x, cell y) plus the exact
distance test, so Catalyst sees an ordinary hash or sort-merge join. The side
that owns the radius is exploded over the cells its square touches, the other
side sits in its home cell only, so every pair within reach meets exactly once
and no pair is produced twice. Hot cells are ordinary skewed join keys: AQE
splits them (see ``session.RUNTIME``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 64.0  # px; matches the nearest-point index of the viewport


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("bigint")


def home_cells(df: DataFrame, size: float = CELL, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"cx": cell(F.col(x), size), "cy": cell(F.col(y), size)})


def cover_cells(df: DataFrame, reach: Column, size: float = CELL, x: str = "x", y: str = "y") -> DataFrame:
    """One row per cell touched by the square of half-side ``reach`` around each point."""
    cx, cy, r = F.col(x), F.col(y), reach
    return df.withColumn("cx", F.explode(F.sequence(cell(cx - r, size), cell(cx + r, size)))).withColumn(
        "cy", F.explode(F.sequence(cell(cy - r, size), cell(cy + r, size)))
    )


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def pairs_in_reach(
    owner: DataFrame,
    other: DataFrame,
    keys: list[str],
    reach: Column,
    *,
    strict: bool,
    size: float = CELL,
    prefix: str = "o_",
    extra: Column | None = None,
) -> DataFrame:
    """All (owner, other) pairs with distance ``<`` (strict) or ``<=`` the owner's ``reach``.

    ``reach`` reads owner columns; ``extra`` may read owner columns and ``prefix``-ed
    other columns. Columns of ``other`` come back prefixed; ``d`` is the distance.
    """
    a = cover_cells(owner.withColumn("_reach", reach), F.col("_reach"), size)
    b = home_cells(prefixed(other, prefix, keys), size, prefix + "x", prefix + "y")
    d = distance(F.col("x"), F.col("y"), F.col(prefix + "x"), F.col(prefix + "y"))
    near = (d < F.col("_reach")) if strict else (d <= F.col("_reach"))
    joined = a.join(b, [*keys, "cx", "cy"]).where(near)
    if extra is not None:
        joined = joined.where(extra)
    return joined.withColumn("d", d).drop("cx", "cy", "_reach")


def hits(owner: DataFrame, other: DataFrame, keys: list[str], owner_id: str, reach: Column, *, strict: bool, size: float = CELL) -> DataFrame:
    """Distinct owner ids with at least one ``other`` point in reach.

    Copies of ``other`` collapse first: existence does not depend on how many
    marks share a position.
    """
    points = other.select(*keys, "x", "y").distinct()
    found = pairs_in_reach(owner.select(*keys, owner_id, "x", "y", reach.alias("_r")), points, keys, F.col("_r"), strict=strict, size=size)
    return found.select(*keys, owner_id).distinct()


def hits_larger(owner: DataFrame, other: DataFrame, keys: list[str], owner_id: str, factor: float, *, size: float = CELL) -> DataFrame:
    """Distinct owner ids within ``factor * max(r, other r)`` (strict) of an ``other`` circle.

    Each radius is owned by one side, so this is the union of two one-sided joins
    and needs no global maximum radius.
    """
    # of copies at one position only the largest can decide
    o = other.groupBy(*keys, "x", "y").agg(F.max("r").alias("r"))
    mine = owner.select(*keys, owner_id, "x", "y", "r")
    own = pairs_in_reach(mine, o, keys, F.col("r") * factor, strict=True, size=size).select(*keys, owner_id)
    theirs = pairs_in_reach(o, mine, keys, F.col("r") * factor, strict=True, size=size).select(*keys, F.col("o_" + owner_id).alias(owner_id))
    return own.unionByName(theirs).distinct()


def pairs_larger(a: DataFrame, b: DataFrame, keys: list[str], factor: float, *, strict: bool, size: float = CELL) -> DataFrame:
    """(a, b) pairs within ``factor * max(r, o_r)``; columns of ``b`` are prefixed ``o_``.

    The larger circle owns the reach, so each pair is found from its larger side only.
    """
    mine = pairs_in_reach(a, b, keys, F.col("r") * factor, strict=strict, size=size, extra=F.col("r") >= F.col("o_r"))
    names = [n for n in a.columns if n not in keys]
    back = pairs_in_reach(prefixed(b, "o_", keys).withColumnsRenamed({"o_x": "x", "o_y": "y"}), a.withColumnsRenamed({n: "m_" + n for n in names}).withColumnsRenamed({"m_x": "x", "m_y": "y"}), keys, F.col("o_r") * factor, strict=strict, size=size, prefix="q_", extra=F.col("o_r") > F.col("q_m_r"))
    cols = [F.col(k) for k in keys]
    cols += [F.col("q_x").alias("x") if n == "x" else F.col("q_y").alias("y") if n == "y" else F.col("q_m_" + n).alias(n) for n in names]
    cols += [F.col("x").alias("o_x") if n == "x" else F.col("y").alias("o_y") if n == "y" else F.col("o_" + n) for n in b.columns if n not in keys]
    return mine.unionByName(back.select(*cols, "d"))
