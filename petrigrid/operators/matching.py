"""Greedy selection and matching.

The keys (an image, a unit) bound what can rival what. Keys of up to ``FOLD`` rows are folded in their greedy
order inside one grouped task each, all in one job. Larger keys go in rounds, where every element that beats
all its undecided rivals is settled at once: rivalry is spatial, so a round is a grid join, and nothing forms
all pairs of a dense cell. Both give the sequential result.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrigrid.plans import grid
from petrigrid.plans.ranks import ordered_rank
from petrigrid.plans.rounds import drain
from petrigrid.session import cut

c = F.col

#: Rows of one key that one task folds.
FOLD = 200_000


def _by_size(rows: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fold`` over the keys that fit a task, ``rounds`` over the keys that do not. A task takes many small keys at once.

    The fold gets the rows of all keys of a task with the number of their key in ``_key`` and tells them apart by
    it, so nothing is done per key.
    """
    rows = cut(rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    dealt = F.pmod(F.xxhash64(*keys), F.lit(max(64, (total or 0) // 50_000)))

    def folds(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.drop(columns="_task").assign(_key=pdf.groupby(keys, sort=False, dropna=False).ngroup()))

    if (most or 0) <= FOLD:
        return rows.withColumn("_task", dealt).groupBy("_task").applyInPandas(folds, schema)
    large = cut(sizes.where(c("_n") > FOLD).select(*keys))
    small = rows.join(large, keys, "left_anti").withColumn("_task", dealt).groupBy("_task").applyInPandas(folds, schema)
    return small.unionByName(rounds(rows.join(large, keys, "left_semi")))


def _schema(df: DataFrame, *columns: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in columns)


def _spread(df: DataFrame, keys: list[str], reach: Column, side: float, *extra: str) -> DataFrame:
    """Cells within ``reach`` of any place in the row's own cell."""
    n = F.ceil(reach / side).cast("bigint")
    out = df.withColumn("_x", F.explode(F.sequence(c("cx") - n, c("cx") + n))).withColumn("_y", F.explode(F.sequence(c("cy") - n, c("cy") + n)))
    return out.select(*keys, c("_x").alias("cx"), c("_y").alias("cy"), *extra)


def greedy_keep(items: DataFrame, keys: list[str], item: str, order: list[Column], factor: float, side: float | None = None) -> DataFrame:
    """Greedy circle suppression: best first, drop a circle closer than ``factor * max(r)`` to a kept one.

    ``order`` are ascending sort columns, best first; ``item`` breaks ties (smaller
    first). Returns ``items`` with ``kept``. (WIN14-16)

    The fold holds the kept circles in one grid per octave of the radius and asks each grid for the cells in reach.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = items.select(*keys, item, "x", "y", "r", *[o.alias(n) for o, n in zip(order, names, strict=True)])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", *names, item], na_position="first")
        grids: dict[int, dict[tuple[int, int], list[tuple[float, float, float]]]] = {}
        kept, key = [], None
        for k, x, y, r in zip(*(pdf[n].tolist() for n in ("_key", "x", "y", "r")), strict=True):
            if k != key:
                key, grids = k, {}
            free = True
            for o, cells in grids.items():
                side, reach = factor * 2.0**o, factor * max(r, 2.0**o)
                x0, x1, y0, y1 = (math.floor(v / side) for v in (x - reach, x + reach, y - reach, y + reach))
                if (x1 - x0 + 1) * (y1 - y0 + 1) <= len(cells):
                    close = (q for i in range(x0, x1 + 1) for j in range(y0, y1 + 1) for q in cells.get((i, j), ()))
                else:
                    close = (q for held in cells.values() for q in held)
                if any(math.sqrt((x - a) ** 2 + (y - b) ** 2) < factor * max(r, s) for a, b, s in close):
                    free = False
                    break
            kept.append(free)
            if free:
                o = math.ceil(math.log2(max(r, 1e-6)))
                side = factor * 2.0**o
                grids.setdefault(o, defaultdict(list))[math.floor(x / side), math.floor(y / side)].append((x, y, r))
        return pdf.assign(kept=kept)[[*keys, item, "kept"]]

    settled = _by_size(rows, keys, fold, f"{_schema(rows, *keys, item)}, kept boolean", lambda big: _keep_in_rounds(big, keys, item, [c(n) for n in names], factor, side))
    return items.join(settled, [*keys, item])


def _keep_in_rounds(items: DataFrame, keys: list[str], item: str, order: list[Column], factor: float, side: float | None) -> DataFrame:
    """Keys, item and ``kept``. A round compares champions only: the best undecided circle of each cell. A
    champion is kept when it beats the champions of every cell in its own reach and no better circle of any size
    class reaches its cell; it then beats all its rivals, seen or not. Kept circles drop what they overlap. A
    cell contributes one row per size class whatever it holds, so copies and dense heaps never become pairs.
    """
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], c(item).alias("id"), "x", "y", "r")
    base = items.select(*keys, item, "x", "y", "r", rank.alias("rank"))
    if side is None:
        # cells about as wide as the usual reach; only speed depends on this number
        usual = base.agg(F.percentile_approx("r", 0.75)).first()[0]
        side = max(1.0, float(usual or 1.0) * factor)
    start = grid.home_cells(base, side)
    octave = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(c("r"), F.lit(1e-6)))))

    def step(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
        classes = pending.groupBy(*keys, "cx", "cy", octave.alias("oct")).agg(F.min("rank").alias("best"))
        champs = classes.groupBy(*keys, "cx", "cy").agg(F.min("best").alias("best"))
        reaching = _spread(classes, keys, c("oct") * factor, side, "best").groupBy(*keys, "cx", "cy").agg(F.min("best").alias("strongest"))
        safe = champs.join(reaching, [*keys, "cx", "cy"]).where(c("best") == c("strongest")).select(*keys, "cx", "cy", "best")
        own = _spread(safe.withColumn("mine", c("best")), keys, c("best.r") * factor, side, "mine")
        beaten = own.join(champs, [*keys, "cx", "cy"]).where(c("best") < c("mine")).select(*keys, c("mine").alias("best")).distinct()
        won = safe.join(beaten, [*keys, "best"], "left_anti").select(*keys, c("best.id").alias(item), c("best.x").alias("x"), c("best.y").alias("y"), c("best.r").alias("r"))
        won = cut(won)
        rest = pending.join(won.select(*keys, item), [*keys, item], "left_anti")
        gone = grid.hits_larger(rest, won, keys, item, factor, size=side)
        verdict = cut(won.select(*keys, item, F.lit(True).alias("kept")).unionByName(gone.withColumn("kept", F.lit(False))))
        return verdict, pending.join(verdict.select(*keys, item), [*keys, item], "left_anti")

    settled = drain(start, step)
    return items.select(*keys, item, F.lit(True).alias("kept")) if settled is None else settled


def near_duplicates(items: DataFrame, keys: list[str], item: str, factor: float = 0.5, score: str = "score") -> DataFrame:
    """Higher support wins, ties keep the earlier; null support comes last (WIN14)."""
    support = F.coalesce(c(score), F.lit(float("-inf")))
    return greedy_keep(items, keys, item, [-support], factor)


def _sites(points: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Positions with their number of copies."""
    return points.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("cap"), F.min(idx).alias("first"))


def match_points(pred: DataFrame, gt: DataFrame, keys: list[str], radius: Column, pred_id: str, gt_id: str, cell: float = grid.CELL) -> DataFrame:
    """Greedy one-to-one matching by increasing distance (``<=`` radius): pairs with ``d`` (JON2).

    ``radius`` reads columns of ``gt`` (a literal, or constant within the keys).
    Ties in distance go to the earlier prediction, then to the cell scan order (upper
    rows first, then left columns), then to the earlier ground-truth mark.

    Copies share a position, so candidates are links of positions, and a heap of copies is one. The fold keeps the
    links in a heap under their next copies on either end.
    """
    p_sites = _sites(pred, keys, pred_id)
    g_sites = gt.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("cap"), F.min(gt_id).alias("first"), F.max(radius.cast("double")).alias("radius"))
    e = cut(grid.pairs_in_reach(g_sites, p_sites, keys, c("radius"), strict=False, size=cell).select(*keys, "o_x", "o_y", "x", "y", "d", "radius", "o_cap", "cap", "o_first", "first"))
    pk, gk = dict(pred.dtypes)[pred_id], dict(gt.dtypes)[gt_id]
    null = lambda n, k: F.lit(None).cast(k).alias(n)
    link = e.select(*keys, c("o_x").alias("px"), c("o_y").alias("py"), c("x").alias("gx"), c("y").alias("gy"), "d", "radius", null("pid", pk), null("gid", gk))
    d = lambda n: F.lit(None).cast("double").alias(n)
    at = lambda n, a, b: [c("x").cast("double").alias(a), c("y").cast("double").alias(b)]
    near_p = pred.select(*keys, pred_id, "x", "y").join(e.select(*keys, c("o_x").alias("x"), c("o_y").alias("y")).distinct(), [*keys, "x", "y"], "left_semi")
    near_g = gt.select(*keys, gt_id, "x", "y").join(e.select(*keys, "x", "y").distinct(), [*keys, "x", "y"], "left_semi")
    rows = link.unionByName(near_p.select(*keys, *at("p", "px", "py"), d("gx"), d("gy"), d("d"), d("radius"), c(pred_id).alias("pid"), null("gid", gk)))
    rows = rows.unionByName(near_g.select(*keys, d("px"), d("py"), *at("g", "gx", "gy"), d("d"), d("radius"), null("pid", pk), c(gt_id).alias("gid")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p, g = defaultdict(list), defaultdict(list)
        is_link = pdf["d"].notna()
        columns = lambda which, *ns: zip(*(pdf.loc[which, n].tolist() for n in ns), strict=True)
        for k, x, y, i in columns(~is_link & pdf["pid"].notna(), "_key", "px", "py", "pid"):
            p[k, x, y].append(i)
        for k, x, y, i in columns(~is_link & pdf["gid"].notna(), "_key", "gx", "gy", "gid"):
            g[k, x, y].append(i)
        for ids in (*p.values(), *g.values()):
            ids.sort(reverse=True)  # the next copy is the last
        queue, out = [], []
        for k, px, py, gx, gy, dist, reach in columns(is_link, "_key", "px", "py", "gx", "gy", "d", "radius"):
            side = max(reach, 1e-6)
            queue.append((dist, p[k, px, py][-1], math.floor(gy / side), math.floor(gx / side), g[k, gx, gy][-1], px, py, gx, gy, k))
        heapq.heapify(queue)
        while queue:
            dist, i, row, col, j, px, py, gx, gy, k = heapq.heappop(queue)
            ps, gs = p[k, px, py], g[k, gx, gy]
            if not ps or not gs:
                continue
            if ps[-1] == i and gs[-1] == j:
                out.append((k, ps.pop(), gs.pop(), dist))
            if ps and gs:
                heapq.heappush(queue, (dist, ps[-1], row, col, gs[-1], px, py, gx, gy, k))
        found = pd.DataFrame(out, columns=["_key", pred_id, gt_id, "d"])
        names = pdf.drop_duplicates("_key").set_index("_key")[keys]
        return names.loc[found["_key"]].reset_index(drop=True).join(found.drop(columns="_key"))

    def rounds(big: DataFrame) -> DataFrame:
        large = big.select(*keys).distinct()
        return _match_in_rounds(e.join(large, keys, "left_semi"), pred.join(large, keys, "left_semi"), gt.join(large, keys, "left_semi"), keys, pred_id, gt_id)

    return _by_size(rows, keys, fold, f"{_schema(pred, *keys, pred_id)}, {_schema(gt, gt_id)}, d double", rounds)


def _match_in_rounds(e: DataFrame, pred: DataFrame, gt: DataFrame, keys: list[str], pred_id: str, gt_id: str) -> DataFrame:
    """Rounds of links that are best at both ends. Positions with capacities are matched first, and the n-th copy
    of one side then pairs with the n-th matched copy of the other. A link takes all its copies at once unless
    another position ties with it in distance; then it takes one copy and looks again.
    """
    side = F.greatest(c("radius"), F.lit(1e-6))
    zero = F.lit(0).cast("bigint")
    edges = e.select(
        *keys,
        F.struct(c("o_x").alias("x"), c("o_y").alias("y")).alias("p"),
        F.struct("x", "y").alias("g"),
        c("o_cap").alias("p_cap"),
        c("cap").alias("g_cap"),
        zero.alias("p_used"),
        zero.alias("g_used"),
        F.struct("d", c("o_first").alias("pi"), F.floor(c("y") / side).alias("ry"), F.floor(c("x") / side).alias("rx"), c("first").alias("gi")).alias("w"),
    )
    edges = cut(edges)
    copies = edges.where("p_cap > 1 or g_cap > 1").limit(1).count() > 0
    at = lambda n: F.struct("x", "y").alias(n)
    if copies:
        p_rank = cut(ordered_rank(pred.select(*keys, pred_id, "x", "y"), [*keys, "x", "y"], pred_id, "rank").select(*keys, at("p"), pred_id, "rank"))
        g_rank = cut(ordered_rank(gt.select(*keys, gt_id, "x", "y"), [*keys, "x", "y"], gt_id, "rank").select(*keys, at("g"), gt_id, "rank"))
    else:
        p_rank = pred.select(*keys, at("p"), pred_id, F.lit(1).alias("rank"))
        g_rank = gt.select(*keys, at("g"), gt_id, F.lit(1).alias("rank"))

    def best(pending: DataFrame, end: str) -> DataFrame:
        tied = pending.groupBy(*keys, end, c("w.d").alias("_d")).agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n"))
        return tied.groupBy(*keys, end).agg(F.min(F.struct("w", "n")).alias("b_" + end))

    def step(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
        m = pending.join(best(pending, "p"), [*keys, "p"]).join(best(pending, "g"), [*keys, "g"]).where((c("w") == c("b_p.w")) & (c("w") == c("b_g.w")))
        tie = (c("b_p.n") > 1) | (c("b_g.n") > 1)
        room = F.least(c("p_cap") - c("p_used"), c("g_cap") - c("g_used"))
        taken = cut(m.select(*keys, "p", "g", "w", "p_used", "g_used", F.when(tie, F.lit(1)).otherwise(room).cast("bigint").alias("n")))
        dp, dg = taken.select(*keys, "p", c("n").alias("np")), taken.select(*keys, "g", c("n").alias("ng"))
        rest = pending.join(dp, [*keys, "p"], "left").join(dg, [*keys, "g"], "left")
        rest = rest.withColumns({"p_used": c("p_used") + F.coalesce("np", zero), "g_used": c("g_used") + F.coalesce("ng", zero)}).drop("np", "ng")
        rest = rest.where((c("p_used") < c("p_cap")) & (c("g_used") < c("g_cap")))
        if copies:
            # the next copy on either end has a new index
            np_ = p_rank.select(*keys, "p", (c("rank") - 1).alias("p_used"), c(pred_id).alias("_pi"))
            ng_ = g_rank.select(*keys, "g", (c("rank") - 1).alias("g_used"), c(gt_id).alias("_gi"))
            rest = rest.join(np_, [*keys, "p", "p_used"]).join(ng_, [*keys, "g", "g_used"])
            rest = rest.withColumn("w", F.struct(c("w.d").alias("d"), c("_pi").alias("pi"), c("w.ry").alias("ry"), c("w.rx").alias("rx"), c("_gi").alias("gi"))).drop("_pi", "_gi")
        return taken, rest.select(pending.columns)

    links = drain(edges, step, lambda d: d.agg(F.count(F.lit(1)), F.sum("p_used"), F.sum("g_used")).first())
    if links is None:
        return pred.select(*keys, pred_id).join(gt.select(*keys, gt_id), keys).withColumn("d", F.lit(0.0)).limit(0)
    # copies of a link: rank ranges of equal length, joined rank to rank
    lp = links.join(p_rank, [*keys, "p"]).where((c("rank") > c("p_used")) & (c("rank") <= c("p_used") + c("n")))
    lp = lp.select(*keys, pred_id, "g", (c("rank") - c("p_used") + c("g_used")).alias("rank"), c("w.d").alias("d"))
    return lp.join(g_rank, [*keys, "g", "rank"]).select(*keys, pred_id, gt_id, "d")


def match_circles(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """One-to-one circle pairs closer than 0.5 * max radius, nearest first (JON24)."""
    e = grid.pairs_larger(a.select(*keys, a_id, "x", "y", "r"), b.select(*keys, b_id, "x", "y", "r"), keys, 0.5, strict=True)
    e = e.select(*keys, a_id, c("o_" + b_id).alias(b_id), "d")
    return _mutual(e.withColumn("w", F.struct("d", a_id, b_id)), keys, a_id, b_id)


def same_colony(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, *, strict: bool) -> DataFrame:
    """Candidate pairs of one colony: centres within 0.5 * max radius and |ln ratio| within 0.3."""
    e = grid.pairs_larger(a.select(*keys, a_id, "x", "y", "r"), b.select(*keys, b_id, "x", "y", "r"), keys, 0.5, strict=strict)
    ratio = F.abs(F.log(c("r") / c("o_r")))
    return e.where((ratio < 0.3) if strict else (ratio <= 0.3)).select(*keys, a_id, c("o_" + b_id).alias(b_id), "d")


def _mutual(edges: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """Sequential greedy matching over edges ordered by ``w``: a struct of the distance and the ids."""
    flat = edges.select(*keys, a_id, b_id, "d")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, keep = set(), set(), []
        pdf = pdf.sort_values(["d", a_id, b_id])
        for k, x, y in zip(pdf["_key"].tolist(), pdf[a_id].tolist(), pdf[b_id].tolist(), strict=True):
            free = (k, x) not in a and (k, y) not in b
            keep.append(free)
            if free:
                a.add((k, x))
                b.add((k, y))
        return pdf[pd.Series(keep, index=pdf.index, dtype=bool)].drop(columns="_key")

    return _by_size(flat, keys, fold, _schema(flat, *flat.columns), lambda big: _mutual_in_rounds(big.withColumn("w", F.struct("d", a_id, b_id)), keys, a_id, b_id))


def _mutual_in_rounds(edges: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    def step(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
        wa = pending.groupBy(*keys, a_id).agg(F.min("w").alias("wa"))
        wb = pending.groupBy(*keys, b_id).agg(F.min("w").alias("wb"))
        m = cut(pending.join(wa, [*keys, a_id]).join(wb, [*keys, b_id]).where((c("w") == c("wa")) & (c("w") == c("wb"))).select(*keys, a_id, b_id, "w"))
        rest = pending.join(m.select(*keys, a_id), [*keys, a_id], "left_anti").join(m.select(*keys, b_id), [*keys, b_id], "left_anti")
        return m, rest

    out = drain(edges, step)
    return (edges.limit(0) if out is None else out.withColumn("d", c("w.d"))).select(*keys, a_id, b_id, "d")


def assign_in_order(edges: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """Each ``a`` in id order takes its nearest free ``b`` (JON25, REV3).

    In rounds: sequential in ``a``, so ``a`` decides once every smaller rival ``a`` that still wants
    the same ``b`` has decided: the next ``b`` of an ``a`` is final when no smaller
    undecided ``a`` of the region has an edge to it.
    """
    e0 = edges.select(*keys, a_id, b_id, "d")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, keep = set(), set(), []
        pdf = pdf.sort_values([a_id, "d", b_id])
        for k, x, y in zip(pdf["_key"].tolist(), pdf[a_id].tolist(), pdf[b_id].tolist(), strict=True):
            free = (k, x) not in a and (k, y) not in b
            keep.append(free)
            if free:
                a.add((k, x))
                b.add((k, y))
        return pdf[pd.Series(keep, index=pdf.index, dtype=bool)].drop(columns="_key")

    return _by_size(e0, keys, fold, _schema(e0, *e0.columns), lambda big: _assign_in_rounds(big, keys, a_id, b_id))


def _assign_in_rounds(e0: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    def step(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
        want = pending.groupBy(*keys, a_id).agg(F.min(F.struct("d", b_id)).alias("m")).select(*keys, a_id, c(f"m.{b_id}").alias(b_id), c("m.d").alias("d"))
        first = pending.groupBy(*keys, b_id).agg(F.min(a_id).alias("_a"))
        m = cut(want.join(first, [*keys, b_id]).where(c(a_id) == c("_a")).select(*keys, a_id, b_id, "d"))
        rest = pending.join(m.select(*keys, a_id), [*keys, a_id], "left_anti").join(m.select(*keys, b_id), [*keys, b_id], "left_anti")
        return m, rest

    out = drain(e0, step)
    return e0.limit(0) if out is None else out


def farthest_points(points: DataFrame, keys: list[str], idx: str, k: int) -> DataFrame:
    """Farthest-point sampling, ``k`` rounds over all groups at once (WIN12).

    Starts nearest the centroid; each round takes the point farthest from all picked
    ones (ties keep list order) as a grouped maximum, so a group of any size combines
    map-side and only one row per group is joined back.
    """
    centre = points.groupBy(*keys).agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"), F.count(F.lit(1)).alias("gn"))
    p = points.join(centre, keys).withColumn("_d", grid.distance(c("x"), c("y"), c("gx"), c("gy")))
    small = p.where(c("gn") <= k).select(*keys, idx, "x", "y", F.lit(0).alias("pick"))
    state = cut(p.where(c("gn") > k).select(*keys, idx, "x", "y", "_d"))
    first = state.groupBy(*keys).agg(F.min(F.struct("_d", idx, "x", "y")).alias("m"))
    picks = None
    for n in range(k):
        chosen = cut(first.select(*keys, c(f"m.{idx}").alias(idx), c("m.x").alias("x"), c("m.y").alias("y"), F.lit(n + 1).alias("pick")))
        picks = chosen if picks is None else picks.unionByName(chosen)
        if n + 1 == k:
            break
        s = chosen.select(*keys, c(idx).alias("_i"), c("x").alias("sx"), c("y").alias("sy"))
        nd = grid.distance(c("x"), c("y"), c("sx"), c("sy"))
        state = cut(state.join(s, keys).where(c(idx) != c("_i")).withColumn("_d", nd if n == 0 else F.least(c("_d"), nd)).select(*keys, idx, "x", "y", "_d"))
        first = state.groupBy(*keys).agg(F.max(F.struct("_d", (-c(idx)).alias("_neg"), idx, "x", "y")).alias("m"))
    return small.unionByName(picks)
