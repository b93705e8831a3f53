"""DuckDB texts of the greedy rules: an ordered list per key, folded into what it keeps."""

from __future__ import annotations


def _fold(name: str, keys: str, entry: str, order: str, source: str, clash: str, out: str) -> str:
    return f"""{name}_l AS (SELECT {keys}, list([{entry}] ORDER BY {order}) AS es FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, {out} FROM (SELECT {keys}, unnest(list_reduce(es, lambda acc, e: CASE WHEN len(list_filter(acc, lambda z: {clash})) > 0 THEN acc ELSE list_concat(acc, e) END)) AS m FROM {name}_l))"""


def distance(a: str = "a", b: str = "b") -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def pairs(name: str, source: str, order: str, keys: str = "image_id") -> str:
    """CTEs up to ``name(keys, p, g, d)``: candidate pairs (p, g, d, ...) in order, each end used once."""
    return _fold(name, keys, "{'p': p, 'g': g, 'd': d}", order, source, "z.p = e[1].p OR z.g = e[1].g", "m.p AS p, m.g AS g, m.d AS d")


def matched(name: str, pred: str, gt: str, radius: str, p: str = "suggestion_id", g: str = "annotation_id", keys: str = "image_id") -> str:
    """One-to-one matching by distance; ``radius`` may read ``b``, the ground truth."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    e = f"""{name}_e AS (SELECT {own}, a.{p} AS p, b.{g} AS g, {distance()} AS d, floor(b.y / greatest({radius}, 1e-6)) AS ry, floor(b.x / greatest({radius}, 1e-6)) AS rx FROM {pred} AS a JOIN {gt} AS b ON {on} AND {distance()} <= {radius})"""
    return e + ",\n" + pairs(name, f"{name}_e", "d, p, ry, rx, g", keys)


def kept(name: str, source: str, item: str, order: str, factor: float, keys: str = "image_id") -> str:
    """CTEs up to ``name(keys, item)``: circles in order, none closer than ``factor`` times the larger radius to a kept one."""
    near = f"sqrt((z.x - e[1].x) * (z.x - e[1].x) + (z.y - e[1].y) * (z.y - e[1].y)) < {factor!r}::DOUBLE * greatest(z.r, e[1].r)"
    return _fold(name, keys, f"{{'i': {item}, 'x': x, 'y': y, 'r': r}}", f"{order}, {item}", source, near, f"m.i AS {item}")


def counts(pred: str, gt: str, match: str, keys: str = "image_id") -> str:
    """Select of the counts and ratios of a matching; keys of either side appear."""
    ks = [k.strip() for k in keys.split(",")]
    return f"""SELECT {keys}, n_pred, n_gt, tp, fp, fn, pr AS precision, rc AS recall, CASE WHEN pr + rc > 0 THEN pr * rc * 2 / (pr + rc) ELSE 0::DOUBLE END AS f1 FROM (
SELECT *, CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred::DOUBLE ELSE 1::DOUBLE END AS pr, CASE WHEN n_gt > 0 THEN tp::DOUBLE / n_gt::DOUBLE ELSE 1::DOUBLE END AS rc, n_pred - tp AS fp, n_gt - tp AS fn FROM (
SELECT {', '.join(f'coalesce(q.{k}, w.{k}) AS {k}' for k in ks)}, coalesce(q.n, 0) AS n_pred, coalesce(w.n, 0) AS n_gt, coalesce(v.n, 0) AS tp
FROM (SELECT {keys}, count(*) AS n FROM {pred} GROUP BY {keys}) AS q FULL OUTER JOIN (SELECT {keys}, count(*) AS n FROM {gt} GROUP BY {keys}) AS w ON {' AND '.join(f'q.{k} = w.{k}' for k in ks)}
LEFT JOIN (SELECT {keys}, count(*) AS n FROM {match} GROUP BY {keys}) AS v ON {' AND '.join(f'v.{k} = coalesce(q.{k}, w.{k})' for k in ks)}))"""
