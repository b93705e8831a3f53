"""Iteration to a fixed point: every round is one Spark job, cut reliably."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrigrid.session import cut


def drain(
    pending: DataFrame,
    step: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    measure: Callable[[DataFrame], object] | None = None,
) -> DataFrame | None:
    """Run ``step(pending) -> (settled rows, still pending)`` until nothing is pending.

    Every step must make progress: the number of pending rows, or ``measure`` of them,
    has to change, so a step that stalls fails loudly instead of looping. Returns the
    union of the settled rows, or None for an empty input.
    """
    size = measure or (lambda d: (d.count(),))
    pending = cut(pending)
    left = size(pending)
    done: DataFrame | None = None
    while left[0]:
        settled, rest = step(pending)
        rest = cut(rest)
        now = size(rest)
        if now == left:
            raise RuntimeError(f"no progress with {now[0]} rows pending")
        done = settled if done is None else done.unionByName(settled)
        pending, left = rest, now
    return done


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str) -> DataFrame:
    """Repeat ``step`` until its boolean column ``changed`` is false in every row."""
    state = cut(state)
    while True:
        nxt = cut(step(state))
        if nxt.where(F.col(changed)).limit(1).count() == 0:
            return nxt.drop(changed)
        state = nxt.drop(changed)
