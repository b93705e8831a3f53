"""Edit streams in batch form: replay, inverses, undo stacks, debounce, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrigrid.plans.ranks import running_total

c = F.col
HISTORY_LIMIT = 300


def replay(ops: DataFrame, keys: list[str], item: str, payload: list[str]) -> DataFrame:
    """State after applying add-if-absent / remove / update-if-present in ``seq`` order (STR1).

    Closed form per item: only ops after the last remove matter; the item is alive when
    one of them is an add, it stands where its first such add put it (``position``), and
    carries the payload of the last update after that add, else of the add. Each part is
    a grouped extreme, so a hot item combines map-side.
    """
    k = [*keys, item]
    last = ops.where("kind = 'remove'").groupBy(*k).agg(F.max("seq").alias("_rm"))
    live = ops.join(last, k, "left").where(c("_rm").isNull() | (c("seq") > c("_rm"))).drop("_rm")
    body = F.struct("seq", *payload)
    add = live.where("kind = 'add'").groupBy(*k).agg(F.min(body).alias("a"))
    upd = live.where("kind = 'update'").groupBy(*k).agg(F.max(body).alias("u"))
    j = add.join(upd, k, "left")
    newer = c("u").isNotNull() & (c("u.seq") > c("a.seq"))
    return j.select(*k, c("a.seq").alias("position"), *[F.when(newer, c(f"u.{p}")).otherwise(c(f"a.{p}")).alias(p) for p in payload])


def inverse_ops(ops: DataFrame) -> DataFrame:
    """The ops that undo a batch, in reverse order (STR2)."""
    kind = F.when(c("kind") == "add", "remove").when(c("kind") == "remove", "add").otherwise(c("kind"))
    out = ops.withColumns({"kind": kind, "seq": -c("seq")})
    if {"before", "after"} <= set(ops.columns):
        out = out.withColumns({"before": c("after"), "after": c("before")})
    return out


def admitted(ops: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ops of allowed batches, and refused batches with their reason (STR4)."""
    v = verdicts.select("batch_id", "reason")
    ok = ops.join(v.where(c("reason").isNotNull()).select("batch_id"), "batch_id", "left_anti")
    return ok, v.where(c("reason").isNotNull())


def quiet_sessions(edits: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """One save per burst: a session ends after ``gap`` of quiet (STR5)."""
    e = edits.withColumn("_t", c(ts).cast("timestamp"))
    s = e.groupBy(*keys, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("edits"), F.max(ts).alias("last_edit"))
    return s.select(*keys, "edits", "last_edit")


def failure_runs(attempts: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """Consecutive failures so far and the delay before the next try (STR7).

    Gaps and islands: the number of successes so far names the run, and the position in
    it is a difference of two running totals, both chunked by the order column.
    """
    flags = attempts.withColumns({"_f": F.when(failed, 1).otherwise(0).cast("bigint"), "_ok": F.when(failed, 0).otherwise(1).cast("bigint")})
    chunk = F.floor(c(order) / (1 << 20))
    run = running_total(flags, keys, order, "_ok", chunk, "_island")
    run = running_total(run, keys, order, "_f", chunk, "_fails")
    names = {k: f"_s{i}" for i, k in enumerate([*keys, "_island"])}
    start = run.groupBy(*[c(k).alias(n) for k, n in names.items()]).agg(F.min(c("_fails") - c("_f")).alias("_f0"))
    on = F.lit(True)
    for k, n in names.items():
        on = on & c(k).eqNullSafe(c(n))
    j = run.join(start, on).where("_f = 1")
    n = c("_fails") - c("_f0")
    delay = F.least(F.lit(300_000.0), F.lit(15_000.0) * F.pow(F.lit(2.0), n - 1)).cast("bigint")
    return j.select(*attempts.columns, n.cast("bigint").alias("failures"), delay.alias("delay_ms"))


def signed_counts(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Counts as sums of +1 / -1 changes (STR8)."""
    delta = F.when(c("kind") == "add", 1).when(c("kind") == "remove", -1).otherwise(0)
    return ops.groupBy(*keys).agg(F.sum(delta).cast("bigint").alias("net"))


def automatic_versions(edits: DataFrame, keys: list[str], ts: str, period_s: int = 600, session_gap_s: int = 3600) -> DataFrame:
    """Automatic versions an edit stream triggers (STR6): session start, then periodic.

    A session starts after a long pause; its first edit triggers a version. Later ones are
    due at the first check at least ``period_s`` after the previous version, if there
    were edits since. The check runs every minute, so edits reduce to one row per minute and
    session before the ordered replay: at most 1440 rows per project and day.
    """
    import pandas as pd

    t = F.floor(F.unix_micros(c(ts).cast("timestamp")) / 1_000_000).cast("bigint")
    minute = F.floor(t / 60)
    per = edits.withColumn("_s", t).groupBy(*keys, minute.alias("m")).agg(F.min("_s").alias("first_s"), F.max("_s").alias("last_s"), F.count(F.lit(1)).alias("edits"))
    out_schema = ", ".join(f"{k} {dict(per.dtypes)[k]}" for k in keys) + ", at_s bigint, reason string"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        head = tuple(pdf[k].iloc[0] for k in keys)
        last_version = prev = None
        pending = False
        for first, last in pdf.sort_values("first_s")[["first_s", "last_s"]].itertuples(index=False):
            if prev is not None and pending and last_version is not None:
                due = -(-max(last_version + period_s, prev) // 60) * 60
                if due <= first and due - prev <= session_gap_s:
                    rows.append((*head, due, "periodic"))
                    last_version, pending = due, False
            if prev is None or first - prev > session_gap_s:
                rows.append((*head, first, "session-start"))
                last_version, pending = first, last > first
            else:
                pending = True
            prev = last
        if pending and last_version is not None:
            rows.append((*head, -(-max(last_version + period_s, prev) // 60) * 60, "periodic"))
        return pd.DataFrame(rows, columns=[*keys, "at_s", "reason"])

    return per.groupBy(*keys).applyInPandas(walk, out_schema)
