"""Edit streams on Structured Streaming: replay, undo/redo, debounce, running counts, folder import."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from petrigrid.operators.oplog import HISTORY_LIMIT
from petrigrid.session import scratch

c = F.col
#: States a stream deals its keys to. A call in Python costs milliseconds, so keys share them; a state is written anew when one of its keys is touched.
SLOTS = 4096


def _slot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def _plain(values: pd.Series, kind: str) -> list:
    """Key values as they were: pandas makes whole numbers beside nulls floats."""
    if not values.isna().any():
        return values.tolist()
    return [None if pd.isna(v) else int(v) if kind in ("tinyint", "smallint", "int", "bigint") else v for v in values.tolist()]


def run_available(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Drain a stream into a table in the shared folder and return that table, with the batch number."""
    spark = stream.sparkSession
    out, ck = scratch(spark, name), scratch(spark, name + "-ck")

    def sink(batch: DataFrame, n: int) -> None:
        # a replayed batch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)


def replay_stream(ops: DataFrame, keys: list[str], item: str, ts: str, late: str) -> DataFrame:
    """Current state of every mark from a stream of ops (STR1).

    Marks are dealt to ``SLOTS`` states. State per mark is what the ops older than the watermark add up to, and the newer ops one by one, so an op that
    arrives up to ``late`` behind the newest still takes its place in ``seq`` order. Emits the mark after each
    batch that touched it (``alive`` false = removed).
    """
    key = [*keys, item]
    kinds = dict(ops.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in key)

    def apply(mark: tuple, ops_: list) -> tuple:
        alive, position, x = mark
        for seq, kind, val, _ in ops_:
            if kind == "add" and not alive:
                alive, position, x = True, seq, val
            elif kind == "remove":
                alive = False
            elif kind == "update" and alive:
                x = val
        return alive, position, x

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marks = pickle.loads(state.get[0]) if state.exists else {}
        new: dict[tuple, list] = {}
        for rows in batches:
            at = rows[ts].astype("datetime64[us]").astype("int64") // 1000
            ids = zip(*(_plain(rows[n], kinds[n]) for n in key), strict=True)
            for k, op in zip(ids, zip(rows["seq"].tolist(), rows["kind"].tolist(), rows["x"].tolist(), at.tolist(), strict=True), strict=True):
                new.setdefault(k, []).append(op)
        mark = state.getCurrentWatermarkMs()
        out = []
        for k, ops_ in new.items():
            base, held = marks.get(k, ((False, -1, 0.0), []))
            open_ = sorted([*held, *ops_])
            settled = 0
            while settled < len(open_) and open_[settled][3] < mark:
                settled += 1
            base, open_ = apply(base, open_[:settled]), open_[settled:]
            marks[k] = base, open_
            out.append((*k, *apply(base, open_)))
        state.update((pickle.dumps(marks),))
        # columns of objects keep nulls among whole numbers
        yield pd.DataFrame({n: pd.Series(v, dtype=object if n in key else None) for n, v in zip([*key, "alive", "position", "x"], zip(*out, strict=True), strict=True)})

    return ops.withWatermark(ts, late).withColumn("_slot", _slot(key)).groupBy("_slot").applyInPandasWithState(
        step, f"{head}, alive boolean, position bigint, x double", "marks binary", "update", GroupStateTimeout.EventTimeTimeout
    )


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode table."""
    rest = [n for n in table.columns if n not in keys and n != "batch"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*keys, "m.*")


def history_stream(commands: DataFrame, image: str = "image_id", limit: int = HISTORY_LIMIT) -> DataFrame:
    """Undo / redo per image (STR3): ``commands(image, seq, action edit|undo|redo, entry, blocked)``.

    State is two stacks of entry ids per image, at most ``limit`` each; images are dealt to ``SLOTS`` states. A new edit clears redo; an
    empty stack or a blocked entry leaves the state unchanged. Commands of a batch apply in
    ``seq`` order.
    """
    kinds = dict(commands.dtypes)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stacks = pickle.loads(state.get[0]) if state.exists else {}
        cmds = []
        for rows in batches:
            cmds += zip(rows["seq"].tolist(), _plain(rows[image], kinds[image]), rows["action"].tolist(), rows["entry"].tolist(), rows["blocked"].tolist(), strict=True)
        out = []
        for seq, k, action, entry, blocked in sorted(cmds, key=lambda r: r[0]):
            undo, redo = stacks.setdefault(k, ([], []))
            result, touched = "applied", None
            if action == "edit":
                undo.append(int(entry))
                del undo[:-limit]
                redo.clear()
                touched = int(entry)
            else:
                src, dst = (undo, redo) if action == "undo" else (redo, undo)
                if not src:
                    result = "empty"
                elif blocked:
                    result, touched = "blocked", src[-1]
                else:
                    touched = src.pop()
                    dst.append(touched)
            out.append((k, int(seq), action, result, touched, len(undo), len(redo)))
        state.update((pickle.dumps(stacks),))
        names = [image, "seq", "action", "result", "touched", "undo_size", "redo_size"]
        yield pd.DataFrame({n: pd.Series(v, dtype=object if n in (image, "touched") else None) for n, v in zip(names, zip(*out, strict=True), strict=True)})

    return commands.withColumn("_slot", _slot([image])).groupBy("_slot").applyInPandasWithState(
        step, f"{image} {kinds[image]}, seq bigint, action string, result string, touched bigint, undo_size bigint, redo_size bigint", "stacks binary", "append", GroupStateTimeout.NoTimeout
    )


def debounced_saves_stream(edits: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """One row per burst of edits once it is quiet for ``gap`` and past the watermark (STR5)."""
    e = edits.withWatermark(ts, late)
    return e.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("edits"), F.max(ts).alias("last_edit")).select(*keys, "edits", "last_edit")


def running_counts_stream(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts from signed changes, update mode (STR8)."""
    delta = F.when(c("kind") == "add", 1).when(c("kind") == "remove", -1).otherwise(0)
    return ops.groupBy(*keys).agg(F.sum(delta).cast("bigint").alias("net"))


def folder_import_stream(spark: SparkSession, path: str) -> DataFrame:
    """New image files of a folder and the folders in it, inspected as they arrive (STR9)."""
    from petrigrid.sources.images import inspect_images

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(path)
    return inspect_images(files.select("path", "content"))
