"""Replay, undo/redo and version rules against sequential restatements."""

import datetime
import random

from petrigrid.operators import oplog as O
from petrigrid.streaming import edits as ST


def ops_rows(seed, n):
    rnd = random.Random(seed)
    return [(1, i, rnd.randint(0, 8), rnd.choice(["add", "add", "remove", "update"]), float(i)) for i in range(n)]


def replayed(rows):
    state = {}
    for _, seq, item, kind, x in rows:
        if kind == "add" and item not in state:
            state[item] = (seq, x)
        elif kind == "remove":
            state.pop(item, None)
        elif kind == "update" and item in state:
            state[item] = (state[item][0], x)
    return state


def in_batches(spark, df, parts, path):
    """A stream that delivers the given parts one batch at a time, in turn."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_replay_batch_and_stream(spark, tmp_path):
    rows = ops_rows(1, 300)
    start = datetime.datetime(2024, 1, 1)
    timed = [(*r, start + datetime.timedelta(minutes=r[1])) for r in rows]
    df = spark.createDataFrame(timed, "image_id int, seq long, item int, kind string, x double, ts timestamp")
    got = {r.item: (r.position, r.x) for r in O.replay(df, ["image_id"], "item", ["x"]).collect()}
    assert got == replayed(rows)
    # every seventh op arrives one batch late; the watermark settles what is older than two hours
    parts = [[r for r in timed if (r[1] // 50 + (r[1] % 7 == 3)) == i] for i in range(7)]
    s = in_batches(spark, df, [p for p in parts if p], tmp_path / "in")
    out = ST.latest(ST.run_available(ST.replay_stream(s, ["image_id"], "item", "ts", "2 hours"), "update"), ["image_id", "item"]).where("alive")
    assert {r.item: (r.position, r.x) for r in out.collect()} == replayed(rows)


def test_debounced_stream_is_complete(spark, tmp_path):
    """Bursts of the last batch come out once closing rows have moved the watermark past them."""
    rnd = random.Random(4)
    at, times = datetime.datetime(2024, 1, 1), []
    for _ in range(200):
        at += datetime.timedelta(minutes=rnd.choice([1, 5, 50, 200]))
        times.append((1, at))
    df = spark.createDataFrame(times, "image_id int, ts timestamp")
    beats = [[(None, at + datetime.timedelta(days=k))] for k in (1, 2)]
    s = in_batches(spark, df, [times[:70], times[70:140], times[140:], *beats], tmp_path / "in")
    got = ST.run_available(ST.debounced_saves_stream(s, ["image_id"], "ts", "30 minutes", "1 hour"), "append").where("image_id is not null")
    want = O.quiet_sessions(df, ["image_id"], "ts", "30 minutes")
    pick = lambda d: sorted((r.edits, r.last_edit) for r in d.collect())
    assert pick(got) == pick(want) and sum(n for n, _ in pick(got)) == 200


def test_undo_redo(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(1, i, rnd.choice(["edit", "edit", "undo", "redo"]), i, rnd.random() < 0.1) for i in range(120)]
    undo, redo, want = [], [], []
    for _, seq, action, entry, blocked in rows:
        res = "applied"
        if action == "edit":
            undo, redo = (undo + [entry])[-5:], []
        else:
            src, dst = (undo, redo) if action == "undo" else (redo, undo)
            if not src:
                res = "empty"
            elif blocked:
                res = "blocked"
            else:
                dst.append(src.pop())
        want.append((seq, res, len(undo), len(redo)))
    df = spark.createDataFrame(rows, "image_id int, seq long, action string, entry long, blocked boolean")
    s = in_batches(spark, df, [rows[:40], rows[40:80], rows[80:]], tmp_path / "in")
    out = ST.run_available(ST.history_stream(s, limit=5), "append").orderBy("seq").collect()
    assert [(r.seq, r.result, r.undo_size, r.redo_size) for r in out] == want


def test_csv_cells(spark):
    from pyspark.sql import functions as F

    from petrigrid.functions.text import csv_text

    cases = {"plain": "plain", "a,b": '"a,b"', 'q"q': '"q""q"', "=1": "'=1", " pad": '" pad"', "l\nb": '"l\nb"', "-x,": '"\'-x,"'}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.t for r in df.select("s", csv_text(F.col("s")).alias("t")).collect()} == cases


def test_stream_state_is_shared_by_marks(spark, tmp_path):
    """A call per mark costs milliseconds: marks and images share a bounded number of states; null keys keep theirs."""
    ops = [(None if i % 7 == 0 else i % 500, i, i % 40, ("add", "update", "remove")[i % 3], float(i), datetime.datetime(2024, 1, 1)) for i in range(4000)]
    df = spark.createDataFrame(ops, "image_id int, seq long, item int, kind string, x double, ts timestamp")
    s = in_batches(spark, df, [ops[:2000], ops[2000:]], tmp_path / "in")
    stream = ST.replay_stream(s, ["image_id"], "item", "ts", "1 day")
    assert "pmod(xxhash64(image_id" in stream._jdf.queryExecution().analyzed().toString()  # not grouped by mark
    got = ST.latest(ST.run_available(stream, "update"), ["image_id", "item"]).where("alive").select("image_id", "item", "position", "x")
    want = {(im, k): v for im in {o[0] for o in ops} for k, v in replayed([o[:5] for o in ops if o[0] == im]).items()}
    assert {(r.image_id, r.item): (r.position, r.x) for r in got.collect()} == want
    cmds = spark.createDataFrame([(None if i % 2 else 5, i, "undo" if i > 5 else "edit", i, False) for i in range(10)], "image_id int, seq long, action string, entry long, blocked boolean")
    h = in_batches(spark, cmds, [cmds.collect()], tmp_path / "h")
    rows = ST.run_available(ST.history_stream(h), "append").orderBy("seq").collect()
    assert [(r.image_id, r.touched, r.undo_size) for r in rows][-4:] == [(5, 4, 2), (None, 5, 2), (5, 2, 1), (None, 3, 1)]
