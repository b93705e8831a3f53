"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

#: Extra columns whose names the operators use inside.
CLASH = ("id", "key", "row", "size", "n", "h", "score", "shard", "slot", "copies", "words", "start", "label_", "path", "sketch", "__h", "__part", "mult", "value", "kind", "host", "list")


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None, str | None]]:
    """(id, text, source)"""
    rng = random.Random(seed)
    base = [words(rng, n) for n in (3, 4, 5, 9, 34, 35, 36, 80, 200, 400)]
    out: list[tuple[int | None, str | None, str | None]] = [(i, t, "a") for i, t in enumerate(base)]
    out += [(20, None, "a"), (21, "", "b"), (22, " \t\n ", None), (None, base[7], "b"), (None, None, None), (23, "é日本  x y 1.2.3.4", "c")]
    near = base[9].split()
    for k in range(8):  # near copies of one text, each with its own change
        changed = list(near)
        changed[10 + 40 * k] = f"changed{k}"
        out.append((30 + k, " ".join(changed), "b"))
    out += [(40, base[8], "a"), (41, base[8], "a"), (41, base[8], "a"), (42, base[8] + " tail", "b")]
    passage = words(rng, 60)
    out += [(50 + k, f"{words(rng, 30)} {passage} {words(rng, 20 + k)}", "c") for k in range(5)]
    out += [(60, "same " * 120, "c"), (61, "one two three " * 60, "c"), (62, f"{passage} {passage}", "c")]
    out += [(70, words(rng, 30_000, 10**7), "a"), (71, "x" * 300_000, "b")]
    return out


def documents(spark, rows=None, clash: bool = True):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for c in CLASH if clash else ():
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df
