import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from petrigrid.llm import collocations as P
from petrigrid.llm import common as C

from .fixtures import CLASH

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        if w := re.findall(r"[^\x20\x09]+", piece):
            yield w


def brute(rows, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    common = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in common.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and w in (q[1:3], q[2:4]) and 100 * b >= covered * a for q, b in common.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É日", "A\x00b", "x" * 50]
    passage = " ".join(rng.choice(vocabulary) for _ in range(90))
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ", ", ".", "\r\n", " "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice([text, text.upper(), passage, f"{text} {passage}"]), rng.choice(["en", "en", None, "und", "é"])))
    rows += [(None, "en"), ("", "fr"), (" \t.,", "fr"), ("same " * 3000, "en"), ("one two three " * 700, "de")]
    return rows


@pytest.mark.parametrize("period", [1, 4, 32])
def test_every_run_is_in_one_chunk(period, monkeypatch):
    monkeypatch.setattr(P, "PERIOD", period)
    monkeypatch.setattr(P, "CHUNK", 7)
    rng = random.Random(period)
    texts = ["".join(rng.choice(["a", "B", "c", "dd"]) + rng.choice([" ", ", ", "  "]) for _ in range(rng.randrange(80))) for _ in range(200)] + ["", None, "a", "a b", "a.b", "same " * 50]
    want = Counter(tuple(w[i : i + k]) for t in texts for w in pieces(t) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    got = Counter()
    for _, _, data, offsets in C.slices(pa.array(texts), 500):
        for chunk in P.parse(data, offsets)[0].to_pylist():
            words = chunk.count(" ") + chunk.strip("\n").count("\n") + 1
            until, at = words if chunk.endswith("\n") else words - 2, 0
            for w in (x.split(" ") for x in chunk.strip("\n").split("\n")):
                got.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1) if at + i < until)
                at += len(w)
    assert got == want


def test_phrases_are_never_broadcast(spark):
    """0.5 GB of documents made a broadcast of 1.4 GB: eight copies of a table of 8 MB in compressed files."""
    df = spark.createDataFrame([(" ".join(["one two three"] * 40), "en")] * 3, "text string, lang string")
    found = P.collocations(df)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("phrase" in line or "__p" in line)]
    assert joins and not any("Broadcast" in line for line in joins)
    rows = spark.createDataFrame([("en", "one two", 12)], "lang string, phrase string, a long")
    table = spark.createDataFrame([("en", "one", 40)], "lang string, phrase string, f long")
    got = P.looked_up(rows, F.substring_index("phrase", " ", 1), table, {"f": "l"})
    assert [tuple(r) for r in got.collect()] == [("en", "one two", 12, 40)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def held(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    for c in (*CLASH, "chunk", "freq", "phrase", "f", "a", "l", "r", "rank", "page"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted(tuple(r) for r in P.collocations(df, **kw).collect())
    assert got == brute(rows, **kw)
    return got


def test_phrases_as_by_brute_force(spark):
    assert len(held(spark, corpus(1))) > 100


def test_fullest_sieve_flushes_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(P, "SIEVE", 16)
    monkeypatch.setattr(P, "HELD", 50)
    monkeypatch.setattr(P, "CHUNK", 5)
    held(spark, corpus(2), top=7, covered=80, least=3)


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000), (10, 10, 10), (7, 8, 9)], "a long, l long, r long")
    got = [r[0] for r in df.select(P.score("a", "l", "r")).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in ((3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000), (10, 10, 10), (7, 8, 9))]


def test_no_rows(spark):
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
