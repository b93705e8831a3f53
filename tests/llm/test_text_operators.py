import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from petrigrid.llm import decontamination, mixing, ngram_join, sharding, substring_dedup

from .fixtures import documents, texts, words

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def empty(spark):
    return documents(spark, [])


# ---- op1 -------------------------------------------------------------------------------------------


def brute_join(rows):
    def grams(t):
        w = PLAIN.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, grams(t)) for i, t, _ in rows]
    links = defaultdict(set)
    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets):
            if x != y and a and b and i is not None and j is not None and 5 * len(a & b) >= 4 * len(a | b):
                links[x].add(y)
    out = []
    for x, (i, a) in enumerate(sets):
        seen, todo = {x}, [x]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        copies = [sets[y][0] for y in links[x] | {x} if sets[y][1] == a]
        out.append((i, min((sets[y][0] for y in seen), default=i) if i is not None else None, len(links[x]), min(copies) if i is not None else None))
    return Counter((i, c, n, m, c == i) for i, c, n, m in out)


def test_join_matches_brute_force(spark):
    got = Counter(tuple(r) for r in ngram_join.join(documents(spark)).collect())
    assert got == brute_join(texts())
    assert ngram_join.join(empty(spark)).count() == 0


def test_join_of_a_large_group_parts_and_blocks(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = words(rng, 300, 10**6).split()
    rows = []
    for k in range(60):
        changed = list(base)
        for _ in range(rng.randrange(1, 9)):
            changed[rng.randrange(300)] = f"c{k}"
        rows.append((k, " ".join(changed), "a"))
    monkeypatch.setattr(ngram_join, "BUCKET", 7)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    got = Counter(tuple(r) for r in ngram_join.join(documents(spark, rows, clash=False)).collect())
    assert got == brute_join(rows)


def notices(n=240, seed=11):
    """Short texts that share a notice and few other words, of many lengths, with some near copies among them."""
    rng = random.Random(seed)
    notice = words(rng, 9)
    rows = [(i, f"{notice} {words(rng, rng.randrange(4, 40), 10**6)}", "a") for i in range(n)]
    for i in range(n, n + n // 8):
        text = rng.choice(rows)[1].split()
        rows.append((i, " ".join([*text[:-1], f"c{i}"]), "a"))
    return rows


def test_short_texts_with_one_notice_are_no_candidates(spark, monkeypatch):
    """Sketches of small sets say little: most texts were one component, compared all against all."""
    rows = notices()
    monkeypatch.setattr(ngram_join, "BUCKET", 40)
    found = []
    monkeypatch.setattr(ngram_join, "_members", lambda *a, members=ngram_join._members: found.append(members(*a)) or found[0])
    got = Counter(tuple(r) for r in ngram_join.join(documents(spark, rows, clash=False)).collect())
    want = brute_join(rows)
    assert got == want
    linked = max(Counter(c for _, c, n, _, _ in want if n).values())
    assert max(r["count"] for r in found[0].groupBy("root").count().collect()) <= 2 * linked


def test_blocks_of_a_component_meet_where_sizes_allow_a_link(spark):
    rng = random.Random(4)
    rows = [(i, 7 if i < 300 else 8, rng.randrange(1, 2000)) for i in range(300)] + [(i, 8, 50) for i in range(300, 320)]
    sized = spark.createDataFrame([(i, root, n, 300 if root == 7 else 20) for i, root, n in rows], "id long, root long, n long, size long")
    dealt = ngram_join.meeting(ngram_join.banded(sized, 0.8, 25)).collect()
    by = defaultdict(list)
    for r in dealt:
        by[r["key"]].append(r)
    met = Counter()
    for at in by.values():
        assert len({r["root"] for r in at}) == 1
        met.update((a["id"], b["id"]) for a in at for b in at if a["id"] < b["id"] and (a["low"] == a["high"] or a["side"] != b["side"]))
    assert max(met.values()) == 1
    for x, (i, root, n) in enumerate(rows):
        assert all((i, j) in met for j, other, m in rows[x + 1 :] if root == other and 5 * min(n, m) >= 4 * max(n, m))
    assert len(met) < 0.5 * 300 * 299 / 2


def test_runs_follow_the_allowed_odds():
    assert ngram_join.runs_for(miss=1e-9) > ngram_join.runs_for(miss=1e-3) >= 1


# ---- op5 -------------------------------------------------------------------------------------------


def brute_dedup(rows, window):
    places = defaultdict(list)
    split = [PLAIN.findall(t or "") for _, t, _ in rows]
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((d, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return Counter((rows[d][0], len(w), len(gone[d]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[d]).encode()).hexdigest()) for d, w in enumerate(split))


@pytest.mark.parametrize("crowded", [substring_dedup.CROWDED, 1])
def test_repeats_match_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup.repeats, "__defaults__", (*substring_dedup.repeats.__defaults__[:-1], crowded))
    got = Counter(tuple(r) for r in substring_dedup.dedup(documents(spark)).collect())
    assert got == brute_dedup(texts(), 35)


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_index_counts_as_search_does():
    import numpy as np

    rng = np.random.default_rng(1)
    seq = rng.integers(1, 4, 400)
    index = substring_dedup.Index(np.append(seq, 0), np.append(np.ones(400, int), 0))
    text = seq.tolist()
    for n in (1, 2, 5, 9):
        for s in range(0, 390, 13):
            lo, hi = np.array([0]), np.array([401])
            for c in text[s : s + n][::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            assert int(index.weight[hi[0]] - index.weight[lo[0]]) == sum(text[i : i + n] == text[s : s + n] for i in range(400 - n + 1))


# ---- op6 -------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = FOLDED.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[s : s + window])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t, _ in rows:
        w = FOLDED.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


def test_contamination_matches_brute_force(spark):
    rows = texts()
    long_ = rows[9][1].split()
    items = [(1, " ".join(long_[20:45])), (2, rows[0][1].upper()), (3, ""), (4, None), (None, " ".join(long_[100:112])), (12, " ".join(long_[30:40])), (5, "same same same"), (6, "never seen words here at all, none of them, no"), (7, rows[9][1] + "!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    pick = lambda df: Counter((r["doc_id"], r["n_words"], tuple(r["hit"]), tuple(r["items"])) for r in df.collect())
    assert pick(decontamination.contamination(documents(spark), table)) == want
    assert decontamination.contamination(empty(spark), table).count() == 0
    assert all(not r["hit"] for r in decontamination.contamination(documents(spark), table.limit(0)).collect())


def test_contamination_in_blocks(spark, monkeypatch):
    rows = [r for r in texts() if r[0] is not None and r[0] != 41]
    items = [(k, " ".join(rows[9][1].split()[7 * k : 7 * k + 20])) for k in range(20)]
    real = decontamination.blocks
    monkeypatch.setattr(decontamination, "blocks", lambda df: real(df, words=100))
    got = decontamination.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r["doc_id"], r["n_words"], tuple(r["hit"]), tuple(r["items"])) for r in got.collect()) == brute_contamination(rows, items)


def test_blocks_keep_repeated_and_null_ids(spark, monkeypatch):
    rows = texts()
    long_ = rows[9][1].split()
    rows += [(None, " ".join(long_[k : k + 30]), "a") for k in (5, 50)] + [(41, " ".join(long_[60:90]), "b")]
    items = [(k, " ".join(long_[7 * k : 7 * k + 20])) for k in range(20)]
    real = decontamination.blocks
    monkeypatch.setattr(decontamination, "blocks", lambda df: real(df, words=100))
    got = decontamination.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r["doc_id"], r["n_words"], tuple(r["hit"]), tuple(r["items"])) for r in got.collect()) == brute_contamination(rows, items)


def test_proximity(spark):
    rows = [(1, "alpha filler beta filler gamma", "a"), (2, "gamma beta alpha", "a"), (3, "alpha beta", "a"), (4, f"alpha {words(__import__('random').Random(1), 40)} beta gamma", "a")]
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near"]) for r in decontamination.contamination(documents(spark, rows), items, span=4).collect()}
    assert got == {1: ([], ["9"]), 2: ([], ["9"]), 3: ([], []), 4: ([], [])}


# ---- op7 -------------------------------------------------------------------------------------------


def test_shards_are_balanced_gapless_and_keep_groups(spark):
    rows = texts() + [(1000 + i, f"text {i % 300} " * (1 + i % 7), "a") for i in range(3000)]
    got = sharding.shards(documents(spark, rows), 8).collect()
    sizes = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, sizes(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    per = Counter()
    for r in got:
        per[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    target = sum(per.values()) / 8
    assert set(per) <= set(range(8))
    assert max(per.values()) <= target + 2 * max(sizes(t) for _, t, _ in rows)
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_of_even_documents_differ_little(spark):
    rows = [(i, f"document {i % 2500} of some length", "a") for i in range(5000)]
    got = sharding.shards(documents(spark, rows, clash=False)).collect()
    per, where = Counter(), defaultdict(set)
    for r in got:
        per[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert len(per) == 24 and max(per.values()) - min(per.values()) <= 0.06 * sum(per.values()) / 24
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shards(empty(spark)).count() == 0


def test_one_hot_text_is_split(spark):
    rows = [(i, "hot text" if i % 3 else f"cold {i}", "a") for i in range(6000)]
    per = Counter()
    for r in sharding.shards(documents(spark, rows, clash=False)).collect():
        per[r["shard"]] += r["size"]
    assert len(per) == 24 and max(per.values()) <= 1.05 * min(per.values())


# ---- op10 ------------------------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    import random

    rng = random.Random(2)
    rows = texts() + [(1000 + i, words(rng, rng.randrange(1, 200)), rng.choice(["a", "b", "c", "d", None, "z"])) for i in range(1500)]
    df = documents(spark, rows)
    got = mixing.mix(df).collect()
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(df.repartition(5)).collect()}
    size = lambda t: len(PLAIN.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    assert all(again[r["doc_id"], r["size"]] == r["taken"] for r in got if r["doc_id"] not in (41, None))
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    words_of = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, share, active = float(sum(words_of.values())), {}, set(names)
    while active:  # water filling
        over = {s for s in active if left * weight[s] / sum(weight[x] for x in active) > 3 * words_of[s]}
        total = sum(weight[x] for x in active)
        share |= {s: 3.0 * words_of[s] if over else left * weight[s] / total for s in over or active}
        left -= sum(share[s] for s in over)
        active = active - over if over else set()
    source = {(i, size(t)): s for i, t, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == words_of[s] and abs(r["target"] - share[s]) < 1e-6 * share[s] + 1e-9
    for s in names:
        assert abs(taken[s] - share[s]) <= 0.01 * share[s] + 3, (s, taken[s], share[s])
    assert mixing.mix(empty(spark)).count() == 0


def test_rates_solve_the_dual(spark):
    import math

    sizes = {0: [(1, 40), (10, 20), (300, 3)], 1: [(5, 10), (7, 1)]}
    hist = spark.createDataFrame([(s, z, n) for s, x in sizes.items() for z, n in x], "sid int, size long, n long")
    words_of = {s: (sum(z * n for z, n in x), sum(n for _, n in x)) for s, x in sizes.items()}
    for part in (0.1, 0.7, 1.6, 2.9):
        lam = mixing.solve(hist, {s: (*words_of[s], part * words_of[s][0]) for s in sizes}, 3)
        for s, x in sizes.items():
            scale = words_of[s][0] / words_of[s][1]
            assert math.isclose(sum(z * n * min(3, math.exp(lam[s] * z / scale)) for z, n in x), part * words_of[s][0], rel_tol=1e-6)


def test_join_counts_rows_not_ids(spark):
    """The smallest id of a class on several rows, several texts of one id, and texts that differ in white space only."""
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a.replace("w30", "x"), " ".join(f"v{i}" for i in range(60))
    for rows in (
        [(1, a, "s"), (1, a, "s"), (2, near, "s")],
        [(1, a, "s"), (2, near, "s"), (2, other, "s")],
        [(1, a, "s"), (1, a.replace(" ", "  "), "s"), (1, near, "s"), (3, near, "s"), (1, other, "s"), (2, other, "s"), (2, other + " tail", "s")],
    ):
        got = Counter(tuple(r) for r in ngram_join.join(documents(spark, rows, clash=False)).collect())
        assert got == brute_join(rows)


def test_crowded_windows_are_added_up_first(spark):
    """Many documents with one passage and surroundings of their own: one row a window reaches the index."""
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = [(i, f"{words(rng, 8, 10**6)} {passage} {words(rng, 8, 10**6)}", "a") for i in range(300)]
    docs = documents(spark, rows, clash=False)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs).select("doc_id", "n_removed").collect()}
    assert got == {i: 60 for i in range(300)}
    held = docs.select("text", F.array(F.struct(F.lit(0).alias("start"), F.lit(76).alias("n"), F.col("doc_id").alias("mk"), F.col("doc_id").alias("sh"), F.lit(1).cast("long").alias("weight"), F.lit(True).alias("crowded"))).alias("wanted"))
    each = substring_dedup._windows(held, 35, True).groupBy("w1", "w2").agg(F.sum("weight").alias("weight"))
    assert each.where("weight = 300").count() == 60 - 34 and each.where("weight > 1").count() == 60 - 34
    assert substring_dedup._crowded(held, 35).groupBy("sh").count().where("count <> 26").count() == 0
