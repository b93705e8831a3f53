from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from petrigrid.llm import common as C

from .fixtures import documents, texts
from .test_text_operators import brute_contamination, brute_join

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the documents of the smallest input that all tables share."""
    docs, out = C.table(spark, SF, "documents"), {}
    for name, stage in P.STAGES:
        done = C.stored(stage(spark, docs, SF), name)
        out[name] = (docs, done)
        docs = done
    return out


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_and_columns(spark, stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, (before, after) in stages.items():
        assert name == "sharding" or after.columns == before.columns
    assert stages["sharding"][1].count() == stages["mixing"][1].count() > 0


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(before, "doc_id", "left_semi").select("doc_id", "quality")
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    good = [r["doc_id"] in kept for r in labels.where("quality = 1").collect()]
    bad = [r["doc_id"] not in kept for r in labels.where("quality = 0").collect()]
    assert sum(good) >= 0.99 * len(good) and sum(bad) >= 0.9 * len(bad)


def test_one_document_of_each_class_stays(stages):
    before, after = (rows(x) for x in stages["near_duplicates"])
    want = {i for (i, _, _, _, kept), _ in brute_join(before).items() if kept}
    assert sorted(i for i, _, _ in after) == sorted(want)


def test_contaminated_documents_go(spark, stages):
    before, after = (rows(x) for x in stages["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for (i, _, hit, _), _ in brute_contamination(before, items).items() if not hit}
    assert {i for i, _, _ in after} == want


def test_mix_repeats_documents_whole(stages):
    before, after = (rows(x) for x in stages["mixing"])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    size = lambda x: sum(len((t or "").split()) for _, t, _ in x)
    assert abs(size(after) - size(before)) <= 0.01 * size(before)


def test_shards_are_near_equal(stages):
    per, slots = Counter(), defaultdict(list)
    for r in stages["sharding"][1].collect():
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(per.values()) - min(per.values()) <= 0.35 * sum(per.values()) / 24


def test_awkward_rows_pass_every_stage(spark):
    docs = documents(spark, texts()).withColumn("lang", F.lit("en"))
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.count() > 0 and (name == "sharding" or out.columns == docs.columns), name


def test_mixing_takes_rows_one_by_one(spark):
    """Many documents without an id in two sources, and rows alike in all columns."""
    held = [(None, f"a{i} " * (20 + i % 30), "a") for i in range(400)] + [(None, f"b{i} " * (5 + i % 9), "b") for i in range(300)] + [(7, "same words here", "b")] * 9
    docs = documents(spark, held, clash=False).withColumn("lang", F.lit("en"))
    out = rows(P.mixing_stage(spark, docs, SF))
    size = lambda x, s: sum(len(t.split()) for _, t, o in x if o == s)
    total = size(held, "a") + size(held, "b")
    want_b = min(total * 2 / 7, 3 * size(held, "b"))
    assert abs(size(out, "b") - want_b) < 40 and abs(size(out, "a") - (total - want_b)) < 80
    assert Counter(out)[(7, "same words here", "b")] <= 27 and set(out) <= set(held)


def test_texts_of_one_id_are_judged_apart(spark):
    a = " ".join(f"w{i}" for i in range(60))
    held = [(1, a, "s"), (2, a.replace("w30", "x"), "s"), (2, "another text with some words of its own", "s"), (2, "another text with some words of its own", "s")]
    out = rows(P.near_duplicate_stage(spark, documents(spark, held, clash=False), SF))
    assert sorted(out) == sorted([held[0], held[2]])
