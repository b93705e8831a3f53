import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from petrigrid.llm import common as C
from petrigrid.llm import quality, toxicity

from .fixtures import documents

SF = "/root/testdata/sf0.1"


def held_accuracy(spark, scored, label, held):
    rows = scored.where(held).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", label).collect()
    hits = [(r["score"] >= 0.5, r[label] == 1) for r in rows]
    return np.mean([a == b for a, b in hits]), np.mean([a for a, b in hits if b]), np.mean([not a for a, b in hits if not b])


def test_quality_on_the_held_out_fold(spark):
    docs, held = C.table(spark, SF, "documents").select("doc_id", "text"), C.remainder("doc_id", 3) == 1
    model = quality.train(docs, C.table(spark, SF, "labels"), "quality", held)
    right, good, bad = held_accuracy(spark, quality.scored(docs, model), "quality", held)
    assert right > 0.97 and good > 0.98 and bad > 0.9


def test_toxicity_on_the_held_out_fold(spark):
    docs, held = C.table(spark, SF, "documents").select("doc_id", "text"), C.remainder("doc_id", 5) == 0
    model = toxicity.train(docs, C.table(spark, SF, "labels"), "toxic", held)
    right, toxic, clean = held_accuracy(spark, toxicity.scored(docs, model), "toxic", held)
    assert right > 0.97 and toxic > 0.8 and clean > 0.98


def test_pairs_count_beyond_their_parts():
    """Label 1 only if an insult meets a group: no additive score tells that from either alone."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{k}" for k in rng.integers(0, 30, 6)] + ["insulting"] * a + ["groupname"] * b
        texts.append(" ".join(rng.permutation(w)))
        y.append(a ^ b ^ True)
    data, offsets = C.buffers(pa.array(texts))
    doc, slot = toxicity.terms(data, offsets)
    model = toxicity.fit(doc, slot, np.array(y, float))
    assert np.mean((model.score(data, offsets) >= 0.5) == np.array(y)) > 0.9


def test_pairs_in_a_large_vocabulary():
    """Two rare words, neutral alone and toxic together, among 5,000 others; judged on texts not fitted on."""

    def sample(n, seed):
        rng = np.random.default_rng(seed)
        texts, pair = [], []
        for _ in range(n):
            kind = int(rng.integers(0, 4)) if rng.random() < 0.2 else 0
            w = [f"v{k}" for k in rng.integers(0, 5000, 20)] + [[], ["qalu"], ["zemi"], ["qalu", "zemi"]][kind]
            texts.append(" ".join(rng.permutation(w)))
            pair.append(kind)
        return C.buffers(pa.array(texts)), np.array(pair)

    (data, offsets), kind = sample(12_000, 1)
    model = toxicity.fit(*toxicity.terms(data, offsets), (kind == 3).astype(float))
    (data, offsets), kind = sample(4_000, 2)
    told = model.score(data, offsets) >= 0.5
    assert np.mean(told[kind == 3]) > 0.9 and np.mean(~told[kind != 3]) > 0.97


def test_flat_trees_follow_their_splits():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y)

    def walk(row, t):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + int(row[model.feature[t, node]] > model.limit[t, node])
        return model.leaf[t, node - model.feature.shape[1]]

    want = [model.bias + sum(walk(r, t) for t in range(len(model.leaf))) for r in x[:50]]
    assert np.allclose(model.margin(x[:50]), want)
    assert np.mean((model.score(x) >= 0.5) == (y == 1)) > 0.97


@pytest.mark.parametrize("op, label", [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, op, label):
    docs = documents(spark).drop("score")
    labels = docs.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 2).alias(label), F.lit("x").alias("text"))
    labels = labels.union(spark.createDataFrame([(None, 1, "x"), (3, None, "x")], labels.schema))
    got = op.scored(docs, op.train(docs, labels, label))
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns == [*docs.columns, "score"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = op.train(docs, labels.limit(0), label)
    assert op.scored(docs.limit(0), none).count() == 0
    assert len({r["score"] for r in op.scored(docs, none).collect()}) == 1
    clash = docs.withColumn("score", F.lit("old"))
    assert dict(op.scored(clash, none).dtypes)["score"] == "double"


def test_one_hash_bucket_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    assert quality.labelled(labels, "quality", F.lit(False), 100).count() == 100
