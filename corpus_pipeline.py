"""The corpus pipeline: documents in, balanced training shards out.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns it was given; the
last returns where each document goes. Stages are written and read again between each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrigrid.llm import common as C
from petrigrid.llm import decontamination, mixing, ngram_join, quality, sharding

_PLACED = {"doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject.

    Null and empty texts are scored like any other. Without labelled documents nothing is rejected.
    """
    model = quality.train(docs, C.table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score="__score").where(F.col("__score") >= 0.5).drop("__score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class; repeated rows become one.

    Documents without words or without an id are in no class and stay; texts of one id are judged apart.
    """
    named = docs.withColumn("__text", F.xxhash64("text"))
    kept = ngram_join.join(named, tag="__text").where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept"), F.col("tag").alias("__tag")).distinct()
    once = named.where("doc_id is not null").join(kept, (F.col("doc_id") == F.col("__kept")) & (F.col("__text") == F.col("__tag")), "left_semi")
    return once.dropDuplicates(["doc_id", "__text"]).drop("__text").unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no phrase of ten words of the benchmark (nor a whole shorter item)."""
    named = docs.withColumn("__key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    hit = decontamination.contamination(named, C.table(spark, sf_dir, "benchmark"), doc_id="__key").where(F.size("hit") > 0).select(F.col("doc_id").alias("__hit")).distinct()
    same = F.col("__key.id").eqNullSafe(F.col("__hit.id")) & (F.col("__key.text") == F.col("__hit.text"))
    return named.join(hit, same, "left_anti").drop("__key")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows alike in all columns share their copies."""
    tags = {"__t1": F.xxhash64(*docs.columns), "__t2": F.xxhash64(F.lit(1), *docs.columns)}
    named = docs.withColumns(tags)
    copies = mixing.mix(named, tags=tuple(tags)).groupBy(*tags).agg(F.sum("copies").cast("int").alias("__n"), F.count("*").alias("__rows")).where("__n > 0")
    taken = named.join(copies, [*tags])
    taken = taken.where("__rows = 1").unionByName(taken.where("__rows > 1").dropDuplicates([*tags]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__n"))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document copy, with its columns but the text."""
    return sharding.shards(docs, carry=tuple(c for c in docs.columns if c not in _PLACED))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Boosted trees and Newton steps have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
