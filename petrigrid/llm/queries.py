"""One registered query per corpus operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import collocations, decontamination, embedding_dedup, html_extraction, merkle_manifest, mixing, multi_index, ngram_join, pii, quality, sharding, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def oracle(sql: str) -> Callable:
    """The DuckDB text of a query's rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[fn.__name__] = sql
        return fn

    return add


def graded(df: DataFrame, held_out) -> DataFrame:
    return df.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query
@oracle(f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y, c = a.n AND c = b.n AS same FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT y, root FROM r JOIN l ON x = id)
SELECT d.doc_id, least(d.doc_id, min(root)) AS class_id, coalesce(any_value(n_links), 0) AS n_links, least(d.doc_id, min(c.least_copy)) AS copy_of, d.doc_id = min(root) AS kept
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN (SELECT x, count(*) AS n_links, min(CASE WHEN same THEN y END) AS least_copy FROM l GROUP BY x) AS c ON c.x = d.doc_id GROUP BY d.doc_id""")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: word 5-grams, Jaccard similarity of 0.8 or more."""
    return ngram_join.join(C.table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; every fifth id by checksum is held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.remainder("doc_id", 5) == 0
    return graded(toxicity.scored(docs, toxicity.train(docs, C.table(spark, sf_dir, "labels"), "toxic", held_out)), held_out)


@query
@oracle("""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IN (SELECT vec_id FROM v, unnest(e) AS t(x) GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x)) AND bool_or(x <> 0))),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok AS a JOIN ok AS b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT y, root FROM r JOIN l ON x = id)
SELECT v.vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, v.vec_id = min(root) AS kept
FROM v JOIN r ON r.id = v.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) AS c ON c.x = v.vec_id GROUP BY v.vec_id""")
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of one label with a cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(C.table(spark, sf_dir, "embeddings"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(C.table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
@oracle(f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 34)) AS t(i)),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, p FROM r, unnest(generate_series(i, i + 34)) AS t(p)),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS kept FROM (SELECT doc_id, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS t(p)) AS x ANTI JOIN gone USING (doc_id, p) GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows of 35 words cover."""
    return substring_dedup.dedup(C.table(spark, sf_dir, "documents"))


@query
@oracle(f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases of ten words in every document."""
    found = decontamination.contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 contiguous shards of near equal bytes."""
    return sharding.shards(C.table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; every third id by checksum is held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.remainder("doc_id", 3) == 1
    return graded(quality.scored(docs, quality.train(docs, C.table(spark, sf_dir, "labels"), "quality", held_out)), held_out)


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: spans by form, and those that learned contexts add."""
    found = pii.extract(C.table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, pii.KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")
    # a second parameter of the lambda would be the position in the array
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(C.table(spark, sf_dir, "documents"))


def _tampered() -> Column:
    """The leaf with one more character counted where 7 divides the checksum of the id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return merkle_manifest.leaf(tuple(F.when(hit, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in merkle_manifest.COLUMNS))


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


_CRC32 = "(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"


@query
@oracle(f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN xor({_CRC32}, 4294967295) % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS seen FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
t AS (SELECT tree, 0 AS lv, list(leaf ORDER BY pos) AS hs FROM p GROUP BY tree
  UNION ALL SELECT tree, lv + 1, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], ''))) FROM t WHERE len(hs) > 1),
s AS (SELECT tree, hs[1] AS subroot FROM t WHERE len(hs) = 1),
u AS (SELECT 0 AS lv, list(subroot ORDER BY tree) AS hs FROM s
  UNION ALL SELECT lv + 1, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], ''))) FROM u WHERE len(hs) > 1),
h AS (SELECT tree, max(lv) AS h FROM t GROUP BY tree),
steps AS (SELECT p.tree, p.pos, t.lv, (p.pos >> t.lv) % 2 AS side, coalesce(hs[xor(p.pos >> t.lv, 1) + 1], '') AS sib FROM p JOIN t ON t.tree = p.tree AND len(t.hs) > 1
  UNION ALL SELECT p.tree, p.pos, h.h + u.lv, (p.tree >> u.lv) % 2, coalesce(hs[xor(p.tree >> u.lv, 1) + 1], '') FROM p JOIN h ON h.tree = p.tree JOIN u ON len(u.hs) > 1),
path AS (SELECT tree, pos, list(struct_pack(side := side, sib := sib) ORDER BY lv) AS path, string_agg(sib, '' ORDER BY lv) AS proof FROM steps GROUP BY tree, pos),
f AS (SELECT tree, pos, 0 AS lv, seen AS acc FROM p
  UNION ALL SELECT f.tree, f.pos, lv + 1, sha256(CASE WHEN path[lv + 1].side = 1 THEN path[lv + 1].sib || acc ELSE acc || path[lv + 1].sib END) FROM f JOIN path ON path.tree = f.tree AND path.pos = f.pos WHERE lv < len(path))
SELECT p.doc_id, leaf, subroot, hs[1] AS root, sha256(coalesce(proof, '')) AS proof_sha256, acc AS folded_root, acc = hs[1] AS verified
FROM p JOIN s ON s.tree = p.tree JOIN u ON len(u.hs) = 1 LEFT JOIN path ON path.tree = p.tree AND path.pos = p.pos JOIN f ON f.tree = p.tree AND f.pos = p.pos AND f.lv = coalesce(len(path), 0)""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, checked against rows of which some were tampered with."""
    return merkle_manifest.manifest(C.table(spark, sf_dir, "documents"), _tampered()).drop("proof")


@query
@oracle(r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, (VALUES (1), (2), (3)) AS v(k), unnest(generate_series(1, len(w) - k + 1)) AS t(i) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
x AS (SELECT c.*, cut, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS score FROM c, unnest(generate_series(1, k - 1)) AS t(cut)
  JOIN g AS l ON l.lang = c.lang AND l.phrase = array_to_string(ws[:cut], ' ') AND l.k = cut JOIN g AS r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') AND r.k = c.k - cut),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, pair, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) AS pair FROM c WHERE k = 3) GROUP BY lang, pair)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN i ON i.lang = s.lang AND i.pair = phrase AND k = 2 WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two and three words of each language."""
    found = collocations.collocations(C.table(spark, sf_dir, "documents"))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query
def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth embedding with all others."""
    return multi_index.nearest(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
