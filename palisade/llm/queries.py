"""Registered queries: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import (
    block_topk,
    dart_minhash,
    ftrl_toxicity,
    hard_negatives,
    hash_forest,
    hd_language,
    lpt_shards,
    page_wrapper,
    pu_quality,
    sentence_pieces,
    source_mix,
    token_alignment,
    token_store,
)
from palisade.llm.common import crc_remainder, table
from palisade.session import stored, work_folder

#: Queries of the searches are the rows whose id is divisible by this.
EVERY = 50
#: Anchors of the hard negatives.
ANCHORS = 100


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text back."""
    pieces = sentence_pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentence_pieces.encode_and_decode(docs, pieces)
    return both.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = crc_remainder("doc_id", 5)
    model = pu_quality.train(
        docs.where(remainder != 0), table(spark, sf_dir, "labels").where(remainder != 0)
    )
    held_out = F.coalesce(remainder == 0, F.lit(False))
    scored = pu_quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write(table(spark, sf_dir, "documents"), path, folder)
    return token_store.read(spark, folder)


def op7_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards.shard(table(spark, sf_dir, "documents"), 40)


def op8_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    prototypes = hd_language.learn(docs.where(~held_out))
    named = hd_language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes)
    return named.select("doc_id", "held_out", "lang_pred", "score")


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


def op10_page_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wrappers = stored(page_wrapper.induce(pages), "wrappers")
    return page_wrapper.extract(pages, wrappers).select("page_id", "url", "text", "n_chars")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vector are moved on by one first, as wrongly marked rows are."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("id") % ANCHORS == 0)


def op13_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = crc_remainder("doc_id", 5)
    model = ftrl_toxicity.train(
        docs.where(remainder != 0), table(spark, sf_dir, "labels").where(remainder != 0)
    )
    held_out = F.coalesce(remainder == 0, F.lit(False))
    scored = ftrl_toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run
    for run in (
        op1_sentence_pieces, op2_hash_forest, op3_dart_minhash, op4_source_mix, op5_pu_quality,
        op6_token_store, op7_lpt_shards, op8_hd_language, op9_block_topk, op10_page_wrapper,
        op11_token_alignment, op12_hard_negatives, op13_ftrl_toxicity,
    )
}

ORACLES: dict[str, str] = {
    "op4_source_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS id FROM s),
-- Water-filling: hold the sources that are above their cap, share the rest again, until none is.
fill(n, held) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT n + 1, (
    SELECT list(id ORDER BY id) FROM i, (
      SELECT (sum(source_size) - 3.0 * coalesce(sum(source_size) FILTER (list_contains(held, id)), 0))
             / sum(w) FILTER (NOT list_contains(held, id)) AS level FROM i) l
    WHERE list_contains(held, id) OR level * w > source_size * 3.0)
  FROM fill
  WHERE n < (SELECT count(*) FROM i) AND EXISTS (
    SELECT 1 FROM i, (
      SELECT (sum(source_size) - 3.0 * coalesce(sum(source_size) FILTER (list_contains(held, id)), 0))
             / sum(w) FILTER (NOT list_contains(held, id)) AS level FROM i) l
    WHERE NOT list_contains(held, id) AND level * w > source_size * 3.0)),
last AS (SELECT held FROM fill ORDER BY n DESC LIMIT 1),
level AS (
  SELECT (sum(source_size) - 3.0 * coalesce(sum(source_size) FILTER (list_contains(held, id)), 0))
         / sum(w) FILTER (NOT list_contains(held, id)) AS level FROM i, last),
t AS (
  SELECT source, source_size,
         CASE WHEN list_contains(held, id) THEN source_size * 3.0 ELSE level * w END AS target
  FROM i, last, level),
p AS (
  SELECT source, source_size, CAST(target AS DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(CAST(target AS DOUBLE) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM t),
r AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, k) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(whole + CASE WHEN source_size > 0 AND upto - own / 2.0 <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM r""",
    "op9_block_topk": """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_hard_negatives": """
WITH w AS (
  SELECT row_number() OVER () AS n, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.n, c.n AS m, a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM w a JOIN w c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT n, m, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.n, p.m ORDER BY score DESC, vec_id, s.m) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.n = p.n AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
}
