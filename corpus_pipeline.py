"""From raw documents to token ids: filter, identify, de-duplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes every stage's result to the shared folder before the next
one reads it, so a lost executor never repeats more than one stage.
"""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import dart_minhash, hd_language, pu_quality, sentence_pieces, source_mix
from palisade.llm.common import crc_remainder, free_name, table
from palisade.session import stored

#: A document less like every language than this is no text of any: five standard deviations of the
#: cosine of unrelated vectors.
LEAST_LANGUAGE_SCORE = 5 / math.sqrt(hd_language.DIMENSION)
#: Texts of fewer letters may score lower than that. Such a text has to reach this percentile of the
#: training documents of its length, if that is lower.
SHORT_LETTERS, SHORT_PERCENTILE = 32, 0.01


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's rows, predicts to be good."""
    remainder = crc_remainder("doc_id", 5)
    model = pu_quality.train(
        docs.where(remainder != 0), table(spark, sf_dir, "labels").where(remainder != 0)
    )
    return pu_quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def least_language_score(training: DataFrame, prototypes: dict) -> Column:
    """The least score, by the number of letters in ``text``, of a document in a learned language."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    kind = F.length(F.bin(letters))  # by powers of two
    short = training.where(F.col("lang").isNotNull() & (letters > 0) & (letters < SHORT_LETTERS))
    scored = hd_language.predict(short.select("text"), prototypes)
    # In thousandths, so that the exact percentile keeps few distinct values.
    reached = scored.groupBy(kind.alias("kind")).agg(
        F.percentile(F.floor(F.col("score") * 1000), SHORT_PERCENTILE).alias("reached")
    ).collect()
    least = F.lit(LEAST_LANGUAGE_SCORE)
    for row in reached:  # one for each power of two below SHORT_LETTERS
        known = min(row["reached"] / 1000, LEAST_LANGUAGE_SCORE)
        least = F.when((letters < SHORT_LETTERS) & (kind == row["kind"]), known).otherwise(least)
    return least


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; their ``lang`` stays what the table says."""
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    training = docs.where(~held_out)
    prototypes = hd_language.learn(training)
    named = hd_language.predict(docs, prototypes)
    good = (F.col("lang_pred") != hd_language.UNKNOWN) & (
        F.col("score") >= least_language_score(training, prototypes))
    return named.where(good).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return dart_minhash.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return source_mix.repeated(source_mix.mix(docs)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in the text's place."""
    pieces = sentence_pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    ids = free_name(docs.columns, "ids")
    encoded = sentence_pieces.encode(docs, pieces, to=ids)
    return encoded.select(
        *(c for c in docs.columns if c != "text"), F.col(ids), F.size(ids).cast("long").alias(
            free_name(docs.columns, "n_tokens"))
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: No SQL for learned models and signatures; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
