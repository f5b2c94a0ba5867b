"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import langid, lines, packing, quality, simhash
from stowage.llm.common import short_batches, written

WORD_IDS = public_tokenizers.path("word_bpe_49k.json")
#: A document whose nearest language scores less lies between learned ones. Those that are in none go by the model's floors.
MIN_LANGUAGE_SCORE = 0.5


# Each stage reads whole texts, however long, takes every row as a document of its own (rows with equal or null ids too), passes
# columns through whatever their names, and gives no rows for an empty table. All but the last return the columns of `docs`.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and are near enough to their
    language's references, which are learned from `docs`. Null and empty texts
    fail the base rule; a null language is held against the nearest one; a
    distance that equals its limit is within it; repeated rows fare alike."""
    short_batches(spark)
    return quality.judge(docs, quality.learn(docs), only_kept=True)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that is learned from the labels of `docs`:
    near one, and as probable in it as its own documents are. Null and empty
    texts and texts without letters go; a null label teaches nothing; of
    equally probable languages the earlier name is taken; repeated rows fare
    alike."""
    short_batches(spark)
    return langid.predict(docs, langid.train(docs, floors=True), keep=MIN_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents of different texts or more share;
    n_chars follows the text. Copies are left to near_dedup, which keeps one:
    repeated rows and texts count once. A null text becomes an empty one; a
    document all of whose lines go stays as an empty text."""
    short_batches(spark)
    kept = lines.drop_repeated_lines(docs, count_copies=False, with_counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: those whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more, found by
    their fingerprints. Null and empty texts are equal. The smallest id stays,
    null ids last; of several rows with it the text that hashes least, and of
    repeated rows one."""
    short_batches(spark)
    return simhash.keep_first(docs, width=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of up to 2048 tokens; a null or empty
    text is the end token alone, and repeated rows are packed each. Its rows
    are pieces of documents, with columns of their own."""
    short_batches(spark)
    return packing.pack(docs, WORD_IDS)


STAGES = [("quality", quality_rules), ("language", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: The stages' models and fingerprints aren't expressible in SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
