"""The numbered queries: each operator under its production parameters, over
its whole table, in the form that is compared. Null, empty and very long
values, ties, repeated rows, empty tables and further columns fare as the
operator's docstring states."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, langid, lines, packing, pieces, quality, simhash, tokencounts, urlfilter, warc

WORD_IDS = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; the pieces with a CRC-32 of their ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"), WORD_IDS)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back by their index."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's source, language and text, of one encoding of all three."""
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), BYTE_RANKS, ["source", "lang"])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, and their components at three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~F.coalesce(held_out(), F.lit(True))))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded: the number and hash of ids, the text's digest."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return pieces.with_decoded(encoded, PIECE_MODEL).select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of each page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, those dropped, and what is left, as a digest."""
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts, distances and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, quality.learn(docs)).drop("text", "lang")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links and component at a cosine of 0.9."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_warc, op3_token_counts, op4_simhash, op5_language, op6_sentencepiece, op7_url_filter, op8_line_dedup, op9_quality,
        op10_embedding_dedup,
    )
}
