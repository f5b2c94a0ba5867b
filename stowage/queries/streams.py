"""Codecs, blocks and archives over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import archives, blocks, codecs
from .common import Registry, table

R = Registry()
BLOCK, TRIP_BLOCK = 1024, 64 << 10


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))


def round_trip(codec: str, level: str):
    """Texts cut into blocks, encoded block by block, put together as streams
    (brotli stays rows of blocks), and decoded."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = docs(spark, sf_dir)
        if codec in blocks.BLOCK_CODECS:
            back = codecs.decode_column(blocks.encode_streams(d, "doc_id", "raw", codec, level, TRIP_BLOCK), "data", "out", codec)
        else:
            encoded = blocks.encode_blocks(blocks.block_rows(d, "doc_id", "raw", TRIP_BLOCK), codec, level)
            back = blocks.joined(blocks.decode_blocks(encoded, codec)).select("stream_id", F.col("data").alias("out"), F.lit(None).cast("string").alias("out_error"))
        back = back.select(F.col("stream_id").alias("doc_id"), F.octet_length("out").cast("long").alias("length"), F.sha2("out", 256).alias("sha256"), F.col("out_error").alias("error"))
        return d.select("doc_id").join(back, "doc_id", "left")

    return query


for _codec in codecs.CODECS:
    for _level in ("fast", "best", "edge"):
        _name = f"q_roundtrip_{_codec}_{_level}"
        R.queries[_name] = round_trip(_codec, _level)
        R.oracles[_name] = "SELECT doc_id, strlen(text) AS length, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents"


@R.add("SELECT doc_id, c.codec, sha256(text || source) AS sha256 FROM documents, (VALUES ('gzip'), ('bzip2'), ('xz'), ('zstd'), ('lz4')) c(codec)")
def q_concat_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of a codec, one after the other, decode as one."""
    out = None
    for codec in ("gzip", "bzip2", "xz", "zstd", "lz4"):
        d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("a"), F.col("source").cast("binary").alias("b"))
        d = codecs.encode_column(codecs.encode_column(d, "a", "x", codec, "fast"), "b", "y", codec, "fast")
        d = codecs.decode_column(d.select("doc_id", F.concat("x", "y").alias("xy")), "xy", "data", codec, "failfast")
        part = d.select("doc_id", F.lit(codec).alias("codec"), F.sha2("data", 256).alias("sha256"))
        out = part if out is None else out.unionByName(part)
    return out


@R.add("SELECT doc_id, c.codec, true AS detected FROM documents, (VALUES ('gzip'), ('bzip2'), ('xz'), ('zstd'), ('lz4')) c(codec) WHERE text IS NOT NULL")
def q_corrupt_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream cut short is an error in its row, not of the query."""
    out = None
    for codec in ("gzip", "bzip2", "xz", "zstd", "lz4"):
        d = codecs.encode_column(docs(spark, sf_dir), "raw", "x", codec, "fast").select("doc_id", F.expr("substring(x, 1, octet_length(x) - 5)").alias("x"))
        part = codecs.decode_column(d, "x", "data", codec).select("doc_id", F.lit(codec).alias("codec"), (F.col("data_error") == "io").alias("detected"))
        out = part if out is None else out.unionByName(part)
    return out


SQL_BLOCKS = f"""b AS (
  SELECT doc_id, strlen(text) AS n, unnest(range(0, greatest((strlen(text) + {BLOCK - 1}) // {BLOCK}, 1))) AS block_index FROM documents WHERE text IS NOT NULL
)"""


@R.add(f"""
WITH {SQL_BLOCKS}
SELECT doc_id, block_index, block_index = greatest((n + {BLOCK - 1}) // {BLOCK}, 1) - 1 AS last, least({BLOCK}, n - block_index * {BLOCK}) AS raw_len FROM b""")
def q_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_rows(docs(spark, sf_dir), "doc_id", "raw", BLOCK).select(F.col("stream_id").alias("doc_id"), "block_index", "last", "raw_len")


def _encoded(spark: SparkSession, sf_dir: str, codec: str, level: str = "best") -> DataFrame:
    return blocks.encode_blocks(blocks.block_rows(docs(spark, sf_dir), "doc_id", "raw", BLOCK), codec, level)


@R.add(f"""
WITH {SQL_BLOCKS}
SELECT count(*) FILTER (n > 0) AS n_blocks, CAST(sum(least({BLOCK}, n - block_index * {BLOCK})) AS BIGINT) AS raw_bytes, CAST(0 AS BIGINT) AS n_grown, CAST(0 AS BIGINT) AS n_misflagged FROM b""")
def q_lz4_stored_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block is stored as it is exactly when encoding makes it no smaller."""
    e = _encoded(spark, sf_dir, "lz4", "fast").where("raw_len > 0").withColumn("body", F.octet_length("payload") - 8)
    wrong = F.when(F.col("stored"), F.col("body") != F.col("raw_len")).otherwise(F.col("body") >= F.col("raw_len"))
    return e.agg(
        F.count("*").alias("n_blocks"), F.sum("raw_len").alias("raw_bytes"), F.count_if(F.col("body") > F.col("raw_len")).alias("n_grown"), F.count_if(wrong).alias("n_misflagged")
    )


def _assembled(codec: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _encoded(spark, sf_dir, codec)
        whole = docs(spark, sf_dir).where("raw is not null").select(F.col("doc_id").alias("stream_id"), F.col("raw").alias("data"))
        made = blocks.assemble_lz4(e, whole) if codec == "lz4" else blocks.assemble(e, codec)
        back = codecs.decode_column(made, "data", "out", codec, "failfast")
        return back.select(F.col("stream_id").alias("doc_id"), F.sha2("out", 256).alias("sha256"))

    return query


for _codec in blocks.BLOCK_CODECS:
    R.queries[f"q_assemble_{_codec}"] = _assembled(_codec)
    R.oracles[f"q_assemble_{_codec}"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL"


@R.add("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS length, true AS same FROM documents WHERE text IS NOT NULL")
def q_crc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each text out of its blocks', beside the one of the whole."""
    folded = blocks.crc32_of_blocks(_encoded(spark, sf_dir, "gzip", "fast"))
    whole = docs(spark, sf_dir).select(F.col("doc_id").alias("stream_id"), F.crc32("raw").alias("whole"))
    return folded.join(whole, "stream_id").select(F.col("stream_id").alias("doc_id"), "length", (F.col("crc32") == F.col("whole")).alias("same"))


# archives


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, an archive for each source and 500 ids, so that no
    archive grows with the table."""
    d = table(spark, sf_dir, "documents")
    archive = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 500).cast("string"))
    return d.select(
        archive.alias("archive"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("./docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").cast("binary").alias("content"), F.lit("file").alias("kind"), F.lit(0o4644).alias("mode"), F.lit(1_700_000_000).cast("long").alias("mtime"),
        F.lit(None).cast("string").alias("link_target"),
    )


SQL_DOCS = """d AS (
  SELECT source || '-' || (doc_id // 500) AS stem, './docs/' || lang || '/' || doc_id || '.txt' AS path, doc_id, text,
         row_number() OVER (PARTITION BY source, doc_id // 500 ORDER BY doc_id) - 1 AS ordinal FROM documents
)"""


def _packed(spark: SparkSession, sf_dir: str, container: str, codec: str | None, suffix: str) -> DataFrame:
    packed = archives.pack(doc_entries(spark, sf_dir), container, codec, "fast")
    return packed.withColumn("archive", F.concat("archive", F.lit(suffix)))


def _listed(container: str, codec: str | None, suffix: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return archives.read_entries(_packed(spark, sf_dir, container, codec, suffix)).select("archive", "ordinal", "path", "size", "is_dir", "error")

    return query


def _extracted(container: str, codec: str | None, suffix: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = archives.read_entries(_packed(spark, sf_dir, container, codec, suffix), with_content=True)
        out = archives.extract(e, ["docs/en", "docs/fr/"])
        return out.select("archive", "path", F.col("mode").cast("long").alias("mode"), F.sha2("content", 256).alias("sha256"), "error")

    return query


_FORMATS = {"tar": ("tar", None, ".tar"), "zip": ("zip", None, ".zip"), "tar_gz": ("tar", "gzip", ".tgz"), "tar_zst_sniff": ("tar", "zstd", ".zst"), "tar_lz4": ("tar", "lz4", ".tar.lz4")}
for _k, (_container, _codec, _suffix) in _FORMATS.items():
    R.queries[f"q_list_{_k}"] = _listed(_container, _codec, _suffix)
    R.oracles[f"q_list_{_k}"] = f"""
WITH {SQL_DOCS} SELECT stem || '{_suffix}' AS archive, ordinal, path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, false AS is_dir, CAST(NULL AS VARCHAR) AS error FROM d"""
    R.queries[f"q_extract_{_k}"] = _extracted(_container, _codec, _suffix)
    R.oracles[f"q_extract_{_k}"] = f"""
WITH {SQL_DOCS} SELECT stem || '{_suffix}' AS archive, substr(path, 8) AS path, CAST(420 AS BIGINT) AS mode, sha256(coalesce(text, '')) AS sha256, CAST(NULL AS VARCHAR) AS error
FROM d WHERE starts_with(path, './docs/en/') OR starts_with(path, './docs/fr/')"""


@R.add("SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.rar' ELSE '.txt' END AS archive, CASE WHEN doc_id % 3 = 0 THEN 'unsupported-operation' ELSE 'unknown-format' END AS error FROM documents")
def q_unreadable_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rar = F.col("doc_id") % 3 == 0
    data = F.when(rar, F.concat(F.lit(bytes.fromhex("526172211A0700")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    name = F.concat(F.col("doc_id").cast("string"), F.when(rar, F.lit(".rar")).otherwise(F.lit(".txt")))
    return archives.read_entries(d.select(name.alias("archive"), data.alias("data"))).select("archive", "error")


@R.add("SELECT doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def q_single_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codec alone, which holds no tar, is extracted as one file."""
    d = codecs.encode_column(docs(spark, sf_dir).where("raw is not null"), "raw", "data", "xz", "fast")
    e = archives.read_entries(d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt.xz")).alias("archive"), "data"), with_content=True)
    return e.select("path", F.sha2("content", 256).alias("sha256"))


@R.add(f"""
WITH {SQL_DOCS} SELECT stem || '.tar' AS archive, count(*) AS n, sha256(string_agg('{{"path":"' || path || '","size":' || strlen(coalesce(text, '')) || ',"is_dir":false}}', ',' ORDER BY ordinal)) AS listing_sha256
FROM d GROUP BY stem""")
def q_listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive's listing as JSON: its entries' objects in stored order."""
    e = archives.read_entries(_packed(spark, sf_dir, "tar", None, ".tar"))
    entry = F.to_json(F.struct("path", "size", "is_dir"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("j")))), lambda x: x["j"])
    return e.groupBy("archive").agg(F.count("*").alias("n"), F.sha2(F.array_join(rows, ","), 256).alias("listing_sha256"))


@R.add("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'mismatch' WHEN doc_id % 4 = 1 THEN 'absent' ELSE 'ok' END AS verdict FROM documents WHERE text IS NOT NULL""")
def q_content_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream decodes to, against the digest that its sidecar states
    for the content; the sidecar names the stream's own digest too."""
    d = codecs.encode_column(docs(spark, sf_dir).where("raw is not null"), "raw", "data", "zstd", "fast")
    i = F.col("doc_id")
    stated = F.when(i % 4 == 0, F.sha2(F.lit("other"), 256)).when(i % 4 > 1, F.sha2("raw", 256))
    d = d.select("doc_id", "data", digests.sidecar_text(F.sha2("data", 256), stated, F.lit("a.zst")).alias("sidecar"))
    d = codecs.decode_column(d, "data", "content", "zstd").withColumn("p", digests.parse_sidecar(F.col("sidecar"), F.lit("a.zst")))
    d = d.where(digests.verdict(F.col("p.artifact"), F.sha2("data", 256)) == "ok")
    return d.select("doc_id", digests.verdict(F.col("p.content"), F.sha2("content", 256)).alias("verdict"))


for _size in (64, 256):
    R.queries[f"q_lz4_blocks_{_size}k"] = (
        lambda spark, sf_dir, size=_size: codecs.decode_column(
            codecs.lz4_column(docs(spark, sf_dir), "raw", "data", size << 10), "data", "out", "lz4", "failfast"
        ).select("doc_id", F.sha2("out", 256).alias("sha256"))
    )
    R.oracles[f"q_lz4_blocks_{_size}k"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"
