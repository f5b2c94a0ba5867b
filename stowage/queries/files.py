"""Folders and archives as files: walked, packed, published, added to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, paths
from ..operators import archives, blocks
from ..operators import entries as ops
from ..shared import fresh_path, small_batches, written
from ..sources import register
from ..sources.tree import store
from .common import Registry, table
from .streams import BLOCK, SQL_BLOCKS, SQL_DOCS, doc_entries, docs

R = Registry()


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (rel, content) below `folder`. A repeated task writes the
    same bytes again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs.create_dir(f"{base}/{rel}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{base}/{rel}", compression=None) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    small_batches(files.sparkSession)
    files.select("rel", F.col("content").cast("binary").alias("content")).mapInArrow(rows, "n long").write.format("noop").mode("overwrite").save()


# walks

#: The ignore files of the folder, and what is left out besides.
IGNORE = {".gitignore": "*.log\n/de/src1/\n", "fr/.gitignore": "!*.log\n"}
EXCLUDE = "*7.txt"


def tree_folder(spark: SparkSession, sf_dir: str) -> str:
    """Documents as files by language and source, some of them logs, with
    ignore files."""
    folder = fresh_path(spark, "tree")
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("n_chars") % 3 == 0, F.lit(".log")).otherwise(F.lit(".txt"))
    write_files(d.select(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("rel"), F.col("text").alias("content")), folder)
    write_files(spark.createDataFrame(list(IGNORE.items()), "rel string, content string"), folder)
    return folder


def walked(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tree").options(exclude=EXCLUDE, **options).load(tree_folder(spark, sf_dir))


_DOC = "lang || '/' || source || '/' || doc_id || CASE WHEN n_chars % 3 = 0 THEN '.log' ELSE '.txt' END"
_KEPT = "NOT (lang = 'de' AND source = 'src1') AND NOT (n_chars % 3 <> 0 AND doc_id % 10 = 7) AND (n_chars % 3 <> 0 OR lang = 'fr')"
SQL_WALK = f"""walk AS (
  SELECT {_DOC} AS rel, false AS is_dir, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, {_KEPT} AS included FROM documents
  UNION ALL SELECT DISTINCT lang || '/' || source, true, 0, NOT (lang = 'de' AND source = 'src1') FROM documents
  UNION ALL SELECT DISTINCT lang, true, 0, true FROM (SELECT lang FROM documents UNION SELECT 'fr')
  UNION ALL VALUES ('.gitignore', false, 16, true), ('fr/.gitignore', false, 7, true)
)"""


@R.add(f"WITH {SQL_WALK} SELECT rel, is_dir, size, included FROM walk")
def q_tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir).select("rel", "is_dir", "size", "included")


@R.add(f"WITH {SQL_WALK} SELECT rel, size FROM walk WHERE included")
def q_tree_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left out isn't walked."""
    return walked(spark, sf_dir, only_included="true").select("rel", "size")


@R.add(f"""
WITH {SQL_WALK}
SELECT count(*) FILTER (included) AS n_included, count(*) FILTER (NOT included) AS n_excluded, CAST(sum(size) FILTER (included) AS BIGINT) AS bytes, count(*) AS n_entries, CAST(sum(size) AS BIGINT) AS input_size
FROM walk""")
def q_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = walked(spark, sf_dir)
    kept = F.col("included")
    return w.agg(
        F.count_if(kept).alias("n_included"), F.count_if(~kept).alias("n_excluded"), F.sum(F.when(kept & ~F.col("is_dir"), F.col("size"))).cast("long").alias("bytes"),
        F.count("*").alias("n_entries"), F.sum("size").cast("long").alias("input_size"),
    )


# archives as files


def publish(packed: DataFrame, folder: str, mode: str = "append") -> None:
    register(packed.sparkSession)
    packed.select("archive", "data").write.format("archives").mode(mode).option("sidecar", "true").save(folder)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, data, verdict): the archives of a folder, each held against
    its sidecar."""
    files = spark.read.format("binaryFile").load(folder).select(paths.base_name(F.col("path")).alias("name"), F.col("content"))
    side = files.where(F.endswith("name", F.lit(".sha256"))).select(F.regexp_replace("name", r"\.sha256$", "").alias("archive"), F.col("content").cast("string").alias("sidecar"))
    blobs = files.where(~F.endswith("name", F.lit(".sha256"))).select(F.col("name").alias("archive"), F.col("content").alias("data"))
    stated = digests.parse_sidecar(F.col("sidecar"), F.col("archive")).getField("artifact")
    return blobs.join(side, "archive", "left").select("archive", "data", digests.verdict(stated, F.sha2("data", 256)).alias("verdict"))


def doc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.pack(doc_entries(spark, sf_dir), "tar", "gzip", "fast").withColumn("archive", F.concat("archive", F.lit(".tgz")))


@R.add(f"WITH {SQL_DOCS} SELECT stem || '.tgz' AS archive, 'ok' AS verdict, count(*) AS n_entries FROM d GROUP BY stem")
def q_sink_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives published with sidecars, verified and listed from the folder."""
    folder = fresh_path(spark, "published")
    publish(doc_archives(spark, sf_dir), folder)
    found = published(spark, folder)
    listed = archives.read_entries(found).where("error IS NULL").groupBy("archive").agg(F.count("*").alias("n_entries"))
    return found.drop("data").join(listed, "archive").select("archive", "verdict", "n_entries")


@R.add(f"""
WITH {SQL_DOCS}
SELECT stem || '.tgz' AS archive, CASE WHEN starts_with(path, './docs/en/') THEN substr(path, 3) ELSE path END AS path, 'ok' AS verdict,
       sha256(CASE WHEN starts_with(path, './docs/en/') THEN stem ELSE coalesce(text, '') END) AS sha256 FROM d""")
def q_archive_add_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published archives are read, English documents replaced in them, and
    the archives and their sidecars published anew."""
    folder = fresh_path(spark, "published")
    publish(doc_archives(spark, sf_dir), folder)
    # read once: the keys of what is added, the clashes and what is kept all come of it
    old = written(archives.read_entries(published(spark, folder), with_content=True).drop("error", "is_dir", "size"), "entries")
    stem = F.regexp_replace("archive", r"\.tgz$", "")
    english = old.where(F.startswith("path", F.lit("./docs/en/")))
    new = english.select(*(c for c in old.columns if c not in ("path", "content")), paths.base_name(F.col("path")).alias("path"), stem.cast("binary").alias("content"), F.lit("docs/en").alias("prefix"))
    merged, _ = ops.merge(old, new, replace=True)
    publish(archives.pack(merged, "tar", "gzip", "fast"), folder, "overwrite")
    found = published(spark, folder)
    entries = archives.read_entries(found, with_content=True).select("archive", "path", F.sha2("content", 256).alias("sha256"))
    return entries.join(found.select("archive", "verdict"), "archive").select("archive", "path", "verdict", "sha256")


@R.add("""
SELECT 'part-' || page_id // 500 || '.zip' AS archive, 'pages/' || page_id AS path, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, false AS is_dir FROM pages
UNION ALL SELECT 'part-' || item_id // 500 || '.zip', 'benchmark/' || item_id, strlen(coalesce(text, '')), false FROM benchmark
UNION ALL SELECT 'part-0.zip', 'pages/', 0, true UNION ALL SELECT 'part-0.zip', 'benchmark/', 0, true""")
def q_compress_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders packed side by side, each below its own name."""

    def folder(name: str, key: str, body: str) -> DataFrame:
        t = table(spark, sf_dir, name).select(F.col(key).cast("string").alias("rel"), F.col(body).cast("binary").alias("content"), F.floor(F.col(key) / 500).alias("part"), F.lit("file").alias("kind"))
        return t.union(spark.range(1).select(F.lit(""), F.lit(None).cast("binary"), F.lit(0).cast("long"), F.lit("dir")))

    both = ops.collect_many([("in/pages/", folder("pages", "page_id", "html")), ("in/benchmark", folder("benchmark", "item_id", "text"))])
    none = F.lit(None)
    entries = both.select(
        F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".zip")).alias("archive"), F.xxhash64("rel").alias("ordinal"), F.col("rel").alias("path"), "content", "kind",
        none.cast("int").alias("mode"), none.cast("long").alias("mtime"), none.cast("string").alias("link_target"),
    )
    return archives.read_entries(archives.pack(entries, "zip", level="fast")).select("archive", "path", "size", "is_dir")


@R.add(f"""
WITH {SQL_DOCS}
SELECT stem || '.tar' AS archive, substr(path, 3) AS path, 'file' AS kind, CASE WHEN starts_with(path, './docs/fr/') THEN 'path-traversal' END AS error FROM d
UNION ALL SELECT DISTINCT stem || '.tar', 'docs/fr', 'symlink', NULL FROM d""")
def q_below_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive has a link where others of its entries lie below: these
    aren't written through it."""
    files = doc_entries(spark, sf_dir)
    link = files.select("archive").distinct().select(
        "archive", F.lit(-1).cast("long").alias("ordinal"), F.lit("docs/fr").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit("symlink").alias("kind"),
        F.lit(None).cast("int").alias("mode"), F.lit(None).cast("long").alias("mtime"), F.lit("en").alias("link_target"),
    )
    packed = archives.pack(files.unionByName(link), "tar").withColumn("archive", F.concat("archive", F.lit(".tar")))
    return archives.extract(archives.read_entries(packed, with_content=True)).select("archive", "path", "kind", "error")


def _decoded(codec: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Blocks of a codec decode one by one, whatever a stream's length."""
        cut = blocks.block_rows(docs(spark, sf_dir), "doc_id", "raw", BLOCK)
        back = blocks.decode_blocks(blocks.encode_blocks(cut, codec, "fast"), codec)
        return back.select(F.col("stream_id").alias("doc_id"), "block_index", F.sha2("raw", 256).alias("sha256"))

    return query


for _codec in blocks.BLOCK_CODECS:
    R.queries[f"q_decode_blocks_{_codec}"] = _decoded(_codec)
    R.oracles[f"q_decode_blocks_{_codec}"] = f"""
WITH {SQL_BLOCKS} SELECT doc_id, block_index, sha256(unhex(substr(hex(encode(text)), 2 * {BLOCK} * block_index + 1, 2 * {BLOCK}))) AS sha256 FROM b JOIN documents USING (doc_id)"""

