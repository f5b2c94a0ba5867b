"""Digests, sidecars and their verification over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, formats, text
from ..operators import archives
from .common import SQL_NAMES, Registry, archive_names, pick, sql_pick, sql_suffix, table
from .streams import doc_entries

R = Registry()


@R.add("SELECT doc_id, sha256(coalesce(text, '')) AS artifact_sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length FROM documents")
def q_sha256_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(body, 256).alias("artifact_sha256"), F.octet_length(body).cast("long").alias("length"))


@R.add("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# content-sha256: ' || sha256(source) || chr(10) ELSE '' END || sha256(text) || '  doc_' || doc_id || '.gz' || chr(10) AS sidecar
FROM documents""")
def q_sidecar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 2 == 0, F.sha2("source", 256))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".gz"))
    return table(spark, sf_dir, "documents").select("doc_id", digests.sidecar_text(F.sha2("text", 256), content, name).alias("sidecar"))


#: Lines of sidecars, with {h} for the text's digest and {c} for the source's, and what they are read as: (artifact, content, error).
SIDECARS = [
    ("{h}  a.gz\n", "h", None, None),
    ("{H} *a.gz\n", "h", None, None),
    ("# content-sha256: {C}\n{h}  a.gz\n", "h", "c", None),
    ("\n# a comment\n\n{c}  other\n{h}  a.gz", "h", None, None),
    ("{c}  b.gz\n", None, None, "no-matching-entry"),
    ("nothex  a.gz\n", None, None, "malformed-artifact-digest"),
    ("# content-sha256: short\n{h}  a.gz\n", None, None, "malformed-content-digest"),
    ("{c}  a.gz\r\n{h}  a.gz\r\n", "h", None, None),
    ("", None, None, "no-matching-entry"),
]


@R.add(f"""
SELECT doc_id, CASE {sql_pick([s[1] for s in SIDECARS], "doc_id")} WHEN 'h' THEN sha256(text) END AS artifact,
       CASE {sql_pick([s[2] for s in SIDECARS], "doc_id")} WHEN 'c' THEN sha256(source) END AS content, {sql_pick([s[3] for s in SIDECARS], "doc_id")} AS error
FROM documents""")
def q_sidecar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, c = F.sha2("text", 256), F.sha2("source", 256)
    body = pick([s[0] for s in SIDECARS], F.col("doc_id"))
    for mark, value in (("{h}", h), ("{c}", c), ("{H}", F.upper(h)), ("{C}", F.upper(c))):
        body = F.replace(body, F.lit(mark), value)
    parsed = table(spark, sf_dir, "documents").select("doc_id", digests.parse_sidecar(body, F.lit("a.gz")).alias("p"))
    return parsed.select("doc_id", "p.artifact", "p.content", "p.error")


@R.add("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(source) ELSE upper(sha256(text)) END AS expected FROM documents WHERE doc_id % 3 > 0)
SELECT d.doc_id, CASE WHEN s.expected IS NULL THEN 'absent' WHEN lower(s.expected) = sha256(d.text) THEN 'ok' ELSE 'mismatch' END AS verdict
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def q_verify_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars, where an archive has one, joined to what the archives hold."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    sidecars = docs.where(i % 3 > 0).select("doc_id", F.when(i % 5 == 0, F.sha2("source", 256)).otherwise(F.upper(F.sha2("text", 256))).alias("expected"))
    j = docs.select("doc_id", F.sha2("text", 256).alias("actual")).join(sidecars, "doc_id", "left")
    return j.select("doc_id", digests.verdict(F.col("expected"), F.col("actual")).alias("verdict"))


_C, _K = sql_suffix("name", "container"), sql_suffix("name", "codec")


@R.add(f"""
WITH {SQL_NAMES}
SELECT page_id, CASE WHEN {_C} IS NULL AND {_K} IS NOT NULL THEN 'input' WHEN {_C} = 'tar' AND {_K} IS NOT NULL THEN 'tar' WHEN {_C} = 'tar' THEN 'artifact' END AS digest
FROM names""")
def q_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digests.content_digest_of(formats.format_of_name(F.col("name")), F.lit("input"), F.lit("tar"), F.lit("artifact"))
    return archive_names(spark, sf_dir).select("page_id", d.alias("digest"))


@R.add("""
WITH s AS (SELECT source || '-' || (doc_id // 500) || '.tar' AS archive, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS input_bytes,
                  CAST(sum(512 + (strlen(coalesce(text, '')) + 511) // 512 * 512) + 1024 AS BIGINT) AS output_bytes FROM documents GROUP BY 1)
SELECT archive, input_bytes, output_bytes, CASE WHEN input_bytes = 0 THEN 0 ELSE CAST(output_bytes AS DOUBLE) / CAST(input_bytes AS DOUBLE) END AS ratio FROM s""")
def q_ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives weigh against what went into them."""
    entries = doc_entries(spark, sf_dir)
    put_in = entries.groupBy("archive").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("input_bytes"))
    made = archives.pack(entries, "tar").select("archive", F.octet_length("data").cast("long").alias("output_bytes"))
    g = put_in.join(made, "archive").withColumn("archive", F.concat("archive", F.lit(".tar")))
    return g.withColumn("ratio", text.ratio(F.col("input_bytes"), F.col("output_bytes")))
