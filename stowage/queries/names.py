"""Formats of names, bytes and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.formats import ALIASES, MAGIC, SHORT
from .common import (
    SQL_NAMES, Registry, archive_names, pick, sql_alias, sql_format_name, sql_known, sql_magic, sql_pick, sql_short, sql_suffix, table,
)

R = Registry()
C, K = sql_suffix("name", "container"), sql_suffix("name", "codec")
WORDS = [*ALIASES, "tar.gz", "TGZ", "Tar.Zst", "nope", ""]
HEADERS = [m[0] for m in MAGIC if m[1] == 0] + ["", "00"]


@R.add(f"""
WITH {SQL_NAMES}
SELECT coalesce({sql_format_name(C, K)}, 'unknown') AS format_name, count(*) AS n,
       count(DISTINCT nullif(string_split(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '/')[1], '')) AS n_roots
FROM names GROUP BY 1""")
def q_format_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.split(F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1), "/")[0]
    name = F.coalesce(formats.format_name(formats.format_of_name(F.col("name"))), F.lit("unknown"))
    return archive_names(spark, sf_dir).groupBy(name.alias("format_name")).agg(F.count("*").alias("n"), F.countDistinct(F.nullif(root, F.lit(""))).alias("n_roots"))


@R.add(f"WITH {SQL_NAMES} SELECT page_id, {C} AS container, {K} AS codec FROM names")
def q_ext_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = formats.format_of_name(F.col("name"))
    return archive_names(spark, sf_dir).select("page_id", f.getField("container").alias("container"), f.getField("codec").alias("codec"))


@R.add(f"""
WITH {SQL_NAMES}
SELECT page_id, {sql_suffix("name", "suffix")} AS suffix, left(name, CAST(length(name) - length({sql_suffix("name", "suffix")}) AS INTEGER)) AS stem FROM names""")
def q_split_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return archive_names(spark, sf_dir).select("page_id", formats.suffix_of(n).alias("suffix"), formats.stem_of_name(n).alias("stem"))


@R.add(f"""
WITH t AS (SELECT doc_id, {sql_pick(WORDS, "doc_id")} AS w FROM documents)
SELECT doc_id, {sql_alias("w", "container")} AS container, {sql_alias("w", "codec")} AS codec FROM t""")
def q_alias_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = formats.parse_format(pick(WORDS, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", f.getField("container").alias("container"), f.getField("codec").alias("codec"))


@R.add(f"""
WITH {SQL_NAMES}
SELECT page_id, {sql_format_name(C, K)} AS format_name,
       CASE WHEN {C} = 'tar' THEN '.tar' || coalesce('.' || {sql_short(K)}, '') WHEN {C} IS NOT NULL THEN '.' || {C} ELSE '.' || {sql_short(K)} END AS extension
FROM names""")
def q_format_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = formats.format_of_name(F.col("name"))
    return archive_names(spark, sf_dir).select("page_id", formats.format_name(f).alias("format_name"), formats.extension(f).alias("extension"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a format's first bytes; every 17th is a tar's header."""
    i = F.col("doc_id")
    text = F.encode("text", "UTF-8")
    tar = F.concat(F.unhex(F.lit("00" * 257)), F.lit(b"ustar"), text)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(i % 17 == 0, tar).otherwise(F.concat(F.unhex(pick(HEADERS, i)), text)).alias("data"))


_H = f"""h AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN from_hex('{"00" * 257}7573746172') || encode(text)
              ELSE from_hex({sql_pick(HEADERS, "doc_id")}) || encode(text) END AS data FROM documents)"""


@R.add(f"WITH {_H} SELECT doc_id, {sql_magic('data', 'container')} AS container, {sql_magic('data', 'codec')} AS codec FROM h")
def q_magic_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = formats.format_of_bytes(F.col("data"))
    return headers(spark, sf_dir).select("doc_id", f.getField("container").alias("container"), f.getField("codec").alias("codec"))


DETECT_NAMES = ["a.tar.gz", "a.tgz", "a.gz", "a.br", "a", "A.ZIP", "a.tar.zst", "a.rar", "a.txt"]
_N = sql_pick(DETECT_NAMES, "(doc_id // 3)")
_REFINES = "coalesce(mk = nk, false) OR coalesce(mc = nc, false)"


@R.add(f"""
WITH {_H}, b AS (
  SELECT doc_id, {sql_magic("data", "container")} AS mc, {sql_magic("data", "codec")} AS mk, {sql_suffix(_N, "container")} AS nc, {sql_suffix(_N, "codec")} AS nk FROM h
), f AS (
  SELECT doc_id, CASE WHEN (mc IS NOT NULL OR mk IS NOT NULL) AND NOT ({_REFINES}) THEN mc WHEN nc IS NOT NULL OR nk IS NOT NULL THEN nc ELSE mc END AS container,
         CASE WHEN (mc IS NOT NULL OR mk IS NOT NULL) AND NOT ({_REFINES}) THEN mk WHEN nc IS NOT NULL OR nk IS NOT NULL THEN nk ELSE mk END AS codec
  FROM b
)
SELECT doc_id, {sql_format_name("container", "codec")} AS format_name FROM f""")
def q_detect_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(DETECT_NAMES, F.floor(F.col("doc_id") / 3))
    return headers(spark, sf_dir).select("doc_id", formats.format_name(formats.detect(name, F.col("data"))).alias("format_name"))


CONTAINERS, PICKED = ["none", "tar", "zip", "7z"], [*SHORT, "nope", None]


@R.add(f"""
WITH t AS (SELECT doc_id, {sql_pick(CONTAINERS, "doc_id")} AS c, {sql_pick(PICKED, "(doc_id // 4)")} AS k FROM documents)
SELECT doc_id, CASE WHEN c IN ('zip', '7z') THEN c WHEN c = 'tar' THEN 'tar' || coalesce('.' || {sql_short("k")}, '')
                    WHEN {sql_short("k")} IS NOT NULL THEN k ELSE 'zstd' END AS format_name FROM t""")
def q_compose_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", formats.compose_format(pick(CONTAINERS, i), pick(PICKED, F.floor(i / 4))).alias("format_name"))


_NAMES = ["zip", "7z", "tar", *SHORT, *(f"tar.{v}" for v in SHORT.values()), "rar", ""]
_INNER = "(CASE WHEN n LIKE 'tar.%' THEN " + sql_suffix("'x' || substr(n, 4)", "codec") + " END)"


@R.add(f"""
WITH t AS (SELECT doc_id, {sql_pick(_NAMES, "doc_id")} AS n FROM documents)
SELECT doc_id, CASE WHEN n IN ('zip', '7z', 'tar') THEN n WHEN {_INNER} IS NOT NULL THEN 'tar' ELSE 'none' END AS container,
       CASE WHEN n IN ('zip', '7z', 'tar') THEN NULL WHEN {_INNER} IS NOT NULL THEN {_INNER} WHEN {sql_short("n")} IS NOT NULL THEN n ELSE 'zstd' END AS codec
FROM t""")
def q_decompose_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = formats.decompose_format(pick(_NAMES, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", d.getField("container").alias("container"), d.getField("codec").alias("codec"))


@R.add(f"""
WITH {SQL_NAMES}, f AS (SELECT page_id, page_id % 2 = 0 AS bundle, {C} AS c, {K} AS k FROM names WHERE {sql_known("name")})
SELECT page_id, {sql_format_name("CASE WHEN c IS NULL AND bundle THEN 'tar' ELSE c END", "k")} AS format_name,
       coalesce(CASE WHEN c IS NULL AND bundle THEN 'tar' ELSE c END IN ('tar', 'zip'), false) AS writable,
       CASE WHEN bundle THEN 'tar.zst' ELSE 'zstd' END AS default_name
FROM f""")
def q_promoted_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = F.col("page_id") % 2 == 0
    f = formats.promoted(formats.format_of_name(F.col("name")), bundle)
    known = archive_names(spark, sf_dir).where(formats.suffix_of(F.col("name")).isNotNull())
    return known.select("page_id", formats.format_name(f).alias("format_name"), formats.writable(f).alias("writable"), formats.default_format(bundle).alias("default_name"))


@R.add(f"""
WITH {_H}, r AS (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels), j AS (
  SELECT r.doc_id, h.doc_id IS NOT NULL AS present, octet_length(h.data) AS size, {sql_magic("h.data", "container")} AS c, {sql_magic("h.data", "codec")} AS k
  FROM r LEFT JOIN h ON r.doc_id = h.doc_id)
SELECT doc_id, present, c IS NOT NULL OR k IS NOT NULL AS is_archive, {sql_format_name("c", "k")} AS format_name, CAST(size AS BIGINT) AS size FROM j""")
def q_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id")).distinct()
    blobs = headers(spark, sf_dir).select("doc_id", F.lit(True).alias("there"), formats.format_of_bytes(F.col("data")).alias("f"), F.octet_length("data").cast("long").alias("size"))
    j = asked.join(blobs, "doc_id", "left")
    return j.select("doc_id", F.coalesce("there", F.lit(False)).alias("present"), F.col("f").isNotNull().alias("is_archive"), formats.format_name(F.col("f")).alias("format_name"), "size")


