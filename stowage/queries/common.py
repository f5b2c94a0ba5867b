"""Derived columns that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None):
        def named(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index):
    """values[index % n], null for a null index."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (index % len(values) + 1).cast("int"))


def sql_pick(values: list, index: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {sql_text(v)}" for k, v in enumerate(values))
    return f"(CASE {index} % {len(values)} {whens} END)"


def sql_text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


#: The suffixes of made-up archive names: all known ones, none, and an unknown one.
NAME_SUFFIXES = (
    ".tar.gz .tar.bz2 .tar.xz .tar.zst .tar.lz4 .tar.br .tgz .tbz2 .txz .tzst .tar .gz .bz2 .xz .zst .lz4 .br .zip .7z .rar".split() + ["", ".unknown"]
)


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a name made of the id: all suffixes, some in upper case."""
    i = F.col("page_id")
    name = F.concat(F.lit("page_"), i.cast("string"), pick(NAME_SUFFIXES, i))
    return table(spark, sf_dir, "pages").withColumn("name", F.when(i % 3 == 0, F.upper(name)).otherwise(name))


_name = f"'page_' || page_id || {sql_pick(NAME_SUFFIXES, 'page_id')}"
SQL_NAMES = f"names AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN upper({_name}) ELSE {_name} END AS name FROM pages)"


# The SQL states formats by itself, so that a wrong entry in the tables of `functions.formats` shows.

_KNOWN = "\\.(?:tar(?:\\.(?:gz|bz2|xz|zst|lz4|br))?|tgz|tbz2|txz|tzst|gz|bz2|xz|zst|lz4|br|zip|7z|rar)$"


def sql_suffix(name: str, what: str) -> str:
    """what: suffix, container or codec, of a name's suffix."""
    s = f"nullif(regexp_extract(lower({name}), '{_KNOWN}'), '')"
    if what == "suffix":
        return s
    if what == "container":
        return f"(CASE WHEN {s} LIKE '.t%' THEN 'tar' WHEN {s} IN ('.zip', '.7z', '.rar') THEN substr({s}, 2) END)"
    return f"(CASE regexp_extract({s}, '(gz|bz2|xz|zst|lz4|br)$') WHEN 'gz' THEN 'gzip' WHEN 'bz2' THEN 'bzip2' WHEN 'xz' THEN 'xz' WHEN 'zst' THEN 'zstd' WHEN 'lz4' THEN 'lz4' WHEN 'br' THEN 'brotli' END)"


def sql_known(name: str) -> str:
    return f"({sql_suffix(name, 'suffix')} IS NOT NULL)"


def sql_magic(blob: str, what: str) -> str:
    h = f"hex({blob})"
    if what == "codec":
        return (
            f"(CASE WHEN {h} LIKE '1F8B%' THEN 'gzip' WHEN {h} LIKE '425A68%' THEN 'bzip2' WHEN {h} LIKE 'FD377A585A00%' THEN 'xz' "
            f"WHEN {h} LIKE '28B52FFD%' THEN 'zstd' WHEN {h} LIKE '04224D18%' THEN 'lz4' END)"
        )
    return (
        f"(CASE WHEN {h} LIKE '504B0304%' OR {h} LIKE '504B0506%' THEN 'zip' WHEN {h} LIKE '377ABCAF271C%' THEN '7z' "
        f"WHEN {h} LIKE '526172211A0700%' OR {h} LIKE '526172211A070100%' THEN 'rar' WHEN substr({h}, 515, 10) = '7573746172' THEN 'tar' END)"
    )


def sql_alias(text: str, what: str) -> str:
    layered = sql_suffix("'x.' || " + text, what)
    if what == "container":
        return f"(CASE lower({text}) WHEN 'tar' THEN 'tar' WHEN 'zip' THEN 'zip' WHEN '7z' THEN '7z' WHEN 'sevenz' THEN '7z' WHEN 'rar' THEN 'rar' ELSE {layered} END)"
    return (
        f"(CASE WHEN lower({text}) IN ('gzip', 'gz') THEN 'gzip' WHEN lower({text}) IN ('bzip2', 'bz2') THEN 'bzip2' WHEN lower({text}) = 'xz' THEN 'xz' "
        f"WHEN lower({text}) IN ('zstd', 'zst') THEN 'zstd' WHEN lower({text}) = 'lz4' THEN 'lz4' WHEN lower({text}) IN ('brotli', 'br') THEN 'brotli' ELSE {layered} END)"
    )


def sql_short(codec: str) -> str:
    return f"(CASE {codec} WHEN 'gzip' THEN 'gz' WHEN 'bzip2' THEN 'bz2' WHEN 'xz' THEN 'xz' WHEN 'zstd' THEN 'zst' WHEN 'lz4' THEN 'lz4' WHEN 'brotli' THEN 'br' END)"


def sql_format_name(container: str, codec: str) -> str:
    return (
        f"(CASE WHEN {container} IS NOT NULL AND {codec} IS NOT NULL THEN {container} || '.' || {sql_short(codec)} "
        f"WHEN {container} IS NOT NULL THEN {container} ELSE {codec} END)"
    )


def sql_parts(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda c: c <> '' AND c <> '.')"


#: Pages as archive entries: a site is an archive, an address a path in it.
def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.regexp_extract(url, "://[^/?#]*/?([^?#]*)", 1)
    top = pick(["docs", "docs/guide", ".cache", "src", "src/Thumbs.db", "./docs", "__MACOSX"], F.col("page_id"))
    return table(spark, sf_dir, "pages").select(
        F.regexp_replace(host, "^.*\\.([^.]*\\.[^.]*)$", "$1").alias("archive"), F.col("page_id").alias("ordinal"),
        F.concat(top, F.lit("/"), path).alias("path"), F.octet_length("html").cast("long").alias("size"), path.endswith("/").alias("is_dir"),
    )


SQL_ENTRIES = f"""entries AS (
  SELECT regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*\\.([^.]*\\.[^.]*)$', '\\1') AS archive, page_id AS ordinal,
         {sql_pick(["docs", "docs/guide", ".cache", "src", "src/Thumbs.db", "./docs", "__MACOSX"], "page_id")} || '/' || regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS path,
         strlen(html) AS size, ends_with(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '/') AS is_dir
  FROM pages
)"""
