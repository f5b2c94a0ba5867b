"""Entries of archives: roots, trees, totals, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entries as ops
from .common import SQL_ENTRIES, Registry, page_entries, sql_parts, table

R = Registry()
_P = sql_parts("path")


@R.add(f"WITH {SQL_ENTRIES} SELECT archive, count(DISTINCT {_P}[1]) AS n_roots FROM entries GROUP BY archive")
def q_distinct_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_roots(page_entries(spark, sf_dir), ["archive"])


@R.add(f"""
WITH {SQL_ENTRIES}
SELECT archive, count(DISTINCT {_P}[1]) AS n_roots, regexp_extract(archive, '^(.+)\\.[^.]*$', 1) AS wrap_name, count(DISTINCT {_P}[1]) > 1 AS wraps FROM entries GROUP BY archive""")
def q_wrap_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.wrap_info(page_entries(spark, sf_dir))


SQL_TREE = f"""{SQL_ENTRIES}, e AS (SELECT archive, ordinal, size, is_dir, {_P} AS parts FROM entries WHERE len({_P}) > 0),
n AS (
  SELECT archive, ordinal, size, is_dir, unnest(range(1, len(parts) + 1)) AS depth, parts FROM e
), o AS (
  SELECT archive, array_to_string(parts[1:depth], '/') AS path, depth, ordinal, depth = len(parts) AS own, is_dir, size FROM n
), tree AS (
  SELECT archive, path, depth, string_split(path, '/')[-1] AS name, min_by(NOT own OR is_dir, ordinal) OR bool_or(own AND is_dir) AS is_dir,
         coalesce(max_by(size, ordinal) FILTER (own AND NOT is_dir), 0) AS size
  FROM o GROUP BY archive, path, depth
)"""


@R.add(f"WITH {SQL_TREE} SELECT archive, path, name, depth, is_dir, CAST(size AS BIGINT) AS size FROM tree")
def q_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tree(page_entries(spark, sf_dir))


_SHOWN = "len(list_filter(string_split(t.path, '/'), lambda c: starts_with(c, '.') OR c = '__MACOSX' OR lower(c) IN ('thumbs.db', 'desktop.ini'))) = 0"


@R.add(f"""
WITH {SQL_TREE}
SELECT archive, count(*) FILTER ({_SHOWN} AND NOT is_dir) AS files, count(*) FILTER ({_SHOWN} AND is_dir) AS folders, CAST(coalesce(sum(size) FILTER (NOT is_dir), 0) AS BIGINT) AS total
FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree f WHERE f.archive = t.archive AND NOT f.is_dir AND starts_with(t.path, f.path || '/'))
GROUP BY archive""")
def q_tree_visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tree_counts(ops.tree(page_entries(spark, sf_dir)))


_RUNS = "regexp_extract_all(lower(string_split(path, '/')[k]), '[0-9]+|[^0-9]+')"
_COUNTED = "CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CAST(length(regexp_replace(r, '^0+([0-9])', '\\1')) AS VARCHAR), 9, '0') || regexp_replace(r, '^0+([0-9])', '\\1') ELSE r END"
SQL_SHOWN = f"""{SQL_TREE}, reached AS (
  SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree f WHERE f.archive = t.archive AND NOT f.is_dir AND starts_with(t.path, f.path || '/'))
), levels AS (
  SELECT archive, path, depth, is_dir, unnest(range(1, depth + 1)) AS k FROM reached
), keys AS (
  SELECT archive, path, is_dir, list(CASE WHEN k = depth AND NOT is_dir THEN '1' ELSE '0' END || chr(1) || array_to_string(list_transform({_RUNS}, lambda r: {_COUNTED}), '') || chr(1) || string_split(path, '/')[k] ORDER BY k) AS sort
  FROM levels GROUP BY archive, path, is_dir
), shown AS (
  SELECT archive, path, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS parent, is_dir, row_number() OVER (PARTITION BY archive ORDER BY sort) AS position FROM keys
)"""


@R.add(f"WITH {SQL_SHOWN} SELECT archive, path, parent, is_dir, position FROM shown")
def q_tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tree_rows(ops.tree(page_entries(spark, sf_dir))).select("archive", "path", "parent", "is_dir", "position")


@R.add(f"WITH {SQL_SHOWN} SELECT archive, path, position FROM shown WHERE position <= 5000")
def q_tree_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a preview, which ends after 5000 of an archive."""
    return ops.tree_rows(ops.tree(page_entries(spark, sf_dir)), limit=5000).select("archive", "path", "position")


@R.add(f"""
WITH {SQL_ENTRIES}
SELECT archive, count(*) AS files, CAST(sum(size) AS BIGINT) AS original, CAST(sum(size) AS DOUBLE) / count(*) AS average,
       CASE WHEN count(*) = 1 THEN 'File size' ELSE 'Avg file size' END AS label
FROM entries WHERE NOT is_dir GROUP BY archive""")
def q_footer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.footer(page_entries(spark, sf_dir), ["archive"])


@R.add(f"""
WITH {SQL_ENTRIES}, k AS (SELECT *, NOT (starts_with(path, '.cache/') OR ends_with(path, '.html')) AS kept FROM entries)
SELECT count(*) FILTER (kept) AS n_included, count(*) FILTER (NOT kept) AS n_excluded, CAST(coalesce(sum(size) FILTER (kept AND NOT is_dir), 0) AS BIGINT) AS bytes FROM k""")
def q_excluded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return ops.included(page_entries(spark, sf_dir), ~(p.startswith(".cache/") | p.endswith(".html")))


@R.add(f"WITH {SQL_ENTRIES} SELECT string_split(path, '/')[-1] AS base, count(*) AS n FROM entries GROUP BY 1 HAVING count(*) > 1")
def q_dup_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicate_bases(page_entries(spark, sf_dir))


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names as files for each site: some at a root that it has."""
    sites = page_entries(spark, sf_dir).select("archive").distinct()
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ordinal"), F.lower("n_name").alias("file"), F.octet_length("n_name").cast("long").alias("size"))
    n = n.withColumn("path", F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("guide/"), F.col("file"))).otherwise(F.col("file")))
    n = n.withColumn("prefix", F.when(F.col("ordinal") % 5 == 0, F.lit("docs")).otherwise(F.lit("")))
    wanted = sites.select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("ordinal"))
    return wanted.join(n, "ordinal").select("archive", "ordinal", "path", "size", F.lit(False).alias("is_dir"), "prefix")


@R.add(f"""
WITH {SQL_ENTRIES}, added AS (
  SELECT archive, CAST(n_nationkey AS BIGINT) AS ordinal, CASE WHEN n_nationkey % 5 = 0 THEN 'docs/guide/' ELSE '' END || lower(n_name) AS path, strlen(n_name) AS size, false AS is_dir, 1 AS added
  FROM (SELECT DISTINCT archive FROM entries) CROSS JOIN nation
), kept AS (
  SELECT *, 0 AS added FROM entries WHERE NOT ({_P}[1:2] = ['docs', 'guide'] OR {_P}[1] IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 5 > 0))
), b AS (SELECT * FROM kept UNION ALL BY NAME SELECT * FROM added)
SELECT archive, path, CAST(size AS BIGINT) AS size, row_number() OVER (PARTITION BY archive ORDER BY CASE WHEN {_P}[1] <> '..' THEN {_P}[1] END NULLS FIRST, added, ordinal) - 1 AS ordinal
FROM b""")
def q_archive_add_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _ = ops.merge(page_entries(spark, sf_dir), _added(spark, sf_dir), replace=True)
    return merged.select("archive", "path", "size", "ordinal")


@R.add(f"""
WITH {SQL_ENTRIES}
SELECT archive, ordinal, path FROM entries WHERE {_P}[1:2] = ['docs', 'guide'] OR {_P}[1] IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 5 > 0)""")
def q_archive_add_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, clashes = ops.merge(page_entries(spark, sf_dir), _added(spark, sf_dir))
    return clashes.select("archive", "ordinal", "path")


@R.add("""
SELECT 'pages/' || page_id AS rel, strlen(html) AS size FROM pages UNION ALL SELECT 'pages', 0 UNION ALL
SELECT 'benchmark/' || item_id, strlen(text) FROM benchmark UNION ALL SELECT 'benchmark', 0""")
def q_collect_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as folders of files, packed side by side."""

    def folder(name: str, key: str, body: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        top = t.limit(1).select(F.lit("").alias("rel"), F.lit(0).cast("long").alias("size"))
        return t.select(F.col(key).cast("string").alias("rel"), F.octet_length(body).cast("long").alias("size")).union(top)

    trees = [("in/pages/", folder("pages", "page_id", "html")), ("benchmark", folder("benchmark", "item_id", "text"))]
    return ops.collect_many(trees).select("rel", "size")




@R.add(f"""
WITH {SQL_TREE}
SELECT archive, path, row_number() OVER (PARTITION BY archive ORDER BY length(path) DESC, path) AS position FROM tree WHERE is_dir""")
def q_dir_mode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders as their modes are set: the deepest first."""
    return ops.deepest_first(ops.tree(page_entries(spark, sf_dir)))
