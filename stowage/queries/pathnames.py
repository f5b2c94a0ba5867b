"""Entry paths, names, sizes and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from .common import SQL_NAMES, Registry, archive_names, pick, sql_parts, sql_pick, sql_suffix, table

R = Registry()

PATHS = [
    "docs/guide/intro.md", "./ok/file", "../evil", "/abs/evil", "foo/../../evil", "", ".", "./", "a//b/./c/", "C:\\evil", "..", "docs/.hidden/x", "__MACOSX/y",
    "pics/Thumbs.DB", "a/b\\.c", "docs/guidebook.md", "docs/guide", "readme.txt", "docs/../../x", "./docs/guide/deep/x.md",
]


def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a path: its source below one of PATHS."""
    p = pick(PATHS, F.col("doc_id"))
    return table(spark, sf_dir, "documents").withColumn("path", F.when(F.col("doc_id") % 3 == 0, p).otherwise(F.concat(p, F.lit("/"), F.col("source"))))


SQL_PATHS = f"""p AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN {sql_pick(PATHS, "doc_id")} ELSE {sql_pick(PATHS, "doc_id")} || '/' || source END AS path FROM documents)"""
_PARTS = sql_parts("path")
_BAD = f"(starts_with(path, '/') OR list_contains({_PARTS}, '..') OR len({_PARTS}) = 0)"


@R.add(f"""
WITH {SQL_PATHS}
SELECT doc_id, CASE WHEN NOT {_BAD} THEN array_to_string({_PARTS}, '/') END AS safe, CASE WHEN {_BAD} THEN 'path-traversal' END AS error,
       NOT starts_with(path, '/') AND len({_PARTS}) = 0 AND contains(path, '.') AS is_root
FROM p""")
def q_sanitize_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = paths.safe_path(F.col("path"))
    return doc_paths(spark, sf_dir).select("doc_id", s.getField("path").alias("safe"), s.getField("error").alias("error"), paths.is_root_entry(F.col("path")).alias("is_root"))


#: A page's path as a link, and another page's, some levels up, as what it points to.
_LINK = "regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1)"
SQL_LINKS = f"""l AS (
  SELECT page_id, {_LINK} AS link, CASE WHEN page_id % 11 = 0 THEN '/' ELSE '' END || repeat('../', CAST(page_id % 4 AS INTEGER)) || string_split(html, ' ')[1 + page_id % 3] || '/./' || {_LINK} AS target FROM pages
), s AS (
  SELECT page_id, starts_with(target, '/') AS absolute, list_transform({sql_parts("target")}, lambda c: [c]) AS steps, list_slice({sql_parts("link")}, 1, greatest(len({sql_parts("link")}) - 1, 0)) AS folder FROM l
), w AS (
  SELECT page_id, absolute, list_reduce(list_prepend(folder, steps), lambda a, c: CASE WHEN a = ['!'] OR (c = ['..'] AND len(a) = 0) THEN ['!'] WHEN c = ['..'] THEN a[1:len(a) - 1] ELSE list_concat(a, c) END) AS place FROM s
)"""


@R.add(f"WITH {SQL_LINKS} SELECT page_id, CASE WHEN NOT absolute AND place <> ['!'] THEN array_to_string(place, '/') END AS resolved FROM w")
def q_link_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, link = F.col("page_id"), F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)
    word = F.element_at(F.split("html", " "), (i % 3 + 1).cast("int"))
    target = F.concat(F.when(i % 11 == 0, F.lit("/")).otherwise(F.lit("")), F.repeat(F.lit("../"), (i % 4).cast("int")), word, F.lit("/./"), link)
    return table(spark, sf_dir, "pages").select("page_id", paths.resolve_link(link, target).alias("resolved"))


_CLEAN = f"array_to_string({_PARTS}, '/')"


@R.add(f"""
WITH {SQL_PATHS}, c AS (SELECT doc_id, {_CLEAN} AS c FROM p WHERE NOT starts_with(path, '/'))
SELECT doc_id, CASE WHEN c = 'docs/guide' OR starts_with(c, 'docs/guide/') THEN substr(c, 6) ELSE c END AS mapped
FROM c WHERE c = 'docs/guide' OR starts_with(c, 'docs/guide/') OR c = 'readme.txt' OR starts_with(c, 'readme.txt/') OR c = 'pics' OR starts_with(c, 'pics/')""")
def q_select_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = paths.select_path(F.col("path"), ["docs/guide/", "./readme.txt", "pics", "docs/guide/deep"])
    return doc_paths(spark, sf_dir).select("doc_id", mapped.alias("mapped")).where("mapped is not null")


_HIDDEN = "len(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda c: c <> '.' AND (starts_with(c, '.') OR c = '__MACOSX' OR lower(c) IN ('thumbs.db', 'desktop.ini')))) > 0"


@R.add(f"WITH {SQL_PATHS} SELECT doc_id, path, {_HIDDEN} AS hidden FROM p")
def q_hidden_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_paths(spark, sf_dir).select("doc_id", "path", paths.is_hidden(F.col("path")).alias("hidden"))


@R.add("SELECT page_id, url FROM pages WHERE contains(lower(url), 'the')")
def q_listing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(paths.matches_search(F.col("url"), F.lit("THE"))).select("page_id", "url")


_SUF = sql_suffix("name", "suffix")


@R.add(f"""
WITH {SQL_NAMES}
SELECT page_id, coalesce(nullif(left(name, CAST(length(name) - length({_SUF}) AS INTEGER)), ''),
       nullif(CASE WHEN regexp_matches(name, '(?s)^.+\\.[^.]*$') THEN regexp_extract(name, '(?s)^(.+)\\.[^.]*$', 1) ELSE name END, ''), 'extracted') AS wrap_name,
       name || '.sha256' AS sidecar
FROM names""")
def q_wrap_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return archive_names(spark, sf_dir).select("page_id", paths.wrap_dir_name(n).alias("wrap_name"), paths.sidecar_path(n).alias("sidecar"))


@R.add(f"""
WITH {SQL_PATHS}
SELECT doc_id, string_split(path, '/')[-1] AS base, regexp_replace(regexp_replace(path, '^(\\./)+', ''), '/+$', '') AS entry_key,
       CASE WHEN doc_id % 2 = 0 THEN {_CLEAN} ELSE array_to_string({_PARTS}[:-2], '/') END AS target,
       CASE WHEN NOT (starts_with(path, '/') OR list_contains({_PARTS}, '..')) THEN {_CLEAN} END AS prefix,
       coalesce(CASE WHEN NOT starts_with(path, '/') AND {_PARTS}[1] <> '..' THEN {_PARTS}[1] END, '-') AS root
FROM p""")
def q_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return doc_paths(spark, sf_dir).select(
        "doc_id", paths.base_name(p).alias("base"), paths.entry_key(p).alias("entry_key"), paths.drop_target(p, F.col("doc_id") % 2 == 0).alias("target"),
        paths.archive_prefix(p).alias("prefix"), F.coalesce(paths.first_component(p), F.lit("-")).alias("root"),
    )


@R.add(f"""
WITH {SQL_PATHS}
SELECT doc_id, path = 'docs/guide' OR starts_with(path, 'docs/guide/') AS clashes, {_PARTS}[1:2] = ['docs', 'guide'] AS inside, CAST(doc_id * 37 & 511 AS BIGINT) AS mode
FROM p""")
def q_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return doc_paths(spark, sf_dir).select(
        "doc_id", paths.clashes(p, F.lit("docs/guide")).alias("clashes"), paths.contains_itself(F.lit("/docs/guide/"), p).alias("inside"), paths.safe_mode(F.col("doc_id") * 37).alias("mode")
    )


STORED = [None, "notes.txt", "dir/inner.txt", "../up.txt", ""]
STREAMS = ["a.gz", "A.GZ", "b.tar.gz", ".gz", "plain"]
_ST, _IN = sql_pick(STREAMS, "doc_id"), sql_pick([None, "notes.txt", "inner.txt", "up.txt", None], "(doc_id // 5)")


@R.add(f"""
SELECT doc_id, coalesce({_IN}, CASE WHEN ends_with({_ST}, '.gz') THEN nullif(left({_ST}, CAST(length({_ST}) - 3 AS INTEGER)), '') END, {_ST} || '.out') AS out_name
FROM documents""")
def q_stream_output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = paths.stream_output_name(pick(STREAMS, i), F.lit("gzip"), pick(STORED, F.floor(i / 5)))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("out_name"))


# sizes and lines


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", (n * n * n).alias("n"), n.alias("ms"), "source")


_SIZES = "s AS (SELECT doc_id, n_chars * n_chars * n_chars AS n, n_chars AS ms, source FROM documents)"


def _fixed(n: str, den: str, digits: int) -> str:
    u = f"(({n}) * {2 * 10**digits} + ({den})) // (CAST(2 AS BIGINT) * ({den}))"
    return f"(({u}) // {10**digits} || '.' || lpad(CAST(({u}) % {10**digits} AS VARCHAR), {digits}, '0'))"


def _human(n: str) -> str:
    return (
        f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {_fixed(n, '1024', 1)} || ' KB' "
        f"WHEN {n} < 1073741824 THEN {_fixed(n, '1048576', 1)} || ' MB' ELSE {_fixed(n, '1073741824', 2)} || ' GB' END"
    )


def _binary(n: str) -> str:
    whens = " ".join(f"WHEN {n} < {1 << (k + 10)} THEN {_fixed(n, str(1 << k), 2)} || ' {u}'" for k, u in ((10, "KiB"), (20, "MiB"), (30, "GiB")))
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' {whens} ELSE {_fixed(n, str(1 << 40), 2)} || ' TiB' END"


_DUR = "CASE WHEN ms >= 60000 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' WHEN ms >= 1000 THEN (ms // 1000) || '.' || (ms % 1000 // 100) || 's' ELSE ms || 'ms' END"


@R.add(f"WITH {_SIZES} SELECT doc_id, {_human('n')} AS size FROM s")
def q_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("doc_id", text.human_bytes(F.col("n")).alias("size"))


@R.add(f"""
WITH {_SIZES}
SELECT doc_id, CASE WHEN n < 1000 THEN n || ' bytes' WHEN n < 1000000 THEN {_fixed("n", "1000", 1)} || ' KB' WHEN n < 1000000000 THEN {_fixed("n", "1000000", 1)} || ' MB'
                    WHEN n < 1000000000000 THEN {_fixed("n", "1000000000", 1)} || ' GB' ELSE {_fixed("n", "1000000000000", 1)} || ' TB' END AS size FROM s""")
def q_human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("doc_id", text.human_size(F.col("n")).alias("size"))


@R.add(f"WITH {_SIZES} SELECT doc_id, {_DUR} AS short, CASE WHEN ms < 1000 THEN ms || ' ms' ELSE {_fixed('ms', '1000', 2)} || ' s' END AS label FROM s")
def q_fmt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("ms")
    return sizes(spark, sf_dir).select("doc_id", text.duration(ms).alias("short"), text.duration_label(ms).alias("label"))


@R.add(f"""
WITH {SQL_PATHS}
SELECT doc_id, lpad(CAST(n_chars AS VARCHAR), 12, ' ') || '  ' || path || CASE WHEN doc_id % 4 = 0 AND NOT ends_with(path, '/') THEN '/' ELSE '' END AS line FROM p""")
def q_ls_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_paths(spark, sf_dir).select("doc_id", text.list_line(F.col("n_chars"), F.col("path"), F.col("doc_id") % 4 == 0).alias("line"))


@R.add("SELECT page_id, CASE WHEN length(url) <= 40 THEN url ELSE '…' || right(url, 39) END AS shown FROM pages")
def q_truncate_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.truncate_entry(F.col("url")).alias("shown"))


@R.add(f"""
WITH {_SIZES}
SELECT doc_id, 'extracted ' || n || ' entries to ' || source || '  in ' || {_DUR} AS extracted,
       'out.tar.gz  ' || {_binary('n')} || ' → ' || {_binary('ms')} || ' (' || CASE WHEN n = 0 THEN '0.0' ELSE {_fixed('ms * 100', 'n', 1)} END || '%)  in ' || {_DUR} AS compressed,
       CASE WHEN doc_id % 7 > 0 THEN 'excluded ' || doc_id % 7 || ' paths via ' || CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN '.gitignore and --exclude'
            WHEN doc_id % 2 = 0 THEN '--exclude' ELSE '.gitignore (use --all to include)' END END AS note
FROM s""")
def q_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n, ms = F.col("doc_id"), F.col("n"), F.col("ms")
    return sizes(spark, sf_dir).select(
        "doc_id", text.extract_line(n, F.col("source"), ms).alias("extracted"), text.compress_line(F.lit("out.tar.gz"), n, ms, ms).alias("compressed"),
        text.excluded_note(i % 7, i % 2 == 0, i % 3 == 0).alias("note"),
    )


@R.add("""SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_sha256 FROM pages""")
def q_escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("escaped_sha256"))
