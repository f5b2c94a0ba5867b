"""Relational operators over entry rows: roots, trees, totals, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..shared import written


def numbered(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """`rows` and `position`: 1, 2, ... within `by` (not null), in `order`,
    whose last column must tell rows apart.

    A `by` of any size is dealt to all tasks by ranges of the order; a range
    numbers its own rows, and starts from the number of rows in the ranges
    before it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("order_", F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))))
    dealt = written(keyed.repartitionByRange(n, by, "order_").withColumn("range_", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy(by, "range_").count().select(by, "range_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy(by, "range_").orderBy("order_"))
    out = dealt.join(starts, [by, "range_"]).withColumn("position", F.col("start_") + own)
    return out.drop("order_", "range_", "start_")


def distinct_roots(entries: DataFrame, by: list[str]) -> DataFrame:
    """(`by`, n_roots): how many top-level names the entries have."""
    return entries.groupBy(*by).agg(F.countDistinct(paths.first_component(F.col("path"))).alias("n_roots"))


def wrap_info(entries: DataFrame) -> DataFrame:
    """(archive, n_roots, wrap_name, wraps): an archive of several roots is
    extracted into a folder of its own name."""
    n = F.countDistinct(paths.first_component(F.col("path")))
    out = entries.groupBy("archive").agg(n.alias("n_roots"))
    return out.select("archive", "n_roots", paths.wrap_dir_name(paths.base_name(F.col("archive"))).alias("wrap_name"), (F.col("n_roots") > 1).alias("wraps"))


def tree(entries: DataFrame) -> DataFrame:
    """(archive, path, name, depth, is_dir, size): every entry and every folder
    above one, once.

    A path first seen above another entry is a folder; one first seen as a
    file stays one unless an entry names it as a folder. Of a file's several
    entries the last gives the size. Each entry becomes a row for each of its
    ancestors, which are aggregated by path before the shuffle.
    """
    parts = paths.components(F.col("path"))
    e = entries.select("archive", "ordinal", "is_dir", "size", parts.alias("parts")).where(F.size("parts") > 0)
    nodes = e.select("*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    nodes = nodes.select(
        "archive", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), "depth", "ordinal", (F.col("depth") == F.size("parts")).alias("own"),
        "is_dir", "size",
    )
    first = F.min_by(~F.col("own") | F.col("is_dir"), "ordinal")
    named = F.max(F.col("own") & F.col("is_dir"))
    size = F.max_by(F.col("size"), F.when(F.col("own") & ~F.col("is_dir"), F.col("ordinal")))
    out = nodes.groupBy("archive", "path", "depth").agg((first | named).alias("is_dir"), F.coalesce(size, F.lit(0).cast("long")).alias("size"))
    return out.select("archive", "path", paths.base_name(F.col("path")).alias("name"), F.col("depth").cast("long").alias("depth"), "is_dir", "size")


def ancestors(path: Column, depth: Column) -> Column:
    """The paths above a node of that depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), depth.cast("int") - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def reached(nodes: DataFrame) -> DataFrame:
    """`nodes` less those below a file, which no preview comes to."""
    above = nodes.where("depth > 1").select("archive", "path", F.explode(ancestors(F.col("path"), F.col("depth"))).alias("ancestor"))
    files = nodes.where("not is_dir").select("archive", F.col("path").alias("ancestor"))
    below = above.join(files, ["archive", "ancestor"], "left_semi").select("archive", "path").distinct()
    return nodes.join(below, ["archive", "path"], "left_anti")


def tree_counts(nodes: DataFrame) -> DataFrame:
    """(archive, files, folders, total): what a preview counts as visible, and
    the bytes of all files. Nothing below a file is counted."""
    shown = ~F.exists(F.split("path", "/"), paths.is_hidden_name)
    count = lambda c: F.count_if(c).alias
    return reached(nodes).groupBy("archive").agg(
        count(shown & ~F.col("is_dir"))("files"), count(shown & F.col("is_dir"))("folders"),
        F.sum(F.when(~F.col("is_dir"), F.col("size")).otherwise(F.lit(0))).cast("long").alias("total"),
    )


def tree_rows(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """`nodes` with parent and `position` (from 1): an archive's rows as a
    preview shows them, a folder and then all below it, its children folders
    first, then by name in natural order. Nothing below a file is shown. With
    `limit` an archive's first rows alone; a preview takes 5000."""
    parts = F.split("path", "/")

    def level(part: Column, k: Column) -> Column:
        is_file = (k == F.size(parts) - 1) & ~F.col("is_dir")
        return F.struct(is_file.alias("f"), text.natural_key(part).alias("n"))

    out = numbered(reached(nodes).withColumn("parent", paths.parent_of(F.col("path"))), "archive", [F.transform(parts, level)])
    return out if limit is None else out.where(F.col("position") <= limit)


def deepest_first(nodes: DataFrame) -> DataFrame:
    """(archive, path, position) of folders, longest path first: a folder's
    mode may forbid writing below it, so it is set after all that is there."""
    return numbered(nodes.where("is_dir").select("archive", "path"), "archive", [-F.length("path"), F.col("path")])


def footer(entries: DataFrame, by: list[str]) -> DataFrame:
    """(`by`, files, original, average, label): totals of the entries that
    aren't folders; label: `File size` for a single one."""
    e = entries.where("not is_dir").groupBy(*by).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("original"))
    average = F.col("original").cast("double") / F.col("files")
    return e.select(*by, "files", "original", average.alias("average"), F.when(F.col("files") == 1, F.lit("File size")).otherwise(F.lit("Avg file size")).alias("label"))


def included(entries: DataFrame, kept) -> DataFrame:
    """(n_included, n_excluded, bytes): of a walk, by the predicate `kept`."""
    return entries.agg(
        F.count_if(kept).alias("n_included"), F.count_if(~kept).alias("n_excluded"),
        F.coalesce(F.sum(F.when(kept & ~F.col("is_dir"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
    )


def duplicate_bases(inputs: DataFrame) -> DataFrame:
    """(base, n): base names that several inputs share, which can't be packed
    side by side."""
    return inputs.groupBy(paths.base_name(F.col("path")).alias("base")).agg(F.count("*").alias("n")).where("n > 1")


def collect_many(trees: list[tuple[str, DataFrame]]) -> DataFrame:
    """The entries of several inputs, each below its base name; a folder gives
    an entry for itself first. Two inputs of one base name are an error."""
    bases = [p.rstrip("/").rsplit("/", 1)[-1] for p, _ in trees]
    if len(set(bases)) < len(bases):
        raise ValueError("duplicate-input: " + ", ".join(sorted({b for b in bases if bases.count(b) > 1})))
    out = None
    for k, (base, (_, df)) in enumerate(zip(bases, trees)):
        rel = F.when(F.col("rel") == "", F.lit(base)).otherwise(F.concat(F.lit(base + "/"), F.col("rel")))
        part = df.withColumn("rel", rel).withColumn("input", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def merge(old: DataFrame, new: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged, clashes) of the entries of archives and of what is added.

    new: as entries, with `prefix` (the folder it goes to, see
    `paths.archive_prefix`). What `old` holds at or below an added root is a
    clash; with `replace` those entries go and there are no clashes, without,
    a caller writes nothing if there is one. Roots are compared by equality of
    the paths that lead to them. Merged entries are ordered by top-level name,
    then as they were, old before new.
    """
    depth = F.size(paths.components(F.col("prefix"))) + 1
    at = F.when(F.col("prefix") == "", F.col("path")).otherwise(F.concat_ws("/", "prefix", "path"))
    added = new.withColumn("depth", depth).withColumn("path", at)
    head = lambda n: F.array_join(F.slice(paths.components(F.col("path")), F.lit(1), n), "/")
    roots = added.select("archive", "depth", head(F.col("depth")).alias("root")).distinct()
    depths = roots.select("archive", "depth").distinct()
    hit = old.join(depths, "archive").select("archive", "ordinal", "depth", head(F.col("depth")).alias("root"), F.size(paths.components(F.col("path"))).alias("n"))
    hit = hit.where("n >= depth").join(roots, ["archive", "depth", "root"], "left_semi").select("archive", "ordinal").distinct()
    clashes = old.join(hit, ["archive", "ordinal"], "left_semi")
    kept = old.join(hit, ["archive", "ordinal"], "left_anti") if replace else old
    both = kept.withColumn("added", F.lit(0)).unionByName(added.drop("prefix", "depth").withColumn("added", F.lit(1)))
    placed = numbered(both, "archive", [paths.first_component(F.col("path")), F.col("added"), F.col("ordinal")])
    return placed.withColumn("ordinal", F.col("position") - 1).drop("added", "position"), clashes.limit(0) if replace else clashes
