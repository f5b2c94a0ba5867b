"""What the operators share: written tables (`stowage.shared`), free names, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, fresh_path, written


__all__ = ["connected_components", "discard", "free_name", "fresh_path", "short_batches", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows of whole documents go to Python `rows` at a time at most: Spark's
    10,000 are tens of MB, held on both sides by each task. Sets
    `spark.sql.execution.arrow.maxRecordsPerBatch` unless it is less already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) for each node that `edges` name; root: the least node of
    its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each
    is an aggregate and an equi-join, and the number of rounds grows with the
    logarithm of the component's size. Each round ends in a written table, the
    one before it is deleted. An edge of a node with itself, or with null, is
    ignored; no edges, no rows.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # all are stars: a node has one edge, and no root has one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).union(e.select("v", F.lit(0)))
        unlike = ends.groupBy("x").agg(F.sum("n").alias("up"), F.min("n").alias("least")).where("up > 1 OR (up = 1 AND least = 0)")
        if not unlike.limit(1).count():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, e = e, written(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
