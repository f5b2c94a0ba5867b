"""Exact near-duplicate links among vectors: a metric range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

#: A pivot for so many vectors, MOST_PIVOTS at most (they are broadcast, 8 bytes a component): cells that hold more vectors
#: are cut into chunks.
CELL_ROWS, MOST_PIVOTS = 8192, 2048
#: A cell's own vectors, and all that it is compared with, are cut into chunks of so many.
OWN_ROWS, OTHER_ROWS = 8192, 32768
#: Vectors that are multiplied at once with a chunk; products of vectors and pivots that are in memory at once.
BLOCK, PRODUCTS = 2048, 1 << 20
#: The slack of bounds in floating point.
SLACK = 1e-6


def units(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(vectors, np.float64).reshape(len(vectors), dim)
    scale = np.abs(x).max(1, keepdims=True) if dim else np.ones((len(x), 1))
    x = x / scale  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True), x


def cells(dim: int, vectors: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, list[list[int]]]:
    """(home, visits): each vector's nearest pivot, and the later pivots whose
    cells it must also meet.

    A vector within the chord r of a point nearer to q than to its home h is
    within r of the plane between the two, whose distance is (<x,h> - <x,q>) /
    |h - q|: beyond r, no vector of q's cell can be linked with it.
    """
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    r = np.sqrt(max(0.0, 2 - 2 * threshold))
    homes, visits, step = [], [], max(1, PRODUCTS // len(pivots))
    for at in range(0, len(vectors), step):
        x = units(vectors[at : at + step], dim)[0]
        near = x @ pivots.T
        home = near.argmax(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (near[np.arange(len(x)), home][:, None] - near) / apart[home]
        reach = ~(plane > r + SLACK) & (np.arange(len(pivots))[None, :] > home[:, None])
        homes.append(home)
        visits += [np.flatnonzero(row).tolist() for row in reach]
    return np.concatenate(homes), visits


class Cell:
    """Compares a chunk of a cell's own vectors with a chunk of all that the
    cell holds, and gives counts and spanning links, not pairs."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.counts: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def compare(self, own_ids, own_weights, own, others_ids, others_weights, others, visiting) -> None:
        for at in range(0, len(others_ids), BLOCK):
            ids, weights, visit = (x[at : at + BLOCK] for x in (others_ids, others_weights, visiting))
            s = own[0] @ others[0][at : at + BLOCK].T  # in single precision; what is near the threshold is done again in double
            near = (own[0].shape[1] + 8) * 1.2e-7
            hit = s >= self.threshold
            for i, j in zip(*np.nonzero(np.abs(s - np.float32(self.threshold)) < near)):
                a, b = own[1][i], others[1][at + j]
                hit[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= self.threshold
            rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            hit = hit[np.ix_(rows, cols)] & (own_ids[rows][:, None] != ids[cols][None, :])
            some, other = hit.any(1), hit.any(0)  # most vectors are near themselves alone
            if not some.any():
                continue
            hit, rows, cols = hit[np.ix_(some, other)], rows[some], cols[other]
            a, b, linked = own_ids[rows], ids[cols], hit.astype(np.float64)  # whole numbers below 2 ** 53
            for k, n in zip(a.tolist(), (linked @ weights[cols].astype(np.float64)).tolist()):
                self.counts[k] = self.counts.get(k, 0) + int(n)
            for k, n, v in zip(b.tolist(), (own_weights[rows].astype(np.float64) @ linked).tolist(), visit[cols].tolist()):
                if v:  # of the cell's own pairs each side is counted as a row once
                    self.counts[k] = self.counts.get(k, 0) + int(n)
            self.span(hit, a, b)

    def span(self, hit, a, b) -> None:
        big = np.iinfo(np.int64).max
        left, right = a.copy(), np.minimum(b, np.where(hit, a[:, None], big).min(0))
        while True:
            low = np.minimum(left, np.where(hit, right[None, :], big).min(1))
            right = np.minimum(right, np.where(hit, low[:, None], big).min(0))
            if (low == left).all():
                break
            left = low
        self.edges += [(k, m) for ids, least in ((a, left), (b, right)) for k, m in zip(ids.tolist(), least.tolist()) if k != m]


def compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """batches: (dim, cell, i, j, kind, rid, weight, embedding), sorted but
    for rid. weight: how many rows have the vector.
    kind: 0 own vectors, 1 others of the cell, 2 visitors from earlier cells.
    A group (dim, cell, i, j) holds at most OWN_ROWS + OTHER_ROWS vectors,
    give or take what a hash deals unevenly."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])
    group, held = None, []

    def done():
        kinds = np.concatenate([h[0] for h in held])
        ids = np.concatenate([h[1] for h in held])
        weights = np.concatenate([h[2] for h in held])
        vectors = [x for h in held for x in h[3]]
        own, other = np.flatnonzero(kinds == 0), np.flatnonzero(kinds > 0)
        if not len(own) or not len(other):
            return
        unit, raw = units(vectors, group[0])
        cell = Cell(threshold)
        unit = unit.astype(np.float32)
        cell.compare(ids[own], weights[own], (unit[own], raw[own]), ids[other], weights[other], (unit[other], raw[other]), kinds[other] == 2)
        keys = np.fromiter(cell.counts.keys(), np.int64, len(cell.counts))
        n = np.fromiter(cell.counts.values(), np.int64, len(cell.counts))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([None] * len(keys), pa.int64()), pa.array(n)], schema=schema)
        u, v = (pa.array([e[k] for e in cell.edges], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([u, v, pa.array([0] * len(u), pa.int64())], schema=schema)

    for batch in batches:
        names = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], 1)
        cuts = np.concatenate(([0], np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1, [len(names)]))
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if group is not None and tuple(names[a]) != group:
                yield from done()
                held = []
            group = tuple(names[a].tolist())
            part = batch.slice(a, b - a)
            flat = part.column(7).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
            held.append((*(part.column(k).to_numpy() for k in (4, 5, 6)), list(flat)))
    if held:
        yield from done()


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): all rows are compared by cosine
    in double precision and linked at `threshold` (over 0) or more.

    Equal vectors (told apart by 128 bits) are compared once, with their
    number as a weight, however many rows have them. Pivots, one for
    `cell_rows` vectors, partition those of their dimension; a vector visits
    the later cells whose vectors it may be linked with by the triangle
    inequality, so each pair meets once, or can't be linked. Cells join on
    their own, in chunks; a cell that holds many rows, or a dimension without
    a pivot, is cut into more of them. Chunks give counts and spanning links.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors of different lengths, aren't linked. Rows with one id are
    vectors of their own, each counts as a link of the other if they are
    linked, and they get one component_id if their vectors are. A cosine that
    equals the threshold links. kept: vec_id = component_id; null for a null
    id. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"  # as they are stored: half the bytes to shuffle
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    good = F.col("e").isNotNull() & finite & F.exists("e", lambda c: c != 0)
    e = F.when(good, F.col("e"))
    digests = [F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(1), e, F.size(e)).alias("h2")]
    v = written(v.select(F.monotonically_increasing_id().alias("rid"), "vec_id", e.alias("e"), *digests), "vectors")
    each = v.where("e is not null").groupBy("h1", "h2").agg(F.min("rid").alias("rid"), F.first("e").alias("e"), F.count("*").alias("weight"))
    each = written(each, "distinct-vectors")
    usable = each.select("rid", "weight", "e", F.size("e").alias("dim"))

    n_rows = each.count()
    pivots = min(MOST_PIVOTS, max(1, math.ceil(n_rows / cell_rows)))
    chosen = usable.groupBy("dim").agg(F.min(F.struct(F.xxhash64("e").alias("h"), "e")).alias("p"))  # every dimension has one at least
    # about eight times as many as are wanted, by hash
    some = usable.select("e", F.xxhash64("e").alias("h")).where(F.pmod("h", F.lit(max(1, n_rows // (8 * pivots)))) == 0)
    picked = [r.e for r in some.orderBy(F.xxhash64("h"), "e").limit(pivots).collect()]
    picked += [r.e for r in chosen.orderBy("dim").limit(MOST_PIVOTS).select("p.e").collect()]
    by_dim: dict[int, np.ndarray] = {}
    for dim in sorted({len(p) for p in picked}):
        by_dim[dim] = np.unique(units([p for p in picked if len(p) == dim], dim)[0], axis=0)
    shared = spark.sparkContext.broadcast(by_dim)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "weight", "e", "dim", "home", "visits"]
        for batch in batches:
            lists, dims = batch.column(2), batch.column(3).to_numpy()
            homes, visits = np.zeros(len(batch), np.int32), [[]] * len(batch)
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    at = np.flatnonzero(dims == dim)
                    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                    homes[at], found = cells(dim, flat, shared.value[dim], threshold)
                    for k, row in zip(at.tolist(), found):
                        visits[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes), pa.array(visits, pa.list_(pa.int32()))], names=names)

    placed = written(usable.mapInArrow(dealt, f"rid long, weight long, e array<{kind}>, dim int, home int, visits array<int>"), "cells")
    # as many rows as dimensions times pivots
    sizes = placed.select("dim", F.explode(F.concat(F.array("home"), "visits")).alias("cell"), "home").groupBy("dim", "cell").agg(
        F.sum((F.col("home") == F.col("cell")).cast("long")).alias("own"), F.count("*").alias("all")
    )
    sizes = sizes.select("dim", "cell", F.ceil(F.col("own") / OWN_ROWS).cast("int").alias("ni"), F.ceil(F.col("all") / OTHER_ROWS).cast("int").alias("nj"))
    kinds = F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(0).alias("kind")), F.struct(F.col("home").alias("cell"), F.lit(1).alias("kind"))),
                               F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(2).alias("kind")))))
    parts = placed.select("rid", "weight", "e", "dim", kinds.alias("x")).select("rid", "weight", "e", "dim", "x.cell", "x.kind").join(F.broadcast(sizes) if small(by_dim) else sizes, ["dim", "cell"])
    all_of = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    one_of = lambda n, seed: F.array(F.pmod(F.xxhash64("rid", F.lit(seed)), F.greatest(F.col(n), F.lit(1))).cast("int"))
    own = F.col("kind") == 0
    parts = parts.withColumn("i", F.explode(F.when(own, one_of("ni", 1)).otherwise(all_of("ni"))))
    parts = parts.withColumn("j", F.explode(F.when(own, all_of("nj")).otherwise(one_of("nj", 2))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.select("dim", "cell", "i", "j", "kind", "rid", "weight", "e").repartition(n, "dim", "cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j", "kind")
    found = written(parts.mapInArrow(lambda batches: compared(batches, threshold), "u long, v long, n long"), "links")

    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n_links")).withColumnRenamed("u", "rid")
    roots = connected_components(found.where("v is not null")).withColumnRenamed("node", "rid")
    classes = each.select("h1", "h2", "rid", "weight").join(roots, "rid", "left").join(counts, "rid", "left")
    others = F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1
    classes = written(classes.select("h1", "h2", F.coalesce("root", "rid").alias("root"), others.alias("n_links")), "classes")
    rooted = v.select("rid", "vec_id", "h1", "h2", F.col("e").isNotNull().alias("usable")).join(classes, ["h1", "h2"], "left")
    rooted = rooted.select("vec_id", F.when(F.col("usable"), F.col("root")).otherwise(F.col("rid")).alias("root"), F.when(F.col("usable"), F.col("n_links")).otherwise(0).alias("n_links"))
    first = written(rooted.groupBy("root").agg(F.min("vec_id").alias("component_id")), "components")
    return rooted.join(first, "root").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def small(by_dim: dict[int, np.ndarray]) -> bool:
    """Whether the table of cell sizes, a row for each pivot at most and one
    for each dimension without, is small: no dimension lacks a pivot."""
    return len(by_dim) < MOST_PIVOTS
