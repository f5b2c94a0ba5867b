"""Removal of lines that many documents share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, fresh_path, written

#: Batches that a table is taken in as.
BATCHES = 4


def key(line: bytes) -> bytes:
    """bytes.strip() and lower() know ASCII white space and A-Z alone."""
    return line.strip().lower()


def keyed(text: bytes, min_chars: int) -> dict[int, None]:
    """The 64-bit hashes of the distinct keys of `min_chars` or more."""
    keys = set(map(key, text.split(b"\n")))
    # bytes are as many as code points at least: only a short one is decoded
    return {xxhash.xxh3_64_intdigest(k): None for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)}


class LineRuns:
    """How many documents hold each line, in sorted runs by level.

    A run is a table (h, n) that is bucketed and sorted by hash, so that runs
    meet bucket by bucket without a shuffle. `add` counts the lines of a new
    batch, leaves out those that a run already knows to be repeated often
    enough (a merge anti-join), and adds the rest as a run of level 0. Two
    runs of a level are compacted into one of the next by a merge join, which
    adds their counts up. A batch thus costs its own size and a join with as
    many runs as there are levels, and a line is rewritten once a level.
    `drop` removes the runs' tables and files.
    """

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []
        self.tables: list[str] = []

    def run(self, counts: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        path = fresh_path(self.spark, "line-run")
        counts.select("h", "n").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def add(self, counts: DataFrame) -> None:
        """counts: (h, n), a hash any number of times."""
        counts = counts.groupBy("h").agg(F.sum("n").alias("n"))
        for run in self.levels:
            if run is not None:
                counts = counts.join(run.where(F.col("n") >= self.min_docs).select("h"), "h", "left_anti")
        run, level = self.run(counts), 0
        while level < len(self.levels) and self.levels[level] is not None:
            older = self.levels[level].withColumnRenamed("n", "m")
            both = older.join(run, "h", "full").select("h", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
            run, self.levels[level] = self.run(both), None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def repeated(self) -> DataFrame:
        """(h): lines of `min_docs` documents or more."""
        out = None
        for run in (r for r in self.levels if r is not None):
            older = run.withColumnRenamed("n", "m")
            out = run if out is None else out.join(older, "h", "full").select("h", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
        return out.where(F.col("n") >= self.min_docs).select("h") if out is not None else self.spark.createDataFrame([], "h long")

    def drop(self) -> None:
        for name in self.tables:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_counts(docs: DataFrame, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(batch, h, n) as a written table, summed by stretch of documents. The
    batch is that of the hash, so that a line's documents of one batch meet
    once; a stream would take batches as they come."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])

        def summed(b: int, held: list[int]):
            h, n = np.unique(np.array(held, np.uint64).view(np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b, np.int32)), pa.array(h), pa.array(n.astype(np.int64))], schema=schema)

        held: list[list[int]] = [[] for _ in range(batches)]
        for part in parts:
            for text in part.column(0).cast(pa.binary()):
                body = text.as_py() or b""
                held[(xxhash.xxh3_64_intdigest(body, 1) >> 32) % batches].extend(keyed(body, min_chars))
            for b in range(batches):
                if len(held[b]) >= 200_000:
                    yield summed(b, held[b])
                    held[b] = []
        for b in range(batches):
            yield summed(b, held[b])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "batch int, h long, n long")
    path = fresh_path(docs.sparkSession, "line-counts")
    counts.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema("h long, n long, batch int").parquet(path)


def distinct_line_counts(docs: DataFrame, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(batch, h, n) as `line_counts`, but each distinct text counts once
    however many rows have it. Texts are told apart by 128 bits of XXH3; a
    digest and its line hashes are shuffled, not the text."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests, hashes = [], []
            for text in part.column(0).cast(pa.binary()):
                body = text.as_py() or b""
                digests.append(xxhash.xxh3_128_digest(body))
                hashes.append(np.array(list(keyed(body, min_chars)), np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(hashes, pa.binary())], names=["d", "hs"])

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
        for part in parts:
            held: list[list[bytes]] = [[] for _ in range(batches)]
            for d, hs in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held[d[0] % batches].append(hs)
            for b in range(batches):
                h, n = np.unique(np.frombuffer(b"".join(held[b]), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b, np.int32)), pa.array(h), pa.array(n.astype(np.int64))], schema=schema)

    texts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "d binary, hs binary")
    # equal texts have equal hashes
    counts = texts.groupBy("d").agg(F.first("hs").alias("hs")).mapInArrow(summed, "batch int, h long, n long")
    path = fresh_path(docs.sparkSession, "line-counts")
    counts.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema("h long, n long, batch int").parquet(path)


def repeated_lines(
    docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, count_copies: bool = True
) -> DataFrame:
    """(h) as a written table: hashes of lines in `min_docs` rows or more, or
    without `count_copies` in so many distinct texts."""
    counts = (line_counts if count_copies else distinct_line_counts)(docs, text_col, min_chars, batches)
    runs = LineRuns(docs.sparkSession, min_docs)
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select("h", "n"))
    out = written(runs.repeated(), "repeated-lines")
    runs.drop()
    return out


def split_lines(text: bytes, repeated, min_chars: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    kept = []
    for line in lines:
        k = key(line)
        long = len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)
        if not (long and xxhash.xxh3_64_intdigest(k) in repeated):
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def drop_repeated_lines(
    docs: DataFrame,
    *,
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = BATCHES,
    count_copies: bool = True,
    with_counts: bool = True,
) -> DataFrame:
    """`docs` with its text less the lines whose key is in `min_docs` rows or
    more, and, with `with_counts`, n_lines (before) and n_dropped.

    The key is the line without ASCII white space at its ends, A-Z in lower
    case; keys under `min_chars` code points are never dropped. Keys are told
    apart by 64 bits of XXH3. Each row is a document, whatever its id, also if
    it is repeated; without `count_copies` rows of one text are a single
    document, so that copies alone don't make a line repeated. A null text is
    one empty line and becomes an empty text. Texts are split whole, however
    long. Other columns pass through, whatever their names; columns named as
    new ones are replaced. An empty table gives no rows.

    A text gets the hashes of its own repeated lines by a join.
    """
    repeated = repeated_lines(docs, text_col=text_col, min_docs=min_docs, min_chars=min_chars, batches=batches, count_copies=count_copies)
    if with_counts:
        docs = docs.drop("n_lines", "n_dropped")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped") if with_counts)])
    at, width = docs.columns.index(text_col), len(docs.columns)
    docs = with_own_hashes(docs, repeated, text_col, min_chars)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).cast(pa.binary())
            own = [set(np.array(x.as_py() or [], np.int64).view(np.uint64).tolist()) for x in part.column(width)]
            done = [split_lines(x.as_py() or b"", h, min_chars) for x, h in zip(texts, own)]
            columns = list(part.columns[:width])
            columns[at] = pa.array([d[2] for d in done], pa.binary()).cast(pa.string())
            columns += [pa.array([d[k] for d in done], pa.int64()) for k in (0, 1) if with_counts]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(rows, schema)


def with_own_hashes(docs: DataFrame, repeated: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """`docs` and an array of those repeated hashes that the row's text has;
    null if none. Texts are told apart by 128 bits."""
    own_names = [free_name(docs, c) for c in ("own1_", "own2_", "hashes_")]
    names = [free_name(docs, c) for c in ("text1_", "text2_")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = [F.xxhash64(text), F.xxhash64(F.lit(1), text, F.length(text))]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in parts:
            new = []
            for t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                new.append(t not in seen)  # a text that comes again in a task has the same lines
                if len(seen) < 1_000_000:
                    seen.add(t)
            part = part.filter(pa.array(new, pa.bool_()))
            hashes = [np.array(list(keyed(body.as_py() or b"", min_chars)), np.uint64).view(np.int64) for body in part.column(2).cast(pa.binary())]
            sizes = [len(h) for h in hashes]
            ids = [pa.array(np.repeat(part.column(k).to_numpy(), sizes)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], names=["t1", "t2", "h"])

    pairs = docs.select(*digests, text).mapInArrow(rows, "t1 long, t2 long, h long").join(repeated, "h", "left_semi")
    # written, so that the join below deals both sides anew and can split a text that many rows have
    own = written(pairs.groupBy("t1", "t2").agg(F.collect_set("h").alias("hs")), "own-lines").toDF(*own_names)
    docs = docs.withColumns(dict(zip(names, digests)))
    found = [F.col(x) == F.col(y) for x, y in zip(names, own_names)]
    return docs.join(own, found, "left").drop(*names, *own_names[:2])
