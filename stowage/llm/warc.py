"""WARC archives: written with an index, read back by byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

INDEX = (
    "page_id long, url string, file string, offset long, length long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)
INDEX_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORDS_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)

ROLL_BYTES = 128 << 20
GAP_BYTES = 64 << 10
#: A payload is hot if more than one row in so many has it: there are fewer such payloads than that.
HOT_SHARE = 20_000
READ_BYTES = 8 << 20
#: Fixed value: all records of one table carry one date, so that equal input gives equal archives.
DATE = "1970-01-01T00:00:00Z"


def store(uri: str):
    """(file system, path) of a URI, for a task that writes or seeks in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def named(page_id) -> str:
    return f"<urn:page:{page_id}>"


def header(page_id, url, kind, digest, n, refers, length) -> bytes:
    # a line break would end the field
    at = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {at}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {named(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def parsed(record: bytes) -> tuple[dict, bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def page_of(name: str | None):
    x = (name or "")[len("<urn:page:") : -1]
    return int(x) if x and x != "None" else None


def digested(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """(page_id, url, payload, digest_hex, n) of (page_id, url, payload). A
    payload that another row of the batch, with a larger page_id, has too is
    left out: its row will refer to that one, or to a later one."""
    names = ["page_id", "url", "payload", "digest_hex", "n"]
    for batch in batches:
        ids, payloads = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        digests, last = [hashlib.sha1(p).hexdigest() for p in payloads], {}
        for i, d in zip(ids, digests):
            if i is not None and i > last.get(d, i - 1):
                last[d] = i
        sizes = [len(p) for p in payloads]
        kept = [p if i is None or n < min_bytes or i == last[d] else None for i, d, n, p in zip(ids, digests, sizes, payloads)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=names)


def resolve_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest_hex, n, refers_to): of equal payloads of
    `min_bytes` bytes or more, rows with a smaller page_id refer to the
    largest; refers_to is null for the rest. Equality is that of SHA-1. n: the
    payload's bytes; a row that refers to another may lack the payload itself.
    Rows repeated with the largest page_id are all responses; a null page_id
    is a response too.

    Digests that occur once need no partner. Those of more than one row in
    HOT_SHARE, fewer than HOT_SHARE digests, are broadcast; the others are
    joined by shuffle.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    digests = p.where(F.octet_length("payload") >= min_bytes).groupBy(F.sha1("payload").alias("digest_hex"))
    shared = written(digests.agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1"), "repeated-digests")
    rows = p.mapInArrow(lambda batches: digested(batches, min_bytes), "page_id long, url string, payload binary, digest_hex string, n long")
    hot = F.col("copies") > pages.count() // HOT_SHARE
    often = shared.where(hot).select(F.col("digest_hex").alias("hot_hex"), F.col("last").alias("hot_last"))
    rows = rows.join(F.broadcast(often), F.col("digest_hex") == F.col("hot_hex"), "left")
    # rows that are resolved already are dealt evenly
    key = F.when(F.col("hot_hex").isNull(), F.col("digest_hex")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    seldom = shared.where(~hot).select(F.col("digest_hex").alias("key"), "last")
    rows = rows.withColumn("key", key).join(seldom, "key", "left")
    last = F.coalesce("hot_last", "last")
    refers = F.when((F.col("n") >= min_bytes) & (F.col("page_id") < last), last)
    return rows.select("page_id", "url", "payload", "digest_hex", "n", refers.alias("refers_to"))


def write_archives(resolved: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes `resolved` as .warc.gz files, one gzip member a record, and
    returns the index as a written table: where each record is, and what.

    Each attempt of a task writes files of its own names, and the index names
    only the files of attempts that ended well, so a repeated task leaves no
    record twice. Files are closed at `roll_bytes`.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, name, at, n_files = None, "", 0, 0
        for batch in batches:
            entries = []
            for page_id, url, payload, hexed, n, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name = f"{part:05d}-{attempt}-{n_files:03d}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    out, at, n_files = fs.open_output_stream(f"{root}/{name}", compression=None), 0, n_files + 1
                kind = "response" if refers is None else "revisit"
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                body = payload if refers is None else b""
                record = header(page_id, url, kind, digest, n, refers, len(body)) + body + b"\r\n\r\n"
                member = gzip.compress(record, 1, mtime=0)
                out.write(member)
                entries.append((page_id, url, name, at, len(member), n, digest, kind, refers))
                at += len(member)
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries), INDEX_ARROW)], schema=INDEX_ARROW)
        if out is not None:
            out.close()

    return written(resolved.select("page_id", "url", "payload", "digest_hex", "n", "refers_to").mapInArrow(rows, INDEX), "warc-index")


def ranges(entries: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesces (offset, length), sorted by offset: (start, end, positions)."""
    group: list[int] = []
    start = end = 0
    for k, (at, n) in enumerate(entries):
        if group and (at - end > gap or at + n - start > most):
            yield start, end, group
            group = []
        if not group:
            start = end = at
        group.append(k)
        end = max(end, at + n)
    if group:
        yield start, end, group


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that `index` (all of it, or a selection) names.

    Index rows are dealt by file and by stretch of 32 MB within it, and
    sorted; neighbouring records are read in one request. What is returned
    comes from the archives. payload is null for a revisit. A record whose
    response doesn't have the digest that its header states fails the task.
    """
    spark = index.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    stretch = F.floor(F.col("offset") / F.lit(32 << 20))
    dealt = index.select("file", "offset", "length").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            k = 0
            while k < len(files):
                j = k
                while j < len(files) and files[j] == files[k]:
                    j += 1
                with fs.open_input_file(f"{root}/{files[k]}") as f:
                    for start, end, group in ranges(list(zip(offsets[k:j], lengths[k:j]))):
                        f.seek(start)
                        data, out = memoryview(f.read(end - start)), []
                        for g in group:
                            at = offsets[k + g] - start
                            fields, body = parsed(zlib.decompress(data[at : at + lengths[k + g]], 31))
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            response = fields["WARC-Type"] == "response"
                            if response and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                                raise ValueError(f"digest differs in {files[k]} at {offsets[k + g]}")
                            out.append((
                                page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], body if response else None, int(fields["X-Payload-Length"]),
                                digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")),
                            ))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORDS_ARROW)], schema=RECORDS_ARROW)
                k = j

    return dealt.mapInArrow(rows, RECORDS)


def write_index(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Writes `pages` into `folder` and returns the index.

    A null payload is an empty one; payloads are written whole, however long.
    An empty table writes no file and gives an empty index. Null page ids and
    urls, and rows repeated, are records like others; of equal payloads the
    rows of the largest page_id, all of them on a tie, are responses. Other
    columns are not read.
    """
    return write_archives(resolve_revisits(pages, **columns), folder)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """All pages written and read back, in a new folder of the shared one."""
    spark: SparkSession = pages.sparkSession
    folder = fresh_path(spark, "warc")
    return read_records(write_index(pages, folder, **columns), folder)
