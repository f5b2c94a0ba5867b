"""Streams in blocks: cut, encode in parallel, put together in order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import small_batches, stretches
from . import codecs

#: Codecs whose streams or segments may be encoded block by block and put one after another.
BLOCK_CODECS = ("gzip", "bzip2", "xz", "zstd", "lz4")
#: Those whose blocks are streams of their own, that may stay rows of blocks alone.
ROW_CODECS = (*BLOCK_CODECS, "brotli")
#: Levels that encode 5 MB a second and core at most: there a block's way to another task costs less than that task's waiting.
SLOW = (("xz", "best"), ("xz", "edge"), ("zstd", "edge"), ("brotli", "edge"))


def block_rows(df: DataFrame, id_col: str, data_col: str, size: int) -> DataFrame:
    """(stream_id, block_index, last, raw_len, raw): `data_col` (binary or
    string) in blocks of `size` bytes. An empty value is one empty last block;
    null has none. Cut in the JVM, without a shuffle."""
    data = F.col(data_col).cast("binary")
    n = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    cut = df.where(data.isNotNull()).select(F.col(id_col).alias("stream_id"), data.alias("data"), n.alias("n"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block_index"))
    raw = F.substring("data", F.col("block_index") * size + 1, F.lit(size))
    return cut.select(
        "stream_id", F.col("block_index").cast("long").alias("block_index"), (F.col("block_index") == F.col("n") - 1).alias("last"),
        F.octet_length(raw).cast("long").alias("raw_len"), raw.alias("raw"),
    )


def dealt(blocks: DataFrame) -> DataFrame:
    """`blocks` in equal shares, eight for a core, whatever files they were
    read from: none waits long for the last one."""
    return blocks.repartition(8 * blocks.sparkSession.sparkContext.defaultParallelism, "stream_id", "block_index")


def encode_blocks(blocks: DataFrame, codec: str, level: str = "best") -> DataFrame:
    """`blocks` without raw, with payload, stored and crc: each block as a
    deflate segment (gzip), a framed block (lz4) or a whole stream (others).
    stored: kept as it was, as encoding didn't make it smaller (lz4). crc: of
    the raw bytes, CRC-32 for gzip, else XXH32. For a slow level the blocks are
    dealt to all tasks first."""
    if codec not in ROW_CODECS:
        raise ValueError(f"{codec} has no blocks")
    blocks = dealt(blocks) if (codec, level) in SLOW else blocks
    at, last_at = blocks.columns.index("raw"), blocks.columns.index("last")
    keep = [f for f in blocks.schema.fields if f.name != "raw"]
    new = [T.StructField("payload", T.BinaryType()), T.StructField("stored", T.BooleanType()), T.StructField("crc", T.LongType())]

    def one(data: bytes, last: bool) -> tuple:
        if codec == "gzip":
            return codecs.gzip_segment(data, level, last), False, zlib.crc32(data)
        if codec == "lz4":
            block = codecs.lz4_block(data, level) if data else b""
            return block, bool(data) and bool(block[3] & 0x80), xxhash.xxh32_intdigest(data)
        return codecs.ENCODERS[codec](data, level), False, xxhash.xxh32_intdigest(data)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py(), last) for x, last in zip(batch.column(at), batch.column(last_at).to_pylist())]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            columns += [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in keep), "payload", "stored", "crc"])

    small_batches(blocks.sparkSession)
    return blocks.mapInArrow(rows, T.StructType([*keep, *new]))


def ordered(value: Column) -> Column:
    """A stream's values in block order: an aggregate for groupBy(stream_id),
    which is as long as the stream itself."""
    pairs = F.array_sort(F.collect_list(F.struct("block_index", value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def crc32_of_blocks(encoded: DataFrame) -> DataFrame:
    """(stream_id, crc32, length): a whole stream's CRC-32 from those of its
    blocks, which are folded in order without the bytes."""
    folded = encoded.groupBy("stream_id").agg(ordered(F.col("crc")).alias("crcs"), ordered(F.col("raw_len")).alias("lens"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, lens = (batch.column(k).to_pylist() for k in (1, 2))
            out = []
            for c, n in zip(crcs, lens):
                crc = 0
                for part, length in zip(c, n):
                    crc = crc32_combine(crc, part, length)
                out.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), pa.array([sum(n) for n in lens], pa.int64())], names=["stream_id", "crc32", "length"])

    return folded.mapInArrow(rows, T.StructType([folded.schema["stream_id"], T.StructField("crc32", T.LongType()), T.StructField("length", T.LongType())]))


def times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_combine(first: int, second: int, length: int) -> int:
    """The CRC-32 of two pieces put together; `length`: the second's bytes."""
    shift, power = 1 << 31, 1 << 23  # 1, and x to the 8th: one byte
    while length:
        if length & 1:
            shift = times(power, shift)
        power, length = times(power, power), length >> 1
    return times(shift, first) ^ second


def in_order(encoded: DataFrame) -> DataFrame:
    """(stream_id, parts, crcs, lens): a stream's blocks together, in order."""
    blocks = F.array_sort(F.collect_list(F.struct("block_index", "payload", "crc", "raw_len")))
    g = encoded.groupBy("stream_id").agg(blocks.alias("b"))
    return g.select("stream_id", F.col("b.payload").alias("parts"), F.col("b.crc").alias("crcs"), F.col("b.raw_len").alias("lens"))


def assemble(encoded: DataFrame, codec: str) -> DataFrame:
    """(stream_id, data): each stream's blocks in order as one stream that any
    decoder of the codec reads. As a binary value holds a stream of 2 GB at
    most, so does a task here; longer ones stay rows of blocks, which
    `decode_blocks` reads. lz4 frames: see `assemble_lz4`."""
    if codec not in BLOCK_CODECS or codec == "lz4":
        raise ValueError(f"{codec} streams aren't put together here")

    def stream(parts: list[bytes], crcs: list[int], lens: list[int]) -> bytes:
        if codec != "gzip":
            return b"".join(parts)
        crc = 0
        for part, length in zip(crcs, lens):
            crc = crc32_combine(crc, part, length)
        tail = crc.to_bytes(4, "little") + (sum(lens) & 0xFFFFFFFF).to_bytes(4, "little")
        return b"".join([b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff", *parts, tail])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                data = stream(*(batch.column(c)[k].as_py() for c in (1, 2, 3)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([data], pa.binary())], names=["stream_id", "data"])

    whole = in_order(encoded)
    small_batches(whole.sparkSession)
    return whole.mapInArrow(rows, T.StructType([whole.schema["stream_id"], T.StructField("data", T.BinaryType())]))


def assemble_lz4(encoded: DataFrame, streams: DataFrame) -> DataFrame:
    """(stream_id, data): lz4 frames of blocks; `streams` (stream_id, data)
    gives the bytes whose hash ends each frame."""
    hashed = codecs.mapped(streams, "data", [T.StructField("content", T.LongType())], lambda data: (xxhash.xxh32_intdigest(data),)).select("stream_id", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                data = codecs.lz4_stream(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([data], pa.binary())], names=["stream_id", "data"])

    whole = in_order(encoded).join(hashed, "stream_id").select("stream_id", "parts", "content")
    small_batches(whole.sparkSession)
    return whole.mapInArrow(rows, T.StructType([whole.schema["stream_id"], T.StructField("data", T.BinaryType())]))


def encode_streams(df: DataFrame, id_col: str, data_col: str, codec: str, level: str = "best", size: int = 1 << 20) -> DataFrame:
    """(stream_id, data): each value of `data_col` as one stream of the codec.
    A value is cut into blocks of `size` bytes, which are encoded wherever
    there is room and put together in order; null gives no row. A codec
    without blocks can't: see `decode_blocks`."""
    encoded = encode_blocks(block_rows(df, id_col, data_col, size), codec, level)
    if codec != "lz4":
        return assemble(encoded, codec)
    whole = df.select(F.col(id_col).alias("stream_id"), F.col(data_col).cast("binary").alias("data")).where("data is not null")
    return assemble_lz4(encoded, whole)


def joined(decoded: DataFrame) -> DataFrame:
    """(stream_id, data): rows of `decode_blocks` put together in order."""
    g = decoded.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "raw"))).alias("b")).select("stream_id", F.col("b.raw").alias("parts"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([b"".join(batch.column(1)[k].as_py())], pa.binary())], names=["stream_id", "data"])

    small_batches(g.sparkSession)
    return g.mapInArrow(rows, T.StructType([g.schema["stream_id"], T.StructField("data", T.BinaryType())]))


def decode_blocks(encoded: DataFrame, codec: str) -> DataFrame:
    """`encoded` (of `encode_blocks`) with raw instead of payload: each block
    is decoded on its own, so that a stream of any length is read block by
    block. A block whose checksum differs fails the query."""
    if codec not in ROW_CODECS:
        raise ValueError(f"{codec} has no blocks")
    at, crc_at, len_at = (encoded.columns.index(c) for c in ("payload", "crc", "raw_len"))
    keep = [f for f in encoded.schema.fields if f.name != "payload"]

    def one(body: bytes, crc: int, length: int) -> bytes:
        if codec == "gzip":
            raw = zlib.decompressobj(-15).decompress(body)
        elif codec == "lz4":
            data = body[4:-4] if body else b""
            stored = bool(body) and body[3] & 0x80
            raw = data if stored or not body else pa.Codec("lz4_raw").decompress(data, length, asbytes=True)
        else:
            raw = codecs.decode(codec, body)
        if len(raw) != length or (zlib.crc32 if codec == "gzip" else xxhash.xxh32_intdigest)(raw) != crc:
            raise ValueError("io: a block's checksum differs")
        return raw

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in stretches(batch.column(len_at).to_pylist()):
                part = batch.slice(start, length)
                raw = [one(*x) for x in zip(*(part.column(k).to_pylist() for k in (at, crc_at, len_at)))]
                columns = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], names=[*(f.name for f in keep), "raw"])

    small_batches(encoded.sparkSession)
    return encoded.mapInArrow(rows, T.StructType([*keep, T.StructField("raw", T.BinaryType())]))
