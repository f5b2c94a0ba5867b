"""The six stream codecs over binary columns, as Arrow map operators."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shared import BATCH_BYTES, small_batches

CODECS = ("gzip", "bzip2", "xz", "zstd", "lz4", "brotli")
# Each codec's own level for fast, best and edge.
LEVELS = {
    "gzip": {"fast": 1, "best": 6, "edge": 9},
    "bzip2": {"fast": 1, "best": 6, "edge": 9},
    "xz": {"fast": 1, "best": 6, "edge": 9},
    "zstd": {"fast": 1, "best": 3, "edge": 22},
    "lz4": {"fast": 1, "best": 6, "edge": 12},
    "brotli": {"fast": 2, "best": 6, "edge": 11},
}
LZ4_BLOCK = 4 << 20


def gzip_encode(data: bytes, level: str) -> bytes:
    return gzip_stream([gzip_segment(data, level, True)], [data])


def gzip_segment(data: bytes, level: str, last: bool) -> bytes:
    """A chunk as raw deflate that ends on a byte: segments can follow each other in one member."""
    z = zlib.compressobj(LEVELS["gzip"][level], zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def gzip_stream(segments: list[bytes], raw: list[bytes]) -> bytes:
    crc = n = 0
    for data in raw:
        crc, n = zlib.crc32(data, crc), n + len(data)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + b"".join(segments) + crc.to_bytes(4, "little") + (n & 0xFFFFFFFF).to_bytes(4, "little")


def lz4_block(data: bytes, level: str) -> bytes:
    """Size word, data and checksum; stored as it is (high bit) unless smaller."""
    native = LEVELS["lz4"][level]
    packed = pa.Codec("lz4_raw", compression_level=native if native > 1 else None).compress(data, asbytes=True)
    stored = len(packed) >= len(data)
    body = data if stored else packed
    return (len(body) | stored << 31).to_bytes(4, "little") + body + xxhash.xxh32_intdigest(body).to_bytes(4, "little")


def lz4_stream(blocks: list[bytes], content_hash: int) -> bytes:
    """A frame of independent 4 MiB blocks with block and content checksums."""
    descriptor = b"\x74\x70"
    check = (xxhash.xxh32_intdigest(descriptor) >> 8 & 0xFF).to_bytes(1, "little")
    return b"\x04\x22\x4d\x18" + descriptor + check + b"".join(blocks) + b"\0\0\0\0" + content_hash.to_bytes(4, "little")


def lz4_encode(data: bytes, level: str) -> bytes:
    blocks = [lz4_block(data[at : at + LZ4_BLOCK], level) for at in range(0, len(data), LZ4_BLOCK)]
    return lz4_stream(blocks, xxhash.xxh32_intdigest(data))


#: Block sizes of a frame, and what its header calls them.
LZ4_SIZES = {64 << 10: 0x40, 256 << 10: 0x50, 1 << 20: 0x60, 4 << 20: 0x70}


def lz4_plain(data: bytes, size: int, level: str = "fast") -> bytes:
    """A frame of independent blocks of `size` bytes without checksums, as
    block encoders on devices write them."""
    descriptor = bytes([0x60, LZ4_SIZES[size]])
    check = (xxhash.xxh32_intdigest(descriptor) >> 8 & 0xFF).to_bytes(1, "little")
    blocks = [lz4_block(data[at : at + size], level)[:-4] for at in range(0, len(data), size)]
    return b"\x04\x22\x4d\x18" + descriptor + check + b"".join(blocks) + b"\0\0\0\0"


def xz_encode(data: bytes, level: str) -> bytes:
    preset = LEVELS["xz"][level] | (lzma.PRESET_EXTREME if level == "edge" else 0)
    # a dictionary over the data's length gains nothing and costs each row its memory
    size = min(1 << max(12, len(data).bit_length()), 64 << 20)
    whole = {"id": lzma.FILTER_LZMA2, "preset": preset}
    return lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC64, filters=[whole | ({"dict_size": size} if size < 1 << 23 else {})])


def zstd_encode(data: bytes, level: str) -> bytes:
    params = zstandard.ZstdCompressionParameters.from_level(LEVELS["zstd"][level], write_checksum=True, write_content_size=True, enable_ldm=level == "edge")
    return zstandard.ZstdCompressor(compression_params=params).compress(data)


ENCODERS: dict[str, Callable[[bytes, str], bytes]] = {
    "gzip": gzip_encode,
    "bzip2": lambda data, level: bz2.compress(data, LEVELS["bzip2"][level]),
    "xz": xz_encode,
    "zstd": zstd_encode,
    "lz4": lz4_encode,
    "brotli": lambda data, level: pa.Codec("brotli", compression_level=LEVELS["brotli"][level]).compress(data, asbytes=True),
}


def streamed(codec: str, data: bytes) -> bytes:
    """What Arrow's reader of `codec` makes of `data`, read into memory that is
    ours: `read` itself leaves what it allocated behind where a stream is
    damaged."""
    held, out = memoryview(bytearray(64 << 10)), []
    with pa.CompressedInputStream(pa.BufferReader(data), codec) as stream:
        while n := stream.readinto(held):
            out.append(bytes(held[:n]))
    return b"".join(out)


def members(codec: str, data: bytes) -> Iterator[bytes]:
    """Decodes streams that follow each other to the end of `data`."""
    make = {
        "gzip": lambda: zlib.decompressobj(31),
        "bzip2": bz2.BZ2Decompressor,
        "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ),
        "zstd": lambda: zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj(),
    }[codec]
    if not data:
        raise ValueError("no stream")
    while data:
        d = make()
        yield d.decompress(data)
        if not d.eof:
            raise ValueError("the stream is cut off")
        data = d.unused_data


def lz4_decode(data: bytes) -> bytes:
    if not data:
        raise ValueError("no stream")
    return streamed("lz4", data)


def decode(codec: str, data: bytes) -> bytes:
    """The bytes of one or more streams; an error for what isn't one."""
    if codec == "lz4":
        return lz4_decode(data)
    if codec == "brotli":
        return streamed("brotli", data)
    return b"".join(members(codec, data))


def encode_column(df: DataFrame, source: str, target: str, codec: str, level: str = "best") -> DataFrame:
    """`df` and a binary column `target`: `source` (binary or string) as one
    stream of `codec`. Null stays null; an empty value is an empty stream's
    bytes. A column named as `target` is replaced. Each row is encoded on its
    own, whatever the partitioning."""
    if codec not in CODECS or level not in LEVELS[codec]:
        raise ValueError(f"unknown codec or level: {codec}, {level}")
    return mapped(df, source, [T.StructField(target, T.BinaryType())], lambda data: (ENCODERS[codec](data, level),))


def lz4_column(df: DataFrame, source: str, target: str, size: int, level: str = "fast") -> DataFrame:
    """As `encode_column` for lz4 frames of blocks of `size` bytes (64 KiB,
    256 KiB, 1 MiB or 4 MiB) without checksums."""
    if size not in LZ4_SIZES:
        raise ValueError(f"no lz4 block size: {size}")
    return mapped(df, source, [T.StructField(target, T.BinaryType())], lambda data: (lz4_plain(data, size, level),))


def decode_column(df: DataFrame, source: str, target: str, codec: str, mode: str = "permissive") -> DataFrame:
    """`df` with `target` (binary) and `target`_error (string): the decoded
    streams of `source`. A damaged stream gives null and `io`; with mode
    `failfast` it fails the query. Null stays null without an error."""

    def one(data: bytes) -> tuple:
        try:
            return decode(codec, data), None
        except Exception:
            if mode == "failfast":
                raise
            return None, "io"

    return mapped(df, source, [T.StructField(target, T.BinaryType()), T.StructField(f"{target}_error", T.StringType())], one)


def mapped(df: DataFrame, source: str, new: list[T.StructField], one: Callable[[bytes], tuple]) -> DataFrame:
    """`df` and the columns `new`, made of each value of `source`. What is made
    goes on as soon as it is BATCH_BYTES."""
    names = [f.name for f in new]
    if source in names:
        raise ValueError(f"{source} is both read and written")
    df = df.drop(*names)
    at = df.columns.index(source)
    types = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in new]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size, start = [], 0, 0
            for k, x in enumerate(batch.column(at).cast(pa.binary()), 1):
                made = (None,) * len(new) if (data := x.as_py()) is None else one(data)
                found.append(made)
                size += sum(len(v) for v in made if isinstance(v, bytes))
                if k == len(batch) or size >= BATCH_BYTES or len(found) == 512:
                    part = batch.slice(start, k - start)
                    arrays = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *names])
                    found, size, start = [], 0, k

    small_batches(df.sparkSession)
    return df.mapInArrow(rows, T.StructType([*df.schema.fields, *new]))
