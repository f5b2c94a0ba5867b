"""tar and zip archives: packed from entry rows, read into entry rows.

7z and RAR archives are recognised; reading them gives `unsupported-operation`.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, paths
from ..shared import small_batches, stretches
from . import codecs

ENTRIES = (
    "archive string, ordinal long, path string, size long, is_dir boolean, kind string, mode int, mtime long, link_target string, content binary, error string"
)
ENTRIES_ARROW = pa.schema(
    [
        ("archive", pa.string()), ("ordinal", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("is_dir", pa.bool_()), ("kind", pa.string()),
        ("mode", pa.int32()), ("mtime", pa.int64()), ("link_target", pa.string()), ("content", pa.binary()), ("error", pa.string()),
    ]
)
KINDS = {"file": tarfile.REGTYPE, "dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE}
DEFLATE = {"fast": 1, "best": 6, "edge": 9}


# packing


def tar_member(path: str, content: bytes | None, kind: str, mode: int | None, mtime: int | None, link: str | None) -> bytes:
    """Header, data and padding of one entry: a tar is its members in order."""
    info = tarfile.TarInfo(path)
    info.type, info.linkname, info.mtime = KINDS[kind], link or "", mtime or 0
    info.mode = (0o755 if kind == "dir" else 0o644) if mode is None else mode & 0o777
    data = (content or b"") if kind == "file" else b""
    info.size = len(data)
    return info.tobuf(tarfile.GNU_FORMAT, "utf-8", "surrogateescape") + data + b"\0" * (-len(data) % 512)


def zip_member(path: str, content: bytes | None, kind: str, mode: int | None, link: str | None, level: str) -> tuple[bytes, bytes]:
    """(local record, central record without its offset). Directories and
    links are stored, files deflated; names are UTF-8."""
    name = (path.rstrip("/") + "/" if kind == "dir" else path).encode()
    data = {"file": content or b"", "symlink": (link or "").encode()}.get(kind, b"")
    z = zlib.compressobj(DEFLATE[level], zlib.DEFLATED, -15)
    body, method = (z.compress(data) + z.flush(), 8) if kind == "file" else (data, 0)
    bits = (0o755 if kind == "dir" else 0o644) if mode is None else mode & 0o777
    typed = {"dir": 0o040000, "symlink": 0o120000}.get(kind, 0o100000) | bits
    common = struct.pack("<HHHHHIIIHH", 20, 0x800, method, 0, 0x21, zlib.crc32(data), len(body), len(data), len(name), 0)
    local = b"PK\3\4" + common + name + body
    central = b"PK\1\2" + struct.pack("<H", 0x0314) + common + struct.pack("<HHHI", 0, 0, 0, typed << 16 | (0x10 if kind == "dir" else 0))
    return local, central + b"OFFS" + name


def members(entries: DataFrame, container: str, level: str) -> DataFrame:
    """(archive, ordinal, member, central): each entry's bytes, in parallel."""
    if container not in ("tar", "zip"):
        raise ValueError(f"unsupported-operation: {container} can't be written")
    schema = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("member", pa.binary()), ("central", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in stretches(1024 + (n or 0) for n in pc.binary_length(batch.column(3)).to_pylist()):
                part, made = batch.slice(start, length), []
                for path, content, kind, mode, mtime, link in zip(*(c.to_pylist() for c in part.columns[2:])):
                    made.append((tar_member(path, content, kind, mode, mtime, link), None) if container == "tar" else zip_member(path, content, kind, mode, link, level))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array([m[k] for m in made], pa.binary()) for k in (0, 1))], schema=schema)

    small_batches(entries.sparkSession)
    cols = ["archive", "ordinal", "path", F.col("content").cast("binary").alias("content"), "kind", "mode", "mtime", "link_target"]
    return entries.select(*cols).mapInArrow(rows, "archive string, ordinal long, member binary, central binary")


def pack(entries: DataFrame, container: str = "tar", codec: str | None = None, level: str = "best") -> DataFrame:
    """(archive, data): each archive's entries in the order of `ordinal`.

    entries: archive, ordinal, path, content, kind (file, dir, symlink or
    hardlink), mode, mtime, link_target; null mode: 644, or 755 for a
    directory. Members are made in parallel; a task holds one archive, which a
    binary value bounds to 2 GB. Equal input gives equal bytes, whatever the
    partitioning. An archive without rows doesn't arise.
    """
    if codec is not None and container != "tar":
        raise ValueError(f"{container} has its own compression")
    m = members(entries, container, level)
    grouped = m.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("ordinal", "member", "central"))).alias("m"))
    grouped = grouped.select("archive", F.transform("m", lambda x: x["member"]).alias("member"), F.transform("m", lambda x: x["central"]).alias("central"))
    schema = pa.schema([("archive", pa.string()), ("data", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                parts = batch.column(1)[k].as_py()
                data = b"".join(parts) + (b"\0" * 1024 if container == "tar" else directory(parts, batch.column(2)[k].as_py()))
                data = codecs.ENCODERS[codec](data, level) if codec else data
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([data], pa.binary())], schema=schema)

    return grouped.mapInArrow(rows, "archive string, data binary")


def directory(locals_: list[bytes], centrals: list[bytes]) -> bytes:
    """The central records with their offsets, and the end; in the 64-bit form
    where a number is too large for the plain one."""
    at, out = 0, []
    for local, central in zip(locals_, centrals):
        if at < 0xFFFFFFFF:
            out.append(central[:42] + struct.pack("<I", at) + central[46:])
        else:
            out.append(central[:30] + struct.pack("<H", 12) + central[32:42] + b"\xff" * 4 + central[46:] + struct.pack("<HHQ", 1, 8, at))
        at += len(local)
    n, size, far = len(out), sum(map(len, out)), b""
    if n >= 0xFFFF or at + size >= 0xFFFFFFFF:
        far = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at) + b"PK\6\7" + struct.pack("<IQI", 0, at + size, 1)
    few = min(n, 0xFFFF)
    return b"".join(out) + far + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, few, few, min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0)


# reading


def tar_rows(data: bytes, with_content: bool) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
        for k, info in enumerate(tar):
            kind = next((n for n, t in KINDS.items() if info.type == t), "file" if info.isreg() else "other")
            body = tar.extractfile(info).read() if with_content and kind == "file" else None
            path = info.name + "/" * (kind == "dir" and not info.name.endswith("/"))
            yield k, path, info.size, kind == "dir", kind, info.mode, int(info.mtime), info.linkname or None, body, None


def zip_rows(data: bytes, with_content: bool) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for k, info in enumerate(z.infolist()):
            bits = info.external_attr >> 16
            kind = "dir" if info.is_dir() else "symlink" if bits & 0o170000 == 0o120000 else "file"
            body = z.read(info) if kind == "symlink" or with_content and kind == "file" else None
            link = body.decode() if kind == "symlink" else None
            yield k, info.filename, info.file_size, kind == "dir", kind, bits & 0o7777 or None, None, link, body if kind == "file" else None, None


def entry_rows(name: str, container: str | None, codec: str | None, data: bytes, with_content: bool) -> Iterator[tuple]:
    if container in ("7z", "rar") or container is None and codec is None:
        raise NotImplementedError(container)
    if codec:
        data = codecs.decode(codec, data)
    if container == "zip":
        yield from zip_rows(data, with_content)
    elif container == "tar" or data[257:262] == b"ustar":
        yield from tar_rows(data, with_content)
    elif with_content:
        yield 0, name, len(data), False, "file", None, None, None, data, None
    else:
        raise NotImplementedError("a single stream has no entries")


def read_entries(blobs: DataFrame, *, name_col: str = "archive", data_col: str = "data", format_name: str | None = None, with_content: bool = False) -> DataFrame:
    """The entries of each archive, in stored order, with their contents if
    asked for.

    The format is detected from name and bytes unless `format_name` says it. A
    codec alone is looked into for a tar; with contents, a stream that isn't
    one is a single file of the name less its suffix. An archive that can't be
    read gives one row with the error `unknown-format`,
    `unsupported-operation` or `io`, after the entries read before it. Null
    data gives no rows. An archive is read by one task.
    """
    name, data = F.col(name_col).cast("string"), F.col(data_col).cast("binary")
    fmt = formats.parse_format(F.lit(format_name)) if format_name else formats.detect(paths.base_name(name), F.substring(data, 1, 512))
    out_name = paths.stream_output_name(paths.base_name(name), F.col("codec"), F.lit(None).cast("string"))
    cols = blobs.where(data.isNotNull()).select(name.alias("archive"), fmt.getField("container").alias("container"), fmt.getField("codec").alias("codec"), data.alias("data"))
    cols = cols.withColumn("out_name", out_name)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(archive, held):
            columns = list(zip(*held))
            arrays = [pa.array([archive] * len(held), pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(ENTRIES_ARROW)[1:]))]
            return pa.RecordBatch.from_arrays(arrays, schema=ENTRIES_ARROW)

        for batch in batches:
            for k in range(len(batch)):
                archive, container, codec, body, out = (c[k].as_py() for c in batch.columns)
                held, size, error = [], 0, None
                try:
                    for row in entry_rows(out, container, codec, body, with_content):
                        held.append(row)
                        size += len(row[8] or b"") + 200
                        if size > 8 << 20:
                            yield made(archive, held)
                            held, size = [], 0
                except NotImplementedError:
                    error = "unsupported-operation" if container or codec else "unknown-format"
                except Exception:  # whatever a damaged archive makes its reader raise
                    error = "io"
                if error:
                    held.append((None,) * 9 + (error,))
                if held:
                    yield made(archive, held)

    small_batches(cols.sparkSession)
    return cols.mapInArrow(rows, ENTRIES)


def extract(entries: DataFrame, select: list[str] | None = None) -> DataFrame:
    """What extraction would write, of `entries` read with contents:
    (archive, ordinal, path, kind, mode, mtime, link_target, content, error).

    Entries outside `select` (archive paths; a folder brings its subtree) are
    left out before anything is judged. `./` and kinds other than file, dir
    and links are skipped. Paths are made relative to the destination; error
    is `path-traversal` for a path or link target that leaves it, or for an
    entry below a symbolic link of its archive; such rows have no content.
    Modes keep permission bits alone.
    """
    e = entries.where("path is not null and kind <> 'other'").where(~paths.is_root_entry(F.col("path")) | ~F.col("is_dir"))
    e = e.withColumn("mapped", paths.select_path(F.col("path"), select or [])).where("mapped is not null")
    e = e.withColumn("safe", paths.safe_path(F.col("mapped")))
    stays = paths.resolve_link(F.col("safe.path"), F.col("link_target")).isNotNull()
    bad_link = (F.col("kind") == "symlink") & ~stays
    bad_hard = (F.col("kind") == "hardlink") & paths.safe_path(F.col("link_target")).getField("error").isNotNull()
    e = e.withColumn("error", F.coalesce("error", "safe.error", F.when(bad_link | bad_hard, F.lit("path-traversal")))).withColumn("path", F.col("safe.path"))
    e = below_links(e)
    content = F.when(F.col("error").isNull(), F.col("content"))
    return e.select("archive", "ordinal", "path", "kind", paths.safe_mode(F.col("mode")).alias("mode"), "mtime", "link_target", content.alias("content"), "error")


def below_links(e: DataFrame) -> DataFrame:
    """Marks entries of which an ancestor is a symbolic link of the archive:
    each path's ancestors, joined to the links by equality."""
    links = e.where("kind = 'symlink' and path is not null").select("archive", F.col("path").alias("ancestor")).distinct()
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    lines = e.where(F.size(parts) > 1).select("archive", "ordinal", F.explode(up).alias("ancestor"))
    hit = lines.join(links, ["archive", "ancestor"], "left_semi").select("archive", "ordinal", F.lit(True).alias("under")).distinct()
    e = e.join(hit, ["archive", "ordinal"], "left")
    return e.withColumn("error", F.coalesce("error", F.when(F.col("under"), F.lit("path-traversal")))).drop("under")


def entry_mtime(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


