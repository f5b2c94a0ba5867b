"""Codecs, blocks, archives, entries and decisions."""

import gzip
import io
import random
import shutil
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stowage.operators import archives, blocks, codecs, entries
from stowage.plans import decisions


def streams():
    state, noise = 0xDEADBEEFCAFEBABE, bytearray()
    for _ in range(1 << 16):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        noise.append(state >> 56)
    return {"empty": b"", "hello": b"hello world", "repetitive": b"\x42" * (1 << 20), "noise": bytes(noise)}


@pytest.mark.parametrize("level", ["fast", "best", "edge"])
@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codec_round_trip(codec, level):
    for data in streams().values():
        packed = codecs.ENCODERS[codec](data, level)
        assert codecs.decode(codec, packed) == data
        if codec != "brotli":
            assert codecs.decode(codec, packed + codecs.ENCODERS[codec](b"second", level)) == data + b"second"


@pytest.mark.parametrize("codec", [c for c in codecs.CODECS if c != "brotli"])
def test_damage_is_found(codec):
    packed = bytearray(codecs.ENCODERS[codec](b"hello world" * 50, "best"))
    packed[len(packed) // 2] ^= 0xFF
    with pytest.raises(Exception):
        codecs.decode(codec, bytes(packed))
    with pytest.raises(Exception):
        codecs.decode(codec, b"")


@pytest.mark.parametrize("codec,tool", [("gzip", "gzip"), ("bzip2", "bzip2"), ("xz", "xz"), ("zstd", "zstd"), ("lz4", "lz4")])
def test_tools_read_streams(codec, tool):
    if not shutil.which(tool):
        pytest.skip(f"{tool} isn't here")
    for data in streams().values():
        out = subprocess.run([tool, "-dc"], input=codecs.ENCODERS[codec](data, "best"), capture_output=True, timeout=60)
        assert out.returncode == 0 and out.stdout == data


@pytest.mark.parametrize("size", codecs.LZ4_SIZES)
def test_plain_lz4_frames(size):
    for data in streams().values():
        frame = codecs.lz4_plain(data, size)
        assert codecs.decode("lz4", frame) == data
        if shutil.which("lz4"):
            assert subprocess.run(["lz4", "-dc"], input=frame, capture_output=True, timeout=60).stdout == data


def test_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc"), "x"), (2, None, "y"), (3, bytearray(b""), "z")], "id long, raw binary, packed string")
    packed = codecs.encode_column(df, "raw", "packed", "zstd")
    assert packed.columns == ["id", "raw", "packed"]
    back = {r.id: r for r in codecs.decode_column(packed, "packed", "out", "zstd").collect()}
    assert bytes(back[1].out) == b"abc" and back[2].out is None and back[2].out_error is None and bytes(back[3].out) == b""
    bad = codecs.decode_column(df, "raw", "out", "gzip").orderBy("id").collect()
    assert [r.out_error for r in bad] == ["io", None, "io"]
    with pytest.raises(ValueError):
        codecs.encode_column(df, "raw", "out", "rar")


@pytest.mark.parametrize("codec", blocks.BLOCK_CODECS)
def test_blocks_whatever_the_partitioning(spark, codec):
    size = 1000
    sizes = [0, 1, size - 1, size, size + 1, 7 * size + 3]
    rows = [(k, bytearray(random.Random(k).randbytes(n) if k % 2 else b"ab" * n)[:n]) for k, n in enumerate(sizes)] + [(99, None)]
    made = []
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "id long, data binary").repartition(parts)
        b = blocks.block_rows(df, "id", "data", size)
        e = blocks.encode_blocks(b, codec)
        whole = df.where("data is not null").select(F.col("id").alias("stream_id"), "data")
        out = blocks.assemble_lz4(e, whole) if codec == "lz4" else blocks.assemble(e, codec)
        made.append({r.stream_id: bytes(r.data) for r in out.collect()})
    assert made[0] == made[1] and {k: codecs.decode(codec, v) for k, v in made[0].items()} == {k: bytes(v) for k, v in rows[:-1]}
    if codec == "gzip":
        assert gzip.decompress(made[0][5]) == bytes(rows[5][1])
    counts = {r.stream_id: (r.n, r.last) for r in b.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col("last").cast("int")).alias("last")).collect()}
    assert counts == {0: (1, 1), 1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (2, 1), 5: (8, 1)}
    if codec == "lz4":
        stored = {r.stream_id for r in e.where("stored").collect()}
        assert stored == {1, 3, 4, 5}  # 4: its last block is one byte


ROWS = [
    ("a", 0, "top/", None, "dir", None, 5, None), ("a", 1, "top/x.txt", b"hello", "file", 0o4755, 6, None), ("a", 2, "top/link", None, "symlink", None, None, "x.txt"),
    ("a", 3, "top/é.txt", b"", "file", None, None, None), ("b", 0, "y", b"z" * 3000, "file", 0o600, None, None),
]
ENTRY = "archive string, ordinal long, path string, content binary, kind string, mode int, mtime long, link_target string"


@pytest.mark.parametrize("container,codec,name", [("tar", None, ".tar"), ("tar", "gzip", ".tgz"), ("tar", "xz", ".xz"), ("tar", "brotli", ".tar.br"), ("zip", None, ".zip")])
def test_archive_round_trip(spark, container, codec, name):
    e = spark.createDataFrame([(a, o, p, None if c is None else bytearray(c), *r) for a, o, p, c, *r in ROWS], ENTRY)
    packed = archives.pack(e.repartition(3), container, codec)
    assert {r.archive: bytes(r.data) for r in packed.collect()} == {r.archive: bytes(r.data) for r in archives.pack(e.coalesce(1), container, codec).collect()}
    blobs = packed.withColumn("archive", F.concat("archive", F.lit(name)))
    got = {(r.archive[0], r.ordinal): r for r in archives.read_entries(blobs, with_content=True).collect()}
    assert len(got) == len(ROWS)
    for a, o, p, c, kind, mode, mtime, link in ROWS:
        r = got[a, o]
        assert (r.path, r.kind, r.link_target, r.error) == (p, kind, link, None) and r.is_dir == (kind == "dir")
        assert (None if r.content is None else bytes(r.content)) == (c if kind == "file" else None)
        if mode:
            assert r.mode & 0o777 == mode & 0o777 and r.mode <= 0o777
    data = bytes(blobs.where("archive like 'a%'").first().data)
    if container == "zip":
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    elif codec is None:
        assert tarfile.open(fileobj=io.BytesIO(data)).getnames() == ["top", "top/x.txt", "top/link", "top/é.txt"]


def hostile(kind, name, link=""):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, k, target in ([("d/up", "sym", ".."), ("d/up/evil", "file", "")] if kind == "chain" else [(name, kind, link)]):
            info = tarfile.TarInfo(n)
            info.type = {"sym": tarfile.SYMTYPE, "hard": tarfile.LNKTYPE, "fifo": tarfile.FIFOTYPE, "dir": tarfile.DIRTYPE}.get(k, tarfile.REGTYPE)
            info.linkname, info.mode = target, 0o6777
            body = b"x" if k == "file" else b""
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_hostile_archives(spark):
    cases = {
        "dots": (hostile("file", "../evil"), ["path-traversal"]), "abs": (hostile("file", "/abs"), ["path-traversal"]), "symabs": (hostile("sym", "l", "/etc"), ["path-traversal"]),
        "symout": (hostile("sym", "a/l", "../../x"), ["path-traversal"]), "symok": (hostile("sym", "a/l", "../x"), [None]), "hard": (hostile("hard", "h", "../x"), ["path-traversal"]),
        "chain": (hostile("chain", ""), [None, "path-traversal"]), "fifo": (hostile("fifo", "p"), []), "root": (hostile("dir", "./"), []), "rootfile": (hostile("file", "./"), ["path-traversal"]),
    }
    blobs = spark.createDataFrame([(f"{k}.tar", bytearray(d)) for k, (d, _) in cases.items()], "archive string, data binary")
    out = archives.extract(archives.read_entries(blobs, with_content=True)).collect()
    for k, (_, want) in cases.items():
        rows = sorted((r for r in out if r.archive == f"{k}.tar"), key=lambda r: r.ordinal)
        if k == "rootfile":  # a reader of tar strips the slash: it is `.`, a file
            assert all(r.error for r in rows)
            continue
        assert [r.error for r in rows] == want, k
        assert all(r.mode <= 0o777 for r in rows) and all(r.content is None for r in rows if r.error)
    picked = archives.extract(archives.read_entries(blobs, with_content=True), ["d"]).collect()
    assert {r.archive for r in picked} == {"chain.tar"}  # what isn't selected isn't judged


def test_unreadable_archives(spark):
    blobs = [("a.rar", b"Rar!\x1a\x07\x00"), ("a.7z", b"7z\xbc\xaf\x27\x1c"), ("a.txt", b"plain"), ("a.gz", b"\x1f\x8bbroken"), ("a.zip", b"PK\x03\x04broken"), ("b.gz", gzip.compress(b"text")), ("n.tar", None)]
    df = spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in blobs], "archive string, data binary")
    want = {"a.rar": "unsupported-operation", "a.7z": "unsupported-operation", "a.txt": "unknown-format", "a.gz": "io", "a.zip": "io", "b.gz": "unsupported-operation"}
    assert {r.archive: r.error for r in archives.read_entries(df).collect()} == want
    full = {r.archive: r for r in archives.read_entries(df, with_content=True).collect()}
    assert full["b.gz"].path == "b" and bytes(full["b.gz"].content) == b"text"


TREE = [("z", k, *r) for k, r in enumerate([("a/b/c.txt", 3, False), ("./a", 0, True), ("x", 5, False), ("x/y", 7, False), (".h/k", 2, False), ("x", 6, False), ("./", 0, True), ("e", 0, False), ("e", 0, True)])]


def test_tree(spark):
    e = spark.createDataFrame(TREE, "archive string, ordinal long, path string, size long, is_dir boolean")
    got = {r.path: (r.is_dir, r.size, r.depth) for r in entries.tree(e).collect()}
    assert got == {
        "a": (True, 0, 1), "a/b": (True, 0, 2), "a/b/c.txt": (False, 3, 3), "x": (False, 6, 1), "x/y": (False, 7, 2), ".h": (True, 0, 1), ".h/k": (False, 2, 2), "e": (True, 0, 1),
    }
    c = entries.tree_counts(entries.tree(e)).first()
    assert (c.files, c.folders, c.total) == (2, 3, 11)
    shown = [r.path for r in entries.tree_rows(entries.tree(e)).where("parent = ''").orderBy("position").collect()]
    assert shown == [".h", "a", "e", "x"]
    assert entries.distinct_roots(e, ["archive"]).first().n_roots == 4
    f = entries.footer(e, ["archive"]).first()
    assert (f.files, f.original, f.label) == (6, 23, "Avg file size")


def test_merge(spark):
    schema = "archive string, ordinal long, path string, size long"
    old = spark.createDataFrame([("z", 0, "docs/a", 1), ("z", 1, "docs/a2", 1), ("z", 2, "docs/a/b", 1), ("z", 3, "top", 1)], schema)
    new = spark.createDataFrame([("z", 0, "a/n", 9, "docs"), ("z", 1, "zz", 9, "")], schema + ", prefix string")
    merged, none = entries.merge(old, new, replace=True)
    assert [r.path for r in merged.orderBy("ordinal").collect()] == ["docs/a2", "docs/a/n", "top", "zz"] and none.count() == 0
    _, clashes = entries.merge(old, new)
    assert sorted(r.path for r in clashes.collect()) == ["docs/a", "docs/a/b"]
    with pytest.raises(ValueError):
        entries.collect_many([("x/a", old), ("y/a/", old)])


def test_names_and_plans(spark):
    there = spark.createDataFrame([("d", "a.zip"), ("d", "a 2.zip"), ("d", "b 1.zip"), ("d", "photos.tar.gz"), ("d", "single"), ("d", "multi"), ("e", "a.zip")], "dir string, name string")
    asked = spark.createDataFrame([("d", "a", ".zip"), ("e", "a", ".zip"), ("d", "b", ".zip"), ("f", "a", ".zip"), ("d", "a 2", ".zip")], "dir string, stem string, ext string")
    got = {(r.dir, r.stem): r.name for r in decisions.unique_names(asked, there).collect()}
    assert got == {("d", "a"): "a 3.zip", ("e", "a"): "a 2.zip", ("d", "b"): "b.zip", ("f", "a"): "a.zip", ("d", "a 2"): "a 2 2.zip"}
    jobs = [("d", "notes.txt", 1, False, None), ("d", "photos", 1, True, None), ("d", "x", 2, False, "zip"), ("d", "photos", 1, True, "gzip"), ("d", "f", 1, False, "gz")]
    plan = decisions.plan_compress(spark.createDataFrame(jobs, "dir string, first_name string, n_inputs int, first_is_dir boolean, preferred string"), there)
    assert sorted((r.name, r.format) for r in plan.collect()) == [("archive.zip", "zip"), ("f.gz", "gzip"), ("notes.txt.zst", "zstd"), ("photos 2.tar.gz", "tar.gz"), ("photos.tar.zst", "tar.zst")]
    jobs = [("d", "free.zip", 1, "free"), ("d", "single.zip", 1, "single"), ("d", "multi.zip", 3, None), ("d", "notes.txt.gz", None, None), ("d", "none.zip", 0, None)]
    plan = {r.file_name: (r.dest, r.result) for r in decisions.plan_extract(spark.createDataFrame(jobs, "dir string, file_name string, n_roots int, root string"), there).collect()}
    assert plan == {"free.zip": ("d", "free"), "single.zip": ("d/single 2", "single 2"), "multi.zip": ("d/multi 2", "multi 2"), "notes.txt.gz": ("d", "notes.txt"), "none.zip": ("d/none", "none")}


MODES = [
    (True, False, False, "o.gz", True, True, "compress", None), (True, False, False, "o", True, True, None, "no-target"), (False, True, False, None, False, False, "extract", None),
    (True, True, True, None, True, True, "compress", None), (False, False, True, "o", True, True, "compress", None), (False, False, False, "o", True, True, "extract", None),
    (False, False, True, None, True, False, "extract", None), (False, False, False, None, True, False, None, "unrecognised-input"), (False, False, False, None, False, False, None, "unreadable-input"),
]


def test_modes(spark):
    df = spark.createDataFrame([r[:6] for r in MODES], "c boolean, x boolean, a boolean, o string, r boolean, d boolean")
    got = df.select(decisions.infer_mode(*(F.col(k) for k in "cxaord")).alias("m")).collect()
    assert [(r.m.mode, r.m.error) for r in got] == [r[6:] for r in MODES]


def test_backends(spark):
    caps = spark.createDataFrame(
        [(0, 0, "p", "d0", "lz4", "tar", "encode", ["fast"], "experimental"), (1, 0, "q", "d1", "lz4", None, "encode", ["fast", "best"], "supported"), (2, 0, "p", "d9", "lz4", "tar", "encode", ["fast"], "supported")],
        "registration long, ordinal long, provider_id string, device_id string, codec string, container string, direction string, levels array<string>, maturity string",
    )
    asked = [
        (1, "cpu", None, None, "lz4", "tar", "encode", "fast", "cpu", None), (2, "auto", None, None, "lz4", "tar", "encode", "fast", "p:d9", None), (3, "required", "p", "d0", "lz4", "tar", "encode", "fast", None, "device"),
        (4, "auto", "zz", "d", "lz4", "tar", "encode", None, "cpu", "provider"), (5, "auto", None, None, "xz", None, "encode", None, "cpu", "codec"), (6, "required", None, None, "lz4", "zip", "encode", None, None, "format"),
        (7, "auto", None, None, "lz4", None, "decode", None, "cpu", "direction"), (8, "auto", None, None, "lz4", None, "encode", "edge", "cpu", "level"), (9, "auto", None, None, "lz4", None, "encode", None, "q:d1", None),
    ]
    schema = "request_id long, preference string, provider_id string, device_id string, codec string, container string, direction string, level string"
    got = decisions.match_backends(spark.createDataFrame([a[:8] for a in asked], schema), caps).orderBy("request_id").collect()
    assert [(r.backend, r.reason) for r in got] == [a[8:] for a in asked]
    assert decisions.match_backends(spark.createDataFrame([asked[3][:8]], schema), caps.where("false")).first().reason == "provider"


def test_repeated_requests_stay(spark):
    caps = spark.createDataFrame([(0, 0, "p", "d", "lz4", "tar", "encode", ["fast"], "supported")], "registration long, ordinal long, provider_id string, device_id string, codec string, container string, direction string, levels array<string>, maturity string")
    schema = "request_id long, preference string, provider_id string, device_id string, codec string, container string, direction string, level string"
    same = (1, "auto", None, None, "lz4", "tar", "encode", None)
    got = decisions.match_backends(spark.createDataFrame([same, same, same, (2, "auto", None, None, None, None, None, None)], schema), caps)
    assert got.columns == [*(c.split()[0] for c in schema.split(", ")), "backend", "reason"]
    assert sorted((r.request_id, r.backend, r.reason) for r in got.collect()) == [(1, "p:d", None)] * 3 + [(2, "cpu", "codec")]


def test_backend_messages(spark):
    rows = [("codec", None, "lz4", "encode", "best", None), ("level", None, "tar.lz4", "encode", "edge", ["best", "fast"]), ("device", "p:d", "lz4", "decode", None, None), ("level", "p:d", "lz4", "encode", "edge", ["fast"]), ("direction", "p:d", "lz4", "decode", None, None), (None, None, "lz4", "encode", None, None)]
    df = spark.createDataFrame(rows, "reason string, target string, fmt string, direction string, level string, levels array<string>")
    got = [r.m for r in df.select(decisions.backend_message(*(F.col(c) for c in df.columns)).alias("m")).collect()]
    assert got == [
        "no compatible hardware accelerator is available for lz4 encoding at Best level",
        "no compatible hardware accelerator is available for tar.lz4 encoding at Edge level; hardware supports tar.lz4 encoding only at Best or Fast level",
        "requested accelerator `p:d` was not found", "requested accelerator `p:d` supports lz4 encoding only at Fast level",
        "requested accelerator `p:d` does not support lz4 decoding", None,
    ]


def test_zip_of_many_entries(spark):
    n = 66_000
    e = spark.range(n).select(
        F.lit("z.zip").alias("archive"), F.col("id").alias("ordinal"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(b"").alias("content"), F.lit("file").alias("kind"),
        F.lit(None).cast("int").alias("mode"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("string").alias("link_target"),
    )
    packed = archives.pack(e, "zip", level="fast")
    names = zipfile.ZipFile(io.BytesIO(bytes(packed.first().data))).namelist()
    assert len(names) == n and names[-1] == f"f{n - 1}"


def test_far_zip_offsets():
    """Beyond 4 GB the 64-bit records say where a member is."""
    local, central = archives.zip_member("a", b"x", "file", None, None, "fast")

    class Far(bytes):
        def __len__(self):
            return (1 << 32) + 10

    tail = archives.directory([Far(b""), local], [central, central])
    at = tail.index(b"PK\x01\x02", 4)
    assert tail[at + 42 : at + 46] == b"\xff" * 4 and tail[at + 30 : at + 32] == b"\x0c\0" and int.from_bytes(tail[at + 46 + 1 + 4 : at + 46 + 1 + 12], "little") == (1 << 32) + 10
    assert b"PK\6\6" in tail and b"PK\6\7" in tail


@pytest.mark.parametrize("codec", blocks.ROW_CODECS)
def test_blocks_decode_alone(spark, codec):
    rows = [(k, bytearray(random.Random(k).randbytes(n) if k % 2 else b"ab" * n)[:n]) for k, n in enumerate([0, 1, 99, 100, 101, 730])]
    cut = blocks.block_rows(spark.createDataFrame(rows, "id long, data binary"), "id", "data", 100)
    e = blocks.encode_blocks(cut, codec)
    key = lambda df: sorted((r.stream_id, r.block_index, bytes(r.raw)) for r in df.collect())
    assert key(blocks.decode_blocks(e, codec)) == key(cut)
    assert {r.stream_id: bytes(r.data) for r in blocks.joined(blocks.decode_blocks(e, codec)).collect()} == {k: bytes(d) for k, d in rows}
    with pytest.raises(Exception, match="io|checksum|Error"):
        blocks.decode_blocks(e.withColumn("crc", F.col("crc") + 1), codec).collect()


def test_rows_of_a_preview(spark):
    """A folder and then all below it; the limit is on an archive's rows, not on a folder's."""
    names = ["b/x2", "b/x10", "b/x1000000000000000000000001", "b/x999999999999999999999999", "a/1", "a/2", "top", "b/sub/k", "top/under"]
    e = spark.createDataFrame([("z", k, n, 1, False) for k, n in enumerate(names)], "archive string, ordinal long, path string, size long, is_dir boolean")
    nodes = entries.tree(e)
    shown = [r.path for r in entries.tree_rows(nodes).orderBy("position").collect()]
    assert shown == ["a", "a/1", "a/2", "b", "b/sub", "b/sub/k", "b/x2", "b/x10", "b/x999999999999999999999999", "b/x1000000000000000000000001", "top"]
    first = entries.tree_rows(nodes, limit=5).orderBy("position").collect()
    assert [(r.path, r.position) for r in first] == list(zip(shown[:5], range(1, 6)))


def test_numbering_of_a_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, F.lit("big")).otherwise(F.lit("small")).alias("g"), ((F.col("id") * 7919) % 5000).alias("k"))
    got = entries.numbered(df, "g", [F.col("k")]).collect()
    for g in ("big", "small"):
        rows = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert set(got[0].asDict()) == {"g", "k", "position"}


@pytest.mark.parametrize("codec", ["lz4", "brotli"])
def test_damaged_streams_leave_no_memory(codec):
    """6000 streams cut short left 7 KB each."""
    import os

    import psutil

    cut = codecs.ENCODERS[codec](os.urandom(20_000), "fast")[:-5]
    rss = psutil.Process().memory_info
    for k in range(7000):
        if k == 1000:
            before = rss().rss
        with pytest.raises(OSError):
            codecs.decode(codec, cut)
    assert rss().rss - before < 20e6


def test_python_holds_a_few_mb_at_a_time(spark):
    """Batches, and what is made of them, don't grow with the rows."""
    from stowage.shared import BATCH_BYTES, stretches

    assert list(stretches([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 1), (3, 2)] and list(stretches([], 6)) == []
    d = spark.range(0, 300, 1, 1).select(F.col("id").alias("k"), F.lit(b"x" * 100_000).alias("raw"))
    encoded = codecs.encode_column(d, "raw", "x", "zstd")
    decoded = codecs.decode_column(encoded.select("k", "x"), "x", "data", "zstd")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([len(b)])], names=["bytes", "rows"])

    for df in (d, decoded):
        got = df.mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r.rows for r in got) == 300 and max(r.bytes for r in got) < BATCH_BYTES + 300_000


def test_added_to_archives_are_read_once(spark, tmp_path, monkeypatch):
    """The entries of the archives that are added to come from a written table."""
    from stowage.queries import files

    made = []
    monkeypatch.setattr(files, "written", lambda df, name, w=files.written: made.append(name) or w(df, name))
    files.q_archive_add_files(spark, "/root/testdata/sf0.001")
    assert made == ["entries"]


@pytest.mark.parametrize("codec,level", blocks.SLOW)
def test_slow_levels_get_equal_shares(spark, codec, level):
    """Blocks of one file, which is one task, are encoded by many."""
    d = spark.range(0, 640, 1, 1).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("raw"))
    cut = blocks.block_rows(d, "k", "raw", 1024)
    e = blocks.encode_blocks(cut, codec, level).withColumn("task", F.spark_partition_id())
    shares = [r["count"] for r in e.groupBy("task").count().collect()]
    assert sum(shares) == 640 and len(shares) >= 7 * spark.sparkContext.defaultParallelism and max(shares) <= 640 / 16
    back = blocks.joined(blocks.decode_blocks(e.drop("task"), codec))
    assert {r.stream_id: bytes(r.data) for r in back.collect()} == {k: f"text {k}".encode() for k in range(640)}


def test_archives_and_streams_come_a_few_mb_at_a_time(spark):
    """What tasks hand to Python of archives, their entries and streams doesn't grow with the rows."""
    from stowage.shared import BATCH_BYTES

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([len(b)])], names=["bytes", "rows"])

    body, none = F.lit(b"x" * 100_000), F.lit(None)
    ids = spark.range(0, 300, 1, 1).select("id", F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".tar")).alias("archive"))
    rows = ids.select(
        "archive", "id", F.lit("f").alias("path"), body.alias("content"), F.lit("file").alias("kind"), none.cast("int").alias("mode"), none.cast("long").alias("mtime"),
        none.cast("string").alias("link_target"),
    ).withColumnRenamed("id", "ordinal")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    packed = archives.pack(rows, "tar")
    read = archives.read_entries(packed, with_content=True)
    back = codecs.decode_column(blocks.encode_streams(ids.withColumn("raw", body), "id", "raw", "bzip2", "fast", 64 << 10), "data", "out", "bzip2")
    for df in (packed, read, back):
        got = df.coalesce(1).mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r.rows for r in got) == 300 and max(r.bytes for r in got) < BATCH_BYTES + 300_000


@pytest.mark.parametrize("name", ["q_roundtrip_bzip2_fast", "q_list_tar_zst_sniff", "q_below_links"])
def test_queries_hand_python_a_few_mb_at_a_time(spark, monkeypatch, name):
    """Over one file of 25 MB of text, in every Python step of the query, both ways."""
    from pyspark.sql.classic.dataframe import DataFrame
    from stowage import catalogue
    from stowage.shared import BATCH_BYTES

    most = BATCH_BYTES + 1_000_000  # and a row, of which the largest is an archive
    steps, plain = [], DataFrame.mapInArrow

    def watched(self, func, *args, **kwargs):
        def small(batches, what):
            for b in batches:
                if b.nbytes > most:
                    raise ValueError(f"{what}: {b.nbytes} bytes in {len(b)} rows")
                yield b

        steps.append(func)
        return plain(self, lambda batches: small(func(small(batches, "handed over")), "handed back"), *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()
    assert len(steps) >= 3
