"""Column functions against the tables of expected values."""

import pytest
from pyspark.sql import functions as F

from stowage.functions import digests, formats, paths, text


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


NAMES = [
    ("photos.TAR.GZ", "photos", "tar", "gzip"), ("Archive.Tar.Bz2", "Archive", "tar", "bzip2"), ("a.b.tar.gz", "a.b", "tar", "gzip"),
    ("my.data.txt.gz", "my.data.txt", None, "gzip"), ("x.tgz", "x", "tar", "gzip"), ("x.7z", "x", "7z", None), ("x.rar", "x", "rar", None),
    ("document.pdf", None, None, None), ("Makefile", None, None, None), ("", None, None, None), (None, None, None, None), ("x.tbz", None, None, None),
    ("a\n.zip", "a\n", "zip", None), ("İ.gz", "İ", None, "gzip"), (".tar.gz", "", "tar", "gzip"),
]


def test_names(spark):
    n, f = F.col("n"), formats.format_of_name(F.col("n"))
    got = values(spark, [(r[0],) for r in NAMES], "n string", n=n, stem=formats.stem_of_name(n), a=f.getField("container"), b=f.getField("codec"))
    assert got == NAMES


DETECT = [
    ("x.tgz", "1F8B08", "tar.gz"), ("x.tar.gz", "1F8B08", "tar.gz"), ("x", "1F8B", "gzip"), ("x.br", "00", "brotli"), ("x.zip", "1F8B", "gzip"),
    ("x.tar.zst", "28B52FFD", "tar.zst"), ("x.txt", "00", None), ("x.tar.gz", "00" * 257 + "7573746172", "tar.gz"), ("x.gz", "00" * 257 + "7573746172", "tar"),
    ("x", "00" * 257 + "75737461", None), ("x", "526172211A070100", "rar"), ("x", "526172211A0700", "rar"), ("x", "504B0506", "zip"), ("x", "", None),
    ("x", "377ABCAF271C", "7z"), ("x", "FD377A585A00", "xz"), ("x", "04224D18", "lz4"), ("x", "425A6839", "bzip2"),
]


def test_detection(spark):
    got = values(spark, [r[:2] for r in DETECT], "n string, h string", f=formats.format_name(formats.detect(F.col("n"), F.unhex("h"))))
    assert [g[0] for g in got] == [r[2] for r in DETECT]


def test_format_names(spark):
    rows = [("tar.gz",), ("GZ",), ("sevenz",), ("tgz",), ("nope",), (None,), ("Brotli",)]
    f = formats.parse_format(F.col("t"))
    got = values(spark, rows, "t string", n=formats.format_name(f), e=formats.extension(f), p=formats.format_name(formats.promoted(f, F.lit(True))), w=formats.writable(f))
    assert got == [
        ("tar.gz", ".tar.gz", "tar.gz", True), ("gzip", ".gz", "tar.gz", False), ("7z", ".7z", "7z", False), ("tar.gz", ".tar.gz", "tar.gz", True),
        (None, None, None, False), (None, None, None, False), ("brotli", ".br", "tar.br", False),
    ]
    assert one(spark, formats.format_name(formats.make_format(None, None))) == "<invalid format>"


SAFE = [
    ("../evil", None), ("/abs/evil", None), ("foo/../../evil", None), ("", None), (".", None), ("/C:/evil", None), ("./ok/file", "ok/file"), ("a/b/c", "a/b/c"),
    ("file.txt", "file.txt"), ("C:\\evil", "C:\\evil"), ("a//b/./c/", "a/b/c"), (None, None), ("..", None),
]


def test_safe_paths(spark):
    s = paths.safe_path(F.col("p"))
    got = values(spark, [(p,) for p, _ in SAFE], "p string", p=s.getField("path"), e=s.getField("error"))
    assert got == [(want, None if want else "path-traversal") for _, want in SAFE]


LINKS = [("sub/link", "/etc/passwd", None), ("sub/link", "../../x", None), ("link", "sub/ok", "sub/ok"), ("sub/link", "../sibling", "sibling"), ("a/b/c", "../../..", None), ("a/l", "..", "")]


def test_links(spark):
    got = values(spark, [r[:2] for r in LINKS], "l string, t string", r=paths.resolve_link(F.col("l"), F.col("t")))
    assert [g[0] for g in got] == [r[2] for r in LINKS]


SELECT = [
    ([], "a/b.txt", "a/b.txt"), (["docs/readme.md"], "docs/readme.md", "readme.md"), (["docs/readme.md"], "docs/other.md", None), (["docs/readme.md"], "docs/", None),
    (["docs/guide/"], "docs/guide/", "guide"), (["docs/guide/"], "docs/guide/intro/a.md", "guide/intro/a.md"), (["docs/guide/"], "docs/guidebook.md", None),
    (["./a"], "./a/b", "a/b"), (["./a"], "a/b", "a/b"), (["a/b", "a"], "a/b/c", "a/b/c"), (["a"], "a/../../x", "a/../../x"), (["./", "a"], "z", "z"), (["a"], "/a/b", None),
]


@pytest.mark.parametrize("roots,raw,want", SELECT)
def test_selection(spark, roots, raw, want):
    assert one(spark, paths.select_path(F.lit(raw), roots)) == want


def test_path_parts(spark):
    wraps = {"photos.tar.gz": "photos", "data.zip": "data", "archive.tgz": "archive", "archive.unknown": "archive", "": "extracted", "Makefile": "Makefile", ".bashrc": ".bashrc", ".tar.gz": ".tar"}
    got = values(spark, [(k,) for k in wraps], "n string", w=paths.wrap_dir_name(F.col("n")))
    assert [g[0] for g in got] == list(wraps.values())
    hidden = {"a/.b": True, "__MACOSX/x": True, "a/Thumbs.DB": True, "a\\.b": True, "./a": False, "a/desktop.ini": True, "a.b": False}
    assert [g[0] for g in values(spark, [(k,) for k in hidden], "n string", h=paths.is_hidden(F.col("n")))] == list(hidden.values())
    roots = {"./": True, ".": True, "./a": False, "": False, "/": False}
    assert [g[0] for g in values(spark, [(k,) for k in roots], "n string", h=paths.is_root_entry(F.col("n")))] == list(roots.values())
    outs = [("a.gz", None, "a"), ("A.GZ", None, "A.GZ.out"), (".gz", None, ".gz.out"), ("a.gz", "x/../y.txt", "y.txt"), ("a.gz", "", "a")]
    got = values(spark, [o[:2] for o in outs], "n string, s string", o=paths.stream_output_name(F.col("n"), F.lit("gzip"), F.col("s")))
    assert [g[0] for g in got] == [o[2] for o in outs]
    prefixes = {"a/./b/": "a/b", "": "", "..": None, "/a": None, "a/../b": None}
    assert [g[0] for g in values(spark, [(k,) for k in prefixes], "n string", h=paths.archive_prefix(F.col("n")))] == list(prefixes.values())


def test_sizes_and_durations(spark):
    sizes = [(0, "0 B", "0 bytes", "0 B"), (1023, "1023 B", "1.0 KB", "1023 B"), (1536, "1.5 KB", "1.5 KB", "1.50 KiB"), (2 << 20, "2.0 MB", "2.1 MB", "2.00 MiB"), (5 << 28, "1.25 GB", "1.3 GB", "1.25 GiB"), (3 << 40, "3072.00 GB", "3.3 TB", "3.00 TiB")]
    n = F.col("n")
    got = values(spark, [(s[0],) for s in sizes], "n long", n=n, a=text.human_bytes(n), b=text.human_size(n), c=text.binary_size(n))
    assert got == sizes
    times = [(0, "0ms", "0 ms"), (999, "999ms", "999 ms"), (1299, "1.2s", "1.30 s"), (59_999, "59.9s", "60.00 s"), (123_456, "2m 3s", "123.46 s")]
    assert values(spark, [(t[0],) for t in times], "n long", n=n, a=text.duration(n), b=text.duration_label(n)) == times
    assert one(spark, text.ratio(F.lit(0), F.lit(5))) == 0 and one(spark, text.ratio(F.lit(4), F.lit(1))) == 0.25
    assert one(spark, text.truncate_entry(F.lit("é" * 41))) == "…" + "é" * 39 and one(spark, text.truncate_entry(F.lit("x" * 40))) == "x" * 40
    assert one(spark, text.list_line(F.lit(5), F.lit("a"), F.lit(True))) == "           5  a/"
    names = ["a10", "a2", "B1", "a02", "b1"]
    got = spark.createDataFrame([(k,) for k in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["a02", "a2", "a10", "B1", "b1"]


H, C = "a" * 64, "B" * 64
SIDECARS = [
    (f"{H}  a.gz\n", H, None, None), (f"{C} *a.gz", C.lower(), None, None), (f"# content-sha256: {C}\n{H}  a.gz\n", H, C.lower(), None),
    (f"\n# note\n{C}  b.gz\n{H}  a.gz\n", H, None, None), (f"{C}  b.gz\n", None, None, "no-matching-entry"), ("", None, None, "no-matching-entry"),
    ("nothex  a.gz\n", None, None, "malformed-artifact-digest"), (f"# content-sha256: zz\n{H}  a.gz", None, None, "malformed-content-digest"),
    (f"{C}  a.gz\r\n{H}  a.gz\r\n", H, None, None), (f"{H} \n", None, None, "no-matching-entry"), (f"{H}   a.gz", H, None, None), ("x  a.gz\n# content-sha256: zz", None, None, "malformed-artifact-digest"),
]


def test_sidecars(spark):
    p = digests.parse_sidecar(F.col("t"), F.lit("a.gz"))
    got = values(spark, [(s[0],) for s in SIDECARS], "t string", a=p.getField("artifact"), c=p.getField("content"), e=p.getField("error"))
    assert got == [s[1:] for s in SIDECARS]
    assert one(spark, digests.sidecar_text(F.lit(H), F.lit(None).cast("string"), F.lit("a.gz"))) == f"{H}  a.gz\n"
    assert one(spark, digests.is_sha256_hex(F.lit(H + "\n"))) is False


def test_large_numbers(spark):
    """No overflow, and no loss beyond what a double holds."""
    n = F.col("n")
    got = values(spark, [(5 * 10**16,), (2**63 - 1,), (10**16,)], "n long", n=n, a=text.human_bytes(n), b=text.binary_size(n), c=text.compress_line(F.lit("o"), n, n - 1, F.lit(5)))
    assert [r[1] for r in got] == ["46566128.73 GB", "8589934592.00 GB", "9313225.75 GB"]
    assert got[1][2] == "8388608.00 TiB" and got[1][3] == "o  8388608.00 TiB → 8388608.00 TiB (100.0%)  in 5ms"


def test_natural_order_of_long_numbers(spark):
    names = ["f1" + "0" * 21, "f9" + "9" * 20, "f2", "f10", "f002", "F3", "g"]
    got = spark.createDataFrame([(k,) for k in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["f002", "f2", "F3", "f10", "f9" + "9" * 20, "f1" + "0" * 21, "g"]
