"""The directory source, the archive sink, and streams of progress events."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stowage.sources import ignore, register
from stowage.streaming import progress

FILES = {
    ".gitignore": "target/\n*.log\n", ".editorconfig": "", "a.txt": "a", "target/build.o": "o", "run.log": "l", "sub/.gitignore": "local-only.txt\n", "sub/b.txt": "bb",
    "sub/local-only.txt": "x", ".git/HEAD": "h",
}


@pytest.fixture
def tree(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    return tmp_path


def walk(spark, path, **options):
    register(spark)
    return spark.read.format("tree").options(**options).load(str(path)).collect()


def test_ignore_rules(spark, tree):
    rows = walk(spark, tree)
    kept = {r.rel for r in rows if r.included}
    assert kept == {".editorconfig", ".gitignore", "a.txt", "sub", "sub/.gitignore", "sub/b.txt"} and len(rows) == 12
    assert all(r.included for r in walk(spark, tree, gitignore="false"))
    kept = {r.rel for r in walk(spark, tree, exclude="*.txt") if r.included}
    assert kept == {".editorconfig", ".gitignore", "sub", "sub/.gitignore"}
    assert "run.log" in {r.rel for r in walk(spark, tree, exclude="!run.log") if r.included}
    assert {r.rel: r.size for r in rows}["sub/b.txt"] == 2 and {r.is_dir for r in rows if r.rel == "sub"} == {True}
    with pytest.raises(Exception, match="invalid-glob"):
        walk(spark, tree, exclude="[z")
    (tree / "empty").mkdir()
    assert walk(spark, tree / "empty") == []


@pytest.mark.parametrize("line,path,is_dir,want", [
    ("a/b", "a/b", False, True), ("a/b", "x/a/b", False, None), ("b", "x/b", False, True), ("b/", "b", False, None), ("b/", "b", True, True), ("/b", "b", False, True), ("/b", "a/b", False, None),
    ("**/c", "c", False, True), ("**/c", "a/b/c", False, True), ("a/**", "a/x/y", False, True), ("a/**", "a", True, None), ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True),
    ("*.log", "a.log", False, True), ("*.log", "d/a.logs", False, None), ("?.c", "a.c", False, True), ("[ab].c", "b.c", False, True), ("[!ab].c", "b.c", False, None), ("\\#x", "#x", False, True),
    ("!x", "x", False, False), ("#x", "#x", False, None), ("x  ", "x", False, True),
])
def test_patterns(line, path, is_dir, want):
    assert ignore.verdict(ignore.patterns(line), path, is_dir) is want


def test_a_large_folder_is_not_held(tmp_path):
    """A task holds a stretch of a folder's entries, however many there are."""
    import tracemalloc

    from stowage.sources.tree import Entry, TreeReader

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for k in range(20_000):
        (tmp_path / "in" / f"{k}.txt").touch()
    (tmp_path / "in" / "gone").symlink_to("nothing")
    reader = TreeReader({"path": str(tmp_path)})
    next(reader.listed("in"))
    tracemalloc.start()
    n = sum(not is_dir for _, _, is_dir, _, _ in reader.walk(Entry("in", True, 0, True, True)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 1e6


def test_archive_sink(spark, tmp_path):
    register(spark)
    out = tmp_path / "out"
    df = spark.createDataFrame([(f"a{k}.bin", bytearray(bytes([k]) * 10)) for k in range(5)], "archive string, data binary").repartition(3)
    df.write.format("archives").mode("append").option("sidecar", "true").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted([f"a{k}.bin" for k in range(5)] + [f"a{k}.bin.sha256" for k in range(5)])
    assert (out / "a3.bin.sha256").read_text() == f"{hashlib.sha256(bytes([3]) * 10).hexdigest()}  a3.bin\n"
    with pytest.raises(Exception, match="already-exists"):
        df.write.format("archives").mode("append").save(str(out))
    df.limit(1).withColumn("data", F.lit(b"new")).write.format("archives").mode("overwrite").save(str(out))
    assert [p.read_bytes() for p in out.glob("a*.bin")].count(b"new") == 1
    bad = spark.createDataFrame([("../x", bytearray(b""))], "archive string, data binary")
    with pytest.raises(Exception, match="path-traversal"):
        bad.write.format("archives").mode("append").save(str(out))
    assert not list(out.glob(".staged*"))


def test_failed_writes_leave_nothing(spark, tmp_path):
    register(spark)
    out = tmp_path / "out"
    rows = [(f"a{k}.bin" if k != 41 else "no/name", bytearray(b"x")) for k in range(60)]
    df = spark.createDataFrame(rows, "archive string, data binary").coalesce(1)
    with pytest.raises(Exception, match="path-traversal"):
        df.write.format("archives").mode("append").save(str(out))
    assert not list(out.iterdir())
    good = df.where("archive like 'a%'")
    good.where("archive < 'a3'").write.format("archives").mode("append").save(str(out))
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    (out / "a5.bin").mkdir()  # a file can't take its place
    (out / "a5.bin" / "x").write_text("")
    with pytest.raises(Exception):
        good.withColumn("data", F.lit(b"new")).write.format("archives").mode("append").save(str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir() if p.is_file()} == before and not list(out.glob(".staged*"))


def test_a_commit_that_breaks_off_is_taken_back(tmp_path, monkeypatch):
    from stowage.sources import archive_sink

    writer = archive_sink.ArchiveWriter({"path": str(tmp_path)}, True)
    staging = tmp_path / writer.staging
    staging.mkdir()
    (tmp_path / "a").write_text("old")
    for n in ("0", "1"):
        (staging / n).write_text("new")
    monkeypatch.setattr(writer, "MOVES", 1)
    with pytest.raises(Exception):
        writer.publish([(f"{writer.staging}/0", "a"), (f"{writer.staging}/1", "b"), (f"{writer.staging}/gone", "c")], {"a"})
    assert (tmp_path / "a").read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["a"]


def test_a_walk_of_one_folder_has_many_parts(spark, tmp_path):
    from stowage.sources.tree import TreeReader

    for k in range(40):
        (tmp_path / "only" / f"d{k}" / "e").mkdir(parents=True)
        (tmp_path / "only" / f"d{k}" / "e" / "f.txt").write_text("x" * k)
    (tmp_path / "only" / "d3" / ".gitignore").write_text("*\n")
    reader = TreeReader({"path": str(tmp_path)})
    assert len(reader.partitions()) >= 40
    rows = walk(spark, tmp_path)
    assert len(rows) == 1 + 40 * 3 + 1 and sum(r.size for r in rows) == sum(range(40)) + 2
    assert {r.rel for r in rows if not r.included} == {"only/d3/.gitignore", "only/d3/e", "only/d3/e/f.txt"}
    assert len(walk(spark, tmp_path, only_included="true")) == len(rows) - 3


TICKS = [(1, 1, 0, "a"), (1, 2, 50, "a"), (1, 3, 60, "b"), (1, 4, 100, "b"), (1, 5, 170, "b"), (1, 6, 260, "b"), (1, 7, 271, "b"), (2, 8, 0, None), (2, 9, 1, None), (2, 10, 100, None)]
SENT = {1, 3, 5, 7, 8, 10}


def test_throttle(spark):
    e = spark.createDataFrame(TICKS, "job_id long, event_id long, ms long, entry string")
    assert {r.event_id for r in progress.throttle(e).collect()} == SENT
    assert {(r.job_id, r.event_id) for r in progress.final_events(e).collect()} == {(1, 7), (2, 10)}
    assert progress.throttle(e.where("false")).count() == 0


@pytest.mark.parametrize("span", [1, 90, 10_000])
def test_runs_go_on_between_stretches(spark, span):
    e = spark.createDataFrame(TICKS, "job_id long, event_id long, ms long, entry string")
    late = lambda prev: prev.isNull() | (F.col("ms") - prev["ms"] >= 50)
    got = {r.event_id: r.run_ for r in progress.numbered_runs(e, "job_id", "ms", "event_id", [], late, span).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 3, 6: 4, 7: 4, 8: 1, 9: 1, 10: 2}


def test_throttle_stream(spark, tmp_path):
    schema = "job_id long, event_id long, ms long, entry string"
    for k, part in enumerate((TICKS[:4], TICKS[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (
            progress.throttle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").outputMode("append")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        assert q.exception() is None
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == SENT


def test_throttle_of_a_long_run(spark):
    """One job, one entry, an event a millisecond: linear, and in more than one stretch."""
    e = spark.range(20_000).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("event_id"), F.col("id").alias("ms"), F.lit("a").alias("entry"))
    assert sorted(r.event_id for r in progress.throttle(e).collect()) == list(range(0, 20_000, 100))


def test_violations(spark):
    rows = [(1, 1, 0, 5, 10), (1, 2, 1, 4, 10), (1, 3, 2, 11, 10), (1, 4, 3, 11, 11), (2, 5, 0, 3, 10), (2, 6, 1, 3, 10)]
    e = spark.createDataFrame(rows, "job_id long, event_id long, ms long, bytes_done long, bytes_total long")
    got = progress.violations(e)
    assert sorted((r.event_id, r.why) for r in got.collect()) == [(2, "back"), (3, "over")] and got.columns == [*e.columns, "why"]


def test_batches(spark):
    rows = [("k", 1, 0, "b"), ("k", 2, 300, "a"), ("k", 3, 700, "b"), ("k", 4, 1101, "c"), ("j", 5, 0, "x")]
    e = spark.createDataFrame(rows, "key string, event_id long, ms long, path string")
    got = sorted((r.key, r.started, r.n_requests, r.paths) for r in progress.batches(e).collect())
    assert got == [("j", 0, 1, ["x"]), ("k", 0, 3, ["b", "a"]), ("k", 1101, 1, ["c"])]


def test_batch_stream(spark, tmp_path):
    rows = [("k", 0, "b"), ("k", 300, "a"), ("k", 1100, "c"), ("z", 60_000, "late")]
    e = spark.createDataFrame(rows, "key string, ms long, path string").select("key", F.timestamp_millis("ms").alias("ts"), "path")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = progress.batch_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n_requests, r.paths) for r in spark.table("closed").collect()) == [(1, ["c"]), (2, ["a", "b"])]


def test_files_in_and_out(spark, tmp_path):
    """Archives as files: read as blobs, listed, extracted, packed anew, written and read again."""
    from stowage.operators import archives

    register(spark)
    rows = [("a", 0, "docs/guide/x.md", bytearray(b"x"), "file", None, None, None), ("a", 1, "top.txt", bytearray(b"t"), "file", None, None, None)]
    schema = "archive string, ordinal long, path string, content binary, kind string, mode int, mtime long, link_target string"
    packed = archives.pack(spark.createDataFrame(rows, schema), "tar", "zstd", "edge").withColumn("archive", F.lit("a.tar.zst"))
    packed.write.format("archives").mode("append").save(str(tmp_path / "out"))
    blobs = spark.read.format("binaryFile").load(str(tmp_path / "out")).select(F.col("path").alias("archive"), F.col("content").alias("data"))
    files = archives.extract(archives.read_entries(blobs, with_content=True), ["docs/guide"]).collect()
    assert [(r.path, bytes(r.content), r.error) for r in files] == [("guide/x.md", b"x", None)]
    assert sorted(r.path for r in archives.read_entries(blobs).collect()) == ["docs/guide/x.md", "top.txt"]
