"""Archives as files: df.write.format("archives").mode(...).save(folder)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .tree import store


@dataclass
class Written(WriterCommitMessage):
    staged: list[tuple[str, str]]


class ArchiveSink(DataSource):
    """Writes rows (archive, data) as files of those names.

    Tasks write into a staging folder of the job; the commit renames what the
    attempts that ended well have written, so that readers see whole files
    alone. A write that fails leaves nothing: the staging folder goes, and a
    commit that breaks off puts back what it has moved. Without overwriting, a
    name that exists fails the write before anything is published
    (`already-exists`). The option `sidecar` writes a `.sha256` file beside
    each.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(dict(self.options), overwrite)


class ArchiveWriter(DataSourceWriter):
    #: Files that a commit moves at once.
    MOVES = 16

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.sidecar = str(options.get("sidecar", "false")).lower() == "true"
        self.staging = f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        import hashlib

        fs, base = store(self.folder)
        fs.create_dir(f"{base}/{self.staging}", recursive=True)
        staged, attempt = [], uuid.uuid4().hex
        for k, row in enumerate(iterator):
            files = [(row.archive, bytes(row.data))]
            if self.sidecar:
                line = f"{hashlib.sha256(files[0][1]).hexdigest()}  {row.archive.rsplit('/', 1)[-1]}\n"
                files.append((f"{row.archive}.sha256", line.encode()))
            for n, (name, data) in enumerate(files):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"path-traversal: {name}")
                hidden = f"{self.staging}/{attempt}-{k}-{n}"
                with fs.open_output_stream(f"{base}/{hidden}", compression=None) as out:
                    out.write(data)
                staged.append((hidden, name))
        return Written(staged)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, base = store(self.folder)
        staged = [s for m in messages if m for s in m.staged]
        names = [name for _, name in staged]
        if len(set(names)) < len(names):
            self.drop()
            raise ValueError("duplicate-input: two archives of one name")
        found = fs.get_file_info([f"{base}/{n}" for n in names]) if names else []
        there = [f.base_name for f in found if f.type != FileType.NotFound]
        if there and not self.overwrite:
            self.drop()
            raise ValueError("already-exists: " + ", ".join(there[:5]))
        self.publish(staged, set(there))
        self.drop()

    def publish(self, staged: list[tuple[str, str]], there: set[str]) -> None:
        """Moves files to their names; those that are there already go to the
        staging folder until all is done."""
        fs, base = store(self.folder)
        moved: list[tuple[str, str]] = []  # (from, to), each as it is done

        def move(k: int) -> None:
            hidden, name = staged[k]
            steps = [(f"{base}/{name}", f"{base}/{self.staging}/old-{k}")] * (name in there) + [(f"{base}/{hidden}", f"{base}/{name}")]
            for a, b in steps:
                fs.move(a, b)
                moved.append((a, b))

        try:
            with ThreadPoolExecutor(self.MOVES) as pool:
                list(pool.map(move, range(len(staged))))
        except Exception:
            for a, b in reversed(moved):
                fs.move(b, a)
            self.drop()
            raise

    def abort(self, messages: list[Written | None]) -> None:
        self.drop()

    def drop(self) -> None:
        fs, base = store(self.folder)
        try:
            fs.delete_dir(f"{base}/{self.staging}")
        except FileNotFoundError:
            pass
