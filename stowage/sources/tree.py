"""A directory tree as a table: spark.read.format("tree").load(path)."""

from __future__ import annotations

import itertools
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import ignore

SCHEMA = "root string, rel string, is_dir boolean, size long, included boolean"
ARROW = pa.schema([("root", pa.string()), ("rel", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("included", pa.bool_())])


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TreeSource(DataSource):
    """Every entry below a folder (which is left out itself), with whether the
    ignore rules include it.

    Options: `gitignore` (true): follow the .gitignore of each folder and
    leave out .git; `exclude`: patterns by line that leave out more, whatever
    the .gitignore files say, or, with `!`, that these may not leave out. What
    lies in a folder that is left out is left out. `only_included` (false):
    what is left out gives no rows and isn't walked. Dotfiles are included.
    Links aren't followed. The store may be any that pyarrow opens by URI.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(dict(self.options))


@dataclass
class Entry:
    """deep: what lies below it belongs to the part too."""

    rel: str
    is_dir: bool
    size: int
    included: bool
    deep: bool


class Part(InputPartition):
    def __init__(self, entries: list[Entry]):
        super().__init__(entries[0].rel if entries else "")
        self.entries = entries


class TreeReader(DataSourceReader):
    """The folders nearest the top are listed by the driver, until there are
    PARTS of them or LISTED were looked into; the tasks walk the rest."""

    PARTS, LISTED, LOOKED = 64, 1024, 1000

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.gitignore = str(options.get("gitignore", "true")).lower() == "true"
        self.exclude = ignore.patterns(options.get("exclude", ""))
        self.only_included = str(options.get("only_included", "false")).lower() == "true"

    def partitions(self) -> list[Part]:
        whole, open_ = [], deque([Entry("", True, 0, True, True)])
        listed = 0
        while open_ and len(open_) + len(whole) < self.PARTS and listed < self.LISTED:
            folder = open_.popleft()
            levels = self.levels(folder.rel)
            for name, is_dir, size in sorted(self.listed(folder.rel)):
                rel = f"{folder.rel}/{name}" if folder.rel else name
                entry = Entry(rel, is_dir, size, folder.included and self.kept(rel, is_dir, levels), is_dir)
                if entry.included or not self.only_included:
                    (open_ if is_dir else whole).append(entry)
            if folder.rel:
                whole.append(Entry(folder.rel, True, 0, folder.included, False))
            listed += 1
        entries = [*open_, *whole]
        return [Part(entries[k :: self.PARTS]) for k in range(min(len(entries), self.PARTS))] or [Part([])]

    def listed(self, rel: str) -> Iterator[tuple[str, bool, int]]:
        """What lies in a folder, in the store's order. A local folder, however
        large, is held LOOKED entries at a time."""
        from pyarrow import fs

        system, base = store(self.root)
        folder = f"{base}/{rel}" if rel else base
        if isinstance(system, fs.LocalFileSystem):
            with os.scandir(folder) as entries:
                while paths := [e.path for e in itertools.islice(entries, self.LOOKED)]:
                    yield from ((f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in system.get_file_info(paths) if f.type != fs.FileType.NotFound)
        else:
            yield from ((f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in system.get_file_info(fs.FileSelector(folder)))

    def rules_of(self, rel: str) -> list[ignore.Pattern]:
        from pyarrow.fs import FileType

        system, base = store(self.root)
        path = "/".join(x for x in (base, rel, ".gitignore") if x)
        if not self.gitignore or system.get_file_info(path).type != FileType.File:
            return []
        with system.open_input_stream(path, compression=None) as f:
            return ignore.patterns(f.read().decode("utf-8", "replace"))

    def levels(self, rel: str) -> list[tuple[str, list]]:
        """The rules of a folder and of those above it, the nearest last."""
        parts = rel.split("/") if rel else []
        return [(at, self.rules_of(at)) for at in ("/".join(parts[:k]) for k in range(len(parts) + 1))]

    def kept(self, rel: str, is_dir: bool, levels: list[tuple[str, list]]) -> bool:
        name = rel.rsplit("/", 1)[-1]
        if self.gitignore and name == ".git":
            return False
        said = ignore.verdict(self.exclude, rel, is_dir)
        if said is not None:
            return not said
        for folder, rules in reversed(levels):  # the nearest folder's rules count first
            said = ignore.verdict(rules, rel[len(folder) + 1 :] if folder else rel, is_dir)
            if said is not None:
                return not said
        return True

    def walk(self, top: Entry) -> Iterator[tuple]:
        yield self.root, top.rel, top.is_dir, 0 if top.is_dir else top.size, top.included
        stack = [(top.rel, self.levels(top.rel), top.included)] if top.deep else []
        while stack:
            folder, levels, above = stack.pop()
            for name, is_dir, size in self.listed(folder):
                rel = f"{folder}/{name}"
                included = above and self.kept(rel, is_dir, levels)
                if not included and self.only_included:
                    continue
                yield self.root, rel, is_dir, 0 if is_dir else size, included
                if is_dir:
                    stack.append((rel, [*levels, (rel, self.rules_of(rel))], included))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        held = []
        for entry in partition.entries:
            for row in self.walk(entry):
                held.append(row)
                if len(held) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)
