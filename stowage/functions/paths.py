"""Entry paths as Column expressions: components, safety, selection, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import short_codec, stem_of_name


def components(path: Column) -> Column:
    """The path's parts as a file system sees them: empty ones and inner `.`
    are dropped, `..` stays; a leading `/` isn't among them."""
    return F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def normal_components(path: Column) -> Column:
    """As `components`, without `..`."""
    return F.filter(components(path), lambda c: c != "..")


def is_root_entry(path: Column) -> Column:
    """Whether the path is made of `.` alone, as `./` in a tar of a folder."""
    return ~is_absolute(path) & (F.size(components(path)) == 0) & path.contains(".")


def safe_path(path: Column) -> Column:
    """struct<path, error>: the path below a destination; or the error
    `path-traversal` if it is absolute, has `..` or names nothing. `\\` is a
    character like others. Null gives an error too."""
    parts = components(path)
    bad = is_absolute(path) | F.exists(parts, lambda c: c == "..") | (F.size(parts) == 0)
    bad = F.coalesce(bad, F.lit(True))
    return F.struct(F.when(~bad, F.array_join(parts, "/")).alias("path"), F.when(bad, F.lit("path-traversal")).alias("error"))


def resolve_link(link_path: Column, target: Column) -> Column:
    """Where a link below the destination points, as a path below it; null if
    it is absolute or leaves the destination on its way, ends above it, or an
    argument is null. Purely by names, as nothing is on disk."""
    parts = components(link_path)
    parent = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    walked = F.aggregate(
        components(target),
        parent,
        lambda at, c: F.when(at.isNull() | ((c == "..") & (F.size(at) == 0)), None)
        .when(c == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
        .otherwise(F.concat(at, F.array(c))),
    )
    return F.when(~is_absolute(target), F.array_join(walked, "/"))


def reduced_roots(paths: list[str]) -> list[list[str]]:
    """The component lists of a selection; none of them under another. One
    that names the whole archive (`./`, empty) selects everything: no roots."""
    roots = [[c for c in p.split("/") if c not in ("", ".", "..")] for p in paths]
    if not all(roots):
        return []
    kept: list[list[str]] = []
    for root in sorted(roots, key=len):
        if not any(root[: len(k)] == k for k in kept):
            kept.append(root)
    return kept


def select_path(path: Column, roots: list[str]) -> Column:
    """The path that a selected entry is extracted at: the root `a/b` brings
    `a/b/c` out as `b/c`; null for an entry under none of `roots`. No roots:
    every entry at its own path. `..` behind a root stays for `safe_path`."""
    kept = reduced_roots(roots)
    if not kept:
        return path
    parts = components(path)
    out = F.lit(None).cast("string")
    for root in reversed(kept):
        n = len(root)
        hit = ~is_absolute(path) & (F.slice(parts, 1, n) == F.array(*map(F.lit, root)))
        rest = F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0)))
        out = F.when(hit, F.array_join(F.concat(F.array(F.lit(root[-1])), rest), "/")).otherwise(out)
    return out


def archive_prefix(prefix: Column) -> Column:
    """Where in an archive entries are added: normal components alone; null if
    the prefix is absolute or has `..`. Empty for the top."""
    bad = is_absolute(prefix) | F.exists(components(prefix), lambda c: c == "..")
    return F.when(~bad, F.array_join(components(prefix), "/"))


def first_component(path: Column) -> Column:
    """The top-level name that an entry is under; null for `./`, an absolute
    path, or one that begins with `..`."""
    first = F.try_element_at(components(path), F.lit(1))
    return F.when(~is_absolute(path) & (first != ".."), first)


def is_hidden(path: Column) -> Column:
    """Whether a part of the path is a dotfile or a platform's by-product;
    `\\` separates parts here."""
    parts = components(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.exists(parts, is_hidden_name)


def is_hidden_name(name: Column) -> Column:
    return name.startswith(".") | (name == "__MACOSX") | F.lower(name).isin("thumbs.db", "desktop.ini")


def matches_search(name: Column, query: Column) -> Column:
    return F.contains(F.lower(name), F.lower(query))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def entry_key(path: Column) -> Column:
    """Without a leading `./` and without `/` at the end."""
    return F.regexp_replace(F.regexp_replace(path, "^(\\./)+", ""), "/+$", "")


def parent_of(path: Column) -> Column:
    parts = components(path)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def drop_target(path: Column, is_dir: Column) -> Column:
    """The folder that something dropped on a row goes into."""
    return F.when(is_dir, F.array_join(components(path), "/")).otherwise(parent_of(path))


def clashes(existing: Column, target: Column) -> Column:
    """Whether an entry is the target or lies in it."""
    return (existing == target) | existing.startswith(F.concat(target, F.lit("/")))


def contains_itself(folder: Column, archive: Column) -> Column:
    """Whether adding the folder would put the archive into itself."""
    a, b = components(folder), components(archive)
    return F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(0))) == a


def file_stem(name: Column) -> Column:
    """Up to the last dot; a dot at the start separates nothing."""
    cut = F.regexp_extract(name, "(?s)^(.+)\\.[^.]*$", 1)
    return F.when(cut != "", cut).otherwise(name)


def wrap_dir_name(name: Column) -> Column:
    """The folder that an archive of several roots is extracted into."""
    stem = stem_of_name(name)
    return F.coalesce(F.nullif(stem, F.lit("")), F.nullif(file_stem(name), F.lit("")), F.lit("extracted"))


def stream_output_name(name: Column, codec: Column, stored: Column) -> Column:
    """What a single compressed file is extracted as: the last part of the
    name stored in it, else its own without the codec's suffix (of that very
    case), else its own and `.out`."""
    last = F.try_element_at(F.filter(components(stored), lambda c: c != ".."), F.lit(-1))
    suffix = F.concat(F.lit("."), short_codec(codec))
    cut = F.when(F.endswith(name, suffix), F.left(name, F.length(name) - F.length(suffix)))
    return F.coalesce(last, F.nullif(cut, F.lit("")), F.concat(name, F.lit(".out")))


def sidecar_path(path: Column) -> Column:
    return F.concat(path, F.lit(".sha256"))


def safe_mode(mode: Column) -> Column:
    """Permission bits alone: no setuid, setgid or sticky bit."""
    return mode.bitwiseAND(F.lit(0o777))
