"""Archive formats as Column expressions: from names, header bytes, aliases.

A format is struct<container: string, codec: string> with at least one set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats' suffixes, layered ones first, their header bytes, and their names.
SUFFIXES = [
    (".tar.gz", "tar", "gzip"),
    (".tar.bz2", "tar", "bzip2"),
    (".tar.xz", "tar", "xz"),
    (".tar.zst", "tar", "zstd"),
    (".tar.lz4", "tar", "lz4"),
    (".tar.br", "tar", "brotli"),
    (".tgz", "tar", "gzip"),
    (".tbz2", "tar", "bzip2"),
    (".txz", "tar", "xz"),
    (".tzst", "tar", "zstd"),
    (".tar", "tar", None),
    (".gz", None, "gzip"),
    (".bz2", None, "bzip2"),
    (".xz", None, "xz"),
    (".zst", None, "zstd"),
    (".lz4", None, "lz4"),
    (".br", None, "brotli"),
    (".zip", "zip", None),
    (".7z", "7z", None),
    (".rar", "rar", None),
]
MAGIC = [
    ("1F8B", 0, None, "gzip"),
    ("425A68", 0, None, "bzip2"),
    ("FD377A585A00", 0, None, "xz"),
    ("28B52FFD", 0, None, "zstd"),
    ("04224D18", 0, None, "lz4"),
    ("504B0304", 0, "zip", None),
    ("504B0506", 0, "zip", None),
    ("377ABCAF271C", 0, "7z", None),
    ("526172211A070100", 0, "rar", None),
    ("526172211A0700", 0, "rar", None),
    ("7573746172", 257, "tar", None),
]
SHORT = {"gzip": "gz", "bzip2": "bz2", "xz": "xz", "zstd": "zst", "lz4": "lz4", "brotli": "br"}
ALIASES = {
    "gzip": (None, "gzip"), "gz": (None, "gzip"), "bzip2": (None, "bzip2"), "bz2": (None, "bzip2"), "xz": (None, "xz"),
    "zstd": (None, "zstd"), "zst": (None, "zstd"), "lz4": (None, "lz4"), "brotli": (None, "brotli"), "br": (None, "brotli"),
    "tar": ("tar", None), "zip": ("zip", None), "7z": ("7z", None), "sevenz": ("7z", None), "rar": ("rar", None),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FORMAT = "struct<container: string, codec: string>"


def ascii_lower(text: Column) -> Column:
    """A-Z alone: the result has the argument's length, so that it may be cut
    by positions found in it."""
    return F.translate(text, UPPER, LOWER)


def make_format(container: Column | str | None, codec: Column | str | None) -> Column:
    """A format of two columns or literals."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("string") for x in (container, codec))
    return F.struct(a.alias("container"), b.alias("codec"))


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds; null if none does."""
    return reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))


def looked_up(values: dict, key: Column) -> Column:
    """The value of a literal map; null for a key that it lacks. One mention
    of `key`, where a chain of comparisons would repeat its expression."""
    return F.try_element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v)))), key)


def suffix_of(name: Column) -> Column:
    """The recognised suffix, in lower case; null if there is none."""
    ends = "|".join(s.replace(".", "\\.") for s, _, _ in SUFFIXES)
    return F.nullif(F.regexp_extract(ascii_lower(name), f"({ends})\\z", 1), F.lit(""))


def format_of_name(name: Column) -> Column:
    """The format that a file name's suffix says (A-Z in either case); null
    for a null name or one without a known suffix."""
    return looked_up({s: make_format(a, b) for s, a, b in SUFFIXES}, suffix_of(name))


def stem_of_name(name: Column) -> Column:
    """The name without its recognised suffix, in its own case; null without."""
    return F.left(name, F.length(name) - F.length(suffix_of(name)))


def format_of_bytes(header: Column) -> Column:
    """The format that a file's first bytes say; null if they say none.
    Brotli has no such bytes. Only the first 512 bytes are looked at."""
    cases = []
    for hexed, at, a, b in MAGIC:
        n = len(hexed) // 2
        cases.append((F.substring(header, at + 1, n) == F.lit(bytes.fromhex(hexed)), make_format(a, b)))
    return first_of(cases)


def detect(name: Column, header: Column) -> Column:
    """The format of a file by both. Its bytes win; a suffix that shares their
    codec or container refines them (gzip bytes named .tgz are a tar inside).
    Without known bytes the suffix counts; null if neither is known."""
    by_bytes, by_name = format_of_bytes(header), format_of_name(name)
    same_codec = by_bytes.getField("codec") == by_name.getField("codec")
    same_container = by_bytes.getField("container") == by_name.getField("container")
    refined = F.coalesce(same_codec, F.lit(False)) | F.coalesce(same_container, F.lit(False))
    return F.when(by_bytes.isNotNull() & ~refined, by_bytes).otherwise(F.coalesce(by_name, by_bytes))


def parse_format(text: Column) -> Column:
    """The format of a codec's or container's name or alias, or of a suffix
    without its dot, in either case; null if unknown."""
    low = ascii_lower(text)
    named = looked_up({k: make_format(a, b) for k, (a, b) in ALIASES.items()}, low)
    return F.coalesce(named, format_of_name(F.concat(F.lit("x."), low)))


def short_codec(codec: Column) -> Column:
    return looked_up(SHORT, codec)


def format_name(fmt: Column) -> Column:
    """`tar.gz`, `zip` or `gzip`; `<invalid format>` if neither is set."""
    container, codec = fmt.getField("container"), fmt.getField("codec")
    both = F.concat_ws(".", container, short_codec(codec))
    return F.when(fmt.isNull(), None).when(container.isNotNull(), both).otherwise(F.coalesce(codec, F.lit("<invalid format>")))


def extension(fmt: Column) -> Column:
    """The suffix, with its dot, that a new archive of the format gets."""
    container, codec = fmt.getField("container"), fmt.getField("codec")
    short = F.concat(F.lit("."), short_codec(codec))
    layered = F.concat(F.lit(".tar"), F.coalesce(short, F.lit("")))
    return (
        F.when(fmt.isNull(), None).when(container == "tar", layered)
        .when(container.isNotNull(), F.concat(F.lit("."), container)).otherwise(F.coalesce(short, F.lit("")))
    )


def compose_format(container: Column, codec: Column) -> Column:
    """The format name of a choice of container (`none`, `tar`, `zip`, `7z`)
    and codec; an unknown codec is none at all, and `zstd` without container."""
    short = short_codec(codec)
    return (
        F.when(container.isin("zip", "7z"), container)
        .when(container == "tar", F.concat_ws(".", F.lit("tar"), short))
        .otherwise(F.when(short.isNotNull(), codec).otherwise(F.lit("zstd")))
    )


def decompose_format(name: Column) -> Column:
    """struct<container, codec>: the choice that a format name stands for;
    `none` and `zstd` if it is unknown."""
    inner = looked_up({f"tar.{v}": k for k, v in SHORT.items()}, name)
    return (
        F.when(name.isin("zip", "7z", "tar"), make_format(name, None))
        .when(inner.isNotNull(), make_format("tar", inner))
        .when(name.isin(*SHORT), make_format("none", name))
        .otherwise(make_format("none", "zstd"))
    )


def default_format(is_dir: Column) -> Column:
    return F.when(is_dir, F.lit("tar.zst")).otherwise(F.lit("zstd"))


def promoted(fmt: Column, bundle: Column) -> Column:
    """The format that a directory or several inputs are packed in: a codec
    alone holds one file, so it goes over a tar."""
    alone = fmt.isNotNull() & fmt.getField("container").isNull() & bundle
    return F.when(alone, make_format("tar", fmt.getField("codec"))).otherwise(fmt)


def writable(fmt: Column) -> Column:
    """Whether entries can be added to an archive of the format: it has a
    container, and one that can be written."""
    return F.coalesce(fmt.getField("container").isin("tar", "zip"), F.lit(False))
