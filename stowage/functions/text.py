"""Sizes, durations and report lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY_WIDTH = 40


def fixed(numerator: Column, denominator: Column | int, digits: int) -> Column:
    """The quotient of two whole numbers with `digits` decimals; a tie goes up.
    In decimals, as floating point would decide ties by its own error and long
    numbers would overflow."""
    n, den = numerator.cast("decimal(23,0)"), (F.lit(denominator) if isinstance(denominator, int) else denominator).cast("decimal(20,0)")
    scaled, den = n * (2 * 10**digits) + den, den * 2
    units = ((scaled - scaled % den) / den).cast("decimal(30,0)")
    whole = ((units - units % 10**digits) / 10**digits).cast("decimal(30,0)")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((units % 10**digits).cast("decimal(9,0)").cast("string"), digits, "0"))


def human_bytes(n: Column) -> Column:
    """1024-based: 512 B, 1.5 KB, 2.0 MB, 1.25 GB."""
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(fixed(n, 1 << 10, 1), F.lit(" KB")))
        .when(n < 1 << 30, F.concat(fixed(n, 1 << 20, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(n, 1 << 30, 2), F.lit(" GB")))
    )


def binary_size(n: Column) -> Column:
    """512 B, 1.50 KiB, ... TiB: as the summary lines show sizes."""
    out = F.concat(fixed(n, 1 << 40, 2), F.lit(" TiB"))
    for k, name in ((30, "GiB"), (20, "MiB"), (10, "KiB")):
        out = F.when(n < 1 << (k + 10), F.concat(fixed(n, 1 << k, 2), F.lit(f" {name}"))).otherwise(out)
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def human_size(n: Column) -> Column:
    """1000-based: 512 bytes, 1.5 KB, ... TB."""
    out = F.concat(fixed(n, 10**12, 1), F.lit(" TB"))
    for k, name in ((9, "GB"), (6, "MB"), (3, "KB")):
        out = F.when(n < 10 ** (k + 3), F.concat(fixed(n, 10**k, 1), F.lit(f" {name}"))).otherwise(out)
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(out)


def duration(ms: Column) -> Column:
    """450ms, 1.2s (tenths cut off), 2m 3s."""
    ms = ms.cast("long")
    seconds = F.floor(ms / 1000)
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    tenths = F.concat(seconds.cast("string"), F.lit("."), F.floor(ms % 1000 / 100).cast("string"), F.lit("s"))
    return F.when(seconds >= 60, minutes).when(seconds >= 1, tenths).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def duration_label(ms: Column) -> Column:
    """450 ms or 1.20 s."""
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(fixed(ms, 1000, 2), F.lit(" s")))


def truncate_entry(path: Column) -> Column:
    """The last characters of a long path, after an ellipsis."""
    return F.when(F.length(path) <= ENTRY_WIDTH, path).otherwise(F.concat(F.lit("…"), F.right(path, F.lit(ENTRY_WIDTH - 1))))


def ratio(input_bytes: Column, output_bytes: Column) -> Column:
    """Output to input; 0 for no input."""
    return F.when(input_bytes == 0, F.lit(0.0)).otherwise(output_bytes.cast("double") / F.nullif(input_bytes, F.lit(0)).cast("double"))


# Fixed values from here on: the wording of report lines.


def list_line(size: Column, path: Column, is_dir: Column) -> Column:
    """An entry as a listing shows it: the size in 12 columns, and the path, a
    directory's with `/` at its end."""
    name = F.when(is_dir & ~path.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path)
    width = F.greatest(F.lit(12), F.length(size.cast("string")))
    return F.concat(F.lpad(size.cast("string"), width, F.lit(" ")), F.lit("  "), name)


def compress_line(output: Column, input_bytes: Column, output_bytes: Column, ms: Column) -> Column:
    share = F.when(input_bytes == 0, F.lit("0.0")).otherwise(fixed(output_bytes.cast("decimal(20,0)") * 100, F.nullif(input_bytes, F.lit(0)), 1))
    return F.concat(output, F.lit("  "), binary_size(input_bytes), F.lit(" → "), binary_size(output_bytes), F.lit(" ("), share, F.lit("%)  in "), duration(ms))


def extract_line(entries: Column, dest: Column, ms: Column) -> Column:
    return F.concat(F.lit("extracted "), entries.cast("string"), F.lit(" entries to "), dest, F.lit("  in "), duration(ms))


def excluded_note(n: Column, all_files: Column, has_excludes: Column) -> Column:
    """Why paths were left out, by what was set; null if none were."""
    head = F.concat(F.lit("excluded "), n.cast("string"), F.lit(" paths via "))
    return F.when(
        n > 0,
        F.when(~all_files & has_excludes, F.concat(head, F.lit(".gitignore and --exclude")))
        .when(all_files, F.concat(head, F.lit("--exclude")))
        .otherwise(F.concat(head, F.lit(".gitignore (use --all to include)"))),
    )


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def natural_key(name: Column) -> Column:
    """Sorts as people count: digits by value, however many, letters without
    case; the name itself decides last."""

    def counted(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)

    padded = F.transform(F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)")), lambda p: F.when(p.rlike("^[0-9]"), counted(p)).otherwise(p))
    return F.struct(F.array_join(padded, "").alias("key"), name.alias("name"))
