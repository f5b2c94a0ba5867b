"""SHA-256 digests and checksum sidecars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import ascii_lower

CONTENT = "# content-sha256:"


def is_sha256_hex(text: Column) -> Column:
    return text.rlike("\\A[0-9A-Fa-f]{64}\\z")


def sidecar_text(artifact: Column, content: Column, name: Column) -> Column:
    """The sidecar of an archive: a comment with its content's digest, if
    there is one, and a line as sha256sum writes it."""
    comment = F.when(content.isNotNull(), F.concat(F.lit(CONTENT + " "), content, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(comment, artifact, F.lit("  "), name, F.lit("\n"))


def parse_sidecar(text: Column, name: Column) -> Column:
    """struct<artifact, content, error> of the sidecar `text` for the file
    `name`.

    Lines of other files, blank lines and other comments don't count; of
    several lines the last counts. Digests come out in lower case. error: the
    first malformed line's, `malformed-content-digest` or
    `malformed-artifact-digest`; else `no-matching-entry` if no line names the
    file. With an error both digests are null; without, content may be.
    """
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, "^\\s+|\\s+$", ""))

    def read(line: Column) -> Column:
        comment = line.startswith(CONTENT)
        content = ascii_lower(F.regexp_replace(F.substring(line, len(CONTENT) + 1, 1 << 30), "^\\s+", ""))
        space = F.instr(line, " ")
        rest = F.substring(line, space + 1, F.lit(1 << 30))
        named = F.when(rest.startswith("*"), F.substring(rest, 2, 1 << 30)).otherwise(F.ltrim(rest))
        ours = ~line.startswith("#") & (space > 0) & (named == name)
        digest = F.left(line, F.greatest(space - 1, F.lit(0)))
        error = F.when(comment & ~is_sha256_hex(content), F.lit("malformed-content-digest")).when(
            ours & ~is_sha256_hex(digest), F.lit("malformed-artifact-digest")
        )
        return F.struct(F.when(ours, ascii_lower(digest)).alias("artifact"), F.when(comment, content).alias("content"), error.alias("error"))

    found = F.transform(lines, read)

    def last(field: str) -> Column:
        return F.try_element_at(F.filter(F.transform(found, lambda x: x[field]), lambda x: x.isNotNull()), F.lit(-1))

    first_error = F.try_element_at(F.filter(F.transform(found, lambda x: x["error"]), lambda x: x.isNotNull()), F.lit(1))
    error = F.coalesce(first_error, F.when(last("artifact").isNull(), F.lit("no-matching-entry")))
    return F.struct(F.when(error.isNull(), last("artifact")).alias("artifact"), F.when(error.isNull(), last("content")).alias("content"), error.alias("error"))


def verdict(expected: Column, actual: Column) -> Column:
    """`ok`, `mismatch`, or `absent` without an expected digest; the case of
    the digits doesn't matter."""
    return F.when(expected.isNull(), F.lit("absent")).when(ascii_lower(expected) == ascii_lower(actual), F.lit("ok")).otherwise(F.lit("mismatch"))


def content_digest_of(fmt: Column, input_digest: Column, tar_digest: Column, artifact: Column) -> Column:
    """Which digest stands for an archive's content: a stream's input, a
    layered archive's tar, a tar itself; none for zip and 7z."""
    container, codec = fmt.getField("container"), fmt.getField("codec")
    return (
        F.when(container.isNull() & codec.isNotNull(), input_digest)
        .when((container == "tar") & codec.isNotNull(), tar_digest)
        .when(container == "tar", artifact)
    )
