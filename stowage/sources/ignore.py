"""Ignore patterns as regular expressions over paths relative to their folder."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    regex: str
    negated: bool
    folders_only: bool

    def fits(self, rel: str, is_dir: bool) -> bool:
        return (is_dir or not self.folders_only) and re.match(self.regex, rel, re.S) is not None


def translate(glob: str) -> str:
    """A glob as a regular expression: `*` and `?` stay within a part, `**`
    as a whole part spans any number of parts."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob[i:] == "**" and i and glob[i - 1] == "/":
            out, i = out + ".+", i + 2
            continue
        if c == "*":
            out += "[^/]*"
            while glob[i : i + 1] == "*":
                i += 1
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise ValueError(f"invalid-glob: {glob}")
            body = glob[i + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out, i = out + "[" + body.replace("\\", "\\\\") + "]", end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def parse(line: str) -> Pattern | None:
    """A line of an ignore file; None for a blank line or a comment."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders_only = line.endswith("/")
    line = line.rstrip("/") if folders_only else line
    anchored = "/" in line
    body = translate(line.lstrip("/"))
    if not body:
        return None
    return Pattern(("" if anchored else "(?:.*/)?") + body + r"\Z", negated, folders_only)


def patterns(text: str) -> list[Pattern]:
    return [p for p in map(parse, text.splitlines()) if p]


def verdict(rules: list[Pattern], rel: str, is_dir: bool) -> bool | None:
    """Whether the last pattern that fits ignores the path; None if none fits."""
    for p in reversed(rules):
        if p.fits(rel, is_dir):
            return not p.negated
    return None
