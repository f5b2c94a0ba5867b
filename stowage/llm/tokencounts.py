"""Token counts of a document's sections, attributed by character offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "majority")
COLUMNS = ("n_tokens", "n_crossing", "n_bytes")


@cache
def encoding(path: str):
    """(tiktoken encoding, bytes of each id); one for each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. Both arguments are sorted
    ends of spans that tile the same bytes; the interval join of the two is a
    merge of sorted ends.

    A token that crosses a boundary goes whole to one section: by `start` to
    that of its first byte, by `end` to that of its last, by `majority` to
    that with most of its bytes, the earlier one on a tie. It is counted as
    crossing there. Sections without bytes get nothing.
    """
    n = len(section_ends)
    if not len(token_ends) or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    to = first.copy() if rule != "end" else last.copy()
    across = first != last
    if rule == "majority":
        for k in np.flatnonzero(across):
            cuts = [starts[k], *section_ends[first[k] : last[k]], token_ends[k]]
            to[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return np.bincount(to, minlength=n), np.bincount(to[across], minlength=n)


def count_tokens(
    docs: DataFrame, vocabulary: str, fields: list[str], *, id_col: str = "doc_id", text_col: str = "text", joint: str = "\n\n", rule: str = "start"
) -> DataFrame:
    """(doc_id, section, n_tokens, n_crossing, n_bytes): a row for each
    document and section, in tokens of the whole document.

    A document is its `fields` and then its text, joined by `joint`; each is a
    section and owns the joint after it. The whole is encoded once, so that a
    token may cross a boundary as it does in training; `rule` says where it
    counts (see `attribute`), and sections' counts add up to the document's.

    A null field or text is empty and keeps its row; a text is encoded whole,
    however long. Rows with equal or null ids, or repeated, are documents of
    their own. An empty table gives no rows. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    names = [*fields, text_col]
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.string()), *((c, pa.int64()) for c in COLUMNS)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, lengths = encoding(vocabulary)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[], [], []]
            for parts in zip(*(c.to_pylist() for c in batch.columns[1:])):
                parts = [(p or "") + joint * (k < len(names) - 1) for k, p in enumerate(parts)]
                ends = np.cumsum([len(p.encode()) for p in parts])
                tokens = np.cumsum(lengths[codec.encode_ordinary("".join(parts))])
                for held, x in zip(out, (*attribute(tokens, ends, rule), np.diff(ends, prepend=0))):
                    held.extend(x.tolist())
            doc_ids = pa.array([i for i in ids for _ in names], pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(names * len(ids), pa.string()), *(pa.array(x, pa.int64()) for x in out)], schema=schema)

    cols = [F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"part{k}") for k, c in enumerate(names))]
    return docs.select(*cols).mapInArrow(rows, "doc_id long, section string, n_tokens long, n_crossing long, n_bytes long")
