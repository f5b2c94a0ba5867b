"""Word shingles of a text: hashes, sets, set prefixes, and similar sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For the order of hashes: SAMPLE texts, or SAMPLE_ROOT times the root of their number if that is more, are looked at; a
#: hash is common if COMMON_IN of them have it; the most frequent MOST_COMMON of these are broadcast (8 bytes each).
SAMPLE, SAMPLE_ROOT, COMMON_IN, MOST_COMMON = 4000, 40, 3, 500_000
#: Columns of a table of sets and hashes that are in memory at once.
COLUMNS_AT_ONCE = 1 << 15


def shingle_hashes(body: bytes, width: int) -> np.ndarray:
    """XXH64 of seed 42 of the `width`-word shingles, with repeats; fewer
    words are one shingle, no words none."""
    h = xxhash.xxh64_intdigest
    parts = body.lower().split()  # bytes: A-Z and ASCII white space alone
    line, n = b" ".join(parts), len(parts)
    if n <= width:
        return np.array([h(line, 42)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(line[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text or b"", width))


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """So many of the first hashes that two sets of this Jaccard similarity or
    more have one in common: the larger can miss n - ceil(similarity * n).
    `common` ones (sorted) come last. Any order that all sets share loses no
    pair; this one keeps texts apart that have a passage in common."""
    n = len(hashes)
    if not n:
        return hashes
    late = np.zeros(n, bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    return np.concatenate((hashes[~late], hashes[late]))[: n - math.ceil(similarity * n - 1e-9) + 1]


def common_hashes(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes, sorted, that are common in a sample of `texts` (text). They only order
    the hashes, so what the sample misses costs time alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width).view(np.int64))], names=["h"])

    n = texts.count()
    share = F.pmod(F.xxhash64("text"), F.lit(max(1, n // max(SAMPLE, SAMPLE_ROOT * math.isqrt(n)))))
    counts = texts.where(share == 0).distinct().mapInArrow(rows, "h long").groupBy("h").count().where(F.col("count") >= COMMON_IN)
    return np.sort(counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for each hash of the prefix; a task gives a set's once."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, len(batch), 500):
            ids, bodies = [], []
            for i, body in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                if i not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()  # what is given twice is dropped later
                    seen.add(i)
                    ids.append(i)
                    bodies.append(body)
            repeated = np.repeat(np.array(ids, np.int64), [len(b) // 8 for b in bodies])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(bodies), np.int64)), pa.array(repeated)], names=["key", "id"])


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id), sorted, those whose key another id has too, each once."""
    keys, ids, flag = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not len(batch):
            continue
        keys, ids = (np.concatenate((x, c.to_numpy(zero_copy_only=False))) for x, c in zip((keys, ids), batch.columns))
        again = np.concatenate(([False], (keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1])))
        keys, ids = keys[~again], ids[~again]
        same, shared = keys[1:] == keys[:-1], np.zeros(len(keys), bool)
        shared[0] = flag
        shared[1:] |= same
        shared[:-1] |= same
        out, flag = np.flatnonzero(shared[:-1]), bool(shared[-1])  # the last row's key may go on in the next batch
        yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(ids[out])], names=["key", "id"])
        keys, ids = keys[-1:], ids[-1:]
    if flag:
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "id"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets have in common, (n, n), by bit tables of
    the hashes that two sets or more have."""
    n = len(sets)
    at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = counts[at] > 1
    row, at = row[keep], (np.cumsum(counts > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((n, n), np.int64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(at, [low, low + COLUMNS_AT_ONCE])
        table = np.zeros((n, min(COLUMNS_AT_ONCE, int(at[-1]) + 1 - low)), bool)
        table[row[a:b], at[a:b] - low] = True
        bits = np.packbits(table, axis=1)
        words = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        for i in range(n - 1):
            common[i, i + 1 :] += np.bitwise_count(words[i] & words[i + 1 :]).sum(1, dtype=np.int64)
    return common + common.T


def similar(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of ids that join the components of those whose sets' Jaccard
    similarity is `similarity` or more."""
    sizes, common = np.array([len(x) for x in sets], np.int64), intersections(sets)
    linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(linked, True)
    label, before = np.arange(len(ids)), None
    while before is None or (label != before).any():
        before = label
        label = np.where(linked, label[None, :], len(ids)).min(1)
    return [(ids[i], ids[k]) for i, k in enumerate(label.tolist()) if i != k]


def verified_rows(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(u, v) of rows (key, a, b, id, hashes) that are sorted by cell."""
    cell, ids, sets = None, [], []

    def found():
        pairs = similar(ids, sets, similarity) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for key, a, b, i, body in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, a, b) != cell:
                yield found()
                cell, ids, sets = (key, a, b), [], []
            ids.append(i)
            sets.append(np.frombuffer(body, np.uint64))
    yield found()
