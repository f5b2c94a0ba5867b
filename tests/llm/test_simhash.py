import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stowage.llm import simhash
from stowage.llm.common import connected_components


def fingerprint(text, width=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_against_brute_force(docs, texts):
    fps = [fingerprint(t) for t in texts]
    want = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{f:016x}", want[k]) for k, f in enumerate(fps)}


@pytest.mark.parametrize("bucket_rows", [4, 2048])
def test_links_of_near_values(spark, bucket_rows):
    rng = np.random.default_rng(3)
    values = list(rng.integers(0, 1 << 64, 300, np.uint64))
    for v in values[:40]:
        for n in (1, 2, 3, 4, 5):
            values.append(v ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))))
    values += [values[0] ^ np.uint64(1 << b) for b in range(40)]  # a full bucket
    values = sorted({int(np.uint64(v).view(np.int64)) for v in values})
    u = np.array(values, np.int64).view(np.uint64)
    want = components(len(u), [(a, b) for a in range(len(u)) for b in range(a) if np.bitwise_count(u[a] ^ u[b]) <= 3])
    rows = spark.createDataFrame([(v, 0, v) for v in values], "id long, n long, f0 long")
    keyed = rows.select(F.explode(simhash.bucket_keys(F.col("f0"), 3)).alias("key"), "id")
    links = simhash.linked(keyed, simhash.with_table(rows, simhash.pivots(16, 1)), 3, bucket_rows, 1)
    at = {v: k for k, v in enumerate(values)}
    got = components(len(u), [(at[r.u], at[r.v]) for r in links.collect()])
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, None), (300, 299)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 140)}, 299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_table_discards_nothing_that_is_linked():
    """A coordinate never differs by more than the fingerprints do, also where it is cut at 255."""
    rng = np.random.default_rng(1)
    for words in (1, 4, 6):
        a = rng.integers(0, 1 << 64, (300, words), np.uint64)
        b = a.copy()
        b[:, 0] ^= rng.integers(0, 1 << 64, 300, np.uint64) & rng.integers(0, 1 << 64, 300, np.uint64)
        for r in np.concatenate((simhash.pivots(8, words), ~a[:4])):
            x, y = (np.minimum(simhash.distances(v, r), 255) for v in (a, b))
            assert (np.abs(x - y) <= simhash.distances(a, b)).all()


def test_many_copies(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the very same words in each of these rows").alias("text"))
    got = simhash.near_duplicates(many).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]
