import re

import numpy as np
import pytest
import xxhash

from stowage.llm import shingles, simhash

from .test_simhash import components


def shingle_set(text, width=5):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1))} if parts else set()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def near_copies(rng, n):
    """Texts, each with copies of growing distance."""
    out = []
    for k in range(n):
        text = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 400)))]
        out.append(" ".join(text))
        for changed in (0.005, 0.018, 0.022, 0.026, 0.035):
            copy = list(text)
            for at in rng.choice(len(text), max(1, round(changed * len(text))), replace=False):
                copy[at] = f"x{rng.integers(0, 3000)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("rows", [{}, {"bucket_rows": 4, "group_rows": 3}])
def test_keep_first_is_exact(spark, docs, texts, no_docs, rows):
    """Copies at and around the limit, with the production defaults and in small chunks: all links, and no other."""
    many = [*texts, *near_copies(np.random.default_rng(2), 60)]
    sets = [shingle_set(t) for t in many]
    roots = components(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b])])
    table = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    kept = simhash.keep_first(table, **rows)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(roots)
    if not rows:
        odd = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (None, "unlike the others here", "x"), (2, None, "x"), (3, "", "x")]
        odd = spark.createDataFrame(odd, "doc_id long, text string, row_ string")
        assert sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_first(odd).collect()) == [(0, "unlike the others here"), (1, "a b c d"), (2, "")]
        assert simhash.keep_first(no_docs).count() == 0


def test_fingerprints_of_similar_sets():
    """How far the fingerprints of similar sets are apart at most, and of others at least."""
    rng = np.random.default_rng(6)
    for n in (5, 20, 100, 1000):
        far, apart = [], []
        for _ in range(400):
            shared, rest = rng.integers(0, 1 << 64, n, np.uint64), max(1, n // 4)
            a, b = shared, np.concatenate((shared, rng.integers(0, 1 << 64, rest, np.uint64)))  # similarity 0.8
            x, y, z = (np.array(simhash.fingerprint(s, 4), np.uint64) for s in (a, b, rng.integers(0, 1 << 64, n, np.uint64)))
            far.append(int(simhash.distances(x, y)))
            apart.append(int(simhash.distances(x, z)))
        assert max(far) <= simhash.SET_BITS and min(apart) > simhash.SET_BITS


def test_prefixes_and_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, int(rng.integers(1, 300)), np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate((s[: int(len(s) * 0.9)], rng.integers(400, 500, 5, np.uint64)))) for s in sets] + [np.zeros(0, np.uint64)]
    common = np.arange(0, 400, 3, dtype=np.uint64)
    got = shingles.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(set(a.tolist()) & set(b.tolist()))
            assert got[i, j] == got[j, i] == n
            if len(a) and 5 * n >= 4 * (len(a) + len(b) - n):
                assert set(shingles.prefix(a, 0.8, common).tolist()) & set(shingles.prefix(b, 0.8, common).tolist())


def test_shared_rows_over_batches():
    import pyarrow as pa

    rows = sorted([(k, i) for k in range(60) for i in range(k % 4)] + [(7, 1), (7, 1), (9, 0), (8, 5), (8, 5)])
    want = sorted({r for r in rows if len({i for k, i in rows if k == r[0]}) > 1})
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 3]], pa.int64()) for c in (0, 1)], names=["key", "id"]) for a in range(0, len(rows), 3)]
    got = [r for b in shingles.shared_rows(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert got == want and xxhash.xxh64_intdigest(b"a b c d e", 42) == int(shingles.shingle_hashes(b"A b\tc d e", 5)[0])
