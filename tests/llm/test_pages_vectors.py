import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest

from stowage.llm import embeddings, urlfilter, warc
from stowage.llm.common import fresh_path

# archives


def pages(spark):
    rows = [(k, f"http://h{k}.org/{k}", f"<p>{k % 7}</p>" if k < 30 else "é" * k) for k in range(50)]
    rows += [(60, None, None), (61, "x\r\ny: z", ""), (62, "", "<p>0</p>"), (62, "", "<p>0</p>")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("least,hot", [(0, 20_000), (9, 20_000), (0, 10), (0, 2)])
def test_round_trip(spark, monkeypatch, least, hot):
    monkeypatch.setattr(warc, "HOT_SHARE", hot)  # so few that some or all payloads are joined by shuffle
    rows, df = pages(spark)
    last = {}
    for k, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), k)
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        refers = last[h or ""] if len(raw) >= least and k < last[h or ""] else None
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", -1 if refers is None else refers))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in warc.round_trip(df, min_bytes=least).collect()]
    assert sorted(got) == sorted(want)


def test_index_selects_and_rolls(spark):
    rows, df = pages(spark)
    folder = fresh_path(spark, "warc-test")
    index = warc.write_archives(warc.resolve_revisits(df.repartition(2)), folder, roll_bytes=2000)
    assert index.select("file").distinct().count() > 4
    some = index.where("page_id % 3 = 0 and record_type = 'response'")
    got = {r.page_id: bytes(r.payload) for r in warc.read_records(some, folder).collect()}
    html = {k: (h or "").encode() for k, _, h in rows}
    assert got and all(got[k] == html[k] for k in got) and len(got) == some.select("page_id").distinct().count()
    assert warc.round_trip(df.where("false")).count() == 0


def test_copies_travel_once_a_batch(spark):
    """Of a payload that all rows share, a batch hands one on."""
    import pyarrow as pa

    n = 500
    batch = pa.RecordBatch.from_arrays([pa.array([*range(n - 2), None, n - 3]), pa.array([""] * n), pa.array([b"<same>"] * n, pa.binary())], names=["page_id", "url", "payload"])
    out = next(warc.digested(iter([batch]), 0))
    held = [i for i, p in zip(out.column(0).to_pylist(), out.column(2).to_pylist()) if p is not None]
    assert held == [n - 3, None, n - 3] and set(out.column(4).to_pylist()) == {6}
    same = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, NULL, 'page') AS html")
    got = warc.round_trip(same).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r.record_type, r.refers_to or 0, r["count"]) for r in got) == [("response", 0, 2), ("revisit", 2997, 999), ("revisit", 2999, 1999)]


def test_ranges_coalesce():
    assert list(warc.ranges([(0, 10), (10, 5), (100, 5), (200, 50)], gap=85, most=120)) == [(0, 105, [0, 1, 2]), (200, 250, [3])]
    assert list(warc.ranges([])) == []


# urls


def brute_rule(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fit = [(len(h) + len(p), len(h), v == "block", h, p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3] + best[4], best[5] if best else default


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    labels = ["org", "com", "a", "b", "example", "co"]
    hosts = [".".join(rng.choices(labels, k=rng.randrange(1, 5))) for _ in range(120)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/en/1", "/en/12?x", "?q=://z/", "#f", "/é"]
    rules = sorted({(rng.choice(hosts), rng.choice(["", "/", "/a", "/a/b", "/en/1"]), rng.choice(["allow", "block"])) for _ in range(60)})
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://UP.Example.ORG/A", "a\nb://org/x", "http://org./x", "http://.org/", "x://u@example.org:80/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for k, u in enumerate(urls):
        assert got[k] == brute_rule(u, rules), u


def test_url_cases(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(None, "http://a.org/x", 1), (1, None, 1), (1, None, 1)], "page_id long, url string, host int")
    assert {(r.rule, r.verdict) for r in urlfilter.judge_urls(df, none, default="block").collect()} == {(None, "block")}
    bad = spark.createDataFrame([(None, "/", "allow"), ("", "/", "allow"), ("org", None, "block")], none.schema)
    assert urlfilter.judge_urls(df, bad).where("rule is not null").count() == 0 and urlfilter.judge_urls(df.where("false"), bad).count() == 0
    plan = urlfilter.judge_urls(df, none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Nested" not in plan and "Cartesian" not in plan


# vectors


@pytest.mark.parametrize("own,others", [(4096, 16384), (7, 11)])
def test_links_against_brute_force(spark, monkeypatch, own, others):
    monkeypatch.setattr(embeddings, "OWN_ROWS", own)
    monkeypatch.setattr(embeddings, "OTHER_ROWS", others)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 8)) * 0.15, np.repeat(x[:1], 40, 0) + rng.normal(size=(40, 8)) * 0.05, x[:5] * 3, x[5:8]])
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [3.0]]
    rows += list(enumerate(odd, 1000)) + [(None, rows[0][1]), (3, rows[3][1])]
    ok = [(n, np.array(v, np.float64)) for n, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a, b) for i, (a, u) in enumerate(ok) for b, w in ok[:i] if len(u) == len(w) and u @ w / (np.linalg.norm(u) * np.linalg.norm(w)) >= 0.9]
    links = {n: 0 for n in range(len(rows))}
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for n, (k, _) in enumerate(rows):
        ids.setdefault(root(n), []).append(k)
    least = {r: min((k for k in v if k is not None), default=None) for r, v in ids.items()}
    want = sorted((-1 if k is None else k, links[n], least[root(n)]) for n, (k, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df, cell_rows=40).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_at_the_threshold(spark, kind):
    """Cosines around 0.9 by less than single precision tells."""
    rng, rows = np.random.default_rng(9), []
    for k in range(60):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        c = 0.9 + (k - 29.5) * 2e-9
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    x = [np.array(r.embedding) for r in df.orderBy("vec_id").collect()]
    want = {k for k in range(60) if x[2 * k] @ x[2 * k + 1] / (np.linalg.norm(x[2 * k]) * np.linalg.norm(x[2 * k + 1])) >= 0.9}
    got = {r.vec_id // 2 for r in embeddings.near_duplicates(df).collect() if r.n_links}
    assert got == want and 0 < len(want) < 60


def test_repeated_vectors_are_one_pivot(spark, monkeypatch):
    """Many rows of one vector leave the other pivots as they are: cells stay many, and clusters don't visit each other."""
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    x = np.concatenate([np.repeat(centres[:1], 2000, 0), *(c + rng.normal(size=(40, 24)) * 0.01 for c in centres)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, real = [], embeddings.written

    def spy(table, name):
        out = real(table, name)
        if name == "cells":
            seen.append(out)
        return out

    monkeypatch.setattr(embeddings, "written", spy)
    got = embeddings.near_duplicates(df, cell_rows=40).collect()
    assert seen[0].count() == 961 and seen[0].select("home").distinct().count() >= 20  # the repeated vector is one row
    assert seen[0].selectExpr("avg(size(visits)) n").first().n < 8  # of 12
    assert len({r.component_id for r in got}) == 24 and sum(r.n_links for r in got) == 2040 * 2039 + 23 * 40 * 39


def test_many_rules_of_one_host(spark):
    """100,000 rules of a host, and urls of that host alone: no task gets all rules, no url an array of them."""
    rules = spark.range(100_000).selectExpr("'big.org' AS host", "concat('/', id % 1000, '/', id) AS path", "if(id % 3 = 0, 'block', 'allow') AS verdict")
    rules = rules.union(spark.createDataFrame([("big.org", "/7", "block"), ("org", "", "allow")], rules.schema))
    urls = spark.range(3000).selectExpr("id AS page_id", "concat('http://', if(id % 2 = 0, 'a.', ''), 'big.org/', id % 1000, '/', id, if(id % 5 = 0, '', '/x')) AS url")
    got = urlfilter.judge_urls(urls, rules)
    for r in got.collect():
        k = r.page_id
        assert (r.rule, r.verdict) == (f"big.org/{k % 1000}/{k}", "block" if k % 3 == 0 else "allow")
    other = spark.createDataFrame([(1, "http://big.org/7/x"), (2, "http://big.org/71"), (3, "http://big.org/8/x"), (4, "http://bigger.org/7")], "page_id long, url string")
    assert {r.page_id: r.rule for r in urlfilter.judge_urls(other, rules).collect()} == {1: "big.org/7", 2: "big.org/7", 3: "org", 4: "org"}
