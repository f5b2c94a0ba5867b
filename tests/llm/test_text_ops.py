import math
import random
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowage.llm import langid, lines, pieces, quality, tokencounts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


# language

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    found = langid.predict(docs.where(held), langid.train(docs.where(~held))).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_cases(spark, docs, no_docs):
    model = langid.train(docs)
    assert model.languages == ["en", "fr"]
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 !? ½", "c"), (4, "x", "d"), (4, "x", "d"), (None, "é" * 700_000, "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.predict(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [r.lang_pred for r in got.where("doc_id < 4").orderBy("doc_id").collect()] == ["und"] * 3
    assert langid.predict(odd, model, keep=0.0).columns == odd.columns and langid.predict(odd, model, keep=0.0).count() == 3
    nothing = langid.train(no_docs)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"} and langid.predict(no_docs, model).count() == 0


def brute_bayes(rows, text, smoothing=0.5):
    """Multinomial naive Bayes over hashed 1- to 3-grams, one n-gram at a time: (language, score). rows: (text, lang)."""

    def grams(t):
        form = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t)
        for n in (1, 2, 3):
            for i in range(len(form) - n + 1):
                h = 0
                for k, c in enumerate(form[i : i + n]):
                    h = ord(c) if k == 0 else (h * 0x9E3779B1 + ord(c)) % 2**32
                h = (h + n) * 0x85EBCA6B % 2**32
                yield (h ^ h >> 15) % 8192

    counts = defaultdict(Counter)
    for t, lang in rows:
        if t and lang is not None:
            counts[lang].update(grams(t))
    if not text or not any(map(str.isalpha, text)) or not counts:
        return "und", 0.0
    own, logs = Counter(grams(text)), {}
    for lang, c in counts.items():
        total = sum(c.values()) + 8192 * smoothing
        logs[lang] = sum(n * math.log((c[g] + smoothing) / total) for g, n in own.items())
    best = min(logs, key=lambda x: (-logs[x], x))
    scale = min(1, langid.EVIDENCE / sum(own.values()))
    return best, 1 / sum(math.exp((v - logs[best]) * scale) for v in logs.values())


@pytest.mark.parametrize("block", [256, 1])
def test_language_against_brute_force(spark, docs, texts, block):
    rows = [(r.text, r.lang) for r in docs.collect()]
    extra = [("¿qué?", "es"), ("über Öl", "de"), ("z", "zz"), ("z", "za")]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(900 + k, *x) for k, x in enumerate(extra)], "doc_id long, text string, lang string"))
    some = table.where("doc_id < 20 OR doc_id >= 60")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(some, langid.train(table, block_languages=block)).collect()}
    every = dict(enumerate(texts)) | {900 + k: t for k, (t, _) in enumerate(extra)}
    for k, (lang, score) in got.items():
        want = brute_bayes([*rows, *extra], every[k]) if len(every[k] or "") < 20_000 else None
        assert want is None or (lang == want[0] and math.isclose(score, want[1], rel_tol=1e-9)), every[k]
    assert got[902][0] == "za"  # a tie


def test_all_languages_are_learned(spark):
    """Far more labels than any list of languages has, each with a word of its own, in three blocks."""
    rows = [(k, f"w{k:04d}".translate(str.maketrans("0123456789", "abcdefghij")) * 8, f"l{k:04d}") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, floors=True)
    assert len(model.languages) == 600 and len(model.blocks) == 3
    assert sum(r.lang_pred == r.lang for r in langid.predict(table, model).collect()) >= 590
    assert langid.predict(table, model, keep=0.0).columns == table.columns


def test_stretches_count_as_one(monkeypatch):
    text = "Some wörds, ánd more of thèm. " * 50
    want = langid.counted(text)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 37)
    assert (langid.counted(text) == want).all()


# lines

def brute_lines(texts, min_docs, min_chars):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    bad = {k for k, n in found.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for t in texts:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) not in bad]
        out.append((len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs,min_chars,batches", [(10, 1, 4), (2, 1, 5), (3, 4, 1), (2, 0, 8)])
def test_lines_against_brute_force(docs, texts, min_docs, min_chars, batches):
    got = lines.drop_repeated_lines(docs, min_docs=min_docs, min_chars=min_chars, batches=batches)
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()}
    assert rows == dict(enumerate(brute_lines(texts, min_docs, min_chars)))


def test_lines_cases(spark, no_docs):
    odd = spark.createDataFrame([(None, "a\nb", "x")] * 3 + [(1, None, "y")], "n_lines long, text string, hashes_ string")
    got = lines.drop_repeated_lines(odd, min_docs=3)
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in got.collect()) == [("", 1, 0)] + [("", 2, 2)] * 3
    assert lines.drop_repeated_lines(no_docs).count() == 0


def test_runs_add_up(spark):
    runs, want = lines.LineRuns(spark, 4), Counter()
    for b in range(5):
        batch = [(h, 1) for h in range(20) if h % (b + 1) == 0] + [(100 + b, 9)]
        for h, n in batch:
            want[h] += n
        runs.add(spark.createDataFrame(batch, "h long, n long"))
    assert [r is not None for r in runs.levels] == [True, False, True]
    assert {r.h for r in runs.repeated().collect()} == {h for h, n in want.items() if n >= 4}
    assert lines.LineRuns(spark, 2).repeated().count() == 0
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_meet_without_a_shuffle(spark):
    """Compaction and the anti-join read buckets as they lie."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = lines.LineRuns(spark, 4)
        a, b = (runs.run(spark.range(k, 9000, 2).select(F.col("id").alias("h"), F.lit(1).cast("long").alias("n"))) for k in (0, 1))
        merged = a.withColumnRenamed("n", "m").join(b, "h", "full")
        assert merged.count() == 9000 and "Exchange hashpartitioning" not in merged._jdf.queryExecution().executedPlan().toString()
        batch = spark.range(9000).select(F.col("id").alias("h"), F.lit(1).alias("n")).groupBy("h").agg(F.sum("n").alias("n"))
        left = batch.join(a.select("h"), "h", "left_anti")
        assert left.count() == 4500 and left._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(h") <= 1
        runs.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# quality

def brute_base(text):
    t = text or ""
    w = WORD.findall(t)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_counts(texts):
    more = ["a b c a b c a b", "x x x x", "a b c d a b c", "#é* <b>\n<b>\n \n \nx", "p q r " * 40]
    for t in [*texts, *more]:
        assert quality.base((t or "").encode()) == brute_base(t), t


def brute_references(rows, common=64):
    """Per language: shares of character classes, by byte, and of the most frequent words. rows: (text, lang)."""
    out, by_lang = {}, defaultdict(list)
    for t, lang in rows:
        if t is not None and lang is not None:
            by_lang[lang].append(t)
    for lang, some in by_lang.items():
        words = Counter(w for t in some for w in brute_words(t))
        top = sorted(words, key=lambda w: (-words[w], w.encode()))[:common]
        classes = Counter(brute_class(b) for t in some for b in t.encode())
        if classes:
            out[lang] = {k: n / sum(classes.values()) for k, n in classes.items()}, {w: words[w] / max(1, sum(words.values())) for w in top}
    return out


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute_class(b):
    c = chr(b)
    if b >= 128:
        return "other"
    for name, some in (("lower", r"[a-z]"), ("upper", r"[A-Z]"), ("digit", r"[0-9]"), ("space", r"[\t-\r ]"), ("mark", r"[.,;:!?'\"()-]"), ("symbol", r"[#*$%&|<>]")):
        if re.match(some, c):
            return name
    return "ascii"


def brute_distance(p, q):
    """Jensen-Shannon, term by term."""
    d = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0), q.get(k, 0)
        d += sum(x * math.log2(x / ((a + b) / 2)) / 2 for x in (a, b) if x > 0)
    return math.sqrt(max(0, d))


def brute_distances(text, lang, refs):
    text = text or ""
    langs = [lang] if lang in refs else list(refs)
    classes, words = Counter(brute_class(b) for b in text.encode()), brute_words(text)
    by_class = [brute_distance({k: n / classes.total() for k, n in classes.items()}, refs[x][0]) for x in langs] if classes.total() >= 200 else []
    by_word = []
    for x in langs if len(words) >= 50 else []:
        q = refs[x][1]
        p = {w: n / len(words) for w, n in Counter(words).items() if w in q}
        by_word.append(brute_distance({**p, None: 1 - sum(p.values())}, {**q, None: 1 - sum(q.values())}))
    return min(by_class, default=None), min(by_word, default=None)


def brute_kept(text, lang, refs):
    n, failed = (f := brute_base(text))[0], f[-1]
    a, b = brute_distances(text, lang, refs)
    return not failed and (a or 0) <= 0.20 + n**-0.5 and (b or 0) <= 0.28 + 1.5 * n**-0.5


@pytest.mark.parametrize("block", [1024, 1])
def test_judge_against_plain_distance(spark, docs, texts, block):
    more = [(700, "жизнь прекрасна и удивительна когда понимаешь " * 30, "ru"), (701, "жизнь прекрасна и удивительна " * 20 + "слово " * 20, None), (702, "a" * 5000 + " b" * 80, "en"), (703, "x" * 300, "fr")]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    rows = {r.doc_id: (r.text, r.lang) for r in table.collect()}
    refs, learned = brute_references(rows.values()), quality.learn(table, block_languages=block)
    assert len(learned) == (3 if block == 1 else 1)
    known = quality.References({k: v for b in learned for k, v in b.value.classes.items()}, {k: v for b in learned for k, v in b.value.words.items()})
    assert set(known.classes) == set(refs) == {"en", "fr", "ru"}
    assert {k.decode(): round(v, 12) for k, v in known.words["ru"].items()} == {w: round(v, 12) for w, v in refs["ru"][1].items()} and len(known.words["ru"]) == 6
    assert {w for w in refs["en"][1]} == {k.decode() for k in known.words["en"]}
    for r in quality.judge(table, learned).collect():
        t, lang = rows[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t)
        for got, want in zip((r.class_distance, r.word_distance), brute_distances(t, lang, refs)):
            assert (got is None) == (want is None) and math.isclose(got or 0, want or 0, abs_tol=1e-7)
        assert r.kept == brute_kept(t, lang, refs)
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert math.isclose(quality.distance(p, q), math.sqrt(0.5)) and quality.distance(p, p) == 0


def test_all_languages_have_references(spark):
    rows = [(k, f"слово{k} другое{k} " * 40, f"l{k:04d}") for k in range(600)]
    learned = quality.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), block_languages=250)
    assert [len(b.value.words) for b in learned] == [250, 250, 100]
    assert learned[2].value.words["l0599"] == {"слово599".encode(): 0.5, "другое599".encode(): 0.5}


def test_labelled_rows(spark):
    """Clean labelled documents stay; of the junk that passes the base rule little does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = quality.judge(docs, quality.learn(docs)).where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in rows}
    assert share[1] >= 0.99 and share[0] <= 0.15


def test_quality_cases(spark, docs, no_docs):
    refs = quality.learn(docs)
    odd = spark.createDataFrame([(None, None, "xx", 1), (1, "", None, 2), (1, "", None, 2)], "doc_id long, text string, lang string, kept long")
    assert [r.kept for r in quality.judge(odd, refs).collect()] == [False] * 3
    assert quality.judge(odd, refs, only_kept=True).columns == odd.columns and quality.judge(odd, refs, only_kept=True).count() == 0
    assert quality.judge(no_docs, refs).count() == 0
    assert quality.judge(docs, quality.learn(no_docs)).where("class_distance is not null").count() == 0


# pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk", [60, 3000, 1 << 16])
def test_pieces_equal_the_whole(docs, texts, chunk):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r.ids for r in pieces.encode(docs, MODEL, chunk=chunk).collect()}
    assert got == {k: sp.encode(t) if t else [] for k, t in enumerate(texts)}


@pytest.mark.parametrize("size", [1, 4, 37, 400])
def test_scan_equals_the_whole(texts, size):
    """Whatever the boundaries fall on: spaces, runs of them, words without an end, bytes."""
    scan, sp, rng = pieces.scanner(MODEL), pieces.processor(MODEL), random.Random(3)
    odd = ["x" * 300, "ab" * 150, "🙂é" * 60, "日本語テキスト" * 30, "a  b   c    " * 20, "\n\n" * 40, " " * 70, "▁a▁▁b", "aaaaab" * 50, "1234567890" * 20]
    odd += ["".join(rng.choices("etaoinshr", k=700)), "".join(rng.choices("etaoins ", k=700)), "".join((texts[0] or "").split())[:700]]
    for text in [*odd, *[t[:900] for t in texts if t]]:
        form = pieces.SPACE + text.replace(" ", pieces.SPACE)
        chunks = []
        for p in range(0, len(form), size):
            q, low = min(p + size, len(form)), max(0, p - scan.longest)
            chunks.append(pieces.Chunk(scan, form[low : q + scan.longest], p - low, q - low, p == 0, q == len(form)))
        matrices = [c.matrix() for c in chunks]
        last = max(reduce(pieces.product, matrices), key=lambda c: c[2])[1]
        states = pieces.between(matrices, pieces.START, last)
        assert [i for c, s, t in zip(chunks, states, states[1:]) for i in c.ids(s, t)] == sp.encode(text), text


def test_product_is_associative():
    rng = random.Random(8)
    a, b, c = ([(s, t, float(rng.randrange(-9, 9))) for s in range(6) for t in range(6) if rng.random() < 0.4] for _ in range(3))
    want = {(s, t): w for s, t, w in pieces.product(pieces.product(a, b), c)}
    assert want == {(s, t): w for s, t, w in pieces.product(a, pieces.product(b, c))} and want
    for (s, t), w in want.items():
        x = pieces.between([a, b, c], s, t)
        assert (x[0], x[-1]) == (s, t) and sum(max(v for p, q, v in m if (p, q) == y) for m, y in zip((a, b, c), zip(x, x[1:]))) == w


def test_a_giant_text(spark, texts, monkeypatch):
    """7 MB in some 220 chunks, with and without spaces: no task gets more than a group of matrices."""
    some = " ".join(t for t in texts if t and "\n" not in t) + " "
    giant = some * (7_000_000 // len(some)) + "abc" * 40_000
    groups, real = [], pieces.in_groups

    def spy(matrices, fan_in):
        out = real(matrices, fan_in)
        groups.append(out.agg(F.max(F.size("group")), F.count("*")).first())
        return out

    monkeypatch.setattr(pieces, "in_groups", spy)
    docs = spark.createDataFrame([(7, giant), (8, "short " * 10_000), (9, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode(docs, MODEL).collect()}
    sp = pieces.processor(MODEL)
    assert got[8] == sp.encode("short " * 10_000) and got[9] == []
    assert got[7] == sp.encode(giant)
    assert len(groups) == 6 and all(most <= 8 for most, _ in groups) and groups[0][1] >= 25


def test_pieces_decode(spark, docs, texts, no_docs):
    odd = [" a  b   ", "  two", "x\n y", "a b\n\n  c ", "   "]
    more = spark.createDataFrame(list(enumerate(odd, 1000)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {r.doc_id: r.text for r in pieces.with_decoded(pieces.encode(more, MODEL, chunk=200), MODEL).collect()}
    for k, t in [*enumerate(odd, 1000), *enumerate(texts)]:
        assert got[k] == (t or ""), t
    assert pieces.encode(no_docs, MODEL).count() == 0


def test_spelling_equals_the_library(spark):
    sp, rng = pieces.processor(MODEL), random.Random(6)
    n = sp.get_piece_size()
    rows = [(k, [rng.randrange(n) for _ in range(rng.randrange(1, 30))]) for k in range(400)] + [(1000, []), (1001, None), (1002, [0, 5, 1]), (1003, [200, 150])]
    rows += [(2000 + k, [rng.randrange(3, 259) for _ in range(12)]) for k in range(50)]
    got = {r.doc_id: r.text for r in pieces.with_decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>"), MODEL).collect()}
    assert got == {k: sp.decode(ids) if ids else "" for k, ids in rows}


# token counts

def test_tokens_are_attributed(spark, docs, texts, no_docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for rule in tokencounts.RULES:
        rows = tokencounts.count_tokens(docs, ranks, ["source", "lang"], rule=rule, joint=" ").collect()
        got = {(r.doc_id, r.section): r.n_tokens for r in rows}
        for r in docs.collect():
            parts = [f"{r.source} ", f"{r.lang or ''} ", r.text or ""]
            assert sum(got[r.doc_id, s] for s in ("source", "lang", "text")) == len(t.encode("".join(parts)).ids)
        assert sum(r.n_bytes for r in rows if r.doc_id == 0) == len(f"{docs.first().source} en {texts[0]}".encode())
    assert tokencounts.count_tokens(no_docs, ranks, []).count() == 0
    with pytest.raises(ValueError):
        tokencounts.count_tokens(docs, ranks, [], rule="none")


def brute_sections(token_lengths, parts, rule):
    """(tokens, crossing, bytes) of each section, byte by byte."""
    owner = [k for k, p in enumerate(parts) for _ in p.encode()]
    out, at = [[0, 0, len(p.encode())] for p in parts], 0
    for n in token_lengths:
        held = owner[at : at + n]
        most = max(sorted(set(held)), key=held.count)
        to = {"start": held[0], "end": held[-1], "majority": most}[rule]
        out[to][0] += 1
        out[to][1] += len(set(held)) > 1
        at += n
    assert at == len(owner)
    return [tuple(x) for x in out]


@pytest.mark.parametrize("rule", tokencounts.RULES)
@pytest.mark.parametrize("joint", ["", "\n\n", " é"])
def test_sections_against_brute_force(spark, docs, texts, rule, joint):
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        size = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, f)}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    some = docs.where("doc_id < 20 OR doc_id >= 60")
    got = defaultdict(dict)
    for r in tokencounts.count_tokens(some, path, ["source", "lang"], rule=rule, joint=joint).collect():
        got[r.doc_id][r.section] = (r.n_tokens, r.n_crossing, r.n_bytes)
    crossing = 0
    for r in some.collect():
        parts = [(r.source or "") + joint, (r.lang or "") + joint, r.text or ""]
        want = brute_sections([size[i] for i in plain.encode("".join(parts)).ids], parts, rule)
        assert [got[r.doc_id][s] for s in ("source", "lang", "text")] == want
        crossing += sum(w[1] for w in want)
    assert crossing or joint


def test_crossing_tokens():
    ends, sections = np.array([2, 7, 9]), np.array([3, 6, 6, 9])
    assert tokencounts.attribute(ends, sections, "start")[0].tolist() == [2, 0, 0, 1]
    assert tokencounts.attribute(ends, sections, "end")[0].tolist() == [1, 0, 0, 2]
    assert tokencounts.attribute(ends, sections, "majority")[0].tolist() == [1, 1, 0, 1]
    assert tokencounts.attribute(ends, sections, "start")[1].tolist() == [1, 0, 0, 0]
