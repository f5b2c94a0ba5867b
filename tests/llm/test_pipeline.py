"""Each stage of the pipeline on its own input, and run() end to end."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_shingles import linked, shingle_set
from .test_simhash import components
from .test_text_ops import brute_bayes, brute_kept, brute_lines, brute_references

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two made-up languages, copies, near copies, shared lines and junk."""
    rng = np.random.default_rng(11)
    vocabulary = {"en": [f"{a}{b}" for a in ("the", "and", "of", "wor", "lan", "tion") for b in ("", "s", "ly", "ing", "er", "est", "ness", "ful")], "es": [f"{a}{b}" for a in ("el", "que", "los", "cami", "ñan", "ción") for b in ("", "o", "a", "ito", "mente", "ado", "ería", "ez")]}
    rows = []

    def prose(lang, n):
        words = vocabulary[lang]
        return [words[int(k)] for k in np.minimum(rng.exponential(12, n), len(words) - 1)]

    for k in range(120):
        lang = "en" if k % 3 else "es"
        rows.append((" ".join(prose(lang, int(rng.integers(60, 300)))) + ("\n Shared LINE of many \n" if k % 6 == 0 else ""), lang))
    for k in range(8):
        rows.append(rows[k])
        words = rows[10 + k][0].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((" ".join(words), rows[10 + k][1]))
    rows += [("too short", "en"), (None, "en"), ("", None), ("spam spam spam " * 40, "en"), ("### $$$ %%% " * 3 + "*** ".join(f"{k:x}###$$$" for k in range(90)), "en"), ("1 2 3 " * 60, None)]
    rows = [(k, t, lang, f"src{k % 3}", len(t or "")) for k, (t, lang) in enumerate(rows)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows, str(folder)


def stage(spark, name, rows, folder):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, DOCUMENTS), folder)
    if name != "packing":
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])
    return out.collect()


def test_stages(spark, corpus):
    rows, folder = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "line_dedup", "near_dedup", "packing"]

    refs = brute_references([(r[1], r[2]) for r in rows])
    want = [r for r in rows if brute_kept(r[1], r[2], refs)]
    kept = stage(spark, "quality", rows, folder)
    assert kept == want and {r[0] for r in rows[:120]} <= {r[0] for r in kept}  # prose stays
    assert not {r[0] for r in rows[136:]} & {r[0] for r in kept}  # junk goes

    labelled = [(r[1], r[2]) for r in kept]
    want = [r for k, r in enumerate(kept) if k % 9 or brute_bayes(labelled, r[1])[1] >= 0.5]
    found = stage(spark, "language", kept, folder)
    assert found == want == kept

    want = [(r[0], text, r[2], r[3], len(text)) for r, (_, _, text) in zip(found, brute_lines([r[1] for r in found], 10, 1))]
    cut = stage(spark, "line_dedup", found, folder)
    assert cut == want and sum(len(a[1]) > len(b[1]) for a, b in zip(found, cut)) >= 20

    sets = [shingle_set(r[1]) for r in cut]
    roots = components(len(cut), [(a, b) for a in range(len(cut)) for b in range(a) if linked(sets[a], sets[b])])
    left = stage(spark, "near_dedup", cut, folder)
    assert left == [cut[k] for k in sorted(set(roots))] and not {120 + k for k in range(16)} & {r[0] for r in left}

    pieces = defaultdict(list)
    for p in stage(spark, "packing", left, folder):
        pieces[p.doc_id].append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in left:
        assert [i for _, ids in sorted(pieces[r[0]]) for i in ids] == [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1]

    whole = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in whole} == {r[0] for r in left} and sum(p.length for p in whole) == sum(len(ids) for v in pieces.values() for _, ids in v)


def test_copies_leave_one_whole_document(spark):
    """Twenty copies don't make their own lines repeated; ten different texts do."""
    text = "\n".join(f"line {k} of a text that is often copied" for k in range(12))
    shared = [f"own line {k}\nshared line\nanother line of {k}" for k in range(10)]
    rows = [(k, t, "en", "src", len(t)) for k, t in enumerate([text] * 20 + shared)]
    cut = stage(spark, "line_dedup", rows, None)
    assert cut[:20] == rows[:20] and [r[1] for r in cut[20:]] == [t.replace("shared line\n", "") for t in shared]
    left = stage(spark, "near_dedup", cut, None)
    assert [r for r in left if r[0] < 20] == rows[:1]


def test_foreign_and_random_texts_go(spark, corpus):
    """The nearest learned language scores high for them too, but they are improbable in it."""
    rng = np.random.default_rng(4)
    clean = [r for r in corpus[0] if r[0] < 120]
    letters = lambda some: " ".join("".join(rng.choice(list(some), int(rng.integers(3, 9)))) for _ in range(80))
    foreign = [
        "中国是世界上历史最悠久的国家之一 各族人民共同创造了光辉灿烂的文化 " * 12,
        "Все люди рождаются свободными и равными в своём достоинстве и правах " * 8,
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw " * 8,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan " * 8,
        letters("bcdfghjklmnpqrstvwxz"), letters("abcdefghijklmnopqrstuvwxyz"),
    ]
    rows = clean + [(1000 + k, t, None, "src", len(t)) for k, t in enumerate(foreign)]
    assert stage(spark, "language", rows, None) == clean
    labelled = [(r[1], r[2]) for r in clean]
    assert sum(brute_bayes(labelled, t)[1] >= 0.5 for t in foreign) >= 4  # the score doesn't see it


def test_clashing_columns_and_no_rows(spark, corpus, tmp_path):
    """Columns that operators make for themselves pass through; an empty table goes through all stages."""
    extra = {c: f"{c}!" for c in ("n_lines", "n_dropped", "row_", "row2_", "hashes_", "text1_", "own1_", "found0_", "kept", "score", "lang_pred", "key", "id", "t")}
    docs = spark.createDataFrame([(*r, *extra.values()) for r in corpus[0][:40]], DOCUMENTS + "".join(f", {c} string" for c in extra))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, corpus[1])
        assert out.columns == docs.columns, name
        assert all({c: r[c] for c in extra} == extra for r in out.collect()), name
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
