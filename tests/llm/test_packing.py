import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowage.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_every_id_lies_in_one_piece(docs, texts):
    rows = packing.pack(docs.repartition(3), PATH, pool=20).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, pieces in by_doc.items():
        want = whole(texts[k])
        pieces.sort(key=lambda r: r.start)
        got, at = [], 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(want) and r.length * 4 == len(r.ids) > 0
            at += r.length
            got += np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert got == want, texts[k]
    sizes = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert len({(r.window, r.step_group) for r in pieces}) == 1 and at <= pieces[0].window <= 2048
        sizes.append(at)
    short = [n for n in sizes if n not in packing.WINDOWS]
    assert len(short) <= 3  # one a task


def test_step_groups_hold_one_window_and_equal_tokens(docs):
    packed = packing.pack(docs.coalesce(1), PATH, step_tokens=4096)
    groups = packed.groupBy("step_group").agg(F.countDistinct("window").alias("w"), F.sum("length").alias("n")).collect()
    assert all(g.w == 1 and g.n <= 4096 for g in groups) and sum(g.n == 4096 for g in groups) >= 3


def test_repeats_and_empty(spark, docs, no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    key = lambda df: sorted(tuple(r) for r in packing.pack(df, PATH).drop("ids").collect())
    assert key(docs) == key(docs)
    odd = spark.createDataFrame([(None, None, "x"), (3, "a b", "y"), (3, "a b", "y")], "doc_id long, text string, sequence_id string")
    rows = packing.pack(odd.coalesce(1), PATH).select("doc_id", "doc_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows)[0] == (0, 1) and len({r.sequence_id for r in packing.pack(odd.coalesce(1), PATH).collect()}) == 1
    assert {r.c for r in rows if r.doc_id is None} == {zlib.crc32(b"\1\0\0\0")}


def test_ids_are_the_plain_tokenizers(spark):
    """Strings of added tokens, alone and within words; another vocabulary is encoded text by text."""
    odd = ["<|endoftext|> a", "x<|endoftext|>y", "<|ENDOFTEXT|> b", "a <|startoftext|><|endoftext|>", "ünïcode<|endoftext|>é", "<|endoftext |>", "Iİ ß\u00a0x don't 12"]
    words = packing.word_ids(PATH)
    assert words.by_word and np.frombuffer(words.ids(b"<|endoftext|> a"), "<u4").tolist() == [49407, 320]
    other = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in odd:
        assert np.frombuffer(words.ids(t.encode()), "<u4").tolist() + [1] == whole(t)
        assert np.frombuffer(other.ids(t.encode()), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), PATH).collect()
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == whole(odd[r.doc_id]) for r in rows)
