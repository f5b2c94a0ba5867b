"""Hierarchical packing of token ids into windows of several lengths."""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOWS = (256, 512, 1024, 2048)

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("window", T.LongType()),
        T.StructField("step_group", T.LongType()),
    ]
)
ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECES])

#: Distinct words and letter runs that a worker keeps; later ones are encoded anew each time.
KEPT_WORDS, KEPT_RUNS = 200_000, 450_000


# The normaliser, the pattern and the rest of the pre-tokenizer of a vocabulary whose texts can be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordIds(dict):
    """Word (UTF-8, without ASCII white space) -> its ids as uint32 bytes.

    A tokenizer with the normaliser and the pattern above drops white space
    and never merges across it, so a text's ids are its words' ids one after
    the other. Words of ASCII or Latin-1 letters are split into runs by the
    pattern and go to the BPE model directly; any other, and words that hold
    the string of an added token, go through the whole tokenizer. So does the
    whole text if the vocabulary is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        known = json.loads(self.tokenizer.to_str())
        added = known["added_tokens"]
        split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        self.by_word = (
            known["normalizer"] == NORMALIZER and known["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, BYTE_LEVEL]}
            and known["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in added)
        )
        self.added = [t["content"] for t in added]
        self.pattern = regex.compile(PATTERN)
        self.plain = regex.compile(r"[!-~¡-ÿ]+")
        shown = {b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}
        hidden = iter(range(256, 512))
        self.letters = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
        self.runs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def run(self, piece: str) -> bytes:
        ids = self.runs.get(piece)
        if ids is None:
            word = "".join([self.letters[b] for b in piece.encode()])
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])
            if len(self.runs) < KEPT_RUNS:
                self.runs[piece] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain.fullmatch(text) and not any(t in text for t in self.added):
            ids = b"".join(map(self.run, self.pattern.findall(text.lower())))
        else:
            ids = self.whole(text)
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if self.by_word else self.whole(text.decode())


@cache
def word_ids(path: str) -> WordIds:
    """One for each worker, kept from task to task."""
    return WordIds(path)


class Packer:
    """Packs one task's documents; holds at most `pool` rests of documents.

    A document's full longest windows go out alone. Its rest is routed to the
    shortest tier that holds it. Each tier, longest first, opens a window for
    each of its pieces; gaps are filled best fit from shorter tiers, and the
    last gap by cutting a piece, so that windows are exactly full. Only the
    last window of a task may not be.
    """

    def __init__(self, windows, step_tokens: int, pool: int, first: int):
        self.windows, self.step_tokens, self.pool = tuple(sorted(windows)), step_tokens, pool
        self.tiers = {w: [] for w in self.windows}  # sorted by length
        self.held, self.n = 0, 0
        self.next_sequence = self.next_group = first
        self.groups: dict[int, list[int]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, top = len(ids) // 4, self.windows[-1]
        whole = n - n % top
        for s in range(0, whole, top):
            self.close([(top, s, doc_id, ids[4 * s : 4 * (s + top)], n)], top)
        if n > whole:
            self.put((n - whole, whole, doc_id, ids[4 * whole :], n))
        if self.held >= self.pool:
            self.pack(False)

    def put(self, piece: tuple) -> None:
        self.n += 1
        insort(self.tiers[next(w for w in self.windows if piece[0] <= w)], (piece[0], self.n, piece))
        self.held += 1

    def take(self, tier: int, at: int) -> tuple:
        self.held -= 1
        return self.tiers[tier].pop(at)[2]

    def close(self, pieces: list[tuple], window: int) -> None:
        group = self.groups.get(window)
        if group is None or group[1] >= self.step_tokens // window:
            group = self.groups[window] = [self.next_group, 0]
            self.next_group += 1
        group[1] += 1
        at = 0
        for n, start, doc_id, ids, total in pieces:
            self.rows.append((doc_id, start, n, ids, total, self.next_sequence, at, window, group[0]))
            at += n
        self.next_sequence += 1

    def filler(self, gap: int, below: int) -> tuple | None:
        """The longest piece of a shorter tier that fits; else one to cut."""
        for w in reversed(self.windows):
            if w < below and self.tiers[w] and (at := bisect_right(self.tiers[w], (gap, float("inf"))) - 1) >= 0:
                return self.take(w, at)
        w = next((w for w in self.windows if self.tiers[w]), None)
        if w is None:
            return None
        n, start, doc_id, ids, total = self.take(w, len(self.tiers[w]) - 1)
        if n > gap:
            self.put((n - gap, start + gap, doc_id, ids[4 * gap :], total))
            n, ids = gap, ids[: 4 * gap]
        return n, start, doc_id, ids, total

    def pack(self, last: bool) -> None:
        for w in reversed(self.windows):
            while self.tiers[w]:
                pieces, gap = [self.take(w, len(self.tiers[w]) - 1)], w
                gap -= pieces[0][0]
                while gap and (piece := self.filler(gap, w)):
                    pieces.append(piece)
                    gap -= piece[0]
                if not gap:
                    self.close(pieces, w)
                    continue
                if last:
                    self.rest(pieces)
                else:
                    for p in pieces:
                        self.put(p)
                return

    def rest(self, pieces: list[tuple]) -> None:
        """What is too little for the open window: full shorter ones, then one that isn't full."""
        left = sum(p[0] for p in pieces)
        for w in [*(w for w in reversed(self.windows)), 0]:
            if w == 0 and left:
                self.close(pieces, self.windows[-1])
            while w and left >= w:
                row, gap = [], w
                while gap:
                    n, start, doc_id, ids, total = pieces.pop(0)
                    if n > gap:
                        pieces.insert(0, (n - gap, start + gap, doc_id, ids[4 * gap :], total))
                        n, ids = gap, ids[: 4 * gap]
                    row.append((n, start, doc_id, ids, total))
                    gap -= n
                self.close(row, w)
                left -= w

    def out(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), ARROW)], schema=ARROW)
            self.rows = []


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    windows=WINDOWS,
    step_tokens: int = 16 * WINDOWS[-1],
    pool: int = 2048,
) -> DataFrame:
    """Packs all documents into windows of `windows` tokens.

    Returns a row for each piece: doc_id, start (tokens of its document before
    it), length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id,
    offset (in the sequence), window (the sequence's length class), step_group
    (sequences of one window that are trained in one step; full groups hold
    `step_tokens` tokens each, so that steps cost the same).

    Each task packs what it reads: no shuffle, and at most `pool` document
    rests in memory. A task's last sequence may be short of its window; all
    others are exactly full. Repeating a task gives the same rows.

    A null or empty text has `end_id` alone. A text is encoded whole, however
    long, as the tokenizer by itself does without special tokens added: strings
    of its added tokens in a text become these. Rows with equal or null ids,
    or repeated, are documents of their own; pieces of equal length are taken
    in the order in which they came. An empty table gives no rows. Other
    columns of `docs` are not read.
    """

    def rows(batches):
        words, end = word_ids(vocabulary), end_id.to_bytes(4, "little")
        packer = Packer(windows, step_tokens, pool, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                packer.add(doc_id, words.ids(text.as_py() or b"") + end)
                yield from packer.out(500)
            pa.default_memory_pool().release_unused()
        packer.pack(True)
        yield from packer.out(1)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, PIECES)
