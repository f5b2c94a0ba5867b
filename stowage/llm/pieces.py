"""SentencePiece encoding and decoding of documents of any length.

The model is a byte-pair one: its segmentation isn't the one of the largest
sum of piece scores. It is a path, though: a sequence of pieces is the model's
if each two neighbours, encoded together, stay as they are, and each text has
one such path. With that as the weight of a step (minus infinity if they
don't) the max-plus scan finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Texts of more characters are cut into chunks of so many.
CHUNK = 1 << 15
#: Neighbouring matrices that a task multiplies at once.
FAN_IN = 8
#: Words that a worker remembers with their pieces.
KEPT_WORDS = 100_000
#: Rows whose ids are Python lists at once.
ROWS = 128
#: Pairs of pieces that a worker remembers as fitting or not.
KEPT_PAIRS = 300_000
SPACE, START = "▁", -1
#: The score of a character without a piece, which is spelled in bytes.
UNKNOWN = -1e5

Span = tuple[int, int]


@cache
def processor(path: str):
    """One for each worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def scanner(path: str) -> Scanner:
    return Scanner(processor(path))


class Scanner:
    """The scan's steps over a text in the model's own form (a mark for each
    space, and one before the text)."""

    def __init__(self, sp):
        self.sp = sp
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.single = {p: [sp.piece_to_id(p)] for p in self.scores}
        self.longest = max(map(len, self.scores))
        self.starts = {p[:k] for p in self.scores for k in range(1, len(p))}  # a piece that isn't one has none longer
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}

    def plain_ids(self, text: str) -> list[int]:
        """The ids of a stretch of text, as if nothing stood before it."""
        if text.startswith(SPACE):
            return self.sp.encode(text[1:].replace(SPACE, " "), num_threads=1)
        return self.sp.encode("\n" + text.replace(SPACE, " "), num_threads=1)[2:]  # without the mark and the line break

    def ids(self, piece: str) -> list[int]:
        return self.single.get(piece) or [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]

    def fits(self, a: str, b: str) -> bool:
        """Whether two neighbouring pieces stay as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.plain_ids(a + b) == self.ids(a) + self.ids(b)
            if len(self.pairs) < KEPT_PAIRS:
                self.pairs[a, b] = known
        return known

    def states(self, text: str, at: int) -> Iterator[Span]:
        """The pieces that may hold the character before the boundary `at`."""
        for i in range(max(0, at - self.longest), at):
            for j in range(at, min(i + self.longest, len(text)) + 1):
                if j - i == 1 or text[i:j] in self.scores:
                    yield i, j

    def reach(self, text: str, origins: list[Span], end: int) -> dict[Span, dict[Span, tuple[float, Span]]]:
        """Piece -> origin -> (score, the piece before it), for all pieces
        that a fitting chain from an origin comes to; chains end with the
        piece that holds the character before `end`."""
        found: dict[Span, dict[Span, tuple[float, Span]]] = {o: {o: (0.0, o)} for o in origins}
        by_end: dict[int, list[Span]] = {}
        for o in origins:
            by_end.setdefault(o[1], []).append(o)
        for at in range(min(by_end, default=end), end):
            for node in by_end.get(at, ()):
                before = text[node[0] : node[1]]
                for j in range(at + 1, min(at + self.longest, len(text)) + 1):
                    piece = text[at:j]
                    if j > at + 1 and text[at : j - 1] not in self.starts:
                        break
                    if (j > at + 1 and piece not in self.scores) or (before and not self.fits(before, piece)):
                        continue
                    step = self.scores.get(piece, UNKNOWN)
                    if (at, j) not in found:
                        found[at, j] = {}
                        by_end.setdefault(j, []).append((at, j))
                    for o, (score, _) in found[node].items():
                        if score + step > found[at, j].get(o, (-float("inf"), node))[0]:
                            found[at, j][o] = (score + step, node)
        return found

    def word(self, text: str) -> list[int]:
        """The ids of a stretch between two places where no piece goes on: as
        `reach` and `path` find them, for the one origin that there is."""
        ids = self.words.get(text)
        if ids is None:
            best = max(self.chains(text)[-1], key=lambda c: c[1])
            spelled = []
            while best[2] is not None:
                spelled.append(best[0])
                best = best[2]
            ids = [i for piece in reversed(spelled) for i in self.ids(piece)]
            if len(self.words) < KEPT_WORDS and len(text) < 100:
                self.words[text] = ids
        return ids

    def chains(self, text: str) -> list[list[tuple]]:
        """For each place in the text the chains (piece, score, the chain
        before it) of fitting pieces that come to it."""
        scores, starts, fits = self.scores, self.starts, self.fits
        ends: list[list[tuple]] = [[] for _ in range(len(text) + 1)]
        ends[0].append(("", 0.0, None))
        for at, chains in enumerate(ends):
            if not chains:
                continue
            for j in range(at + 1, len(text) + 1):
                piece = text[at:j]
                step = scores.get(piece)
                if step is None and j == at + 1:
                    step = UNKNOWN
                if step is not None:
                    best = None
                    for c in chains:
                        if (best is None or c[1] > best[1]) and (at == 0 or fits(c[0], piece)):
                            best = c
                    if best is not None:
                        ends[j].append((piece, best[1] + step, best))
                if piece not in starts:
                    break
        return ends

    def path(self, found: dict, origin: Span, last: Span) -> list[Span]:
        """The pieces after `origin`, up to `last`."""
        out = []
        while last != origin:
            out.append(last)
            last = found[last][origin][1]
        return out[::-1]


class Chunk:
    """A chunk [at, end) of a text, with `longest` characters around it.

    Where a space follows another character, no piece goes on and any two fit:
    there is one state. Between the chunk's first and last such place each
    word is scanned on its own, whatever the states at the chunk's ends, and
    the chunk's matrix is the outer sum of what comes before and behind.
    """

    def __init__(self, scan: Scanner, text: str, at: int, end: int, first: bool, last: bool):
        self.scan, self.text, self.at, self.end, self.first, self.last = scan, text, at, end, first, last
        self.places = [i for i in range(at + 1, end) if text[i] == SPACE and text[i - 1] != SPACE]
        self.a, self.b = (self.places[0], self.places[-1]) if self.places else (None, None)

    def name(self, span: Span, boundary: int) -> int:
        return (boundary - span[0]) * 256 + span[1] - boundary

    def span(self, name: int, boundary: int) -> Span:
        return boundary - name // 256, boundary + name % 256

    def entries(self) -> list[Span]:
        return [(self.at, self.at)] if self.first else list(self.scan.states(self.text, self.at))

    def exits(self, found: dict) -> list[Span]:
        return [s for s in found if s[0] < self.end <= s[1] and (s[1] == self.end or not self.last)]

    def matrix(self) -> list[tuple[int, int, float]]:
        """(entry, exit, weight) of the finite cells."""
        entry = lambda s: START if self.first else self.name(s, self.at)
        if self.a is None:
            found = self.scan.reach(self.text, self.entries(), self.end)
            return [(entry(o), self.name(t, self.end), w) for t in self.exits(found) for o, (w, _) in found[t].items()]
        head = self.scan.reach(self.text, self.entries(), self.a)
        into: dict[Span, float] = {}
        for t in head:
            if t[1] == self.a:
                for o, (w, _) in head[t].items():
                    into[o] = max(w, into.get(o, w))
        tail = self.scan.reach(self.text, [(self.b, self.b)], self.end)
        return [(entry(o), self.name(t, self.end), w + tail[t][self.b, self.b][0]) for o, w in into.items() for t in self.exits(tail)]

    def ids(self, entry: int, exit_: int) -> list[int]:
        """The ids of the pieces that start in the chunk."""
        origin, last = (self.at, self.at) if self.first else self.span(entry, self.at), self.span(exit_, self.end)
        spelled = lambda spans: [i for s in spans for i in self.scan.ids(self.text[s[0] : s[1]])]
        if self.a is None:
            return spelled(self.scan.path(self.scan.reach(self.text, [origin], self.end), origin, last))
        head = self.scan.reach(self.text, [origin], self.a)
        ends = [t for t in head if t[1] == self.a]
        best = max(ends, key=lambda t: head[t][origin][0])
        tail, start = self.scan.reach(self.text, [(self.b, self.b)], self.end), (self.b, self.b)
        middle = [i for x, y in zip(self.places, self.places[1:]) for i in self.scan.word(self.text[x:y])]
        return spelled(self.scan.path(head, origin, best)) + middle + spelled(self.scan.path(tail, start, last))


Matrix = list[tuple[int, int, float]]


def product(left: Matrix, right: Matrix) -> Matrix:
    """The max-plus product, which is associative: (entry of the left, exit of
    the right, weight of the best way between)."""
    rows: dict[int, list[tuple[int, float]]] = {}
    for s, t, w in right:
        rows.setdefault(s, []).append((t, w))
    best: dict[tuple[int, int], float] = {}
    for s, m, w in left:
        for t, v in rows.get(m, ()):
            if w + v > best.get((s, t), -float("inf")):
                best[s, t] = w + v
    return [(s, t, w) for (s, t), w in best.items()]


def between(matrices: list[Matrix], entry: int, exit_: int) -> list[int]:
    """The states at the boundaries of neighbouring matrices on the best way
    from `entry` to `exit_`, these two included."""
    best, back = {entry: 0.0}, []
    for m in matrices:
        step: dict[int, tuple[float, int]] = {}
        for s, t, w in m:
            if s in best and best[s] + w > step.get(t, (-float("inf"), s))[0]:
                step[t] = (best[s] + w, s)
        best = {t: w for t, (w, _) in step.items()}
        back.append({t: s for t, (_, s) in step.items()})
    out = [exit_]
    for pointers in reversed(back):
        out.append(pointers[out[-1]])
    return out[::-1]


PARTS = "rid long, doc_id long, k long, first boolean, last boolean, at int, end int, part string"


def chunk_rows(giants: DataFrame, model: str, size: int) -> DataFrame:
    """The chunks of long texts, with what they need of their neighbours."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = scanner(model).longest
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                form = SPACE + text.replace(" ", SPACE)
                starts = list(range(0, len(form), size))
                for at in range(0, len(starts), 64):
                    out = []
                    for k in range(at, min(at + 64, len(starts))):
                        p, q = starts[k], min(starts[k] + size, len(form))
                        low = max(0, p - longest)
                        out.append((rid, doc_id, k, k == 0, q == len(form), p - low, q - low, form[low : q + longest]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    cut = giants.mapInArrow(rows, PARTS)
    return written(cut.repartition(int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid", "k"), "chunks")


MATRICES = "rid long, k long, s array<int>, t array<int>, w array<double>"
CELLS = ((0, pa.int32()), (1, pa.int32()), (2, pa.float64()))


def matrix_rows(rids: list[int], ks: list[int], matrices: list[Matrix]) -> pa.RecordBatch:
    cells = [pa.array([[c[n] for c in m] for m in matrices], pa.list_(t)) for n, t in CELLS]
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ks, pa.int64()), *cells], names=["rid", "k", "s", "t", "w"])


def matrix_of(row: dict) -> Matrix:
    return list(zip(row["s"], row["t"], row["w"]))


def in_groups(matrices: DataFrame, fan_in: int) -> DataFrame:
    """(rid, p, group): neighbouring matrices, `fan_in` at most, in order."""
    return matrices.groupBy("rid", F.expr(f"k div {fan_in}").alias("p")).agg(F.array_sort(F.collect_list(F.struct("k", "s", "t", "w"))).alias("group"))


def combined(matrices: DataFrame, fan_in: int) -> DataFrame:
    """The level above: the product of each group of neighbours."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ps, groups = (c.to_pylist() for c in batch.columns)
            yield matrix_rows(rids, ps, [reduce(product, map(matrix_of, g)) for g in groups])

    return written(in_groups(matrices, fan_in).mapInArrow(rows, MATRICES), "matrices")


def boundary_states(matrices: DataFrame, n_chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """(rid, k, s, t): the states before and after each chunk on its text's
    best path, from the chunks' `matrices`, `n_chunks` of a text at most.

    Matrices are combined group by group, level by level, to one a text; its
    best exit is chosen, and each level hands the states at a group's ends
    down to the level below. No task holds more than a group.
    """
    levels = [matrices]
    while n_chunks > 1:
        levels.append(combined(levels[-1], fan_in))
        n_chunks = -(-n_chunks // fan_in)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ways = [c for c in matrix_of(r) if c[0] == START]
                if not ways:
                    raise ValueError("the model has no path of fitting pieces through a text")
                out.append((r["rid"], r["k"], START, max(ways, key=lambda c: (c[2], -c[1]))[1]))
            yield state_rows(out)

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, group, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                states = between(list(map(matrix_of, group)), s, t)
                out += [(rid, m["k"], a, b) for m, a, b in zip(group, states, states[1:])]
            yield state_rows(out)

    schema = "rid long, k long, s int, t int"
    states = levels[-1].mapInArrow(chosen, schema)
    for below in reversed(levels[:-1]):
        above = written(states, "states").withColumnRenamed("k", "p")
        states = in_groups(below, fan_in).join(above, ["rid", "p"]).select("rid", "group", "s", "t").mapInArrow(handed, schema)
    return written(states, "states")


def state_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=["rid", "k", "s", "t"])


def encode_long(giants: DataFrame, model: str, size: int, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, ids) of long texts (rid, doc_id, text): a matrix for each
    chunk, the states at their boundaries, each chunk's ids from these."""
    parts = chunk_rows(giants, model, size)
    fields = ["first", "last", "at", "end", "part"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(model)
        for batch in batches:
            rid, k, first, last, at, end, part = (c.to_pylist() for c in batch.columns)
            yield matrix_rows(rid, k, [Chunk(scan, *x).matrix() for x in zip(part, at, end, first, last)])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(model)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                cols = [c.to_pylist() for c in some.columns[3:]]
                found = [Chunk(scan, part, a, end, first, last).ids(s, t) for first, last, a, end, part, s, t in zip(*cols)]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["rid", "doc_id", "k", "ids"])

    matrices = written(parts.select("rid", "k", *fields).mapInArrow(weigh, MATRICES), "matrices")
    most = parts.agg(F.max("k")).first()[0]
    states = boundary_states(matrices, (most or 0) + 1, fan_in)
    joined = parts.join(states, ["rid", "k"]).select("rid", "doc_id", "k", *fields, "s", "t")
    spelled = joined.mapInArrow(spell, "rid long, doc_id long, k long, ids array<int>")
    whole = spelled.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("c"))
    return whole.select("doc_id", F.flatten(F.transform("c", lambda x: x["ids"])).alias("ids"))


def encode_short(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of (doc_id, text), each text at once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = [sp.encode(text, num_threads=1) if text else [] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.mapInArrow(rows, "doc_id long, ids array<int>")


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids): array of the whole text's ids.

    Texts of up to `chunk` characters are encoded at once. Longer ones are cut
    into chunks that are dealt to all tasks: each gives the matrix of its
    boundary states, the matrices of a text are combined level by level, and
    each chunk is spelled from the states at its ends. Ways of equal weight
    don't occur, as a text has one path of fitting pieces.

    A null or empty text has no ids. Rows with equal or null ids, or repeated,
    are documents of their own. An empty table gives no rows. Other columns
    are not read.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    giants = written(cols.where(long).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "long-texts")
    return encode_short(cols.where(~long), model).union(encode_long(giants, model, chunk))


class Spelling:
    """Ids -> text, by a table of the bytes of each piece."""

    def __init__(self, sp):
        self.sp = sp
        n = sp.get_piece_size()
        self.special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        self.bytes = np.empty(n, object)
        self.bytes[:] = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]

    def text(self, ids: np.ndarray) -> str:
        if len(ids) and not self.special[ids].any():
            try:
                return b"".join(self.bytes[ids].tolist()).decode().removeprefix(" ")  # the space that encoding puts first
            except UnicodeDecodeError:  # bytes that are no character
                pass
        return self.sp.decode(ids.tolist())


@cache
def spelling(path: str) -> Spelling:
    return Spelling(processor(path))


def with_decoded(encoded: DataFrame, model: str, *, ids_col: str = "ids") -> DataFrame:
    """`encoded` and the text of each row's ids; no ids or null: empty. Other
    columns pass through; one named text is replaced."""
    encoded = encoded.drop("text")
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])
    at = encoded.columns.index(ids_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = spelling(model)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                texts = [spell.text(x.values.to_numpy()) if x.is_valid else "" for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(rows, schema)
