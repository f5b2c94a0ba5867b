"""Language identification: multinomial naive Bayes over hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

#: Hashed n-grams of 1 to ORDERS characters fall into 2 ** BUCKET_BITS buckets.
ORDERS, BUCKET_BITS = 3, 13
#: Languages of one broadcast matrix (16 MB at most) and of one pass over the texts; more languages take more of both.
BLOCK_LANGUAGES = 256
#: The score of a long text is that of one of so many n-grams, so that it doesn't saturate.
EVIDENCE = 60.0
#: Characters that are hashed at once.
CHARS_AT_ONCE = 1 << 19
UNDETERMINED = "und"
#: A text is in no learned language if its log-probability per n-gram is so many spreads under the mean of its nearest
#: language's own documents. A spread counts as LEAST_SPREAD at least: few documents may be alike by chance.
SPREADS, LEAST_SPREAD = 12.0, 0.1


@dataclass
class Block:
    """languages, sorted; their log-probabilities, (language, bucket); and, if
    learned, the least log-probability per n-gram of a text in each."""

    languages: list[str]
    log_probabilities: np.ndarray
    floors: np.ndarray | None = None


@dataclass
class Model:
    """Broadcast blocks of languages, in order of name."""

    blocks: list[Broadcast]

    @property
    def languages(self) -> list[str]:
        return [x for b in self.blocks for x in b.value.languages]


@cache
def folded() -> np.ndarray:
    """Code point -> its lower-case letter's code point, or a space's."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets(text: str) -> Iterator[np.ndarray]:
    """The text's n-gram buckets, stretch by stretch. Runs of other than
    letters count as a space each."""
    table, mask = folded(), np.uint32((1 << BUCKET_BITS) - 1)
    for at in range(0, len(text), CHARS_AT_ONCE):
        piece = " " * (at == 0) + text[max(0, at - ORDERS + 1) : at + CHARS_AT_ONCE]
        c = table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        skip = 0 if at == 0 else ORDERS - 1  # already counted as ends of n-grams
        h = c.copy()
        for n in range(1, ORDERS + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :]
            mixed = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            yield (mixed & mask)[max(0, skip - n + 1) :]


def counted(text: str) -> np.ndarray:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in buckets(text):
        total += np.bincount(b, minlength=len(total))
    return total


def train(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", block_languages: int = BLOCK_LANGUAGES, smoothing: float = 0.5, floors: bool = False
) -> Model:
    """Counts n-grams in all rows with a text and a language; each task sends
    its sums alone, and the driver gets languages x buckets numbers, those of
    `block_languages` at a time, and broadcasts them. With `floors` the rows
    are read again to learn how probable texts of each language are.

    Every label is learned. Rows with a null text or language, or an empty
    text, teach nothing; repeated rows count as often as they occur.
    Texts are counted whole, however long. An empty table, or no labels: no
    languages, and every prediction is `und`. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                for b in buckets(text):
                    total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                    total += np.bincount(b, minlength=len(total))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    cols = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sums = cols.mapInArrow(rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = written(sums, "language-counts")
    languages = sorted(r.lang for r in sums.select("lang").distinct().collect())
    blocks = []
    for k in range(0, len(languages), block_languages):
        block = languages[k : k + block_languages]
        found = sums.where(F.col("lang").between(block[0], block[-1])).toPandas()
        table = np.full((len(block), 1 << BUCKET_BITS), smoothing)
        at = {lang: k for k, lang in enumerate(block)}
        table[[at[x] for x in found["lang"]], found["bucket"]] += found["n"].to_numpy()
        own = learn_floors(cols, block, table) if floors else None
        blocks.append(docs.sparkSession.sparkContext.broadcast(Block(block, np.log(table) - np.log(table.sum(1, keepdims=True)), own)))
    return Model(blocks)


def own_log_probability(counts: np.ndarray, table: np.ndarray) -> float:
    """Per n-gram, in a language whose `table` has the text's counts in it:
    they are taken out first, so that the text doesn't vouch for itself."""
    at = np.flatnonzero(counts)
    n = counts[at].sum()
    return float((np.log(table[at] - counts[at]) @ counts[at]) / n - np.log(table.sum() - n))


def learn_floors(cols: DataFrame, languages: list[str], table: np.ndarray) -> np.ndarray:
    """Mean less SPREADS spreads of the log-probabilities of each language's
    own rows. cols: (text, lang), no nulls. Sums are of whole thousandths, so
    that their order doesn't matter."""
    shared = cols.sparkSession.sparkContext.broadcast(table)
    at = {lang: k for k, lang in enumerate(languages)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at), 3), np.int64)
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in at and has_letter(text):
                    x = round(1000 * own_log_probability(counted(text), shared.value[at[lang]]))
                    sums[at[lang]] += (1, x, x * x)
        k = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(sums[k, c]) for c in range(3))], names=["k", "n", "x", "xx"])

    floors = np.full(len(at), -np.inf)
    found = cols.mapInArrow(rows, "k long, n long, x long, xx long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    for r in found.collect():
        spread = math.sqrt(max(0, r.n * r.xx - r.x * r.x)) / r.n / 1000
        floors[r.k] = r.x / r.n / 1000 - SPREADS * max(spread, LEAST_SPREAD)
    return floors


#: What is known of a text after some blocks: its language so far, that one's log-probability, the sum of all languages'
#: probabilities relative to it, and whether it isn't under that language's floor.
Found = tuple[str, float, float, bool]
NOTHING: Found = (UNDETERMINED, -math.inf, 0.0, False)


def placed(text: str | None, block: Block, before: Found = NOTHING) -> Found:
    """The text's best language among `block` and those before it. Equal
    priors; the earlier name wins a tie. A text without a letter has none."""
    if not block.languages or not has_letter(text):
        return before
    counts = counted(text)
    at = np.flatnonzero(counts)  # a text's n-grams are few: a sparse product
    log, n = block.log_probabilities[:, at] @ counts[at], counts[at].sum()
    best = int(log.argmax())
    name, top, fits = block.languages[best], float(log[best]), block.floors is None or bool(log[best] / n >= block.floors[best])
    if top <= before[1]:
        name, top, fits = before[0], before[1], before[3]
    evidence = min(1.0, EVIDENCE / n)
    return name, top, float(np.exp((log - top) * evidence).sum()) + before[2] * math.exp((before[1] - top) * evidence), fits


def probability(found: Found) -> float:
    return 1 / found[2] if found[2] else 0.0


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: float | None = None) -> DataFrame:
    """`docs` with lang_pred and score; or, with `keep`, `docs` without rows
    whose language is undetermined, whose score is under `keep`, or whose
    text is too improbable in its nearest language if the model has floors.
    (The score alone says which learned language is nearest, not whether the
    text is in one of them.)

    Null and empty texts, and texts without a letter, are `und`, score 0. Of
    languages that are equally probable the earlier name is taken. Only the
    text is looked at, whole, however long; other columns and repeated rows
    pass through, whatever their names; columns named as the two new ones are
    replaced. An empty table gives no rows. The model's blocks (256 x 8192
    numbers, 16 MB, at most) are broadcast; each is a pass over the texts, and
    hands on four numbers a row.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if keep is None:
        docs = docs.drop("lang_pred", "score")
    at, width = docs.columns.index(text_col), len(docs.columns)
    final = docs.schema if keep is not None else T.StructType([*docs.schema.fields, *new])
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    handed = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, f"found{k}_"), kind) for k, kind in enumerate(kinds))])

    def passed(shared: Broadcast | None, first: bool, last: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value if shared else Block([], np.zeros((0, 1)))
            for batch in batches:
                columns = batch.columns[:width]
                before = [NOTHING] * len(batch) if first else list(zip(*(c.to_pylist() for c in batch.columns[width:])))
                found = [placed(x.as_py(), block, b) for x, b in zip(columns[at], before)]
                if not last:
                    arrays = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([*columns, *arrays], names=handed.names)
                elif keep is None:
                    arrays = [pa.array([f[0] for f in found], pa.string()), pa.array(list(map(probability, found)), pa.float64())]
                    yield pa.RecordBatch.from_arrays([*columns, *arrays], names=final.names)
                else:
                    kept = pa.RecordBatch.from_arrays(columns, names=final.names)
                    yield kept.filter(pa.array([f[0] != UNDETERMINED and probability(f) >= keep and f[3] for f in found], pa.bool_()))

        return rows

    blocks = model.blocks or [None]
    for k, shared in enumerate(blocks):
        last = k == len(blocks) - 1
        docs = docs.mapInArrow(passed(shared, k == 0, last), final if last else handed)
    return docs
