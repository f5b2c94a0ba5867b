"""Quality rules: base counts, and divergence from a language's references."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
#: Character classes: lower-case ASCII, upper-case ASCII, digits, white space, sentence marks, symbols, other ASCII, other.
CLASSES = 8
#: A language's reference holds its COMMON most frequent words. Words of more than KEY_BYTES bytes are told apart by a digest.
COMMON, KEY_BYTES = 64, 24
#: Languages whose references are broadcast together (some 5 KB each); more languages take more broadcasts and passes.
BLOCK_LANGUAGES = 1024
#: Distinct words that a task counts before it hands the counts on.
WORDS_AT_ONCE = 300_000
#: Under so many characters or words a histogram isn't judged.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: A text is rejected beyond a Jensen-Shannon distance (square root of base-2 divergence) of limit + noise / sqrt(words):
#: a histogram of few words strays from its own source by about that. (limit, noise) for classes and for words.
CLASS_LIMIT, WORD_LIMIT = (0.20, 1.0), (0.28, 1.5)


def class_table() -> bytes:
    kinds = bytearray([7] * 256)
    for b in range(128):
        c = chr(b)
        if c.islower():
            kinds[b] = 0
        elif c.isupper():
            kinds[b] = 1
        elif c.isdigit():
            kinds[b] = 2
        elif b in SPACE:
            kinds[b] = 3
        elif c in ".,;:!?'\"()-":
            kinds[b] = 4
        elif b in SYMBOLS:
            kinds[b] = 5
        else:
            kinds[b] = 6
    return bytes(kinds)


CLASS_OF = class_table()


def class_counts(text: bytes) -> np.ndarray:
    """By byte; a letter beyond ASCII counts as its bytes in class 7."""
    return np.bincount(np.frombuffer(text.translate(CLASS_OF), np.uint8), minlength=CLASSES)


def word_keys(words: list[bytes]) -> list[bytes]:
    """The words; of a long one a digest, after a byte that no text has."""
    return [w if len(w) <= KEY_BYTES else b"\xff" + xxhash.xxh3_128_digest(w) for w in words]


@dataclass
class References:
    """classes[lang]: shares of the classes. words[lang]: word's key -> share
    of all words, for the common ones."""

    classes: dict[str, np.ndarray]
    words: dict[str, dict[bytes, float]]


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", common: int = COMMON, block_languages: int = BLOCK_LANGUAGES) -> list[Broadcast]:
    """References over all rows with a text and a language: the languages'
    class counts and most frequent words, of any length. Tasks send sums; the
    driver gets `common` words a language, those of `block_languages` at a
    time, and broadcasts them.

    Every label gets references. Rows with a null text or language teach
    nothing, nor do empty texts; repeated rows count as often as they occur.
    Of equally frequent words the first in order of bytes is taken. Texts are
    counted whole, however long. An empty table, or no labels: no references,
    and nothing is judged by distance. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("n", pa.int64())])
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        totals: Counter = Counter()

        def drained():
            for lang, counter in words.items():
                keys = list(counter)
                arrays = [pa.array([lang] * len(keys), pa.string()), pa.array([b"w" + k for k in keys], pa.binary()), pa.array([counter[k] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                body = text.as_py()
                classes[lang] = classes.get(lang, 0) + class_counts(body)
                all_words = body.lower().split()
                totals[lang] += len(all_words)
                words.setdefault(lang, Counter()).update(word_keys(all_words))
            if sum(map(len, words.values())) > WORDS_AT_ONCE:
                yield from drained()
        yield from drained()
        for lang, n in classes.items():
            keys = [b"c%d" % k for k in range(CLASSES)] + [b"t"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array([*n.tolist(), totals[lang]], pa.int64())], schema=schema
            )

    cols = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sums = cols.mapInArrow(rows, "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    sums = written(sums, "quality-counts")
    is_word = F.substring("key", 1, 1) == F.lit(b"w")
    # a partition sends its own `common` best of a language alone
    best = Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "key")
    top = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(common, CLASSES + 1))
    top = written(top.select("lang", "key", "n"), "quality-references")
    languages = sorted(r.lang for r in top.select("lang").distinct().collect())
    blocks = []
    for at in range(0, len(languages), block_languages):
        block = languages[at : at + block_languages]
        found: dict[str, dict[bytes, int]] = {}
        for r in top.where(F.col("lang").between(block[0], block[-1])).collect():
            found.setdefault(r.lang, {})[bytes(r.key)] = r.n
        classes, words = {}, {}
        for lang, keys in found.items():
            n = np.array([keys[b"c%d" % k] for k in range(CLASSES)], np.float64)
            if n.sum():
                classes[lang] = n / n.sum()
                ranked = sorted((k for k in keys if k[:1] == b"w"), key=lambda k: (-keys[k], k))[:common]
                words[lang] = {k[1:]: keys[k] / keys[b"t"] for k in ranked}
        blocks.append(docs.sparkSession.sparkContext.broadcast(References(classes, words)))
    return blocks


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two distributions, 0 to 1."""
    m = (p + q) / 2
    a, b = p > 0, q > 0
    d = (p[a] * np.log2(p[a] / m[a])).sum() / 2 + (q[b] * np.log2(q[b] / m[b])).sum() / 2
    return math.sqrt(max(0.0, float(d)))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    a = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = a[:-1] * len(seen) + a[1:]
    if len(seen) > 2_000_000:  # else the product of three fits 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + a[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.split()
    chars = sum(map(len, words)) - len(text.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, failed


#: (class distance, word distance, whether they are from the text's own language); a distance is null if not judged.
Distances = tuple[float | None, float | None, bool]
UNJUDGED: Distances = (None, None, False)


def divergence(text: bytes, lang: str | None, refs: References, before: Distances = UNJUDGED) -> Distances:
    """Distances from the language's references, or from the nearest ones,
    those before included, if the language is null or has none. Too short
    texts aren't judged."""
    own = lang in refs.classes
    if before[2] or not refs.classes:
        return before
    langs = [lang] if own else list(refs.classes)
    counts, by_class, by_word = class_counts(text).astype(np.float64), [], []
    if counts.sum() >= GUARD_CHARS:
        by_class = [distance(counts / counts.sum(), refs.classes[x]) for x in langs]
    words = text.lower().split()
    if len(words) >= GUARD_WORDS:
        held = Counter(word_keys(words))
        for x in langs:
            shares = refs.words[x]
            p = np.array([held[w] for w in shares], np.float64) / len(words)
            q = np.fromiter(shares.values(), np.float64, len(shares))
            by_word.append(distance(np.append(p, 1 - p.sum()), np.append(q, 1 - q.sum())))
    if not own:
        by_class += [before[0]] * (before[0] is not None)
        by_word += [before[1]] * (before[1] is not None)
    return min(by_class, default=None), min(by_word, default=None), own


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = [*COUNTS, "base_failed", "class_distance", "word_distance", "kept"]
FIELDS = [
    *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()),
    T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType()),
]
ARROW = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]


def within(distance: float | None, limit: tuple[float, float], n_words: int) -> bool:
    return distance is None or distance <= limit[0] + limit[1] / math.sqrt(max(1, n_words))


def judge(
    docs: DataFrame,
    refs: list[Broadcast],
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    only_kept: bool = False,
    class_limit: tuple[float, float] = CLASS_LIMIT,
    word_limit: tuple[float, float] = WORD_LIMIT,
) -> DataFrame:
    """`docs` with the columns VERDICT; or, with `only_kept`, the rows of
    `docs` that are kept.

    A row is kept if it passes the base rule and neither of its histograms is
    farther from its language's reference than allowed; a row without a
    language, or of one without references, is held against the nearest. A
    null text counts as an empty one and fails. Texts are read whole, however
    long. Repeated rows are judged each; a distance that equals its limit is
    within it. Other columns pass through, whatever their names; columns named
    as new ones are replaced. An empty table gives no rows. The references
    (`learn`) are broadcast in blocks; each block but the last is a pass that
    hands on two distances a row.
    """
    if not only_kept:
        docs = docs.drop(*VERDICT)
    at, lang_at, width = docs.columns.index(text_col), docs.columns.index(lang_col), len(docs.columns)
    final = docs.schema if only_kept else T.StructType([*docs.schema.fields, *FIELDS])
    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    handed = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, f"found{k}_"), kind) for k, kind in enumerate(kinds))])

    def verdict(text: bytes, lang: str | None, known: References, before: Distances) -> tuple:
        counts = base(text)
        by_class, by_word, _ = divergence(text, lang, known, before)
        return *counts, by_class, by_word, not counts[-1] and within(by_class, class_limit, counts[0]) and within(by_word, word_limit, counts[0])

    def passed(shared: Broadcast | None, first: bool, last: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value if shared else References({}, {})
            for batch in batches:
                columns = batch.columns[:width]
                texts, langs = columns[at].cast(pa.binary()), columns[lang_at].cast(pa.string()).to_pylist()
                before = [UNJUDGED] * len(batch) if first else list(zip(*(c.to_pylist() for c in batch.columns[width:])))
                cases = ((x.as_py() or b"", lang, known, b) for x, lang, b in zip(texts, langs, before))
                if not last:
                    found = [divergence(*x) for x in cases]
                    arrays = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([*columns, *arrays], names=handed.names)
                elif only_kept:
                    yield pa.RecordBatch.from_arrays(columns, names=final.names).filter(pa.array([verdict(*x)[-1] for x in cases], pa.bool_()))
                else:
                    found = [verdict(*x) for x in cases]
                    new = [pa.array([f[k] for f in found], t) for k, t in enumerate(ARROW)]
                    yield pa.RecordBatch.from_arrays([*columns, *new], names=final.names)

        return rows

    blocks = refs or [None]
    for k, shared in enumerate(blocks):
        last = k == len(blocks) - 1
        docs = docs.mapInArrow(passed(shared, k == 0, last), final if last else handed)
    return docs
