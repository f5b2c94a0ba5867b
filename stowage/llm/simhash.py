"""SimHash fingerprints and near-duplicate components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import connected_components, free_name, written
from .shingles import shingle_hashes

#: Rows of one bucket that are compared in one task; fuller buckets are cut into chunks and compared chunk by chunk.
BUCKET_ROWS = 2048
#: Sets of one candidate group that are compared in one task, likewise.
GROUP_ROWS = 512
#: Reference fingerprints of the distance table.
PIVOTS = 32
#: Shingles whose bits are in memory at once.
BITS_AT_ONCE = 100_000
#: Words of 64 bits of the fingerprints of sets, and how far two may be apart for their sets to be compared.
SET_WORDS, SET_BITS = 4, 72


def streams(hashes: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The hashes, and `words` - 1 further ones that are mixed from them."""
    yield hashes
    for k in range(1, words):
        h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        yield h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        bits = np.unpackbits(hashes[at : at + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # as many as a byte counts
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(hashes: np.ndarray, words: int) -> list[int]:
    """Of no hashes: zero."""
    return [majority(x) for x in streams(hashes, words)] if len(hashes) else [0] * words


def fingerprint_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(shingle_hashes(text.as_py() or b"", width), 1)[0] for text in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "f0"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, f0); f0: the fingerprint of 64 bits. A-Z lower-cased, ASCII
    white space between words, `width`-word shingles with repeats, XXH64 of
    seed 42; a bit is 1 if set in over half the hashes. Fewer words: the whole
    sequence is the one shingle. No words, empty or null: 0."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(lambda batches: fingerprint_rows(batches, width), "doc_id long, f0 long")


def columns_of(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def row_hashes(id_col: str, text_col: str) -> list:
    """Two hashes, 128 bits, that name a row by its id and text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, F.length(text), doc_id)]


def pivots(n: int, words: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, (n, words), np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def with_table(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """`rows` (id, ..., f0, ...) and `t`: the distances to the references, a
    byte each. (255 stands for more: that never makes two coordinates differ
    by more than they do.)"""
    names = [*rows.columns, "t"]
    at = [rows.columns.index(c) for c in columns_of(references.shape[1])]

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in at], 1).view(np.uint64)
            table = np.stack([np.minimum(distances(fps, r), 255).astype(np.uint8) for r in references], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.tobytes() for t in table], pa.binary())], names=names)

    return rows.mapInArrow(tabled, ", ".join(f"{c} {kind}" for c, kind in [*rows.dtypes, ("t", "binary")]))


def blocks(bits: int) -> list[tuple[int, int, int, int]]:
    """(shift, width) of an outer block, then of an inner one in the 64 bits
    without it. Two values that differ in at most `bits` bits agree in one of
    bits + 1 outer blocks, and in the other bits in one of bits + 1 inner
    blocks: in both at once for one of the pairs."""
    k, out = bits + 1, []
    cuts = [64 * i // k for i in range(k + 1)]
    for a, b in zip(cuts, cuts[1:]):
        rest = 64 - (b - a)
        inner = [rest * i // k for i in range(k + 1)]
        out += [(a, b - a, c, d - c) for c, d in zip(inner, inner[1:])]
    return out


def bucket_keys(fp, bits: int):
    """One key for each pair of blocks; what a block says is the tuple of the
    fingerprint's distances to references that differ in the block alone."""
    keys = []
    for n, (a, w, c, v) in enumerate(blocks(bits)):
        outer = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1))
        low = fp.bitwiseAND(F.lit((1 << a) - 1)) if a else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, a + w), a) if a + w < 64 else F.lit(0).cast("long")
        inner = F.shiftrightunsigned(low.bitwiseOR(high), c).bitwiseAND(F.lit((1 << v) - 1))
        keys.append(F.shiftleft(F.shiftleft(outer, v).bitwiseOR(inner), 6).bitwiseOR(F.lit(n).cast("long")))
    return F.array(*keys)


class Linker:
    """Finds links among rows (key, a, b, id, n, t, f0, ...) that are sorted
    by cell (key, a, b), a whole cell at a time.

    t: the distance table's row. n: a size; two rows aren't linked if one is
    less than `ratio` of the other.
    """

    def __init__(self, bits: int, words: int, ratio: float = 0.0):
        self.bits, self.words, self.ratio = bits, words, ratio

    def near(self, i: np.ndarray, d: int, n: np.ndarray, fps: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Those of `i` whose row is linked with the one `d` further on."""
        if self.ratio:
            i = i[np.minimum(n[i], n[i + d]) >= self.ratio * np.maximum(n[i], n[i + d]) - 1e-6]
        for k in range(0, table.shape[1], 8):  # a coordinate that differs by more than `bits` rules the pair out
            i = i[(np.abs(table[i, k : k + 8] - table[i + d, k : k + 8]) <= self.bits).all(1)]
        return i[distances(fps[i], fps[i + d]) <= self.bits]

    def links(self, cells: np.ndarray, ids: np.ndarray, n: np.ndarray, fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning set of the links: pairs that are already joined by
        others aren't verified again. cells: (rows, 3), sorted."""
        rows, d = len(fps), 1
        same = np.flatnonzero((cells[1:] == cells[:-1]).all(1))
        if not len(same):
            return ids[:0], ids[:0]
        run = np.concatenate(([0], np.cumsum((cells[1:] != cells[:-1]).any(1))))
        parent, left, right = np.arange(rows), [], []
        while len(same):
            i = same[parent[same] != parent[same + d]]
            i = self.near(i, d, n, fps, table)
            if len(i):
                left.append(ids[i])
                right.append(ids[i + d])
                while True:
                    a, b = parent[i], parent[i + d]
                    open_ = a != b
                    if not open_.any():
                        break
                    np.minimum.at(parent, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
                    while (parent[parent] != parent).any():
                        parent = parent[parent]
            d += 1
            same = same[same + d < rows]
            same = same[run[same] == run[same + d]]
        return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tables = np.zeros((0, 5 + self.words), np.int64), np.zeros((0, 0), np.int16)

        def found(x, table):
            u, v = self.links(x[:, :3], x[:, 3], x[:, 4], np.ascontiguousarray(x[:, 5:]).view(np.uint64), table)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            table = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(batch), -1).astype(np.int16)
            tables = np.concatenate((tables, table)) if len(held) else table
            longs = [c.to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns) if k != 5]
            held = np.concatenate((held, np.stack(longs, 1)))
            if (held[0, :3] != held[-1, :3]).any():  # the last cell may go on in the next batch
                done = int(np.flatnonzero((held[:, :3] != held[-1, :3]).any(1))[-1]) + 1
                yield found(held[:done], tables[:done])
                held, tables = held[done:], tables[done:]
        yield found(held, tables)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The distinct rows of `keyed` (key, id) whose key another id has too, as
    a written table. Of keys with the very same ids one is left: it says all
    that they do (told apart by 128 bits, the number and the least of ids)."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select("key", "id").repartition(n, "key").sortWithinPartitions("key", "id")
    shared = written(dealt.mapInArrow(shingles.shared_rows, "key long, id long"), "shared-keys")
    same = ["n", "x", "y", "least"]
    ids = shared.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"), F.min("id").alias("least")
    )
    return shared.join(ids.groupBy(*same).agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def in_cells(keyed: DataFrame, bucket_rows: int) -> DataFrame:
    """The rows of `keyed` (key, id, ...) as (key, a, b, id, ...), sorted by
    cell (key, a, b), a cell in one partition. A key of up to `bucket_rows`
    rows is one cell; of a fuller one any two rows meet in some cell."""
    rest = [c for c in keyed.columns if c not in ("key", "id")]
    full = keyed.groupBy("key").count().where(F.col("count") > bucket_rows)
    full = full.select("key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    cut = keyed.join(full, "key", "left").select("key", "id", *rest, "chunks", chunk.alias("a"))
    # a row of chunk a meets every other chunk in a cell of its own
    partners = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    cut = cut.select("key", "id", *rest, F.coalesce("a", F.lit(0)).alias("a"), F.col("chunks"), F.explode(partners).alias("b"))
    cut = cut.where(F.col("chunks").isNull() | (F.col("a") != F.col("b")))
    cut = cut.select("key", F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), "id", *rest)
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")


def linked(keyed: DataFrame, tabled: DataFrame, bits: int, bucket_rows: int, words: int, ratio: float = 0.0) -> DataFrame:
    """(u, v): links among the ids of `tabled` (id, n, t, f0, ...) that share
    a key of `keyed` (key, id), enough to join each component."""
    rows = shared_keys(keyed).join(tabled.select("id", "n", "t", *columns_of(words)), "id").select("key", "id", "n", "t", *columns_of(words))
    return in_cells(rows, bucket_rows).mapInArrow(Linker(bits, words, ratio).rows, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    bits: int = 3,
    bucket_rows: int = BUCKET_ROWS,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints
    differ in `bits` bits or fewer are linked; component_id is the smallest
    doc_id that links reach.

    Only distinct fingerprints are compared. Each has its row of the table of
    distances to `n_pivots` reference fingerprints. Candidates agree in a pair
    of blocks, which each pair within `bits` does for one at least, so that
    none is lost. Pairs with a coordinate that differs by more than `bits` are
    discarded (the triangle inequality); the survivors are verified.

    Texts are read whole, however long. Documents without words (null, empty,
    white space) have fingerprint zero and are linked like others. Rows with
    equal ids are documents of their own and fall into one component when
    their texts do. A null doc_id is never a component_id unless all in its
    component are null. An empty table gives no rows. Other columns are not
    read.
    """
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    least = fps.groupBy("f0").agg(F.min("doc_id").alias("least")).select(F.col("f0").alias("id"), F.lit(0).cast("long").alias("n"), "f0", "least")
    least = written(with_table(least, pivots(n_pivots, 1)), "distance-table")
    keyed = least.select(F.explode(bucket_keys(F.col("f0"), bits)).alias("key"), "id")
    roots = connected_components(linked(keyed, least, bits, bucket_rows, 1))
    rooted = least.join(roots, least.f0 == roots.node, "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(first, "root").select("f0", "component_id")
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint")
    return fps.join(classes, "f0", "left").select("doc_id", hexed, "component_id")


def set_rows(batches: Iterator[pa.RecordBatch], width: int, similarity: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row", "row2", "id", "id2", "n", *columns_of(SET_WORDS), "prefix"]
    for batch in batches:
        found, prefixes = [], []
        for text in batch.column(3).cast(pa.binary()):
            hashes = shingles.shingle_set(text.as_py(), width)
            digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.uint64)
            found.append((*digest.tolist(), len(hashes), *fingerprint(hashes, SET_WORDS)))
            prefixes.append(shingles.prefix(hashes, similarity, common).tobytes())
        columns = np.array(found, np.uint64).reshape(-1, 3 + SET_WORDS).view(np.int64)
        arrays = [pa.array(np.ascontiguousarray(c)) for c in columns.T]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays, pa.array(prefixes, pa.binary())], names=names)


def keep_first(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    bits: int = SET_BITS,
    bucket_rows: int = BUCKET_ROWS,
    group_rows: int = GROUP_ROWS,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """`docs` less all but one row of each component of near copies: texts are
    linked if the Jaccard similarity of their sets of `width`-word shingles is
    `similarity` or more, and the sets' fingerprints of 256 bits differ in
    `bits` or fewer.

    Such fingerprints differ in 15 % of the bits on average at a similarity of
    0.8, 39 of 256 with a standard deviation of 6, so that 72 exclude a
    similar pair once in 10^7 (of sets of five shingles or fewer in 10^4).
    Two sets that similar have one of their first hashes in common
    (`shingles.prefix`): candidates are sets that do. Their distances to
    `n_pivots` reference fingerprints, drawn from the candidates, are
    precomputed; pairs with a coordinate that differs by more than `bits` are
    discarded, survivors verified, first by fingerprint, then, within the
    groups that these join, by the sets themselves.

    Of a component the row of the smallest id stays (null ids last), and of
    rows with that id the one whose text hashes least. Of rows of one id and
    text one stays. Texts without words (null, empty, white space) are equal;
    texts are read whole, however long. All columns pass through, whatever
    their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    common = spark.sparkContext.broadcast(shingles.common_hashes(docs.select(text), width))
    rows = [h.alias(c) for h, c in zip(row_hashes(id_col, text_col), ("row", "row2"))]
    schema = ", ".join(f"{c} long" for c in ("doc_id", "row", "row2", "id", "id2", "n", *columns_of(SET_WORDS))) + ", prefix binary"
    sets = docs.select(F.col(id_col).cast("long").alias("doc_id"), *rows, text).mapInArrow(lambda x: set_rows(x, width, similarity, common.value), schema)
    sets = written(sets, "shingle-sets")
    keyed = shared_keys(sets.select("id", "prefix").mapInArrow(shingles.key_rows, "key long, id long"))
    keyed = written(keyed, "candidate-keys")
    # one row a set, before the join: copies of a text are many
    each = sets.groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", *columns_of(SET_WORDS))), F.min("row").alias("row"), F.min_by("row2", "row").alias("row2"))
    candidates = each.join(keyed.select("id").distinct(), "id", "left_semi")
    candidates = written(candidates, "candidate-sets")
    drawn = candidates.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select(*columns_of(SET_WORDS)).collect()
    references = np.array([tuple(r) for r in drawn] or [(0,) * SET_WORDS], np.int64).view(np.uint64)
    tabled = with_table(candidates.drop("row", "row2"), references)
    cells = in_cells(keyed.join(tabled, "id").select("key", "id", "n", "t", *columns_of(SET_WORDS)), bucket_rows)
    possible = cells.mapInArrow(Linker(bits, SET_WORDS, similarity).rows, "u long, v long").distinct()
    groups = connected_components(possible)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [shingles.shingle_set(x.as_py(), width).tobytes() for x in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], names=["key", "id", "hashes"])

    chosen = groups.join(candidates, groups.node == candidates.id).select(F.col("root").alias("key"), "id", "row", "row2")
    members = docs.select(text, *rows).join(chosen, ["row", "row2"]).select("key", "id", "text").mapInArrow(hashed, "key long, id long, hashes binary")
    members = written(members.dropDuplicates(["id"]), "group-sets")
    roots = connected_components(in_cells(members, group_rows).mapInArrow(lambda x: shingles.verified_rows(x, similarity), "u long, v long").distinct())
    own = F.struct(F.coalesce("root", "id").alias("id"), F.when(F.col("root").isNull(), F.col("id2")).alias("id2"))
    rooted = sets.join(roots, sets.id == roots.node, "left").select("doc_id", "row", "row2", own.alias("root"))
    return first_rows(docs, rooted, id_col, text_col)


def first_rows(docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that are the first of their root. rooted: (doc_id,
    row, row2, root), a row for each of `docs`."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "row2")
    kept = rooted.groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.row").alias("kept_row"), F.col("first.row2").alias("kept_row2"))
    row, row2 = free_name(docs, "row_"), free_name(docs, "row2_")
    named = docs.withColumns(dict(zip((row, row2), row_hashes(id_col, text_col))))
    out = named.join(kept, (F.col(row) == kept.kept_row) & (F.col(row2) == kept.kept_row2), "left_semi")
    if rooted.groupBy("row", "row2").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([row, row2])
    return out.drop(row, row2)
