"""Vector codes: product quantization in whole numbers, with exact nearest entries found by segment-mean bounds.

A vector is cut into consecutive parts, and each part is coded by the nearest entry of its position's codebook. Most
entries are never measured against a part: the means of segments, one that is the whole part first and shorter ones
then, and the length of what the means leave over, bound the distance from below. Entries whose bound lies
above a distance that is already known are dropped, and the survivors get their exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import once
from ._common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Larger components are not coded: sums of their squares would not fit 64 bits.
LARGEST = 1 << 14
MOST_COMPONENTS = 1 << 12
#: Parts that are compared with a codebook at once.
CHUNK = 2048


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, length, fits, values) of a list column: whether a row has no null and no component that is null or not finite; its
    length; whether its components can be coded; and floor(1024 * x) of all components of the rows that fit."""
    length = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    owner = np.repeat(np.arange(len(length)), length)
    bad = np.bincount(owner, ~np.isfinite(x), len(length)) > 0
    kept = ~bad & np.asarray(column.is_valid())
    fits = kept & (np.bincount(owner, ~(np.abs(x) <= LARGEST), len(length)) == 0)
    return kept, length, fits, np.floor(x[fits[owner]] * SCALE).astype(np.int64)


def segments(size: int) -> list[np.ndarray]:
    """The cuts of a part, coarse to fine: where the segments start, for 1, 4, 16 ... of them below its size."""
    cuts, n = [], 1
    while n == 1 or n < size:
        cuts.append(np.unique(np.arange(n) * size // n))
        n *= 4
    return cuts


class Outline:
    """Of some parts (rows of whole numbers), per cut: the segments' means times the roots of their lengths, and the
    length of what is left when the means are taken away."""

    def __init__(self, parts: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        squares = (parts.astype(np.float64) ** 2).sum(axis=1)
        for cut in segments(parts.shape[1]):
            long = np.diff(np.append(cut, parts.shape[1]))
            means = np.add.reduceat(parts, cut, axis=1) / np.sqrt(long)
            self.levels.append((means, np.sqrt(np.maximum(squares - (means**2).sum(axis=1), 0.0))))
        self.scale = squares


def below(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> np.ndarray:
    """No more than the squared distances of the parts outlined so: those of the means, and what the rests differ in
    length by. `size` bounds the rounding of the floats, which is taken off."""
    return ((a[0] - b[0]) ** 2).sum(axis=-1) + (a[1] - b[1]) ** 2 - 1e-7 * size - 1e-6


def exact(parts: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    step = parts[row] - book[entry]
    return np.einsum("ij,ij->i", step, step)


def nearest(parts: np.ndarray, book: np.ndarray, outline: Outline | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every part: the nearest entry, of equally near ones the lowest. All in whole numbers."""
    outline = outline or Outline(book)
    if not parts.shape[1]:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    out, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for begin in range(0, len(parts), CHUNK):
        some = parts[begin : begin + CHUNK]
        own, every = Outline(some), np.arange(len(some))
        (mean, rest), (means, rests) = own.levels[0], outline.levels[0]
        size = own.scale[:, None] + outline.scale[None, :]
        bound = (mean - means[:, 0]) ** 2 + (rest[:, None] - rests[None, :]) ** 2 - 1e-7 * size - 1e-6
        known = exact(some, book, every, bound.argmin(axis=1))
        row, entry = np.nonzero(bound <= known[:, None])
        for level in range(1, len(own.levels)):
            (mean, rest), (means, rests) = own.levels[level], outline.levels[level]
            closer = below((mean[row], rest[row]), (means[entry], rests[entry]), size[row, entry])
            # the entry of the least bound so far is measured, and what lies above it goes
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            least = np.minimum.reduceat(closer, starts)
            at = np.flatnonzero(closer == least[row])
            at = at[np.concatenate([[True], row[at][1:] != row[at][:-1]])]
            known = np.minimum(known, exact(some, book, every, entry[at]))
            on = closer <= known[row]
            row, entry = row[on], entry[on]
        distance = exact(some, book, row, entry)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(distance, starts)
        found = np.flatnonzero(distance == least[row])
        found = found[np.concatenate([[True], row[found][1:] != row[found][:-1]])]
        out[begin : begin + len(some)], best[begin : begin + len(some)] = entry[found], least
    return out, best


def assigned(shared: Broadcast[list[np.ndarray]], column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(kept, coded, and per part position the parts, entries and distances) of a list column."""
    books = shared.value
    kept, length, fits, values = whole_numbers(column)
    size = books[0].shape[1]
    coded = fits & (length == size * len(books))
    vectors = values[coded[fits].repeat(length[fits])].reshape(int(coded.sum()), -1)
    parts = [vectors[:, p * size : (p + 1) * size] for p in range(len(books))]
    found = [nearest(x, b) for x, b in zip(parts, books, strict=True)]
    return kept, coded, parts, [f[0] for f in found], [f[1] for f in found]


def first_books(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the vectors of the smallest ids. A bounded number of rows."""
    fine = F.expr("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    codable = F.expr(f"size(v) % {parts} = 0 and size(v) between {parts} and {MOST_COMPONENTS} and forall(v, x -> abs(x) <= {LARGEST})")
    usable = vectors.where(F.col("vec_id").isNotNull()).where(fine).where(codable)
    rows = usable.orderBy("vec_id", "v").limit(entries).select("v").collect()
    if len({len(r.v) for r in rows}) > 1:
        rows = usable.where(F.size("v") == len(rows[0].v)).orderBy("vec_id", "v").limit(entries).select("v").collect()
    if not rows:
        return []
    whole = np.floor(np.array([r.v for r in rows], np.float64) * SCALE).astype(np.int64)
    return [np.ascontiguousarray(x) for x in np.split(whole, parts, axis=1)]


def moved_books(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The books after a round: every entry the mean of its parts, rounded down; entries without parts stay. A task adds
    up its parts by entry, so a row per entry and task is shuffled, and one per entry reaches the driver."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(books)
    size = books[0].shape[1]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), size), np.int64) for b in shared.value]
        many = [np.zeros(len(b), np.int64) for b in shared.value]
        for batch in batches:
            _, _, parts, entries, _ = assigned(shared, batch.column("v"))
            for p, (x, e) in enumerate(zip(parts, entries, strict=True)):
                # sums of a batch are whole numbers far below 2 to the 53, so floats hold them
                sums[p] += np.stack([np.bincount(e, x[:, i], len(many[p])) for i in range(size)], axis=1).astype(np.int64)
                many[p] += np.bincount(e, minlength=len(many[p]))
        for p in range(len(sums)):
            used = np.flatnonzero(many[p])
            made = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(many[p][used]), pa.array(list(sums[p][used]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["part", "entry", "many", "sums"])

    partial = vectors.select("v").mapInArrow(added, "part int, entry int, many long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("many").alias("many"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)])
    books = [b.copy() for b in books]
    for row in total.toLocalIterator():  # at most parts * entries rows
        books[row["part"]][row["entry"]] = [row[f"s{i}"] // row["many"] for i in range(size)]
    shared.destroy()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per usable row of vectors: (vec_id, code, error, label, label_error, codebooks_sha256).

    Rows whose vector is null or has a null, NaN or infinite component are dropped. Components become
    floor(1024 * x). The codebooks begin with the parts of the `entries` smallest ids (null ids never; of equal ids the smaller
    vector first) and move `rounds` times. The code has two hexadecimal digits per part, `error` is the
    sum of the parts' squared distances, `label_error` its sum over the rows of equal label, nulls together.

    A row that the codebooks have no measure for has a null code and error: one of another length than the vector of
    the smallest id, one whose length the parts do not divide, of more than 4,096 components, or with one beyond 16,384 in size. A label of such rows only has a
    null sum. Without any codable row codes are null and the digest is that of no entries. Repeated rows are coded alike. No rows give no rows; other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits per part: 1 to 256 entries")
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = once(named, "vectors")
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved_books(rows, books)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)], object)
        for batch in batches:
            column = batch.column("v")
            kept = whole_numbers(column)[0]
            code, error = np.full(len(column), None, object), np.zeros(len(column), np.int64)
            measured = np.zeros(len(column), bool)
            if shared.value:
                kept, measured, _, found, distances = assigned(shared, column)
                code[measured] = np.sum([digits[e] for e in found], axis=0)
                error[measured] = np.sum(distances, axis=0)
            mask = pa.array(kept)
            made = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, mask=~measured)]
            yield pa.RecordBatch.from_arrays(made, names=schema.names).filter(mask)

    done = stored(rows.mapInArrow(coded, schema), "codes", narrow=False)
    # a label's rows are added up where they are before anything is shuffled; both sides of the join are plain, so
    # that adaptive execution can split a label that holds a large part of the rows
    sums = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = done.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
