"""Vectors as short codes: product quantisation whose distances are looked up in per-dimension value dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
# Components become floor(SCALE * x); a power of two, so the product is exact.
SCALE = 256
# Beyond this size of integers, sums of squares may leave 64 bits; such batches are worked in Python integers.
SMALL = 1 << 28
# Sums of components travel as this many digits of 40 bits, so that they are exact for every finite component.
DIGIT, DIGITS = 40, 5
MOST = (1 << 63) - 1
# Vectors that share one set of dictionaries; 8 MB at 64 components.
GATHERED = 16_384

# All entries of all parts: ``book[part][entry][place]``, integers.
Book = list[list[list[int]]]


def integers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``floor(SCALE * x)``."""
    values = np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(len(column), width)
    values = np.floor(values * SCALE)
    if np.abs(values).max(initial=0) < SMALL:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)


class Dictionaries:
    """Per dimension the distinct integers of a batch; rows are codes into them."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.values, self.codes = len(rows), [], []
        for d in range(rows.shape[1]):
            values, codes = np.unique(rows[:, d], return_inverse=True)
            self.values.append(values)
            self.codes.append(codes.reshape(-1))

    def distances(self, dimensions: range, entries: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each entry over some dimensions: one table a dimension, of every distinct integer to
        all entries; a row's distances are its rows of the tables, added."""
        total = np.zeros((self.rows, len(entries)), dtype=entries.dtype)
        for place, d in enumerate(dimensions):
            table = np.square(self.values[d][:, None] - entries[None, :, place])
            total = total + table[self.codes[d]]
        return total


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.Table]:
    """Batches put together up to so many rows: the more of them, the fewer distinct integers a row."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def nearest(rows: np.ndarray, book: Book) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part by part, each row's nearest entry, of several the first, and its squared distance."""
    width = rows.shape[1] // PARTS
    coded = Dictionaries(rows)
    for part, entries in enumerate(book):
        wide = any(abs(x) >= SMALL for entry in entries for x in entry)
        matrix = np.array(entries, dtype=object if wide or rows.dtype == object else np.int64).reshape(len(entries), width)
        distance = coded.distances(range(part * width, (part + 1) * width), matrix)
        best = distance.argmin(axis=1)
        yield part, best, distance[np.arange(len(rows)), best]


def digits(number: int) -> list[int]:
    low = [(number >> (DIGIT * k)) & ((1 << DIGIT) - 1) for k in range(DIGITS - 1)]
    return [*low, number >> (DIGIT * (DIGITS - 1))]


def number(parts: list[int]) -> int:
    return sum(int(x) << (DIGIT * k) for k, x in enumerate(parts))


def summed(batches: Iterator[pa.RecordBatch], book: Book, width: int) -> Iterator[pa.RecordBatch]:
    """What a task adds to each entry: the number of its parts and their sums, one row an entry at most."""
    count, total = {}, {}
    for batch in gathered(batches):
        rows = integers(batch.column("vector"), width)
        step = width // PARTS
        for part, best, _ in nearest(rows, book):
            cut = rows[:, part * step:(part + 1) * step]
            for entry in np.unique(best):
                own = cut[best == entry]
                key = part, int(entry)
                count[key] = count.get(key, 0) + len(own)
                total[key] = [a + int(b) for a, b in zip(total.get(key, [0] * step), own.sum(axis=0), strict=True)]
    keys = list(count)
    yield pa.RecordBatch.from_pydict({
        "part": pa.array([k[0] for k in keys], pa.int32()),
        "entry": pa.array([k[1] for k in keys], pa.int32()),
        "count": pa.array([count[k] for k in keys], pa.int64()),
        "digits": pa.array([[x for place in total[k] for x in digits(place)] for k in keys], pa.list_(pa.int64())),
    })


def encoded(batches: Iterator[pa.RecordBatch], book: Book, width: int) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches):
        rows = integers(batch.column("vector"), width)
        codes, error = np.zeros((len(rows), PARTS), dtype=np.uint8), np.zeros(len(rows), dtype=rows.dtype)
        for part, best, distance in nearest(rows, book):
            codes[:, part] = best
            error = error + distance
        yield from pa.Table.from_pydict({
            "vec_id": batch.column("vec_id"),
            "label": batch.column("label"),
            "code": pa.array([row.tobytes().hex() for row in codes], pa.string()),
            "error": pa.array([min(int(x), MOST) for x in error], pa.int64()),
        }).to_batches()


def book_digest(book: Book) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter(x.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), x.cast("array<double>").alias("vector")
    )


def learn_book(kept: DataFrame) -> tuple[Book, int]:
    """The entries of all parts and the vectors' length.  What reaches the driver is the book's size, whatever the input's."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    width = len(first[0]["vector"]) if first else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    step = width // PARTS
    start = [[int(np.floor(x * SCALE)) for x in row["vector"]] for row in first if len(row["vector"]) == width]
    book = [[row[p * step:(p + 1) * step] for row in start] for p in range(PARTS)]
    same = kept.filter(F.size("vector") == width).select("vector")
    for _ in range(ROUNDS if width else 0):
        held = book
        each = same.mapInArrow(lambda batches: summed(batches, held, width), "part int, entry int, count long, digits array<long>")
        places = [F.sum(F.get("digits", F.lit(n))).alias(f"d{n}") for n in range(step * DIGITS)]
        sums = each.groupBy("part", "entry").agg(F.sum("count").alias("count"), *places)
        book = [list(part) for part in book]
        for row in sums.collect():
            got = [number([row[f"d{place * DIGITS + k}"] for k in range(DIGITS)]) for place in range(step)]
            book[row["part"]][row["entry"]] = [x // row["count"] for x in got]
    return book, width


def compress_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each vector that is kept.

    Components become ``floor(256 * x)``; vectors are cut into 16 equal parts, and each part position has a book of 64
    entries, which begin as the parts of the 64 smallest ids and are refined in two rounds of assignment and averages (rounded
    down; entries without parts stay).  ``code`` names each part's nearest entry by two hex digits, ``error`` is the sum of the
    squared distances, ``label_error`` its sum over all vectors of the same label, ``codebooks_sha256`` the hash of all entries.

    Tasks hold the book, and per Arrow batch and dimension a dictionary of the distinct integers with the squared differences of
    each to all entries, so that a part's distances are rows of tables that are added.  A round shuffles one row for each
    entry and task; the driver gets one row for each of 1,024 entries.  Labels are summed before they are shuffled, and meet their
    vectors by a join of stored tables, in which a hot label can be split.

    Vectors that are null or hold a null, NaN or infinite component are dropped.  Repeated rows each count.  Vectors without an
    id are kept and come last in the order of ids; equal ids are ordered by vector.  With fewer than 64 vectors, books have
    so many entries.  Vectors of another length than the first one's get a null code and error and do not count.
    Empty vectors have 16 empty parts.  A length that 16 does not divide is an error.  Errors stop at 2^63 - 1.  An empty
    table gives none.  Null labels are one label.  Other columns are not read.
    """
    spark = session(vectors.sparkSession)
    kept = kept_vectors(vectors, id_column, vector_column, label_column)
    book, width = learn_book(kept)
    kind = kept.schema["label"].dataType.simpleString()
    same = kept.filter(F.size("vector") == width)
    coded = same.mapInArrow(lambda batches: encoded(batches, book, width), f"vec_id long, label {kind}, code string, error long")
    other = kept.filter(F.size("vector") != width).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = stored(coded.unionByName(other), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = stored(rows.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")), "vector-labels")
    joined = rows.join(labels, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignment to book n-1 and the book after it."""
    return f"""
near{n} AS (
  SELECT vec_id, p, min(d * {ENTRIES} + e) AS best FROM (
    SELECT c.vec_id, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN book{n - 1} b ON c.p = b.p AND c.i = b.i GROUP BY ALL
  ) GROUP BY ALL
), book{n} AS (
  SELECT b.p, b.e, b.i, coalesce(CAST(floor(sum(c.x) / count(c.x)) AS BIGINT), any_value(b.x)) AS x
  FROM book{n - 1} b LEFT JOIN (near{n} a JOIN comp c ON a.vec_id = c.vec_id AND a.p = c.p)
    ON b.p = a.p AND b.e = a.best % {ENTRIES} AND b.i = c.i
  GROUP BY b.p, b.e, b.i
)"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS (
  SELECT vec_id, j // (len(v) // {PARTS}) AS p, j % (len(v) // {PARTS}) AS i, v[j + 1] AS x FROM kept, LATERAL (SELECT unnest(range(len(v))) AS j)
), book0 AS (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, i, x FROM comp
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})
), {_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM near3 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
