"""Best-fit packing of documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session, stored, text_of
from .tokens import encoder

CAPACITY = 2048


def fullest(lengths: dict[int, int], room: int) -> list[int]:
    """Of the available lengths, those whose sum is nearest to ``room`` from below.

    Bit s of the set is on when the sum s can be reached; taking a length in shifts the set by it.  Long ones come
    first, and the walk back leaves out a length where the sum was reached without it.
    """
    reached, within, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in lengths if x <= room), reverse=True):
        for _ in range(min(lengths[length], room // length)):
            steps.append((length, reached))
            reached |= (reached << length) & within
            if reached >> room & 1:
                break
        if reached >> room & 1:
            break
    left, taken = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fills bins one after the other, each as full as can be, starting from the longest piece left.

    As many bins of the same filling are made as the counts allow, so the work depends on the number of different
    lengths, not on the number of pieces.
    """
    left, made = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        filling = [longest, *fullest({k: v for k, v in left.items() if v}, capacity - longest)]
        left[longest] += 1
        times = min(left[k] // n for k, n in Counter(filling).items())
        made.append((filling, times))
        for k, n in Counter(filling).items():
            left[k] -= n * times
        left = {k: v for k, v in left.items() if v}
    return made


def _places(made: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows of first rank, first sequence, pieces per sequence, offset."""
    rows, used, sequence = defaultdict(list), Counter(), 0
    for filling, times in made:
        offset = 0
        for length, per in Counter(filling).items():
            rows[length].append((used[length], sequence, per, offset))
            used[length] += per * times
            offset += per * length
        sequence += times
    return {length: np.array(x, dtype=np.int64) for length, x in rows.items()}


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``), and ``part, nth``:
    the task that cut it and how many pieces of the same length that task had cut before."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("part", pa.int64()), ("nth", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, part, end = encoder(tokenizer), Counter(), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        for batch in batches:
            columns = [[] for _ in fields]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), known.encode(batch.column("body").to_pylist()), strict=True):
                ids += end
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    length = capacity if start else (total - 1) % capacity + 1
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, piece, start, length, zlib.crc32(own), part, seen[length], own)
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    names = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids binary" * with_ids
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("body"))
    return slim.mapInArrow(cut, names)


def best_fit_pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Where every piece of every document lies: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Each document is its ids and ``end_id``.  Only documents longer than ``capacity`` are cut, from the end: their
    first piece may be shorter.  One pass cuts all texts and stores a narrow row per piece.  What decides the
    packing is how many pieces there are of each length, a table of ``capacity`` rows at most whatever the input,
    so the driver plans with that alone: per bin a subset-sum bit set over the lengths left finds the fullest
    filling.  A piece's rank among those of its length (tasks before it, then its place in its task) then tells
    its sequence and offset.  Pieces are joined by task and length, both sides sorted, which no hot length or source can skew.

    Null and empty texts are one piece of the end id.  Rows that repeat an id are packed each on their own.  Rows without an id
    are packed with a null.  An empty table gives no rows.  Other columns are not read.
    """
    spark = session(docs.sparkSession)
    cut = stored(cut_documents(docs, tokenizer, end_id, capacity, id_column, text_column, with_ids), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(patterns(lengths, capacity)))
    tasks = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(tasks), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        own, ranks = length.to_numpy(), rank.to_numpy()
        for x in np.unique(own):
            table, here = places.value[x], own == x
            row = table[np.searchsorted(table[:, 0], ranks[here], side="right") - 1]
            nth = ranks[here] - row[:, 0]
            sequence[here], offset[here] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # Rows for each task and length are as many as tasks want; how small they are on disk says nothing about their size in memory.
    ranked = cut.hint("merge").join(before, ["part", "length"]).withColumn("at", place("length", F.col("before") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * with_ids)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the token ids of each sequence; ``pieces`` has ``ids``.  A group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
