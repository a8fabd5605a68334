"""Token ids in Arrow files of equal-length sequences with masks, open for random access."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, session, shared_files, stored, text_of
from .tokens import encoder

SEQUENCE = 2048
# Sequences in one record batch: the unit of a random access.
BATCH = 64


def _schema(length: int, wide: bool) -> pa.Schema:
    ids = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Appends ids to a file; only the last sequence of a file is padded, where its mask is false."""

    def __init__(self, sink, length: int, wide: bool):
        self.schema, self.length = _schema(length, wide), length
        self.type, self.size = (np.uint32 if wide else np.uint16), BATCH * length
        self.out, self.waiting, self.count, self.total = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.type))
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= self.size:
            joined = np.concatenate(self.waiting)
            for at in range(0, len(joined) - self.size + 1, self.size):
                self._batch(joined[at : at + self.size], self.size)
            self.waiting = [joined[len(joined) - len(joined) % self.size :]]
            self.count = len(self.waiting[0])

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        arrays = (pa.array(ids), pa.array(np.arange(len(ids)) < valid))
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(a, self.length) for a in arrays], schema=self.schema))

    def close(self) -> None:
        if self.count:
            ids = np.concatenate(self.waiting)
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()


class SequenceFile:
    """Random access to one file: ``sequence(k)``, ``mask(k)`` and ``ids(start, n)``.

    Batches have the same size, so the place of a sequence follows from its number.  From a local file the ids are
    views of the mapped file; nothing is copied until ``ids`` joins parts of two batches.
    """

    def __init__(self, uri: str):
        files, path = shared_files(uri)
        local = isinstance(files, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _flat(self, number: int) -> np.ndarray:
        if number != self.at:
            self.at, self.batch = number, self.reader.get_batch(number)
        return self.batch.column("ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> np.ndarray:
        at = k % BATCH * self.length
        return self._flat(k // BATCH)[at : at + self.length]

    def mask(self, k: int) -> np.ndarray:
        self._flat(k // BATCH)
        return np.array(self.batch.column("mask")[k % BATCH].as_py())

    def ids(self, start: int, count: int) -> np.ndarray:
        size, parts = BATCH * self.length, []
        while count:
            flat = self._flat(start // size)[start % size :][:count]
            parts.append(flat)
            start, count = start + len(flat), count - len(flat)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint16)])


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, sequence: int = SEQUENCE,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encode all texts in ascending order of their ids and write them; returns the manifest.

    The manifest has a row per file: ``part, ids_file, docs_file, n_docs, n_tokens, start``, ``start`` being the number of ids in all files
    before.  Each file holds the ids of a range of documents, one after the other, ``end_id`` behind each, cut
    into sequences of equal length; ``docs_file`` lists ``doc_id, start, n_tokens`` within the file.  Ids
    take two bytes where the vocabulary allows.

    Texts are shuffled once, by ranges of id, and encoded by the task that writes them; it holds one batch at a time.  A
    task that runs again writes a file of another name, and only files named in the manifest count, so lost
    executors leave nothing behind that is read.  Null texts are empty: their one id is the end.  Rows
    without an id come first; rows that share an id are ordered by a hash of their text, so that many of them are several tasks.  An empty table gives an empty manifest.
    """
    spark = session(docs.sparkSession)
    folder = folder or scratch(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, known = None, encoder(tokenizer)
        wide = max(known.vocabulary, end_id + 1) > 1 << 16
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"{folder}/part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex[:12]}"
                files, path = shared_files(name)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                sinks = [files.open_output_stream(f"{path}.{kind}.arrow") for kind in ("ids", "docs")]
                writer = _Writer(sinks[0], sequence, wide)
                listed = pa.ipc.new_file(sinks[1], listed_schema)
                n_docs = 0
            starts, counts = [], []
            for raw in known.encode(batch.column("body").to_pylist()):
                ids = np.append(np.frombuffer(raw, dtype="<u4"), end)
                starts.append(writer.total)
                counts.append(len(ids))
                writer.add(ids)
            listed.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(counts)], schema=listed_schema))
            n_docs += len(counts)
        if writer is not None:
            writer.close()
            listed.close()
            for sink in sinks:
                sink.close()
            row = [TaskContext.get().partitionId(), f"{name}.ids.arrow", f"{name}.docs.arrow", n_docs, writer.total]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["part", "ids_file", "docs_file", "n_docs", "n_tokens"])

    listed_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    ordered = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("body"))
        .withColumn("hash", F.xxhash64("body")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "body")
        .drop("hash")
    )
    files = stored(ordered.mapInArrow(write, "part long, ids_file string, docs_file string, n_docs long, n_tokens long"), "token-manifest")
    # One row per file: a single small window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files; ids are little-endian unsigned 32-bit integers."""
    return _read(manifest, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def check_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    return _read(manifest, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(manifest: DataFrame, column: str, made, kind: pa.DataType) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids_file = SequenceFile(row["ids_file"])
                files, path = shared_files(row["docs_file"])
                listed = pa.ipc.open_file(files.open_input_file(path))
                for k in range(listed.num_record_batches):
                    part = listed.get_batch(k)
                    starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    values = [made(ids_file.ids(s, n)) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(starts + row["start"]), part.column("n_tokens"), pa.array(values, kind)],
                        ["doc_id", "start", "n_tokens", column.split()[0]],
                    )

    # A file is a task's work.  A fixed number of tasks, since the rows that name the files are too small to be dealt by size.
    tasks = manifest.select("ids_file", "docs_file", "start").repartition(max(1, manifest.count()))
    return tasks.mapInArrow(read, f"doc_id long, start long, n_tokens long, {column}")
