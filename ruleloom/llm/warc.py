"""Web archives with a two-level capture index: sorted compressed blocks and a sparse directory of them."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, session, shared_files, stored, text_of

# Entries of one compressed block of the index; the directory has one line per block.
BLOCK = 256
# A task begins another archive beyond so many bytes.
FILE_BYTES = 1 << 28
# The lookup sends the first key of every index file, cut to so many characters, to the tasks, so its size is bounded.
MOST_FILES, KEY_CHARS = 1 << 16, 256
# Tasks that may look keys up in one index file.
SHARES = 16
# Fixed values of the archive format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id long, file string, offset long, length long"


def reversed_host_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL: hosts of one domain sort together.  Null is the empty URL."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


@dataclass
class Archive:
    """What was written: ``index`` has a row per index file, ``index_file, first_key, n_entries, n_blocks``."""

    index: DataFrame


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.rpartition(":")[2].rstrip(">")
    return None if number == "none" else int(number)


def encode_record(page_id, url: str, payload: bytes, digest: str, original: tuple | None, size: int, date: str) -> bytes:
    """A record as a gzip member of its own.  ``original`` is ``(page_id,)`` of the response for a revisit, which has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if original else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if original:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(original[0])}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> dict:
    """Fields of a record; digest and size of a response are those of its payload, of a revisit what its headers say."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    record = {"page_id": _page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "url": fields["WARC-Target-URI"]}
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return record | {"refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return record | {"refers_to": _page(fields["WARC-Refers-To"]), "payload": None, "payload_bytes": size, "payload_digest": digest}


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _new_file(folder: str, kind: str):
    uri = f"{folder}/{kind}/part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex[:12]}.gz"
    files, path = shared_files(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, files.open_output_stream(path, compression=None)


def write_archive(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_column: str = "page_id",
    url_column: str = "url", body_column: str = "html",
) -> Archive:
    """Write a record per page and the index of all records.

    Of the records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page id is the response, the others
    are revisits without a payload.  Which page that is comes from narrow rows of digests, counted within tasks first;
    only the pages that revisit another are joined to the pages.  Each task writes archives of its own pages, and a
    sorted run of the index: keys are the URLs with the host reversed, in blocks of 256 entries that are compressed each, the
    file ending in a directory of its blocks.  The key range is split by page id too, so one URL or host may fill many files.  Files
    have new names in every attempt and count only once a stored table names them.

    Null payloads are empty, null URLs are empty URLs.  Rows that repeat page id and payload are all responses (or all revisits).  A row
    without a page id is written, and is a response only if no row of its payload has an id.  An empty table gives an
    empty archive.
    """
    spark = session(pages.sparkSession)
    folder = folder or scratch(spark, "archive")
    slim = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), text_of(body_column).alias("html")
    ).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    digests = stored(slim.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest"), "archive-digests")
    kept = digests.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = stored(kept.select("digest", "original"), "archive-originals")
    again = digests.join(kept, "digest").filter(~F.col("page_id").eqNullSafe(F.col("original")))
    again = stored(again.select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "original").distinct(), "archive-revisits")
    joined = slim.join(again, slim.page_id.eqNullSafe(again.revisit_id) & (slim.digest == again.revisit_digest), "left").select(
        "page_id", "url", "digest", reversed_host_key(F.col("url")).alias("key"), F.octet_length("html").alias("size"),
        F.when(F.col("revisit_digest").isNull(), F.col("html")).alias("html"), "original",
    )

    names = [f.split()[0] for f in ENTRY.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, at = None, 0
        for batch in batches:
            rows = []
            for page_id, url, digest, key, size, html, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or at > FILE_BYTES:
                    if sink:
                        sink.close()
                    (uri, sink), at = _new_file(folder, "warc"), 0
                name = base64.b32encode(digest).decode()
                member = encode_record(page_id, url, (html or "").encode(), name, None if html is not None else (original,), size, date)
                sink.write(member)
                rows.append((key, page_id, uri, at, len(member)))
                at += len(member)
            if rows:
                yield _batch(rows, names, kinds)
        if sink:
            sink.close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, waiting, directory, at, first, total = None, [], [], 0, None, 0

        def block():
            nonlocal at
            packed = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in waiting).encode())
            sink.write(packed)
            directory.append([waiting[0][0], at, len(packed)])
            at += len(packed)
            waiting.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    (uri, sink), first = _new_file(folder, "index"), row[0]
                waiting.append(row)
                total += 1
                if len(waiting) == BLOCK:
                    block()
        if sink:
            if waiting:
                block()
            packed = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
            sink.write(packed + len(packed).to_bytes(8, "little"))
            sink.close()
            yield _batch([(uri, first, total, len(directory))], ["index_file", "first_key", "n_entries", "n_blocks"], [pa.string(), pa.string(), pa.int64(), pa.int64()])

    entries = stored(joined.mapInArrow(write, ENTRY), "archive-entries")
    ranged = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return Archive(stored(ranged.mapInArrow(index, "index_file string, first_key string, n_entries long, n_blocks long"), "archive-index"))


class IndexFile:
    """One sorted run of the index: reads its directory, then single blocks."""

    def __init__(self, uri: str):
        files, path = shared_files(uri)
        self.source = files.open_input_file(path)
        size = self.source.size()
        tail = int.from_bytes(self.source.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.source.read_at(tail, size - 8 - tail)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list[list]] | None = None

    def block(self, k: int) -> list[list]:
        """The last block read is kept: keys looked up in order find their neighbours there."""
        if self.held is None or self.held[0] != k:
            _, at, length = self.directory[k]
            self.held = k, [json.loads(line) for line in zlib.decompress(self.source.read_at(length, at)).decode().split("\n")]
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """All entries of a key: binary search among the blocks, then within them."""
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            rows = self.block(k)
            keys = [r[0] for r in rows]
            yield from rows[bisect_left(keys, key) : bisect_right(keys, key)]


def _entries(batches: Iterator[pa.RecordBatch], of_row) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for row in batch.to_pylist():
            rows = []
            for entry in of_row(row):
                rows.append(entry)
                if len(rows) >= 4096:
                    yield _batch(rows, [f.split()[0] for f in ENTRY.split(", ")], kinds)
                    rows = []
            if rows:
                yield _batch(rows, [f.split()[0] for f in ENTRY.split(", ")], kinds)


def all_entries(archive: Archive) -> DataFrame:
    """Every entry of the index, block by block."""

    def read(batches):
        def of(row):
            run = IndexFile(row["index_file"])
            for k in range(len(run.directory)):
                yield from run.block(k)

        return _entries(batches, of)

    # A fixed number of tasks, one per file: the rows that name the files are too small to be dealt by size.
    return archive.index.select("index_file").repartition(max(1, archive.index.count())).mapInArrow(read, ENTRY)


def lookup(archive: Archive, urls: DataFrame, url_column: str = "url") -> DataFrame:
    """Index entries of the captures of some URLs, without reading the rest of the index.

    The first keys of the index files (a bounded list) tell the files that may hold a key; each file's directory the blocks; only
    those are read.  Keys are dealt to tasks by file and hash, so a file that many keys need is no single task.  URLs may repeat; each is looked up once.
    """
    files = archive.index.select("index_file", F.substring("first_key", 1, KEY_CHARS).alias("first_key")).limit(MOST_FILES + 1).collect()
    if len(files) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} index files")
    files = sorted((r["first_key"], r["index_file"]) for r in files)
    firsts, names = np.array([f[0] for f in files], dtype=object), [f[1] for f in files]

    @F.pandas_udf("array<string>")
    def places(key: pd.Series) -> pd.Series:
        cut = key.str[:KEY_CHARS].to_numpy(dtype=object)
        begin = np.maximum(np.searchsorted(firsts, cut, side="left") - 1, 0)
        return pd.Series([names[a:b] for a, b in zip(begin, np.searchsorted(firsts, cut, side="right"), strict=True)])

    def read(batches):
        at, run = None, None

        def of(row):
            nonlocal at, run
            if row["index_file"] != at:  # keys come sorted by file
                at, run = row["index_file"], IndexFile(row["index_file"])
            yield from run.find(row["key"])

        return _entries(batches, of)

    keys = urls.select(reversed_host_key(F.col(url_column)).alias("key")).distinct()
    placed = keys.select("key", F.explode(places("key")).alias("index_file"))
    dealt = placed.repartition("index_file", F.pmod(F.xxhash64("key"), F.lit(SHARES)))
    return dealt.sortWithinPartitions("index_file", "key").mapInArrow(read, ENTRY)


def read_records(entries: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at some entries, by range reads: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` (and ``payload``)."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source = None, None
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if uri != at:
                    files, path = shared_files(uri)
                    at, source = uri, files.open_input_file(path)
                record = decode_record(source.read_at(length, offset))
                rows.append(tuple(record[n] for n in names))
            if rows:
                yield _batch(rows, names, kinds)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    # Neighbours in a file are read together; a large file is shared by several tasks.  Entries are small and the records are not,
    # so the number of tasks goes by the records' bytes and is the session's at least.
    # A task reads some 64 MB of records.
    size = entries.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 26)))
    dealt = entries.repartition(tasks, "file", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(read, schema)
