"""Similarity join on word n-grams: MinHash bands for candidates, Jaccard of whole n-gram sets for proof."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fine_sieve, passes_fine, session, stored, text_of, word_hashes
from .components import components

GRAM = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 128
# A block of one bucket: so many documents or n-grams on average.  Two blocks are compared at a time.
BLOCK_DOCS = 512
BLOCK_GRAMS = 200_000
SIEVE_BITS, NODE_SIEVE_BITS = 1 << 23, 1 << 25
COLUMNS = 4096


def bands_for(similarity: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most selective rows for which pairs of just this similarity meet with this recall."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most or rows == 1:
            return bands, rows
    raise AssertionError


def grams_of(words: np.ndarray, ends: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``gram`` words of several texts, and where each text's end; a shorter text is one run."""
    factor = np.random.default_rng(5).integers(1, 1 << 63, gram, dtype=np.uint64) | np.uint64(1)
    words, starts = words.view(np.uint64), np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    rows = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    padded = np.concatenate([words, np.zeros(gram, np.uint64)])
    owner = np.repeat(np.arange(len(ends)), rows)
    out_ends = np.cumsum(rows)
    at = np.arange(len(owner)) - np.repeat(out_ends - rows, rows) + np.repeat(starts, rows)
    short = (sizes < gram)[owner]
    total = np.zeros(len(owner), np.uint64)
    for k in range(gram):
        word = padded[at + k]
        if short.any():
            word = np.where(short & (k >= sizes[owner]), np.uint64(0), word)
        total += word * factor[k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32)), out_ends


def signatures(grams: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, a row per text.  A text without n-grams has the signature of the empty set."""
    random = np.random.default_rng(7)
    factor = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    sizes = np.diff(np.concatenate([[0], ends]))
    some, out = sizes > 0, np.zeros((len(ends), bands), np.uint64)
    first = (ends - sizes)[some]
    for band in range(bands):
        mixed = np.full(int(some.sum()), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            if len(first):
                least = np.minimum.reduceat((grams * factor[k]) >> np.uint64(8), first)
                mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
        out[some, band] = mixed
    return out


def similar(one: list[np.ndarray], other: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of n-gram sets reach the similarity, from the sizes of all intersections."""
    sets = one + other
    sizes = np.array([len(s) for s in sets], np.float64)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.empty(0, bool)
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else fresh
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((len(one), len(other)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[here], column[here] - low] = 1
        common += table[: len(one)] @ table[len(one) :].T
    either = sizes[: len(one), None] + sizes[None, len(one) :] - common
    return common >= similarity * either - 1e-6


def _compare(rows: list[dict], bands: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the members of two blocks: node, links, linked copies, and the smallest node of its part here."""
    band, inner = rows[0]["band"], rows[0]["i"] == rows[0]["j"]
    node = np.array([r["node"] for r in rows], np.int64)
    copies = np.array([r["copies"] for r in rows], np.int64)
    marks = np.frombuffer(b"".join(r["marks"] for r in rows), np.uint64).reshape(-1, bands)
    grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    left = np.arange(len(rows)) if inner else np.flatnonzero([r["block"] == r["i"] for r in rows])
    right = left if inner else np.flatnonzero([r["block"] == r["j"] for r in rows])
    links, weight, label = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), node.copy()
    if len(left) and len(right):
        linked = similar([grams[k] for k in left], [grams[k] for k in right], similarity)
        for b in range(band):  # a pair belongs to the first band in which it meets
            linked &= marks[left, b][:, None] != marks[right, b][None, :]
        if inner:
            np.fill_diagonal(linked, False)
        links[left] += linked.sum(1)
        weight[left] += (linked * copies[right][None, :]).sum(1)
        if not inner:
            links[right] += linked.sum(0)
            weight[right] += (linked * copies[left][:, None]).sum(0)
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        while True:
            least = label.copy()
            np.minimum.at(least, x, label[y])
            np.minimum.at(least, y, label[x])
            if (least == label).all():
                break
            label = least
    return node, links, weight, label


def ngram_join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM, similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """Classes of documents linked by n-gram similarity: ``doc_id, class_id, n_links, n_linked_texts, class_size``.

    Two texts are linked if the Jaccard similarity of their sets of ``gram``-word runs reaches ``similarity``; a class is
    all that links join, and its id the smallest document id in it.  ``n_links`` counts linked documents, copies included,
    ``n_linked_texts`` linked texts of other wording.  The number of bands and rows follows from ``recall`` for a
    pair of just the threshold; more similar pairs meet more surely.

    Documents of the same words are one node with a count, so copies are never paired.  Bands of all nodes are shuffled as
    narrow rows; buckets of one node drop out, and of buckets with the same members only one is kept.  Only nodes in a
    bucket have their n-grams computed again, in a second pass behind a fixed-size sieve, and shuffled.
    A bucket is cut into blocks by its number of documents and n-grams, and each pair of blocks is a task's work
    of bounded size: nothing is capped, and no pair leaves that task, only counts and one label per member.
    Labels become classes by connected components.

    Null and empty texts have no n-grams; they are copies of each other, in one class, linked to no other text.  A text of fewer
    than ``gram`` words is one n-gram.  Repeated rows count as copies.  Rows without an id take part, with a null
    ``doc_id``; a class of such rows alone has a null id.  An empty table gives no rows; other columns are not read.
    """
    session(docs.sparkSession)
    bands, rows = bands_for(similarity, recall)
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), word_hashes(text_of(text_column)).alias("word"))
    slim = slim.withColumn("node", F.xxhash64("word"))

    def flat(column) -> tuple[np.ndarray, np.ndarray]:
        offsets = column.offsets.to_numpy().astype(np.int64)
        return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0])[1:]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words, ends = flat(batch.column("word"))
                marks = signatures(*grams_of(words, ends, gram), bands, rows)
                column = pa.array([m.tobytes() for m in marks], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), column], ["doc_id", "node", "marks"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams, ends = grams_of(*flat(batch.column("word")), gram)
                sets = [np.unique(x).tobytes() for x in np.split(grams, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "grams"])

    signed = stored(slim.mapInArrow(sign, "doc_id long, node long, marks binary"), "join-signatures")
    nodes = stored(
        signed.groupBy("node").agg(F.first("marks").alias("marks"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")),
        "join-nodes",
    )
    mark = F.substring("marks", F.col("band") * 8 + 1, F.lit(8))
    each = nodes.select("node", "marks", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    each = each.filter(mark != F.unhex(F.lit("00" * 8))).select("node", "band", F.xxhash64("band", mark).alias("bucket"))
    full = each.groupBy("bucket").count().filter("count > 1").select("bucket")
    bits = stored(fine_sieve(full, "bucket", SIEVE_BITS), "join-sieve").scalar()
    likely = stored(each.filter(passes_fine(bits, F.col("bucket"), SIEVE_BITS)), "join-likely")
    # The sieve lets single nodes through: the counts are taken again, and of buckets with the same members the first band's stays.
    buckets = (
        likely.groupBy("bucket", "band")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum1"),
            F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("sum2"),
        )
        .filter("n > 1")
        .groupBy("n", "sum1", "sum2").agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select("b.bucket")
    )
    members = stored(likely.join(stored(buckets, "join-buckets"), "bucket"), "join-members")

    # One document of each node in a bucket is read again: the one with the node's smallest id.
    wanted = members.select("node").distinct().join(nodes.select("node", "least"), "node")
    wanted = wanted.select(F.xxhash64("node", "least").alias("key"))
    named = stored(fine_sieve(wanted, "key", NODE_SIEVE_BITS), "join-sieve").scalar()
    again = slim.filter(passes_fine(named, F.xxhash64("node", "doc_id"), NODE_SIEVE_BITS)).select("node", "word")
    grams = stored(again.mapInArrow(expand, "node long, grams binary").withColumn("tag", F.monotonically_increasing_id()), "join-grams")
    # Repeated rows of one id give the same n-grams twice; one of them counts.
    once = grams.groupBy("node").agg(F.min(F.struct("tag", (F.length("grams") / 8).alias("weight"))).alias("one"))
    once = stored(once.select("node", F.col("one.tag").alias("chosen"), F.col("one.weight").cast("long").alias("weight")), "join-weights")

    sizes = members.join(once, "node").groupBy("bucket").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("weight") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    sizes = stored(sizes, "join-sizes")
    block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "bucket").withColumn("block", block)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", "band", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    about = nodes.select("node", "marks", "copies").join(once.select("node", "chosen"), "node")
    content = grams.join(about, "node").filter("tag = chosen").drop("tag", "chosen")
    work = placed.join(content, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, key = [], None
        names = ["node", "links", "weight", "label"]

        def compared():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _compare(waiting, bands, similarity)], names)

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["bucket"], row["i"], row["j"])
                if now != key and len(waiting) > 1:
                    yield compared()
                if now != key:
                    waiting, key = [], now
                waiting.append(row)
        if len(waiting) > 1:
            yield compared()

    verified = stored(
        work.mapInArrow(verify, "node long, links long, weight long, label long").filter("links > 0 OR node <> label"), "join-links"
    )
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    joined = components(verified.select(F.col("node").alias("a"), F.col("label").alias("b")))
    found = nodes.select("node", "copies", "least").join(linked, "node", "left").join(joined, "node", "left")
    found = stored(found.withColumn("component", F.coalesce("component", "node")), "join-found")
    classes = found.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = stored(classes, "join-classes")
    found = stored(found.join(classes, "component"), "join-classed")
    return signed.select("doc_id", "node").join(found, "node").select(
        "doc_id", "class_id",
        (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_linked_texts"),
        "class_size",
    )
