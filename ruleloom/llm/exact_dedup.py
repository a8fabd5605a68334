"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fine_sieve, passes_fine, session, sieve_bits, stored, text_of


def _sieved(keys: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be among the keys; the sieve has 16 bits for each of them, up to 8 MB."""
    keys = stored(keys, "dedup-keys")
    size = sieve_bits(keys.count())
    bits = stored(fine_sieve(keys, "key", size), "dedup-sieve").scalar()
    return lambda hashed: passes_fine(bits, hashed, size)


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prefix_chars: int = 64, digest_column: str | None = None
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept``, and with ``digest_column`` the text's SHA-256 under that name.

    Texts are equal if all their bytes are; of equal texts the one with the largest id stays.  A first
    pass reads lengths and prefix hashes; only groups of the same length *and* prefix have their whole
    content hashed, in a second pass.  Two sieves of bounded size carry the surviving groups to the tasks, so no
    text is ever shuffled: what moves is one narrow row per document.  Counts are combined before they are
    shuffled, and joins on hash read stored tables on both sides, so that a group with a third of all rows
    is split over many tasks.  Each row keeps its own length and hash and meets its group by them, whatever its id.

    Null texts count as empty ones, and empty texts equal each other.  Rows that repeat id *and* text are one document
    in several rows: each keeps its row, counts in ``group_size`` and is kept if its id is.  Different texts under one id are
    decided apart.  Rows without an id take part; they are kept only if no row of their group has an id.  Other columns are not read.
    """
    spark = session(docs.sparkSession)
    body = F.col("body")
    slim = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("body"))
    n, prefix = F.octet_length(body).cast("long"), F.xxhash64(F.substring(body, 1, prefix_chars))

    first = stored(slim.select(n.alias("n"), prefix.alias("prefix")), "dedup-lengths")
    by_length = _sieved(first.groupBy("n").count().filter("count > 1").select(F.xxhash64("n").alias("key")))
    groups = first.filter(by_length(F.xxhash64("n"))).groupBy("n", "prefix").count().filter("count > 1")
    by_prefix = _sieved(groups.select(F.xxhash64("n", "prefix").alias("key")))
    full = F.when(by_prefix(F.xxhash64(n, prefix)), F.unhex(F.sha2(body, 256)))
    digest = [] if digest_column is None else [F.sha2(body, 256).alias("digest")]
    rows = stored(slim.select("doc_id", n.alias("n"), full.alias("full"), *digest), "dedup-hashes")

    survivors = rows.filter("full IS NOT NULL")
    copies = survivors.groupBy("n", "full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = stored(copies.filter("group_size > 1"), "dedup-groups")
    named = [] if digest_column is None else [F.col("digest").alias(digest_column)]
    alone = F.col("group_size").isNull()
    met = survivors.join(copies, ["n", "full"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        *named,
    )
    single = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    return met.unionByName(rows.filter("full IS NULL").select("doc_id", *single, *named))
