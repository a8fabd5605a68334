"""What several operators share: scratch tables, bounded sieves, word hashes, shared files."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of text that one Arrow batch carries at most; long texts make larger batches than numbers do.
BATCH_ROWS = 512
# And bytes, whatever the length of the texts; one longer text is a batch of its own.
BATCH_BYTES = 1 << 26
# Everything that is not a letter or a digit separates words.
NOT_WORD = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for rows with texts, and plans that adapt to skew."""
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in wanted.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Folders that this process has named, in order.
SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, else in the warehouse.

    A warehouse on the local disk is refused where executors run on other machines: each would write to its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if urlparse(base).scheme in ("", "file") and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {base} is one of each machine")
    SCRATCH.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete scratch folders whose tables are no longer read."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps neither repeat the work
    nor depend on the executors that did it, and joins on it may split hot keys."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _three_bits(key: Column) -> Column:
    """A long with the bits that a hash sets in its word of a fine sieve; the word is told by the hash's lowest bits."""
    def bit(n: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, n).bitwiseAND(F.lit(63).cast("long")).cast("int"))

    return bit(58).bitwiseOR(bit(51)).bitwiseOR(bit(44))


def fine_sieve(hashes: DataFrame, key: str, bits: int = 1 << 22) -> DataFrame:
    """One row with one array of ``bits``/64 longs, in which each hash sets three bits of one long.

    Its size is fixed whatever the number of hashes, so it can go to every task.  It lets through all
    that was put in, and others the more the fuller it is: exact work has to follow.
    """
    slots = bits // 64
    slot = F.col(key).bitwiseAND(F.lit(slots - 1).cast("long"))
    filled = hashes.select(slot.alias("slot"), _three_bits(F.col(key)).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    every = hashes.sparkSession.range(0, slots, 1, 1).withColumnRenamed("id", "slot")
    dense = every.join(filled, "slot", "left").select("slot", F.coalesce("bit", F.lit(0).cast("long")).alias("bit"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("slot", "bit"))).alias("all")).select(F.col("all.bit").alias("bits"))


def sieve_bits(keys: int, least: int = 1 << 20, most: int = 1 << 26) -> int:
    """Bits of a fine sieve for so many keys: 16 a key, 8 MB at most, beyond which it lets more through."""
    return min(most, max(least, 1 << (16 * keys).bit_length()))


def passes_fine(bits: Column, key: Column, size: int = 1 << 22) -> Column:
    """Whether a hash may be in the fine sieve of ``size`` bits, a power of two."""
    word = F.get(bits, key.bitwiseAND(F.lit(size // 64 - 1).cast("long")).cast("int"))
    wanted = _three_bits(key)
    return word.bitwiseAND(wanted) == wanted


def shared_files(uri: str):
    """The file system of a shared folder and the path in it, for tasks that write files of their own."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)
