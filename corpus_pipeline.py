"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; the first four return the rows of
``documents`` that stay, with all their columns, the last one the places of their pieces.  What a stage rejects is
a table of ids.  A sieve of these ids lets all other rows pass at the scan; rows that it holds back are joined with the table, so
no texts are shuffled but theirs.  Rejecting goes by ``doc_id``, among exact copies by ``doc_id`` and text: rows that share it
share the decision, and rows without one are never rejected.  Null texts are empty texts,
which have no language and go in the first stage.  Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import SCRATCH, fine_sieve, passes_fine, release, session, sieve_bits, stored, table, text_of
from ruleloom.llm.decontamination import contaminated
from ruleloom.llm.exact_dedup import exact_dedup
from ruleloom.llm.language_id import UNKNOWN, identify, learn
from ruleloom.llm.ngram_join import ngram_join
from ruleloom.llm.packing import best_fit_pack

# Below this mean of the words' best posteriors, a text's words are of no language that is known.  Mixed texts are not below.
LEAST_CONFIDENCE = 0.5


def parted(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``doc_id`` is not among the ids, and those where it may be."""
    size = sieve_bits(ids.count())
    bits = stored(fine_sieve(ids.select(F.xxhash64(F.col(column).cast("long")).alias("hash")), "hash", size), "ids-sieve").scalar()
    may_be = passes_fine(bits, F.xxhash64(docs.doc_id.cast("long")), size)
    return docs.filter(~may_be), docs.filter(may_be)


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    ids = stored(rejected.select(F.col("doc_id").alias("rejected_id")).filter("rejected_id IS NOT NULL").distinct(), "rejected")
    clear, doubtful = parted(docs, ids, "rejected_id")
    return clear.unionByName(doubtful.join(ids, doubtful.doc_id == ids.rejected_id, "left_anti"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    found = identify(docs, learn(docs))
    return without(docs, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("confidence") < LEAST_CONFIDENCE)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, other texts under its id apart; of rows that repeat id and text, one."""
    decided = exact_dedup(docs, digest_column="digest").filter("group_size > 1")
    copies = stored(
        decided.select("doc_id", F.unhex("digest").alias("digest"), (~F.col("kept") & F.col("doc_id").isNotNull()).alias("gone")), "copies")
    marks = copies.groupBy(F.col("doc_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "gone").count()
    marks = stored(marks.filter("gone OR count > 1").drop("count"), "rejected")
    clear, doubtful = parted(docs, marks, "copy_id")

    def same(marked: DataFrame):
        return doubtful.doc_id.eqNullSafe(marked.copy_id) & (F.unhex(F.sha2(text_of("text"), 256)) == marked.copy_digest)

    again = marks.filter("NOT gone")
    repeats = doubtful.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return clear.unionByName(doubtful.join(marks, same(marks), "left_anti")).unionByName(repeats)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id stays."""
    return without(docs, ngram_join(docs).filter("doc_id <> class_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents left, in sequences of at most 2048 tokens."""
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

# The first stage's model is not a SQL expression; tests hold the pipeline against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(session(spark), sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        start = len(SCRATCH)
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        *used, kept = SCRATCH[start:]
        release(spark, before + used)
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)
