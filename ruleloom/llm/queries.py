"""The operators' queries over their whole tables, and SQL where there is an equivalent."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontamination, toxicity, turn_repair, vector_codes
from .common import stored, table
from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .language_id import identify, learn
from .ngram_join import ngram_join
from .packing import best_fit_pack
from .pii import KINDS, find_pii
from .pseudo_likelihood import pseudo_likelihood
from .registry import ORACLES, QUERIES, query
from .site_templates import main_text
from .token_file import check_token_files, write_token_files
from .warc import lookup, read_records, write_archive

__all__ = ["ORACLES", "QUERIES"]


@query("op1_toxicity")
def op1_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query("op2_token_file")
def op2_token_file(spark, folder):
    files = write_token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return check_token_files(files)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, folder):
    return best_fit_pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op4_pseudo_likelihood")
def op4_pseudo_likelihood(spark, folder):
    return pseudo_likelihood(table(spark, folder, "documents"))


@query("op5_warc_index")
def op5_warc_index(spark, folder):
    pages = table(spark, folder, "pages")
    archive = write_archive(pages)
    entries = stored(lookup(archive, pages.select(F.coalesce("url", F.lit("")).alias("url"))), "archive-found")
    records = read_records(entries, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_language_id")
def op6_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return identify(docs, learn(docs))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark, folder):
    return ngram_join(table(spark, folder, "documents"))


def _of_kind(kind):
    return lambda span: span["kind"] == kind


@query("op8_pii")
def op8_pii(spark, folder):
    found = find_pii(table(spark, folder, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    place = F.create_map(*(F.lit(x) for n, k in enumerate(KINDS) for x in (k, n)))
    ordered = F.transform(
        F.array_sort(F.transform(
            F.concat("base", "added"), lambda s: F.struct(place[s["kind"]].alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        )),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(ordered).alias("spans"),
        F.size("added").alias("n_added"),
    )


@query("op9_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op9_exact_dedup(spark, folder):
    return exact_dedup(table(spark, folder, "documents"), digest_column="text_sha256")


@query("op10_decontamination", decontamination.SQL)
def op10_decontamination(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_turn_repair", turn_repair.SQL)
def op11_turn_repair(spark, folder):
    return turn_repair.conversation_digests(turn_repair.repair_pieces(table(spark, folder, "conversations")))


@query("op12_main_text")
def op12_main_text(spark, folder):
    return main_text(table(spark, folder, "pages"))


@query("op13_vector_codes", vector_codes.SQL)
def op13_vector_codes(spark, folder):
    return vector_codes.compress_vectors(table(spark, folder, "embeddings"))
