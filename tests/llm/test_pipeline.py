"""The pipeline stage by stage against plain loops."""

import os
import re

import fixtures
from test_text_operators import loops, overlaps

import __spark_entry__ as entry_module
import corpus_pipeline
from ruleloom.llm.common import SCRATCH


def test_stages_keep_what_loops_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaks(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return any(any(overlaps(words, item)) for item in items)

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        left = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(left)
        if name == "language_id":
            assert set(left) <= set(kept) and len(left) >= 0.97 * len(kept)
        elif name == "exact_dedup":
            last = {t: k for k, t in sorted(kept.items())}
            assert set(left) == set(last.values())
        elif name == "ngram_jaccard_join":
            assert set(left) == {c for c, _ in loops(kept.items()).values()}
        else:
            assert set(left) == {k for k, t in kept.items() if not leaks(t)}
        kept = left
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()} == set(kept)


def test_run_chains_the_stages(spark, folder):
    found = entry_module.queries()["pipeline"](spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 0


def test_stages_bear_awkward_rows(spark, folder):
    rows = fixtures.ROWS + [(4, "another text under the same id", "en")]
    docs = fixtures.documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        left = stage(spark, docs, folder)
        if name == "exact_dedup":
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in left.collect())[:4] == [(0, 19), (2, 0), (4, 30), (4, 70)]
            assert left.columns == docs.columns
        elif name == "language_id":
            assert not {1, 2, 6} & {r.doc_id for r in left.collect()} and left.columns == docs.columns
        else:
            assert left.count() >= 1


def test_mixed_languages_stay(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").filter("lang IS NOT NULL AND n_chars > 300").select("lang", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r.text[:300])
    mixed = [(1000 + k, " ".join(texts[k] for texts in by.values()), None) for k in range(min(map(len, by.values())))]
    docs = fixtures.documents(spark, [(n, r.text, r.lang) for n, r in enumerate(rows)] + mixed)
    assert len(by) == 4 and len(mixed) > 3
    assert {k for k, _, _ in mixed} <= {r.doc_id for r in corpus_pipeline.language(spark, docs, folder).collect()}


def test_scratch_of_finished_stages_is_removed(spark, folder):
    start = len(SCRATCH)
    entry_module.queries()["pipeline"](spark, folder).count()
    left = [os.path.basename(p) for p in SCRATCH[start:] if os.path.exists(p)]
    assert "pipeline-benchmark_decontamination" in "".join(left) and not any(p.startswith(("graph", "leaks", "dedup")) for p in left)


def test_exact_stage_keeps_the_other_text_of_an_id(spark, folder):
    docs = fixtures.documents(spark, [(5, "A", None), (5, "B", None), (7, "B", None)])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs, folder).collect()) == [(5, "A"), (7, "B")]
