"""Exact copies, similar texts, benchmark passages: small cases and plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import fixtures
import numpy as np
import oracle
import pytest

from ruleloom.llm import queries
from ruleloom.llm.components import components
from ruleloom.llm.decontamination import contaminated
from ruleloom.llm.exact_dedup import exact_dedup
from ruleloom.llm.ngram_join import bands_for, ngram_join, similar


def tuples(df, *columns):
    key = lambda r: tuple((v is not None, v) for v in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, folder, name):
    assert oracle.compare(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.ORACLES[name]) is None


def test_exact_dedup_of_awkward_rows(spark):
    got = tuples(exact_dedup(fixtures.documents(spark)), "doc_id", "keep_id", "group_size", "kept")
    assert got == [
        (None, None, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True),
        (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True),
    ]
    assert exact_dedup(fixtures.documents(spark, [])).count() == 0


def test_exact_dedup_needs_all_of_the_text(spark):
    head = "x" * 500
    rows = [(1, head + "a", None), (2, head + "b", None), (3, head + "a", None), (4, "x" * 501, None)]
    got = tuples(exact_dedup(fixtures.documents(spark, rows)), "doc_id", "keep_id", "kept")
    assert got == [(1, 3, False), (2, 2, True), (3, 3, True), (4, 4, True)]


def test_exact_dedup_of_texts_that_share_an_id_or_have_none(spark, tmp_path):
    texts = [(5, "A"), (5, "B"), (7, "B"), (None, "C"), (None, "C"), *[(None, "D")] * 3, (None, "alone"), (9, "E"), (None, "E")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = tuples(queries.QUERIES["op9_exact_dedup"](spark, str(tmp_path)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = [
        (5, 5, 1, True, "A"), (5, 7, 2, False, "B"), (7, 7, 2, True, "B"), *[(None, None, 2, True, "C")] * 2, *[(None, None, 3, True, "D")] * 3,
        (None, None, 1, True, "alone"), (9, 9, 2, True, "E"), (None, 9, 2, False, "E"),
    ]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert got == sorted(((*r[:4], hashlib.sha256(r[4].encode()).hexdigest()) for r in want), key=key)


def test_rows_without_any_id(spark):
    got = tuples(exact_dedup(fixtures.documents(spark, [(None, "a", None), (None, "a", None)])), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(None, None, 2, True)] * 2


def loops(rows):
    """Classes and links by comparing all pairs."""
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\W_]+", text.lower())
        sets[key] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1 if words else 0))}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links, keys = Counter(), sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            common = len(sets[a] & sets[b])
            if not (sets[a] or sets[b]) or common >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), links[k]) for k in sets}


def near_copies(groups: int, size: int, seed: int):
    dice, rows = random.Random(seed), []
    for g in range(groups):
        words = fixtures.prose(seed * 1000 + g, 150).split()
        for _ in range(size):
            own = list(words)
            for _ in range(dice.randint(0, 6)):
                own[dice.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("blocks", [None, 3])
def test_ngram_join_finds_what_loops_find(spark, monkeypatch, blocks):
    if blocks:  # buckets larger than a block are cut
        monkeypatch.setattr("ruleloom.llm.ngram_join.BLOCK_DOCS", blocks)
    rows = near_copies(4, 12, 3) + [(1000 + n, fixtures.prose(n, n)) for n in range(8)] + [(2000, ""), (2001, " .,"), (2002, fixtures.prose(3, 3))]
    got = {r[0]: (r[1], r[2]) for r in tuples(ngram_join(fixtures.documents(spark, [(k, t, None) for k, t in rows])), "doc_id", "class_id", "n_links")}
    assert got == loops(rows)


def test_ngram_join_of_awkward_rows(spark):
    found = ngram_join(fixtures.documents(spark))
    assert tuples(found, "doc_id", "class_id", "n_links", "n_linked_texts", "class_size") == [
        (None, None, 0, 0, 1), (1, 1, 1, 0, 2), (2, 1, 1, 0, 2), (3, 3, 2, 0, 3), (4, 3, 2, 0, 3), (4, 3, 2, 0, 3),
        (5, 5, 0, 0, 1), (6, 6, 0, 0, 1), (7, 7, 0, 0, 1), (8, 8, 0, 0, 1),
    ]
    assert ngram_join(fixtures.documents(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = bands_for(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_similar_counts_intersections():
    dice = np.random.default_rng(2)
    sets = [np.unique(dice.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = similar(sets[:10], sets[10:], 0.3)
    want = [[len(set(a) & set(b)) >= 0.3 * len(set(a) | set(b)) for b in sets[10:]] for a in sets[:10]]
    assert (got == np.array(want)).all() and got.any() and not got.all()


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(159, 90)]
    got = dict(tuples(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {k: 0 for k in range(41)} | {k: 90 for k in [90, *range(100, 160)]}


def test_contaminated_windows(spark):
    item = fixtures.prose(1, 30).split()
    filler = lambda n: fixtures.prose(50 + n, 20)

    def changed(*places):
        return " ".join("other" if k in places else w for k, w in enumerate(item))

    docs = [
        (1, filler(1) + " " + changed() + " " + filler(2)), (2, filler(3) + " " + changed(5, 15, 25)), (3, filler(4)),
        (4, changed(*range(0, 30, 3))), (5, " ".join(item[:11])), (6, " ".join(item[9:21]).upper().replace(" ", ", ")), (7, None), (8, ""),
    ]
    rows = [(k, t, None) for k, t in docs]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short to match"), (1, " ".join(item))], "item_id long, text string")
    got = tuples(contaminated(fixtures.documents(spark, rows), items), "doc_id", "item_id", "agreeing")
    assert got == [(1, 1, 12), (2, 1, 11), (6, 1, 12)]
    assert contaminated(fixtures.documents(spark, []), items).count() == 0
    assert contaminated(fixtures.documents(spark, rows), items.limit(0)).count() == 0
    assert contaminated(fixtures.documents(spark), items).count() == 0


def overlaps(a, b):
    """All windows of two texts' words that are a hit and count: ``-agreeing, -overlap agreeing, overlap, places``."""
    masks = [[p for p in range(12) if p % 4 in pair] for pair in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]
    at = defaultdict(set)
    for q in range(len(b) - 11):
        for k, mask in enumerate(masks):
            at[k, tuple(b[q + p] for p in mask)].add(q)
    for p in range(len(a) - 11):
        for q in set().union(*(at.get((k, tuple(a[p + m] for m in mask)), ()) for k, mask in enumerate(masks))):
            front, behind = min(p, q, 24), min(len(a) - p, len(b) - q, 36)
            same = [a[p + n] == b[q + n] for n in range(-front, behind)]
            agreeing = sum(same[front : front + 12])
            if agreeing >= 10 or sum(same) * 6 >= len(same) * 5:
                yield -agreeing, -sum(same), len(same), p, q


def test_overlaps_are_found_whatever_is_substituted(spark):
    dice, items, docs = random.Random(8), [], []
    for n in range(30):
        words = fixtures.prose(700 + n, dice.choice([12, 15, 20, 30, 70])).split()
        items.append((n, " ".join(words)))
        own = list(words)
        for k in dice.sample(range(len(own)), dice.randint(1, 5)):
            own[k] = "other"
        docs.append((n, " ".join([*fixtures.prose(800 + n, 15).split(), *own, *fixtures.prose(900 + n, dice.choice([0, 40])).split()]), None))
    for n, size, places in ((100, 20, (10, 11)), (101, 15, (6, 10)), (102, 24, (1, 5, 10, 22)), (103, 30, (0, 1, 2))):
        words = fixtures.prose(n, size).split()
        items.append((n, " ".join(words)))
        docs.append((n, " ".join("other" if k in places else w for k, w in enumerate(words)), None))
    docs.append((104, " ".join([items[3][1]] * 5), None))
    want = {}
    for d, text, _ in docs:
        for i, item in items:
            if found := min(overlaps(text.split(), item.split()), default=None):
                want[d, i] = found
    got = contaminated(fixtures.documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (-r.agreeing, -r.overlap_agreeing, r.overlap, r.doc_at, r.item_at) for r in got.collect()} == want
    assert {(100, 100), (101, 101), (102, 102), (103, 103), (104, 3)} <= set(want)


def test_a_short_item_counts_by_its_whole_overlap(spark):
    words = fixtures.prose(5, 18).split()
    changed = [("other" if k in (3, 7, 11) else w) for k, w in enumerate(words)]
    assert max(sum(x == y for x, y in zip(words[p : p + 12], changed[p : p + 12])) for p in range(7)) == 10
    spread = [("other" if k in (4, 8, 12) else w) for k, w in enumerate(words)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = contaminated(fixtures.documents(spark, [(1, " ".join(changed), None), (2, " ".join(spread), None)]), items).collect()
    assert {(r.doc_id, r.overlap, r.overlap_agreeing) for r in got} == {(1, 18, 15), (2, 18, 15)}


def test_contamination_plan_has_no_python(spark, folder, capsys):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_digest_is_of_the_utf8_text(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    groups = defaultdict(list)
    for k, t in docs.items():
        groups[t].append(k)
    for r in queries.QUERIES["op9_exact_dedup"](spark, folder).collect():
        own = groups[docs[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
