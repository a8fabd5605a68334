"""Held-out accuracy, awkward rows and exact parts of the fitted operators, and the web archive."""

import base64
import hashlib
import itertools
import math
import re

import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import chains, language_id, pii, pseudo_likelihood, queries, toxicity, warc


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def all_paths(emission, transition):
    """Every labelling of one chain with its score."""
    steps, states = emission.shape
    for path in itertools.product(range(states), repeat=steps):
        yield path, sum(emission[t, s] for t, s in enumerate(path)) + sum(transition[a, b] for a, b in itertools.pairwise(path))


def test_chains_equal_the_sum_over_all_paths():
    dice = np.random.default_rng(6)
    length = np.array([5, 2, 1, 4])
    index, inside = chains.padded(np.array([0, 5, 7, 8]), length, 5)
    flat, transition = dice.normal(0, 2, (12, 3)), dice.normal(0, 1, (3, 3))
    post, normal, pairs = chains.forward_backward(flat[index], inside, transition, True)
    best = chains.viterbi(flat[index], inside, transition)
    want_pairs = np.zeros((3, 3))
    for c, n in enumerate(length):
        paths = list(all_paths(flat[index[:n, c]], transition))
        total = sum(math.exp(s) for _, s in paths)
        assert normal[c] == pytest.approx(math.log(total))
        for t in range(n):
            for k in range(3):
                assert post[t, c, k] == pytest.approx(sum(math.exp(s) for p, s in paths if p[t] == k) / total)
        assert tuple(best[:n, c]) == max(paths, key=lambda x: x[1])[0]
        for p, s in paths:
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += math.exp(s) / total
    assert pairs == pytest.approx(want_pairs)


def test_pieces_cover_all_texts():
    at, length, owner = chains.pieces(np.array([3, 3, 10]), 4)
    assert at.tolist() == [0, 3, 7] and length.tolist() == [3, 4, 3] and owner.tolist() == [0, 2, 2]


# -- languages ---------------------------------------------------------------


def test_languages_of_held_out_documents(spark, folder):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op6_language_id"](spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held) > 0


def test_languages_of_awkward_rows(spark):
    rows = [(f"the cat and the dog number {n} went with them", "en") for n in range(20)]
    rows += [(f"der hund und die katze gingen mit ihnen über straße {n}", "de") for n in range(20)]
    model = language_id.fit(rows)
    got = by_id(language_id.identify(fixtures.documents(spark), model), "lang_pred", "score")
    assert {k for k, v in got.items() if v == ("und", 0.0)} == {1, 2, 6}
    assert got[7][0] == "de" and got[3][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(fixtures.documents(spark), model).count() == len(fixtures.ROWS)
    assert language_id.identify(fixtures.documents(spark, []), model).count() == 0
    mixed = [(1, "the cat and the dog went with them " * 3 + "der hund und die katze gingen mit ihnen " * 3, None)]
    row = language_id.identify(fixtures.documents(spark, mixed), model).first()
    assert row.switches == 1 and 0.4 < row.score < 0.7


def test_learning_languages_from_nothing(spark):
    model = language_id.learn(fixtures.documents(spark, []))
    assert {r.lang_pred for r in language_id.identify(fixtures.documents(spark), model).collect()} == {"und"}


def test_learning_leaves_out_held_out_documents(spark):
    docs = fixtures.documents(spark)
    held = {r.doc_id for r in docs.filter(language_id.held_out()).collect()}
    usable = [r for r in docs.collect() if r.doc_id is not None and r.doc_id not in held and r.lang]
    assert language_id.learn(docs).languages == sorted({r.lang for r in usable if re.search("[^\\W\\d_]", r.text or "")})


# -- toxicity ----------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.score, toxic[r.doc_id]) for r in queries.QUERIES["op1_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    high, low = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low]) > 0.75


def test_toxicity_of_awkward_rows(spark):
    docs = fixtures.documents(spark)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    for model in (toxicity.learn(docs, labels), toxicity.learn(docs, labels.limit(0)), toxicity.learn(docs.limit(0), labels)):
        rows = toxicity.score_toxicity(docs, model).collect()
        assert len(rows) == len(fixtures.ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_isotonic_pools_violators():
    at, share = toxicity.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert share.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [0.0, 1.5, 3.0]


def test_trees_fit_a_rule():
    dice = np.random.default_rng(1)
    x = dice.random((600, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 2] < 0.5)).astype(float)
    margin = toxicity.fit_trees(x, y).margin(x)
    assert ((margin > 0) == (y == 1)).mean() > 0.98


def test_obfuscated_insults_are_seen():
    names = toxicity.NAMES
    row = toxicity.features(["You are an 1d10t and a m*o*r*o*n!!"], toxicity.Lexicon({}, {}))[0]
    assert row[names.index("obfuscated_tokens")] > 0 and row[names.index("obfuscated_hits")] > 0 and row[names.index("near_second_person")] > 0


# -- personal data -----------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {
            "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")),
            "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15,
        }[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if fits(k, m.group())]


def test_base_spans_equal_the_plain_patterns():
    dice = np.random.default_rng(3)
    for _ in range(4000):
        text = "".join(dice.choice(list("a1.@ +-9()45\nZ%"), dice.integers(0, 40)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain_spans(text), text
    for text in ["4111111111111111 0.0.0.0 a@b.c", "000300.1.2.3 x@@y.z.w@q.r", "a" * 3000 + "@" + "1" * 3000, "+1 (988) 555-2485 1.2.3.4.5"]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain_spans(text)


def test_chain_adds_what_the_patterns_miss():
    texts = ["please call (415) 555-2671 today", "nothing to see in 12 lines of version 3.0", "amex 3782 822463 10005 ok", ""]
    tagger = pii.Tagger(*pii.fitted())
    found = [[(pii.KINDS[k], t[a:b]) for k, a, b in spans] for t, spans in zip(texts, pii.tag(texts, tagger), strict=True)]
    assert found == [[("phone", "(415) 555-2671")], [], [("card", "3782 822463 10005")], []]


def test_forgetting_shapes_changes_no_span(monkeypatch):
    odd = " ".join("-".join(["a1", "b", "=", "9" * n][: n % 4 + 1]) + "/" * (n % 3) + "#" * (n % 2) for n in range(40))
    calls = [f"{odd} please call (415) 555-2671 today {odd}", "amex 3782 822463 10005 ok", f"call (415) 555-2671 {odd[::-1]}"]
    whole = pii.Tagger(*pii.fitted())
    want = [pii.tag([t, calls[1]], whole) for t in calls * 2]
    monkeypatch.setattr(pii, "KEPT_TOKENS", 4)
    small = pii.Tagger(*pii.fitted())
    assert [pii.tag([t, calls[1]], small) for t in calls * 2] == want
    assert all(w[1] for w in want)


def test_personal_data_query_against_plain_patterns(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.QUERIES["op8_pii"](spark, folder).collect():
        spans = plain_spans(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in spans) for x in pii.KINDS)
        assert set(listed) <= set(r.spans.split(",")) | {""}


def test_personal_data_of_awkward_rows(spark):
    found = pii.find_pii(fixtures.documents(spark)).collect()
    assert len(found) == len(fixtures.ROWS) and not any(r.base or r.added for r in found)
    assert pii.find_pii(fixtures.documents(spark, [])).count() == 0


# -- likelihood --------------------------------------------------------------


def test_likelihood_prefers_the_order_of_the_corpus(spark):
    rows = [(n, "red green blue white black " * 40 + fixtures.prose(n, 5), None) for n in range(60)]
    rows += [(900, "red green blue white black " * 40, None), (901, "blue red black green white green " * 34, None)]
    got = by_id(pseudo_likelihood.pseudo_likelihood(fixtures.documents(spark, rows)), "mean_log_likelihood")
    assert got[900][0] > got[901][0]


def test_likelihood_is_the_sum_over_tokens(spark):
    docs = fixtures.documents(spark)
    got = by_id(pseudo_likelihood.pseudo_likelihood(docs), "n_tokens", "log_likelihood", "mean_log_likelihood")
    assert got[1] == got[2] == (0, 0.0, None) and got[6][0] == 1 and got[5][0] == 60_000
    assert all(v[1] == pytest.approx(v[0] * (v[2] or 0)) for v in got.values())
    assert pseudo_likelihood.pseudo_likelihood(fixtures.documents(spark, [])).count() == 0


def test_classes_and_words_are_distributions(spark):
    words = pseudo_likelihood.vocabulary(pseudo_likelihood.count_words(fixtures.documents(spark)))
    assert np.exp(words.prior).sum() == pytest.approx(1)
    known = np.bincount(words.of[1:], np.exp(words.inside[1:]), len(words.prior))
    assert (known <= 1 + 1e-9).all()


@pytest.mark.parametrize("counted", [0, 3, 65_536])
def test_each_rare_word_has_its_own_count(spark, monkeypatch, counted):
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 2)
    monkeypatch.setattr(pseudo_likelihood, "COUNTED", counted)
    rows = [(1, "the a boxing the a", None), (2, "the a foxing the a", None), (3, "foxing " * 8 + "the a " * 40, None), (None, "the a foxing the a", None), (2, "the a boxing the a", None)]
    docs = fixtures.documents(spark, rows)
    found = pseudo_likelihood.pseudo_likelihood(docs).collect()
    assert len(found) == len(rows) and all(r.perplexity == pytest.approx(math.exp(-r.log_likelihood / r.n_tokens)) for r in found)
    got = {k: sorted(r.log_likelihood for r in found if r.doc_id == k) for k in (1, 2, None)}
    # foxing occurs 10 times, boxing twice; the ending and the words around them are the same
    assert got[2][1] - got[1][0] == pytest.approx(math.log(10 / 2)) and got[2][0] == pytest.approx(got[1][0]) and got[None][0] == pytest.approx(got[2][1])


def test_windows_do_not_cross_texts():
    centre, around = pseudo_likelihood.windows([np.array([5, 6, 7]), np.array([], int), np.array([8])])
    assert centre.tolist() == [5, 6, 7, 8]
    assert around.T.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def test_windows_only_of_the_places_asked_for():
    centre, around = pseudo_likelihood.windows([np.array([5, 6, 7]), np.array([8], "<u2")], 1, 2)
    assert centre.tolist() == [6, 8] and around.T.tolist() == [[0, 5, 7, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize("text", ["A_b  c9\x1f\x85d\n_", "", "Stra\u00dfe_\u0130x 9\u00b2 \u4e2d\u6587", "x\x00y-Z"])
def test_words_are_cut_as_by_the_pattern(text):
    assert pseudo_likelihood.cut(text) == re.findall(r"[^\W_]+", text.lower())


def test_steps_equal_plain_ones():
    random = np.random.default_rng(5)
    size, n, classes = 40, 2 * pseudo_likelihood.SLICE + 7, 6
    net = pseudo_likelihood.Network(size, np.log(np.full(classes, 1 / classes)))
    plain = [p.astype(float) for p in net.parts]
    squares = [np.full_like(p, 1e-2) for p in plain]
    for _ in range(3):
        around, target = random.integers(0, size // 2, (2 * pseudo_likelihood.AROUND, n)), random.integers(0, classes, n)
        tables, bias, weights, offset = plain
        hidden = np.tanh(sum(t[a] for t, a in zip(tables, around)) + bias)
        scores = hidden @ weights + offset
        log = scores - np.log(np.exp(scores).sum(1, keepdims=True))
        assert net.log_of(around, target) == pytest.approx(log[np.arange(n), target], abs=1e-4)
        gap = np.eye(classes)[target] - np.exp(log)
        back = gap @ weights.T * (1 - hidden**2)
        sums = np.zeros_like(tables)
        for table, ids in zip(sums, around):
            np.add.at(table, ids, back)
        for p, g, q in zip(plain, [sums, back.sum(0), hidden.T @ gap, gap.sum(0)], squares):
            q += g**2 / n
            p += pseudo_likelihood.RATE * g / np.sqrt(n) / np.sqrt(q)
        net.step(around, target)
    for got, want in zip(net.parts, plain):
        assert got == pytest.approx(want, abs=1e-3)


# -- web archives ------------------------------------------------------------


def test_archive_query_against_plain_hashing(spark, folder):
    pages = [(r.page_id, r.html.encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    last = {}
    for k, body in pages:
        last[body] = max(k, last.get(body, k))
    want = []
    for k, body in pages:
        again = last[body] != k
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((k, len(body), digest, "revisit" if again else "response", last[body] if again else None))
    assert sorted(map(tuple, queries.QUERIES["op5_warc_index"](spark, folder).collect())) == sorted(want)


def awkward_pages(spark):
    rows = [(n, f"http://Hot.example.com/{'x' if n % 3 else n}", f"body {n % 5}") for n in range(700)]
    rows += [(1000, None, None), (1001, "", ""), (None, "no scheme", "body 0"), (1002, "https://a.b:81/p?q=é\nInjected: 1", "é\r\n\r\n" * 3), (1002, "https://a.b:81/p?q=é\nInjected: 1", "é\r\n\r\n" * 3)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("original", F.lit(2))


def test_archive_of_awkward_pages(spark):
    archive = warc.write_archive(awkward_pages(spark))
    rows = warc.read_records(warc.all_entries(archive)).collect()
    assert len(rows) == 705
    kind = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in rows}
    assert kind[0] == ("revisit", 695, 6) and kind[695] == ("response", None, 6) and kind[None] == ("revisit", 695, 6)
    assert kind[1000] == ("revisit", 1001, 0) and kind[1002] == ("response", None, 18)
    assert {bytes(r.payload) for r in rows if r.page_id == 1002} == {("é\r\n\r\n" * 3).encode()}
    empty = warc.write_archive(awkward_pages(spark).limit(0))
    assert warc.all_entries(empty).count() == 0 and warc.lookup(empty, awkward_pages(spark)).count() == 0


def test_lookup_reads_what_a_scan_finds(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 16)
    archive = warc.write_archive(awkward_pages(spark))
    urls = spark.createDataFrame([("http://hot.example.com/x",), ("http://hot.example.com/9",), ("http://nowhere.example/",), (None,)], "url string")
    got = sorted(r.page_id for r in warc.lookup(archive, urls).collect())
    assert got == sorted([*(n for n in range(700) if n % 3), 9, 1000, 1001])


def test_small_payloads_are_always_responses(spark):
    archive = warc.write_archive(awkward_pages(spark), least_bytes=7)
    assert {r.record_type for r in warc.read_records(warc.all_entries(archive)).collect()} == {"response"}


def test_reversed_host_keys(spark):
    urls = ["http://www.Example.com/A?b", "https://u:p@a.b.c:8080/x", "http://host", "", None, "plain/path"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.reversed_host_key(F.col("url")))
    assert [r[0] for r in df.collect()] == ["com,example,www)/A?b", "c:8080,b,a)/x", "host)", ")", ")", ")plain/path"]
