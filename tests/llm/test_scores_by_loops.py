"""Scores of the three models, number by number: from features to trees, from words to posteriors, from neighbours to likelihoods."""

import math
import re

import fixtures
import numpy as np
import pytest

from ruleloom.llm import language_id, pseudo_likelihood, toxicity
from ruleloom.llm.queries import QUERIES


def test_toxicity_scores_by_walking_the_trees(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, folder).collect()}
    inner = len(model.trees.feature[0])
    assert len(model.trees.feature) > 10 and len(model.at) > 1

    def walked(x):
        margin = model.trees.base
        for feature, threshold, value in zip(model.trees.feature, model.trees.threshold, model.trees.value):
            node = 0
            while node < inner:
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            margin += value[node - inner]
        return margin

    def calibrated(margin):
        if margin <= model.at[0]:
            return model.share[0]
        for a, b, low, high in zip(model.at, model.at[1:], model.share, model.share[1:]):
            if margin <= b:
                return low + (high - low) * (margin - a) / (b - a)
        return model.share[-1]

    assert all(a <= b for a, b in zip(model.share, model.share[1:]))
    for row in docs.orderBy("doc_id").limit(60).collect():
        x = toxicity.features([row["text"] or ""], model.lexicon)[0]
        margin = walked(x)
        score = 0.99 * calibrated(margin) + 0.01 / (1 + math.exp(-margin))
        assert got[row["doc_id"]]["score"] == pytest.approx(min(1, max(0, score)), abs=1e-9)
        assert got[row["doc_id"]]["predicted"] == int(got[row["doc_id"]]["score"] >= 0.3)


def plain_features(word):
    """Buckets of prefixes, suffixes and trigrams, with whole numbers modulo 2^64."""
    prime, whole = 0x9E3779B97F4A7C15, 1 << 64
    letters = [ord(c) for c in (word if len(word) <= 24 else word[:16] + word[-8:])]

    def bucket(mixed):
        mixed = mixed * 0xBF58476D1CE4E5B9 % whole
        return (mixed ^ (mixed >> 31)) % (language_id.BUCKETS - 1) + 1

    found = []
    for start, order in ((11, letters), (12, letters[::-1])):
        mixed = start
        for letter in order[:4]:
            mixed = (mixed * prime + letter) % whole
            found.append(bucket(mixed))
    framed = [1, *letters, 2]
    for a, b, c in zip(framed, framed[1:], framed[2:]):
        found.append(bucket(((a * prime + b) * prime + c + 3) % whole))
    return found


def test_language_scores_from_letters_to_posteriors(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.learn(docs)
    k = len(model.languages)

    def posteriors(words):
        emit = [
            [sum(float(model.weights[f][c]) for f in plain_features(w)) + float(model.own[model.lexicon.get(w, 0)][c]) for c in range(k)] for w in words
        ]
        local = [[math.exp(e - max(row)) for e in row] for row in emit]
        move = [[math.exp(float(model.transition[a][b])) for b in range(k)] for a in range(k)]
        ahead, behind = [local[0]], [[1.0] * k]
        for row in local[1:]:
            step = [sum(ahead[-1][a] * move[a][b] for a in range(k)) * row[b] for b in range(k)]
            ahead.append([x / sum(step) for x in step])
        for row in local[:0:-1]:
            step = [sum(move[a][b] * row[b] * behind[0][b] for b in range(k)) for a in range(k)]
            behind.insert(0, [x / sum(step) for x in step])
        both = [[a * b for a, b in zip(x, y)] for x, y in zip(ahead, behind)]
        return [[x / sum(row) for x in row] for row in both]

    rows = [r for r in docs.orderBy("doc_id").limit(40).collect() if r["text"]][:12]
    rows += [r for r in docs.orderBy("doc_id").collect() if r["text"] and len(re.findall(r"[^\W\d_]+", r["text"])) > 150][:2]
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for row in rows:
        words = re.findall(r"[^\W\d_]+", row["text"].lower())
        post = [p for at in range(0, len(words), language_id.CHAIN) for p in posteriors(words[at : at + language_id.CHAIN])]
        mean = [sum(p[c] for p in post) / len(post) for c in range(k)]
        found = got[row["doc_id"]]
        assert found["lang_pred"] == model.languages[mean.index(max(mean))]
        assert found["score"] == pytest.approx(max(mean), abs=1e-3)
        assert found["confidence"] == pytest.approx(sum(max(p) for p in post) / len(post), abs=1e-3)


def test_likelihoods_by_looking_at_each_word(spark, monkeypatch):
    texts = [fixtures.prose(n, 40) for n in range(30)] + ["one two three", "one", "", None, "two Two TWO one!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 200)
    monkeypatch.setattr(pseudo_likelihood, "COUNTED", 20)
    held = {}

    def train(encoded, words):
        held["words"] = words
        size = len(pseudo_likelihood.Network(len(words.of), words.prior).flat)
        held["flat"] = np.random.default_rng(5).normal(0, 0.3, size).astype(np.float32)
        return held["flat"]

    monkeypatch.setattr(pseudo_likelihood, "train", train)
    got = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(docs).collect()}
    words, count = held["words"], {}
    split = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    for w in (w for t in split for w in t):
        count[w] = count.get(w, 0) + 1
    ranked = sorted(count, key=lambda w: (-count[w], w))
    assert ranked[:200] == sorted(words.ids, key=words.ids.get) and len(ranked) > 300
    net = pseudo_likelihood.Network(len(words.of), words.prior, held["flat"])
    tables, bias, out, last = (p.astype(float) for p in net.parts)
    own, endings = pseudo_likelihood.OWN_CLASSES, pseudo_likelihood.ENDINGS

    def number(w):
        return words.ids[w] if w in words.ids else len(words.ids) + 1 + pseudo_likelihood.ending_class(w)

    def class_of(w):
        rank = ranked.index(w)
        return rank if rank < own else own + pseudo_likelihood.ending_class(w)

    total = [0] * (own + endings)
    for w in count:
        total[class_of(w)] += count[w]
    for e in range(endings):
        total[own + e] += 1  # for a word that no text had

    for k, t in enumerate(split):
        log = 0.0
        for at, w in enumerate(t):
            around = [number(t[at + d]) if 0 <= at + d < len(t) else 0 for d in (-2, -1, 1, 2)]
            hidden = [math.tanh(bias[h] + sum(tables[s][a][h] for s, a in enumerate(around))) for h in range(len(bias))]
            scores = [last[c] + sum(hidden[h] * out[h][c] for h in range(len(bias))) for c in range(len(last))]
            most = max(scores)
            log += scores[class_of(w)] - most - math.log(sum(math.exp(s - most) for s in scores))
            log += math.log(count[w] / total[class_of(w)])
        assert got[k]["n_tokens"] == len(t) and got[k]["log_likelihood"] == pytest.approx(log, abs=0.02 + 1e-4 * abs(log)), k
