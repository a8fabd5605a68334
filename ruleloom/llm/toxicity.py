"""Toxicity of documents: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, stored, text_of, words_of

# Labelled documents are dealt by crc32 of their ids into folds; 2 is held out.
FOLDS, HELD_OUT = (0, 1, 3), 2
# At most so many documents of each fold are fitted on, those with the smallest hashes of their ids.
SAMPLE = 6000
LEXICON = 400
LEAST_TEXTS = 5
PREFIXES = (4, 5, 6, 7)
LEAST_ODDS = 3.0
NEAR = 5
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
THRESHOLD = 0.3
KEPT_TOKENS = 300_000

# Second-person words of the languages at hand, look-alikes of letters, and a few plain insults.
SECOND_PERSON = set(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split()
)
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
INSULTS = set("idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb fool jerk garbage".split())
MARKS = "!?.,;:*#$%&"
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"
NAMES = [
    "log_tokens", "lexicon_density", "log_lexicon_hits", "lexicon_strength", "strongest", "insult_density", "near_second_person", "second_person_density",
    "capital_tokens", "capitalised_tokens", "exclamations", "questions", "marks", "obfuscated_tokens", "obfuscated_hits", "stretched_tokens",
]
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_INNER = re.compile(r"[^\W\d_][0-9@$!|*._\-]+[^\W\d_]|^[0-9@$!|]+[^\W_]*[^\W\d_]{2}")
# Columns of the table of known tokens.
_STRENGTH, _INSULT, _PERSON, _CAPITAL, _TITLE, _OBFUSCATED, _HIDDEN, _STRETCH = range(8)


@dataclass
class Lexicon:
    """Words and word beginnings that mark toxic texts, with their log odds."""

    words: dict[str, float]
    prefixes: dict[str, float]
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def strength(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if self.prefixes:
            found = max(found, *(self.prefixes.get(word[:k], 0.0) for k in PREFIXES if len(word) > k), 0.0)
        return found

    def row(self, token: str) -> tuple:
        low = token.lower()
        word = low.strip(EDGE)
        strength, hidden = self.strength(word), 0.0
        obfuscated = bool(_INNER.search(low))
        if obfuscated and not strength:
            plain = re.sub(r"[^\w]|_", "", low.translate(LOOKALIKE))
            hidden = float(plain in INSULTS or self.strength(plain) > 0)
        capital = len(word) > 1 and token.isupper()
        return (strength, word in INSULTS, word in SECOND_PERSON, capital, token[:1].isupper(), obfuscated, hidden, bool(_STRETCHED.search(low)))

    def rows(self, tokens: list[str]) -> np.ndarray:
        if self.table is None or len(self.known) > KEPT_TOKENS:
            self.known, self.table = {}, np.zeros((0, 8), np.float32)
        known = self.known
        fresh = list(set(tokens).difference(known))
        if fresh:
            self.table = np.concatenate([self.table, np.array([self.row(t) for t in fresh], np.float32)])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        return self.table[[known[t] for t in tokens]]


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """A row of ``NAMES`` per text."""
    split = [t.split() for t in texts]
    ends = np.cumsum([len(t) for t in split])
    starts, n = ends - np.diff(np.concatenate([[0], ends])), np.diff(np.concatenate([[0], ends])).astype(float)
    table = lexicon.rows([t for tokens in split for t in tokens])
    summed = np.concatenate([np.zeros((1, 8)), np.cumsum(table, 0, dtype=np.float64)])
    sums = summed[ends] - summed[starts]
    hit = (table[:, _STRENGTH] > 0) | (table[:, _INSULT] > 0) | (table[:, _HIDDEN] > 0)
    hits = np.concatenate([[0], np.cumsum(hit)])
    persons = summed[:, _PERSON]
    owner = np.repeat(np.arange(len(texts)), n.astype(int))
    at = np.flatnonzero(hit)
    low, high = np.maximum(at - NEAR, starts[owner[at]]), np.minimum(at + NEAR + 1, ends[owner[at]])
    near = np.bincount(owner[at], persons[high] - persons[low] > 0, len(texts))
    strongest = np.zeros(len(texts))
    np.maximum.at(strongest, owner, table[:, _STRENGTH])
    chars = np.maximum([len(t) for t in texts], 1)
    marks = np.array([[t.count(m) for m in MARKS] for t in texts], float).reshape(len(texts), len(MARKS))
    each = np.maximum(n, 1)
    count = hits[ends] - hits[starts]
    return np.stack(
        [
            np.log1p(n), 100 * count / each, np.log1p(count), 100 * sums[:, _STRENGTH] / each, strongest, 100 * sums[:, _INSULT] / each, near / each * 100,
            sums[:, _PERSON] / each, sums[:, _CAPITAL] / each, sums[:, _TITLE] / each, marks[:, 0] / chars, marks[:, 1] / chars, marks.sum(1) / chars,
            sums[:, _OBFUSCATED] / each, sums[:, _HIDDEN] / each * 100, sums[:, _STRETCH] / each,
        ],
        1,
    )


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold per inner node, value per leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += v[node - (2**DEPTH - 1)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Gradient boosting of the logistic loss, with splits from histograms of quantile bins."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 1e-3
    base, inner = float(np.log(share / (1 - share))), 2**DEPTH - 1
    out = Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) < 20 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    margin, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        node, feature, threshold = np.zeros(len(y), int), np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local, best = node - first, np.full(width, 1e-9)
            for f, c in enumerate(cuts):
                cell = local * BINS + bins[:, f]
                g = np.bincount(cell, gradient, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(cell, curve, width * BINS).reshape(width, BINS).cumsum(1)
                rg, rh = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + 1) + rg**2 / (rh + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(h < 1) | (rh < 1)] = -1
                gain = gain[:, : len(c)]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                for w in np.flatnonzero(better):
                    feature[first + w], threshold[first + w] = f, c[at[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curve, inner + 1) + 1)
        margin += value[leaf]
        made.append((feature, threshold, value))
    return Trees(base, *(np.stack(part) for part in zip(*made, strict=True)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit by pooling neighbours that violate the order: mean margin and share of each pool."""
    blocks: list[list[float]] = []
    for m, v in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
        blocks.append([m, v, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            m2, v2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + m2, blocks[-1][1] + v2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    share: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        margin = self.trees.margin(features(texts, self.lexicon))
        raw = 1 / (1 + np.exp(-margin))
        fitted = np.interp(margin, self.at, self.share) if len(self.at) else raw
        return np.clip(0.99 * fitted + 0.01 * raw, 0, 1)  # the raw part orders what one pool holds


def _fold(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"
) -> Model:
    """Find the lexicon, fit the trees and calibrate, on at most ``sample`` labelled documents of each of three folds.

    Words found in a text's own fold would mark it too well, so the trees are fitted on features from the lexicon of the other two
    folds, and calibrated on margins of trees fitted on the other two; the lexicon and trees that stay come from all three.
    Rows of ``labels`` without id or label are left out; of several labels of one document the largest holds.  Without labels of both
    kinds the model scores the share of toxic labels, or near 0.
    """
    spark = session(docs.sparkSession)
    marked = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic")).dropna()
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", _fold("id")).filter(F.col("fold") != HELD_OUT)
    # Fold by fold, so that no task sorts more than it keeps; a window over a fold would hold all its labels in one.
    marked, chosen = stored(marked, "toxicity-labels"), None
    for f in FOLDS:
        own = marked.filter(F.col("fold") == f).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    # The sample is bounded by its size, so it may go to every task.
    texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("body")).join(F.broadcast(chosen), "id")
    texts = stored(texts, "toxicity-sample")

    total = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    word = F.array_distinct(words_of(F.col("body")))
    terms = [F.transform("word", lambda w: F.concat(F.lit("="), w))]
    for k in PREFIXES:
        terms.append(F.transform(F.filter("word", _longer(k)), _beginning(k)))
    each = texts.select("fold", "toxic", word.alias("word")).select("fold", "toxic", F.explode(F.array_distinct(F.concat(*terms))).alias("term"))
    cells = [F.count(F.when((F.col("fold") == f) & (F.col("toxic") == t), 1)).alias(f"n{f}{t}") for f in FOLDS for t in (0, 1)]
    all_toxic = sum(F.col(f"n{f}1") for f in FOLDS)
    counted = stored(each.groupBy("term").agg(*cells).filter(all_toxic >= LEAST_TEXTS), "toxicity-terms")

    def lexicon(folds) -> Lexicon:
        has, lacks = (sum(total.get((f, t), 0) for f in folds) for t in (1, 0))
        if not has or not lacks:
            return Lexicon({}, {})
        a, b = (sum((F.col(f"n{f}{t}") for f in folds), F.lit(0)) for t in (1, 0))
        odds = F.log((a + 0.5) / (has + 1)) - F.log((b + 0.5) / (lacks + 1))
        best = counted.filter(a >= max(LEAST_TEXTS, 0.004 * has)).select("term", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS)
        best = best.orderBy(F.desc("odds"), "term").limit(LEXICON).collect()
        words, prefixes = ({r["term"][1:]: r["odds"] for r in best if r["term"][0] == mark} for mark in "=^")
        return Lexicon(words, prefixes)

    others = {f: lexicon([x for x in FOLDS if x != f]) for f in FOLDS}
    shared = spark.sparkContext.broadcast(others)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                folds, bodies = np.array(batch.column("fold").to_pylist()), batch.column("body").to_pylist()
                x = np.zeros((len(folds), len(NAMES)))
                for f in np.unique(folds):
                    own = np.flatnonzero(folds == f)
                    x[own] = features([bodies[k] for k in own], shared.value[f])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "fold", "toxic")), pa.array(list(x))], ["id", "fold", "toxic", "x"])

    slim = texts.select(F.col("id").cast("string").alias("id"), F.col("fold").cast("long").alias("fold"), "toxic", "body")
    rows = sorted(slim.mapInArrow(measure, "id string, fold long, toxic int, x array<double>").collect(), key=lambda r: (r["id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES))
    y, fold = np.array([float(r["toxic"]) for r in rows]), np.array([r["fold"] for r in rows])
    margin = np.zeros(len(rows))
    for f in FOLDS:
        margin[fold == f] = fit_trees(x[fold != f], y[fold != f]).margin(x[fold == f])
    at, share = isotonic(margin, y)
    return Model(lexicon(FOLDS), fit_trees(x, y), at, share)


def _longer(k):
    return lambda w: F.length(w) > k


def _beginning(k):
    return lambda w: F.concat(F.lit("^"), F.substring(w, 1, k))


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; only the text enters the score.

    Features are rates per token of the whole text, so length alone changes little.  No shuffle; a batch of texts is held at a time, and a bounded
    table of tokens.  Null and empty texts are scored from features that are all 0.  Rows that repeat, and rows without an id, give a
    row each; other columns are not read.
    """
    session(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = shared.value.score(batch.column("body").to_pylist())
                columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(_fold(id_column) == HELD_OUT, F.lit(False))
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"), text_of(text_column).alias("body"))
    return slim.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
