"""Language of documents by a linear-chain conditional random field over their words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import forward_backward, padded, pieces
from .common import session, text_of

CHAIN = 64
BUCKETS = 1 << 16
WIDTH = 24
# The sample that the model is fitted on: at most so many labelled documents of each language.
SAMPLE = 120
LEXICON = 20_000
STEPS = 30
KEPT_WORDS = 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(words: list[str]) -> np.ndarray:
    """Hashed prefixes and suffixes of 1 to 4 letters and all trigrams with word ends; 0 is no feature.

    Of words longer than 24 letters the first 16 and last 8 count.
    """
    clipped = [w if len(w) <= WIDTH else w[:16] + w[-8:] for w in words]
    letters = np.array(clipped, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)
    sizes = (letters > 0).sum(1)
    row, prime, columns = np.arange(len(words)), np.uint64(0x9E3779B97F4A7C15), []

    def bucket(mixed: np.ndarray, valid: np.ndarray) -> None:
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        columns.append(np.where(valid, mixed % np.uint64(BUCKETS - 1) + np.uint64(1), np.uint64(0)).astype(np.int32))

    for end in (False, True):
        mixed = np.full(len(words), 11 + end, np.uint64)
        for k in range(4):
            letter = letters[row, np.maximum(sizes - 1 - k, 0)] if end else letters[:, k]
            mixed = mixed * prime + letter
            bucket(mixed, sizes > k)
    framed = np.zeros((len(words), WIDTH + 2), np.uint64)
    framed[:, 1:-1], framed[:, 0] = letters, 1
    framed[row, sizes + 1] = 2
    for k in range(int(sizes.max(initial=0))):
        bucket((framed[:, k] * prime + framed[:, k + 1]) * prime + framed[:, k + 2] + np.uint64(3), sizes > k)
    return np.stack(columns, 1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    own: np.ndarray
    transition: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        found = np.concatenate([self.weights[features(words[k : k + 20_000])].sum(1) for k in range(0, len(words), 20_000)])
        return found + self.own[[self.lexicon.get(w, 0) for w in words]]

    def word_scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all words of some texts, through a bounded table of words met before."""
        if self.scores is None:
            self.scores = np.empty((0, len(self.languages)), np.float32)
        fresh = list({w for words in texts for w in words}.difference(self.known))
        table, known = self.scores, self.known
        if fresh:
            table = np.concatenate([self.scores, self.emissions(fresh).astype(np.float32)])
            numbers = dict(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            if len(known) + len(fresh) <= KEPT_WORDS:
                known.update(numbers)
                self.scores = table
            else:
                known = known | numbers if len(numbers) > len(known) else _Both(known, numbers)
        ids = np.fromiter((known[w] for words in texts for w in words), np.int64)
        return table[ids], np.cumsum([len(w) for w in texts])


class _Both(dict):
    """Looks in a second table for what the first lacks."""

    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key):
        return self.first[key]


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 3) -> Model:
    """Maximum likelihood by gradient steps over whole labelled texts.

    Every word of a text has the text's language.  A fifth of the chains are joined from halves of two others, so that
    transitions are learned from switches too.
    """
    texts = [(_WORD.findall(text.lower()), lang) for text, lang in rows]
    texts = [(words, lang) for words, lang in texts if words]
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)))
    counts = Counter(w for words, _ in texts for w in words)
    lexicon = {w: n + 1 for n, (w, c) in enumerate(counts.most_common(LEXICON)) if c > 2}
    words = {w: n for n, w in enumerate(counts)}
    ids = np.array([words[w] for t, _ in texts for w in t])
    gold = np.repeat([languages.index(lang) for _, lang in texts], [len(t) for t, _ in texts])
    at, length, _ = pieces(np.cumsum([len(t) for t, _ in texts]), CHAIN)
    index, inside = padded(at, length, CHAIN)
    random = np.random.default_rng(seed)
    whole = random.permutation(np.flatnonzero(length == CHAIN))
    first, second = whole[: len(whole) // 10], whole[len(whole) // 10 : 2 * (len(whole) // 10)]
    index[CHAIN // 2 :, first], index[CHAIN // 2 :, second] = index[CHAIN // 2 :, second], index[CHAIN // 2 :, first]
    feats, own_of = features(list(words)), np.array([lexicon.get(w, 0) for w in words])
    k, seen = len(languages), np.bincount(ids[index[inside]], minlength=len(words))
    target = np.zeros((len(words), k))
    np.add.at(target, (ids[index[inside]], gold[index[inside]]), 1)
    moves = np.zeros((k, k))
    both = inside[1:]
    np.add.at(moves, (gold[index[:-1]][both], gold[index[1:]][both]), 1)
    weights, own, transition = np.zeros((BUCKETS, k)), np.zeros((len(lexicon) + 1, k)), np.zeros((k, k))
    parts = [weights, own, transition]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    total = seen.sum()
    for step in range(1, steps + 1):
        scores = (weights[feats].sum(1) + own[own_of]).astype(np.float32)
        post, _, pairs = forward_backward(scores[ids[index]], inside, transition.astype(np.float32), True)
        flat, of = post[inside], ids[index[inside]]
        expected = np.stack([np.bincount(of, flat[:, c], len(words)) for c in range(k)], 1)
        gap = (target - expected) / total
        by_feature = np.stack([np.bincount(feats.ravel(), np.repeat(gap[:, c], feats.shape[1]), BUCKETS) for c in range(k)], 1)
        by_word = np.stack([np.bincount(own_of, gap[:, c], len(own)) for c in range(k)], 1)
        by_feature[0] = by_word[0] = 0
        steep = [by_feature, by_word, (moves - pairs) / total - 1e-4 * transition]
        for p, g, m, s in zip(parts, steep, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(languages, weights.astype(np.float32), lexicon, own.astype(np.float32), transition.astype(np.float32))


def learn(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Fit on at most ``sample`` labelled documents per language, those with the smallest hashes of their ids."""
    usable = docs.filter(~held_out(id_column) & F.col(lang_column).isNotNull() & F.col(id_column).isNotNull())
    keys = usable.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"))
    order = F.row_number().over(_by_hash())
    chosen = keys.withColumn("rank", order).filter(F.col("rank") <= sample).select("id").collect()
    texts = usable.filter(F.col(id_column).isin([r["id"] for r in chosen])).select(text_of(text_column), lang_column, id_column).collect()
    return fit([(r[0], r[1]) for r in sorted(texts, key=lambda r: (r[2], r[0]))])


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_words, switches, confidence`` for every document.

    Words are runs of letters in lower case.  Each word's scores for the languages come from its affixes, trigrams and the lexicon; learned
    transitions join them in chains of 64 words, and forward-backward gives every word's posterior.  ``score`` is the
    mean posterior of the predicted language, so it is low in mixed texts; ``switches`` counts neighbouring words of different
    languages; ``confidence`` is the mean of each word's best posterior, high in a mixed text whose words are clear.  Only the text enters.  No shuffle; a batch of texts is held at a time, and a bounded table of words.

    Null texts and texts without a letter are ``und`` with score and confidence 0.  Ties go to the first language in alphabetical order.  Rows that
    repeat, and rows without an id, give a row each.  With a model of no language everything is ``und``.
    """
    session(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "lang_pred", "score", "n_words", "switches", "confidence"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [_WORD.findall(t.lower()) for t in batch.column("body").to_pylist()]
            if not batch.num_rows:
                continue
            n = np.array([len(t) for t in texts])
            n[[k for k, t in enumerate(texts) if not any(c.isalpha() for w in t for c in w)]] = 0
            texts = [t if m else [] for t, m in zip(texts, n, strict=True)]
            sums, switches = np.zeros((len(texts), max(1, len(model.languages)))), np.zeros(len(texts), np.int64)
            sure = np.zeros(len(texts))
            if n.any() and model.languages:
                scores, ends = model.word_scores(texts)
                at, length, owner = pieces(ends, CHAIN)
                index, inside = padded(at, length, CHAIN)
                post, _, _ = forward_backward(scores[index], inside, model.transition)
                np.add.at(sums, owner, (post * inside[:, :, None]).sum(0))
                np.add.at(sure, owner, (post.max(2) * inside).sum(0))
                best = post.argmax(2)
                np.add.at(switches, owner, ((best[1:] != best[:-1]) & inside[1:]).sum(0))
            known = (n > 0) & bool(model.languages)
            top = sums.argmax(1)
            lang = [model.languages[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)]
            score = np.where(known, sums.max(1) / np.maximum(n, 1), 0.0)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(n), pa.array(switches),
                       pa.array(np.clip(sure / np.maximum(n, 1), 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), text_of(text_column).alias("body"))
    return slim.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, switches long, confidence double")
