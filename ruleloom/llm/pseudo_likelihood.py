"""Masked pseudo-likelihood of documents by a bidirectional window network trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import NOT_WORD, session, stored, text_of

# Words that have an id of their own, and how many of them are a class of their own; all others are classed by their last two letters.
VOCABULARY, OWN_CLASSES, ENDINGS = 8192, 64, 32
# So many further words have their counts in the workers; those of still rarer words are joined.
COUNTED = 65_536
AROUND, HIDDEN = 2, 16
# Each round trains on every ROUNDS-th place of every text, beginning one place later, so that all rounds together take every place once.
ROUNDS, BATCH, RATE = 2, 16_384, 0.1
# Scores of all classes are held for so many places at once, which fit the cache of a core.
SLICE = 512
# Parameters travel in blocks; models are averaged in two steps, so that no task gets more than so many per block.
BLOCK, SALTS = 1 << 16, 64
MOST_ENDINGS = 1 << 20
_WORD = re.compile(r"[^\W_]+")
# The same for texts of ASCII: what is no letter or digit becomes a space.
_SPACED = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))


def ending_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % ENDINGS


def cut(text: str) -> list[str]:
    """The words of a text in lower case."""
    text = text.lower()
    return text.translate(_SPACED).split() if text.isascii() else _WORD.findall(text)


@dataclass
class Vocabulary:
    """Ids: 0 is beyond the text, then the words from frequent to rare, then the endings of all other words.

    ``of`` is the class of each id and ``inside`` the log share that a word of this id has of its class, for ids of endings that of a word
    counted once; ``prior`` the classes' log shares.  ``more`` has the log counts of the most frequent words that share an ending's id.
    """

    ids: dict[str, int]
    of: np.ndarray
    inside: np.ndarray
    prior: np.ndarray
    more: dict[str, float]

    @cached_property
    def numbers(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """The words of ``ids`` and ``more`` numbered from 1, and by number their ids and, for those of ``more``, log counts; 0 is any other."""
        first = len(self.ids) + 1
        numbers = self.ids | {w: first + k for k, w in enumerate(self.more)}
        ids = np.array([*range(first), *(first + ending_class(w) for w in self.more)], dtype="<u2")
        return numbers, ids, np.array([0.0] * first + list(self.more.values()))

    def read(self, text: str) -> tuple[np.ndarray, float, list[str]]:
        """The ids of a text's words; of those without an own id, the sum of the log counts in ``more``, and the words that are not there."""
        numbers, id_of, logs = self.numbers
        words = cut(text)
        found = np.fromiter(map(numbers.get, words, repeat(0)), np.int32, len(words))
        ids, rare, places, classes = id_of[found], [], np.flatnonzero(found == 0), []
        for k in places.tolist():
            word = words[k]
            ending = word[-2:]
            known = _ENDINGS.get(ending)
            if known is None:
                if len(_ENDINGS) >= MOST_ENDINGS:
                    _ENDINGS.clear()
                known = _ENDINGS[ending] = ending_class(word)
            classes.append(known)
            rare.append(word)
        ids[places] = np.array(classes, dtype="<u2") + np.uint16(len(self.ids) + 1)
        return ids, float(logs[found].sum()), rare


# Classes of endings met before, in a worker.
_ENDINGS: dict[str, int] = {}


def count_words(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``word, n`` over all texts."""
    # Empty pieces go as rows, in compiled code; a filter of the array, as in words_of, is interpreted piece by piece.
    words = docs.select(F.explode(F.split(F.lower(text_of(text_column)), NOT_WORD)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, wanted: int) -> list[Row]:
    """The ``wanted`` most frequent words, of equal counts the first ones; no more rows than these reach the driver.

    How many words there are of each count tells the count of the last rank.  All words above it are few enough; of those that have
    just this count as many as are still wanted are found on the executors.
    """
    left, least = wanted, None
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(wanted).collect():
        least = row["n"]
        if row["words"] >= left:
            break
        left -= row["words"]
    if least is None:
        return []
    above = counts.filter(F.col("n") > least).collect()
    last = stored(counts.filter(F.col("n") == least).orderBy("word").limit(left), "frequent-words").collect()
    return sorted(above + last, key=lambda r: (-r["n"], r["word"].encode()))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the counts of all words; the driver gets the frequent words and one row per ending."""
    ranked = most_frequent(counts, VOCABULARY + COUNTED)
    frequent, more = ranked[:VOCABULARY], {r["word"]: float(np.log(r["n"])) for r in ranked[VOCABULARY:]}
    ids = {r["word"]: k + 1 for k, r in enumerate(frequent)}
    ending = F.crc32(F.encode(F.expr("right(word, 2)"), "UTF-8")) % ENDINGS
    sums = counts.groupBy(ending.cast("int").alias("e")).agg(F.sum("n").alias("n")).collect()
    mass = np.zeros(ENDINGS)
    for r in sums:
        mass[r["e"]] = r["n"]
    size = len(ids) + 1 + ENDINGS
    of, number = np.zeros(size, np.int64), np.zeros(size)
    for k, r in enumerate(frequent):
        e = ending_class(r["word"])
        mass[e] -= r["n"]
        of[k + 1], number[k + 1] = (k if k < OWN_CLASSES else OWN_CLASSES + e), r["n"]
    # One more than counted, for a word that no text had.
    of[len(ids) + 1 :] = OWN_CLASSES + np.arange(ENDINGS)
    number[len(ids) + 1 :] = np.maximum(mass, 0) + 1
    total = np.bincount(of[1:], number[1:], OWN_CLASSES + ENDINGS)
    share = number[1:] / total[of[1:]]
    share[len(ids) :] = 1 / total[of[len(ids) + 1 :]]
    prior = np.log((total + 1) / (total + 1).sum())
    return Vocabulary(ids, of, np.concatenate([[0.0], np.log(share)]), prior, more)


class Network:
    """Embeddings of the words around a place, summed, through tanh to the classes of the masked word."""

    def __init__(self, size: int, prior: np.ndarray, flat: np.ndarray | None = None):
        self.shapes = [(2 * AROUND, size, HIDDEN), (HIDDEN,), (HIDDEN, len(prior)), (len(prior),)]
        if flat is None:
            random = np.random.default_rng(11)
            first = [random.normal(0, 0.1, s) for s in self.shapes[:1]] + [np.zeros(HIDDEN), random.normal(0, 0.1, self.shapes[2]), prior]
            flat = np.concatenate([p.ravel() for p in first])
        self.flat = flat.astype(np.float32)
        self.parts, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            self.parts.append(self.flat[at : at + n].reshape(s))
            at += n
        self.squares = self.cells = None

    def hidden(self, around: np.ndarray) -> np.ndarray:
        tables, bias, _, _ = self.parts
        total = tables[0].take(around[0], 0)
        total += bias
        for k in range(1, 2 * AROUND):
            total += tables[k].take(around[k], 0)
        return np.tanh(total, out=total)

    def _scores(self, hidden: np.ndarray) -> np.ndarray:
        """A row for each class and a column for each place, less the place's largest score."""
        scores = self.parts[2].T @ hidden.T
        scores += self.parts[3][:, None]
        scores -= scores.max(0)
        return scores

    def log_of(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each place's class."""
        log = np.empty(len(target), np.float32)
        for k in range(0, len(target), SLICE):
            own = target[k : k + SLICE]
            scores = self._scores(self.hidden(around[:, k : k + SLICE]))
            log[k : k + SLICE] = scores[own, np.arange(len(own))]
            log[k : k + SLICE] -= np.log(np.exp(scores, out=scores).sum(0))
        return log

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        """One step of the mean log-likelihood, scaled per parameter by its past gradients."""
        tables, *dense = self.parts
        if self.squares is None:
            self.squares = [np.full_like(p, 1e-2) for p in self.parts]
            self.cells = np.arange(tables[0].size).reshape(tables[0].shape)
        back, gradients = np.empty((len(target), HIDDEN)), [np.zeros_like(p) for p in dense]
        for k in range(0, len(target), SLICE):
            own = target[k : k + SLICE]
            hidden = self.hidden(around[:, k : k + SLICE])
            gap = self._scores(hidden)
            np.exp(gap, out=gap)
            gap /= -gap.sum(0)
            gap[own, np.arange(len(own))] += 1
            part = back[k : k + SLICE]
            np.multiply((dense[1] @ gap).T, 1 - hidden**2, out=part)
            for total, more in zip(gradients, (part.sum(0), (gap @ hidden).T, gap.sum(1)), strict=True):
                total += more.astype(np.float32)
        scale, weights = np.float32(1 / np.sqrt(len(target))), back.ravel()
        for table, square, ids in zip(tables, self.squares[0], around, strict=True):
            sums = np.bincount(self.cells.take(ids, 0).ravel(), weights, table.size).reshape(table.shape)
            # Ids that are not in the batch have no gradient, so their parameters stay.
            met = np.flatnonzero(np.bincount(ids, minlength=len(table)))
            g = sums[met].astype(np.float32) * scale
            squares = square[met] + g * g
            square[met] = squares
            table[met] += RATE * g / np.sqrt(squares)
        for p, g, s in zip(dense, gradients, self.squares[1:], strict=True):
            g *= scale
            s += g * g
            p += RATE * g / np.sqrt(s)


def windows(texts: list[np.ndarray], first: int = 0, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts after each other, and for each place the ids around it; beyond a text's ends they are 0.

    Of all places, those from ``first`` on, one of ``every``.
    """
    gap = np.zeros(AROUND, np.uint16)
    joined = np.concatenate([x for t in texts for x in (gap, t)] + [gap]).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + AROUND) - sizes
    at = (np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes))[first::every]
    steps = [k for k in range(-AROUND, AROUND + 1) if k]
    return joined[at], np.stack([joined[at + k] for k in steps])


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in batch.column("ids").to_pylist()]


def train(encoded: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after some rounds: every task goes over its texts from the shared state, then the tasks' models are
    averaged, weighted by their numbers of places."""
    spark, flat = encoded.sparkSession, Network(len(words.of), words.prior).flat
    for nth in range(rounds):
        shared = spark.sparkContext.broadcast((words.of, words.prior, flat))

        def learn(batches: Iterator[pa.RecordBatch], nth=nth, shared=shared) -> Iterator[pa.RecordBatch]:
            of, prior, state = shared.value
            net, waiting, held, seen = Network(len(of), prior, state.copy()), [], 0, 0

            def flush():
                nonlocal held, seen
                centre = np.concatenate([w[0] for w in waiting])
                around = np.concatenate([w[1] for w in waiting], 1)
                waiting.clear()
                for k in range(0, len(centre), BATCH):
                    net.step(around[:, k : k + BATCH], of[centre[k : k + BATCH]])
                seen, held = seen + len(centre), 0

            for batch in batches:
                centre, around = windows(_ids(batch), nth, rounds) if batch.num_rows else (np.empty(0), np.empty((2 * AROUND, 0)))
                if len(centre):
                    waiting.append((centre, around))
                    held += len(centre)
                if held >= BATCH:
                    flush()
            if held:
                flush()
            if seen:
                blocks = [net.flat[k : k + BLOCK] for k in range(0, len(net.flat), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(blocks)), pa.int32()), pa.array([TaskContext.get().partitionId() % SALTS] * len(blocks), pa.int32()),
                        pa.array([float(seen)] * len(blocks)), pa.array([b.tobytes() for b in blocks], pa.binary()),
                    ],
                    ["block", "salt", "weight", "part"],
                )

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            weight = rows["weight"].sum()
            total = sum(np.frombuffer(p, np.float32) * np.float64(w) for p, w in zip(rows["part"], rows["weight"], strict=True))
            part = (total / weight).astype(np.float32).tobytes()
            return pd.DataFrame({"block": rows["block"].iloc[:1], "salt": rows["salt"].iloc[:1], "weight": [weight], "part": [part]})

        schema = "block int, salt int, weight double, part binary"
        found = encoded.select("ids").mapInArrow(learn, schema)
        found = found.groupBy("block", "salt").applyInPandas(mean, schema).groupBy("block").applyInPandas(mean, schema)
        blocks = sorted((r["block"], bytes(r["part"])) for r in found.collect())
        if blocks:
            flat = np.concatenate([np.frombuffer(b, np.float32) for _, b in blocks])
        shared.unpersist()
    return flat


def pseudo_likelihood(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood, perplexity`` for every document.

    Tokens are runs of letters and digits in lower case.  Each token is masked in turn and predicted from the two tokens on either side:
    the network gives the log-probability of its class, the counts of the whole corpus that of the token within its class, each word
    by its own count; a document's score is the sum over all its tokens.  Counts of the frequent words are in the workers, those
    of the others are joined by word, so that no word's score is that of its ending.  As contexts, words beyond the vocabulary
    share the embedding of their ending.  All words of all texts are counted in one aggregation; texts
    are then stored as ids, in two bytes each, for training and scoring.  Training reads all texts, every task
    its own, and averages the tasks' parameters, whose number is fixed; so what is gathered grows with the corpus, but
    neither the driver nor a task ever holds more than one model and a batch.

    Null and empty texts have 0 tokens, a sum of 0 and no mean or perplexity.  Rows that repeat, and rows without an id, give a row
    each.  An empty table gives no rows; other columns are not read.
    """
    spark = session(docs.sparkSession)
    counts = stored(count_words(docs, text_column), "likelihood-counts")
    words = vocabulary(counts)
    known = spark.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36  # rows are numbered, as ids may repeat or be null
        for batch in batches:
            texts = batch.column("body").to_pylist()
            ids, more, rare = zip(*map(known.value.read, texts)) if texts else ((), (), ())
            ids = [x.tobytes() for x in ids]
            columns = [
                pa.array(range(row, row + len(texts)), pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary()),
                pa.array(more, pa.float64()), pa.array(rare, pa.list_(pa.string())),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "ids", "more", "rare"])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("body"))
    encoded = stored(slim.mapInArrow(encode, "row long, doc_id long, ids binary, more double, rare array<string>"), "likelihood-ids")
    shared = spark.sparkContext.broadcast((words.of, words.inside, words.prior, train(encoded, words)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, inside, prior, flat = shared.value
        net = Network(len(of), prior, flat)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = _ids(batch)
            centre, around = windows(texts)
            owner, total = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.zeros(len(texts))
            for k in range(0, len(centre), BATCH):
                own = centre[k : k + BATCH]
                log = net.log_of(around[:, k : k + BATCH], of[own]) + inside[own]
                total += np.bincount(owner[k : k + BATCH], log, len(texts))
            n = np.array([len(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(total + batch.column("more").to_numpy())],
                ["row", "doc_id", "n_tokens", "total"],
            )

    scored = encoded.select("row", "doc_id", "ids", "more").mapInArrow(score, "row long, doc_id long, n_tokens long, total double")
    # A word that Spark splits otherwise than the workers counts as one; all others have their count.
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts, "word")
    logs = rare.groupBy("row").agg(F.sum(F.log("n")).alias("logs"))
    total = F.col("total") + F.coalesce("logs", F.lit(0.0))
    summed = scored.join(logs, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return summed.select("*", mean.alias("mean_log_likelihood"), F.exp(-mean).alias("perplexity"))
