"""Benchmark passages in training texts, found by spaced seeds.  DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fine_sieve, passes_fine, session, sieve_bits, stored, text_of, word_hashes

# A seed spans this many words.  Words four apart make a comb of three; a mask compares two of a window's four combs and
# ignores the others, six words of twelve.  Wherever two words are substituted, one mask ignores both.
SPAN, COMBS = 12, 4
MASKS = list(combinations(range(COMBS), 2))
# A window is contaminated if so many of its words agree with a benchmark window, in place.
AGREE = 10
# Around a hit, texts are compared along their diagonal over so many words more on either side, as far as both reach;
# they also share a passage if five of six words of that overlap agree.
REACH = 24
PASSAGE_AGREE, PASSAGE_OF = 5, 6
# The sieves take 1 MB at most, as four and one of them go into every task.
MOST_BITS = 1 << 23


def _combed(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, word, comb``: a text's word hashes, and at each place the hash of the words there, four and eight places on."""
    # As the only element of an array, the words are made once: the optimiser would write their expression into the loop below.
    words = rows.select(F.col(key), F.explode(F.array(word_hashes(text))).alias("word"))
    places = F.when(F.size("word") >= SPAN, F.sequence(F.lit(0), F.size("word") - 2 * COMBS - 1))
    comb = F.transform(places, lambda p: F.xxhash64(*(F.get("word", p + COMBS * n) for n in range(SPAN // COMBS))))
    return words.select(key, "word", F.explode(F.array(comb)).alias("comb"))


def _windows(combed: DataFrame, key: str) -> DataFrame:
    """One row for each place ``at`` where SPAN words begin."""
    return combed.select(key, "word", "comb", F.explode(F.sequence(F.lit(0), F.size("comb") - COMBS)).alias("at"))


def _comb(n: int) -> Column:
    return F.get("comb", F.col("at") + n)


def _seed(mask: int) -> Column:
    a, b = MASKS[mask]
    return F.xxhash64(F.lit(mask), _comb(a), _comb(b))


def _surrounded(windows: DataFrame, key: str) -> DataFrame:
    """``key, at, before, around, mask, seed`` for every mask: ``around`` are the words around a window, ``before`` of them in front of it."""
    before = F.least("at", F.lit(REACH))
    around = F.slice("word", F.col("at") - before + 1, before + SPAN + REACH)
    seeds = F.array(*(F.struct(F.lit(k).alias("mask"), _seed(k).alias("seed")) for k in range(len(MASKS))))
    return windows.select(key, "at", before.alias("before"), around.alias("around"), F.inline(seeds))


def _numbered(seeds: DataFrame, key: str, number: str, name: str) -> DataFrame:
    """Each window once, with a number and its seeds; of windows that repeat in a text with all around them, the first."""
    once = seeds.groupBy(key, "before", "around").agg(F.min("at").alias("at"), F.collect_set(F.struct("mask", "seed")).alias("seeds"))
    return stored(once.withColumn(number, F.monotonically_increasing_id()), name)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item that share a passage: ``doc_id, item_id, doc_at, item_at, agreeing, overlap, overlap_agreeing``.

    Words are runs of letters and digits in lower case.  Windows of 12 words that are equal under a mask are a hit.  A hit counts if
    10 of its 12 words are the same in the same place, or five of six words of the whole overlap around it: along the diagonal, up
    to 24 words to either side as far as both texts reach, so the whole of a short item.  Any two substituted words of a window leave a mask
    whole.  ``agreeing`` is the best window's number of equal words, then the overlap's; the places are those of the first such window.

    At every place of a text three words are hashed once.  A sieve of the benchmark's combs drops, at the scan and before any seed is
    made, windows with fewer than two known combs; a sieve of its seeds drops most of the others.  What is left, about as many
    rows as there are hits, is joined on the seed, by number of window; the words around a window follow once for each pair.
    Spark broadcasts the benchmark's tables if they are below its size limit, else it shuffles both sides, and
    splits a seed that many documents share.  Windows that repeat with all their surroundings count once.

    Null texts are empty.  Texts and items of fewer than 12 words have no window and match nothing.  Repeated rows give
    the same pair once.  Rows without an id are compared too and give a pair with a null.  Empty tables give no pairs.
    """
    session(docs.sparkSession)
    left = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("body"))
    right = benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("body"))

    combed = _combed(right, "item_id", text_of("body"))
    items = _numbered(_surrounded(_windows(combed, "item_id"), "item_id"), "item_id", "item_window", "leaks-items")
    item_seeds = stored(items.select("item_window", F.inline("seeds")), "leaks-seeds")
    known = stored(combed.select(F.explode("comb").alias("hash")).distinct(), "leaks-combs")
    comb_size, seed_size = sieve_bits(known.count(), most=MOST_BITS), sieve_bits(item_seeds.count(), most=MOST_BITS)
    comb_bits = stored(fine_sieve(known, "hash", comb_size), "leaks-sieve").scalar()
    seed_bits = stored(fine_sieve(item_seeds, "seed", seed_size), "leaks-sieve").scalar()

    # Both filters are compiled with what is below them; a function of arrays in them would make Spark copy a text for each window.
    familiar = sum((passes_fine(comb_bits, _comb(n), comb_size).cast("int") for n in range(COMBS)), F.lit(0))
    windows = _windows(_combed(left, "doc_id", text_of("body")), "doc_id").filter(familiar >= 2)
    hits = _surrounded(windows, "doc_id").filter(passes_fine(seed_bits, F.col("seed"), seed_size))
    found = _numbered(hits, "doc_id", "window", "leaks-windows")

    seeds = found.select("window", F.inline("seeds"))
    pairs = seeds.join(item_seeds, ["mask", "seed"]).select("window", "item_window").distinct()
    own = items.select("item_window", "item_id", *(F.col(c).alias(f"item_{c}") for c in ("at", "before", "around")))
    met = pairs.join(found.drop("seeds"), "window").join(own, "item_window")

    front = F.least("before", "item_before")
    length = front + F.least(F.size("around") - F.col("before"), F.size("item_around") - F.col("item_before"))
    same = F.zip_with(
        F.slice("around", F.col("before") - front + 1, length), F.slice("item_around", F.col("item_before") - front + 1, length),
        lambda x, y: (x == y).cast("int"))
    compared = met.select("doc_id", "item_id", F.col("at").alias("doc_at"), "item_at", front.alias("front"), length.alias("overlap"), same.alias("same"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda so_far, one: so_far + one)

    judged = compared.select(
        "doc_id", "item_id", "doc_at", "item_at", "overlap", total(F.slice("same", F.col("front") + 1, SPAN)).alias("agreeing"),
        total(F.col("same")).alias("overlap_agreeing"))
    leaks = judged.filter((F.col("agreeing") >= AGREE) | (F.col("overlap_agreeing") * PASSAGE_OF >= F.col("overlap") * PASSAGE_AGREE))
    best = F.min(F.struct(
        (-F.col("agreeing")).alias("worse"), (-F.col("overlap_agreeing")).alias("less"), "overlap", "doc_at", "item_at")).alias("best")
    return leaks.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.doc_at", "best.item_at", (-F.col("best.worse")).alias("agreeing"), "best.overlap",
        (-F.col("best.less")).alias("overlap_agreeing"))


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


#: The definition by the words themselves, for DuckDB.
SQL = f"""
WITH docs AS (
  SELECT doc_id, {_words_sql('text')} AS word FROM documents
), items AS (
  SELECT item_id, {_words_sql('text')} AS word FROM benchmark
), dw AS (
  SELECT doc_id, pos, word[pos + 1 : pos + {SPAN}] AS w FROM docs, LATERAL (SELECT unnest(range(len(word) - {SPAN - 1})) AS pos)
), iw AS (
  SELECT item_id, pos, word[pos + 1 : pos + {SPAN}] AS w FROM items, LATERAL (SELECT unnest(range(len(word) - {SPAN - 1})) AS pos)
), masks AS (
  SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(MASKS))}) m(k, a, b)
), bs AS (
  SELECT item_id, pos, k, array_to_string(list_filter(w, lambda x, i: (i - 1) % {COMBS} IN (a, b)), ' ') AS seed FROM iw, masks
), ds AS (
  SELECT doc_id, pos, k, array_to_string(list_filter(w, lambda x, i: (i - 1) % {COMBS} IN (a, b)), ' ') AS seed FROM dw, masks
), hits AS (
  SELECT DISTINCT doc_id, item_id, ds.pos AS doc_at, bs.pos AS item_at FROM ds JOIN bs ON ds.k = bs.k AND ds.seed = bs.seed
), spans AS (
  SELECT h.*, d.word AS dword, i.word AS iword, least(doc_at, item_at, {REACH}) AS front,
    least(len(d.word) - doc_at, len(i.word) - item_at, {SPAN + REACH}) AS behind
  FROM hits h JOIN docs d USING (doc_id) JOIN items i USING (item_id)
), same AS (
  SELECT doc_id, item_id, doc_at, item_at, front, front + behind AS overlap, list_transform(range(-front, behind), lambda p:
    CASE WHEN dword[doc_at + p + 1] = iword[item_at + p + 1] THEN 1 ELSE 0 END) AS same FROM spans
), judged AS (
  SELECT *, list_sum(same[front + 1 : front + {SPAN}]) AS agreeing, list_sum(same) AS overlap_agreeing FROM same
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, overlap_agreeing DESC, overlap, doc_at, item_at) AS r
  FROM judged WHERE agreeing >= {AGREE} OR overlap_agreeing * {PASSAGE_OF} >= overlap * {PASSAGE_AGREE}
)
SELECT doc_id, item_id, CAST(doc_at AS INTEGER) AS doc_at, CAST(item_at AS INTEGER) AS item_at, CAST(agreeing AS INTEGER) AS agreeing,
  CAST(overlap AS INTEGER) AS overlap, CAST(overlap_agreeing AS INTEGER) AS overlap_agreeing
FROM ranked WHERE r = 1
"""
