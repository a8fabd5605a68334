"""Vector codes against plain loops over whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from ruleloom.llm.vector_codes import compress_vectors, digits, gathered, number

KIND = "vec_id long, embedding array<float>, label int, vector string, code string, error string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", None, "x") for r in rows], KIND)


def by_loops(rows):
    """The definition, number by number; rows are (id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    step = len(kept[0][1]) // 16
    cut = [[v[p * step:(p + 1) * step] for p in range(16)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:64]] for p in range(16)]

    def near(part, entries):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(entries))

    for _ in range(2):
        after = []
        for p in range(16):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], book[p])[1]].append(c[p])
            after.append([[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else e for n, e in enumerate(book[p])])
        book = after
    found = [[near(c[p], book[p]) for p in range(16)] for c in cut]
    errors = [min(sum(d for d, _ in f), 2**63 - 1) for f in found]
    label = defaultdict(int)
    for (_, _, n), e in zip(kept, errors):
        label[n] = min(label[n] + e, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return [(i, "".join(f"{n:02x}" for _, n in f), e, label[l], digest) for (i, _, l), f, e in zip(kept, found, errors)]


def check(spark, rows):
    got = [tuple(r) for r in compress_vectors(table(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(by_loops(rows), key=str)
    return got


def vectors(seed, count, spread=0.2):
    dice = random.Random(seed)
    return [(n, [dice.choice([dice.gauss(0, spread), -0.0, 0.25]) for _ in range(32)], dice.choice([None, 1, 1, 2])) for n in range(count)]


def rounded(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]


def test_against_loops(spark):
    check(spark, rounded(vectors(1, 150)))


def test_ties_repeats_and_missing(spark):
    rows = rounded(vectors(2, 70))
    rows += rows[:40] + [(None, rows[3][1], None), (None, rows[4][1], 7), (900, None, 1), (901, rows[0][1][:-1] + [None], 1)]
    rows += [(902, rows[0][1][:-1] + [float("nan")], 1), (903, rows[0][1][:-1] + [float("-inf")], 1), (5, rows[9][1], 1)]
    assert len(check(spark, rows)) == 113


def test_fewer_vectors_than_entries_and_none(spark):
    assert len(check(spark, rounded(vectors(3, 5)))) == 5
    assert check(spark, []) == []
    assert len(check(spark, [(1, [], 1), (2, [], None)])) == 2


def test_huge_components_are_exact(spark):
    rows = rounded([(n, [(-1) ** k * (n + 1) * 10.0 ** ((n + k) % 37 - 1) for k in range(16)], 1) for n in range(80)])
    assert max(r[2] for r in check(spark, rows)) == 2**63 - 1


def test_other_lengths(spark):
    rows = rounded(vectors(4, 20))
    got = {r["vec_id"]: r for r in compress_vectors(table(spark, [*rows, (50, [1.0] * 16, 1)])).collect()}
    assert got[50]["code"] is None and got[50]["error"] is None
    assert got[3]["code"] == {r[0]: r[1] for r in by_loops(rows)}[3]
    with pytest.raises(ValueError, match="equal parts"):
        compress_vectors(table(spark, [(1, [1.0] * 17, 1)]))


def test_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(3))}) for _ in range(5)]
    assert [len(t) for t in gathered(iter(batches), rows=5)] == [6, 6, 3]
    assert list(gathered(iter([]))) == []


def test_digits():
    for x in (0, 1, -1, 10**45, -(10**45), 2**40, -(2**40) - 7):
        assert number(digits(x)) == x
    assert number([a + b for a, b in zip(digits(-(10**41)), digits(10**41 + 5))]) == 5
