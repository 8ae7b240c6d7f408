import math
import random

import pytest

from fieldloom.llm import impact_search
from fieldloom.llm.impact_search import clean_vectors, top_k


def brute(rows, k):
    import math

    clean = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for i, q in clean:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in clean if j != i and len(c) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    vectors = clean_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, query int, score int").repartition(3))
    return sorted(map(tuple, top_k(vectors, vectors.where("vec_id % 50 = 0"), k).collect()))


@pytest.mark.parametrize("block, lot, few", [(16_384, 256, 256), (64, 3, 256), (300, 100, 2)])
def test_against_brute_force(spark, monkeypatch, block, lot, few):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(impact_search, "QUERY_ROWS", lot)
    monkeypatch.setattr(impact_search, "FEW_ROWS", few)
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)], 0, 1, 2) for i in range(500)]
    rows += [(500 + i, centres[0], 0, 1, 2) for i in range(120)]  # ties
    assert run(spark, rows) == brute(rows, 5)


def test_odd_and_empty_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [inf, 1.0]), (4, [nan, 1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (7, [0.0, 0.0])]
    rows += [(50, [3.0]), (51, [2.0]), (100, []), (101, []), (150, [9.0, 9.0, 9.0])]
    rows = [(*r, None, None, None) for r in rows]
    assert run(spark, rows) == brute(rows, 5) and len(run(spark, rows)) == 4
    assert run(spark, []) == []
    twice = [(0, [1.0], 0, 0, 0)] * 2 + [(i, [1.0], 0, 0, 0) for i in range(1, 9)]
    assert run(spark, twice) == sorted([(0, r, r, 65536) for r in range(1, 6)] * 2)


def test_sums_beyond_a_long(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e15, 2.0]), (2, [2e14, 0.0]), (3, [-1e16, 3.0]), (4, [1e15, 1.0]), (5, [0.0, 9.0])]
    rows += [(50, [5e9, 2.0]), (100, [1e300, -1e300]), (6, [2.0, 5e9])]
    ends = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    clean = [(i, [ends(math.floor(256 * x)) for x in v]) for i, v in rows]
    out = []
    for i, q in clean:
        if i % 50 == 0:
            found = sorted((-ends(sum(a * b for a, b in zip(q, c))), j) for j, c in clean if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found[:5], 1)]
    assert run(spark, [(*r, 0, 1, 2) for r in rows]) == sorted(out)
