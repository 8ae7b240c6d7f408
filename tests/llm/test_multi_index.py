import math
import random

import numpy as np
import pytest

from fieldloom.llm import multi_index
from fieldloom.llm.multi_index import cells_to_visit, clean_vectors, nearest, pairs_by_distance

SCHEMA = "vec_id bigint, embedding array<double>, label int, query_id int, block string, cell string"


def brute(rows, k, every):
    clean = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, q in clean:
        if i % every == 0:
            found = sorted((-float((np.array(c) * np.array(q)).sum()), j) for j, c in clean if j != i and len(c) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows, k=20, every=20, margin=multi_index.MARGIN):
    vectors = clean_vectors(spark.createDataFrame([(*r, 1, 2, "b", "c") for r in rows], SCHEMA).repartition(3))
    return sorted(map(tuple, nearest(vectors, vectors.where(f"vec_id % {every} = 0"), k, margin).collect()))


def near(found, expected):
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in expected], rel=1e-12)


def spread(rng, n, dim):
    return [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(dim)]) for i in range(n)]


def grouped(rng, n, dim):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(25)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("make, most", [(spread, 1.01), (grouped, 0.5)])
def test_recall(spark, monkeypatch, make, most):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 300)
    monkeypatch.setattr(multi_index, "LOT_ROWS", 40)
    seen = []
    score = multi_index._score
    monkeypatch.setattr(multi_index, "_score", lambda index, visits, keep: seen.append((index, visits)) or score(index, visits, keep))
    rows = make(random.Random(4), 2000, 16)
    found, expected = run(spark, rows), brute(rows, 20, 20)
    hits = {r[:1] + r[2:3] for r in found} & {r[:1] + r[2:3] for r in expected}
    assert len(found) == len(expected) and len(hits) >= 0.9 * len(expected)
    scores = {(i, j): float((np.array(a) * np.array(b)).sum()) for i, a in rows if i % 20 == 0 for j, b in rows}
    assert all(s == pytest.approx(scores[q, j], rel=1e-12) for q, _, j, s in found)
    index = seen[0][0]
    scored = sum(int(index.counts[16][np.frombuffer(r.cells, "<i4")].sum()) for _, v in seen for r in v.collect())
    assert scored <= most * 100 * 2000


def test_equal_vectors_and_ties(spark, monkeypatch):
    """A vector that a third of the rows share: its smallest ids, never the query's own."""
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 64)
    rng = random.Random(8)
    rows = spread(rng, 400, 6)
    rows += [(400 + i, rows[7][1]) for i in range(200)]
    near(run(spark, rows, 5, 10, 1e9), brute(rows, 5, 10))


def test_odd_and_empty_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [inf, 1.0]), (4, [nan, 1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (7, [0.0, 0.0])]
    rows += [(20, [3.0]), (21, [2.0]), (21, [2.0]), (40, []), (60, [9.0, 9.0, 9.0]), (80, [1.0, 2.0]), (80, [-1.0, 2.0]), (100, [0.0, -0.0])]
    near(run(spark, rows), brute(rows, 20, 20))
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (20, [2.0])], 3) == [(20, 1, 1, 2.0)]


def test_pairs_come_by_sum():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(pairs_by_distance(a, b))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(7) for j in range(5)]
    assert [s for s, _, _ in got] == sorted(s for s, _, _ in got)
    assert all(s == pytest.approx(a[i] + b[j]) for s, i, j in got)


def test_second_visit_takes_every_cell_above_the_limit():
    rng = np.random.default_rng(5)
    books = tuple(rng.normal(size=(6, 4)) for _ in range(2))
    book = multi_index.Book(3, books, (20.0, 20.0), (0.01, 0.02))
    counts, query = rng.integers(0, 4, 36), rng.normal(size=6)
    first = cells_to_visit(query, book, counts, 5, None)
    assert sum(counts[first]) >= 5 > sum(counts[first[:-1]])
    estimate = np.add.outer(books[0][:, :3] @ query[:3], books[1][:, :3] @ query[3:]).ravel()
    spread_ = (float(query[:3] @ query[:3]) * 0.01 + float(query[3:] @ query[3:]) * 0.02) ** 0.5
    limit = float(np.median(estimate))
    more = cells_to_visit(query, book, counts, 5, limit + multi_index.MARGIN * spread_)
    assert set(first) | set(more) >= {c for c in range(36) if counts[c] and estimate[c] >= limit + 1e-9} and not set(first) & set(more)
