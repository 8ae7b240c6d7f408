import random

import pytest

from fieldloom.operators.ordering import Running, with_position, with_running

RUNS = {
    "rn": Running("number"),
    "total": Running("sum", "v"),
    "best": Running("max_before", "v"),
    "prev": Running("lag", "v"),
}


def rows_with_a_hot_group(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(12)}"
        rows.append((key if i % 50 else None, i, rng.choice([None, *range(30)])))
    rng.shuffle(rows)
    return rows


def brute_force(rows):
    out = []
    for key in {r[0] for r in rows}:
        total = best = prev = None
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for rn, (_, o, v) in enumerate(group, 1):
            if v is not None:
                total = v + (total or 0)
            out.append((key, o, v, rn, total, best, prev))
            if v is not None:
                best = v if best is None else max(best, v)
            prev = v
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_running_values_match_brute_force(spark, partitions):
    rows = rows_with_a_hot_group()
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    got = with_running(df, ["k"], ["o"], RUNS, partitions)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)


def test_positions_are_dense_in_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as o").repartition(6)
    got = sorted((r["o"], r["pos"]) for r in with_position(df, ["o"], partitions=9).collect())
    assert got == [(i, i) for i in range(1000)]
