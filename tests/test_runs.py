import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import runs


def test_spec():
    spec = runs.CriteriaSpec.parse("samples1e3:stagnant:stagnant5,0.5:seconds60")
    assert spec.samples == (1000,) and spec.seconds == (60.0,)
    assert spec.stagnant == ((30, (0.75, 0.8)), (5, (0.5,)))
    assert runs.CriteriaSpec.parse("never") == runs.CriteriaSpec()
    with pytest.raises(ValueError):
        runs.CriteriaSpec.parse("epochs3")


@pytest.mark.parametrize("partitions", [9, None])
def test_best_and_stagnation_against_loops(spark, partitions):
    rng = random.Random(6)
    logs = {r: [rng.randrange(20) for _ in range(n)] for r, n in ((1, 80), (2, 12), (3, 40))}
    rows = [(r, i, float(v)) for r, values in logs.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "run int, ts int, loss double").withColumnRenamed("ts", "at")
    best = runs.best_checkpoint(log, ["at"], "loss", partitions=partitions)
    want = {(r, i + 1) for r, vs in logs.items() for i, v in enumerate(vs) if all(v > u for u in vs[:i])}
    assert {(r["run"], r["step"]) for r in best.collect()} == want

    def first_stop(values, min_log, points):
        for n in range(1, len(values) + 1):
            seen = values[:n]
            if n >= min_log and all(seen[math.floor(p * (n - 1))] < seen[-1] for p in points):
                return n
        return None

    steps = runs.number_steps(log, ["at"], partitions=partitions)
    got = {r["run"]: r["stop_step"] for r in runs.stop_stagnation(steps, 10, (0.5, 0.9)).collect()}
    want = {r: first_stop(vs, 10, (0.5, 0.9)) for r, vs in logs.items()}
    assert got == {r: s for r, s in want.items() if s is not None}


def test_elapsed_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(runs, "STEP_BLOCK", 4)
    rows = [(r, i + 1, i * gap) for r, gap, n in ((1, 10, 30), (2, 3, 50), (3, 100, 1)) for i in range(n)]
    steps = spark.createDataFrame(rows, "run int, step bigint, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["run"]: r["stop_step"] for r in runs.stop_elapsed(steps, 100).collect()}
    assert got == {1: 11, 2: 35}


def test_never_stops_nothing(spark):
    steps = spark.createDataFrame([(1, 1, 0.5, 0)], "run int, step bigint, loss double, ts int")
    assert runs.stop_any(steps, "never", 10).count() == 0


@pytest.mark.parametrize("bs, test_k, train_k", [(2048, 50_000, 100_000), (2048, 50_000, 20_000), (7, 20, 3), (100, 30, 60)])
def test_cadence_against_the_counters(spark, bs, test_k, train_k):
    test = train = 0
    want = []
    for i in range(120):
        test, train = test + bs, train + bs
        do_test = i == 0 or test >= test_k
        do_train = do_test or train >= train_k
        want.append((i + 1, do_test, do_train))
        if do_train:
            train = 0
        if do_test:
            test = 0
    steps = spark.range(1, 121).withColumnRenamed("id", "step")
    got = runs.evaluation_cadence(steps, bs, test_k, train_k).orderBy("step").collect()
    assert [(r["step"], r["evaluates"], r["train_evaluates"]) for r in got] == want


@pytest.mark.parametrize("bs, test_k, train_k", [(2048, 50_000, 100_000), (2048, 50_000, 7_000), (9_000, 2_000, 50), (100, 1_000, 30), (70, 300, 300)])
def test_cadence_with_remainder(spark, monkeypatch, bs, test_k, train_k):
    monkeypatch.setattr(runs, "STEP_BLOCK", 37)
    test = train = 0
    want = []
    for i in range(200):
        test, train = test + bs, train + bs
        do_test = i == 0 or test >= test_k
        do_train = do_test or train >= train_k
        want.append((do_test, do_train))
        test = max(0, test - test_k) if do_test else test
        train = max(0, train - train_k) if do_train else train
    steps = spark.range(1, 201).withColumnRenamed("id", "step")
    got = runs.evaluation_cadence(steps, bs, test_k, train_k, keep_remainder=True).orderBy("step").collect()
    assert [(r["evaluates"], r["train_evaluates"]) for r in got] == want


@pytest.mark.parametrize("bs, test_k, train_k", [(2048, 50_000, 7_000), (30, 100, 70), (70, 330, 90)])
def test_cadence_of_far_steps(spark, bs, test_k, train_k):
    test, train, states, want = 0, 0, {}, []
    while (test, train) not in states or not want:
        states[test, train] = len(want)
        test, train = test + bs, train + bs
        do_test = not want or test >= test_k
        do_train = do_test or train >= train_k
        want.append(do_train)
        test = max(0, test - test_k) if do_test else test
        train = max(0, train - train_k) if do_train else train
        if len(want) == 1:
            states = {}
    first = states[test, train]
    length = len(want) - first
    far = [first + 10**12 // length * length + i for i in range(length)]
    steps = spark.createDataFrame([(i + 1,) for i in far], "step bigint")
    got = runs.evaluation_cadence(steps, bs, test_k, train_k, keep_remainder=True).orderBy("step").collect()
    assert [r["train_evaluates"] for r in got] == want[first:]
