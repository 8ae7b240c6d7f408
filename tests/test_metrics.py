import math

import numpy as np
import pytest

from fieldloom.operators import metrics
from fieldloom.schema import OUTCOME, Dictionary, Field

STATS = {"mean": 2.0, "sd": 1.5, "min": 0, "max": 3, "default": 0}
FIELDS = Dictionary(
    [
        Field(f"participants.{i}.{n}", "int", h, OUTCOME, occurrence="per-participant", **STATS)
        for i in (0, 5)
        for n, h in (("u", "unary"), ("c", "continuous"), ("b", "bool"))
    ]
    + [Field("lane", "enum", "one-hot", OUTCOME, levels=("x", "y", "z"), default="x")]
)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    width = FIELDS.width(OUTCOME)
    y = (rng.random((60, width)) > 0.5).astype(float)
    z = rng.normal(size=(60, width))
    rows = [(i, y[i].tolist(), z[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, y array<double>, z array<double>").repartition(5)
    return df, y, z


def spans():
    return {s.field.path: slice(s.start, s.stop) for s in FIELDS.portion_spans(OUTCOME)}


def table(df):
    return {(r["metric"], r["field"]): (r["loss"], r["accuracy"], r["accuracy_weight"]) for r in df.collect()}


def test_parts_match_the_definitions(scored):
    df, y, z = scored
    got = table(metrics.eval_parts(df, FIELDS))
    at = spans()

    def hinge(c):
        return np.mean([max(0.0, 1 - (2 * a - 1) * b) for a, b in zip(y[:, c].ravel(), z[:, c].ravel())])

    c = at["participants.0.c"]
    e = np.abs(y[:, c] - z[:, c])
    assert got["continuous", f"{c.start}:{c.stop}"] == pytest.approx((e.sum(1).mean(), (1 / (1 + e)).sum(1).mean(), 1))
    c = at["participants.5.b"]
    assert got["bool", "participants.5.b"] == pytest.approx((hinge(c), np.mean((z[:, c] > 0) == (y[:, c] > 0)), 1))
    c = at["participants.0.u"]
    off = np.abs((z[:, c] > 0).sum(1) - y[:, c].sum(1)) / 1.5
    assert got["unary", "participants.0.u"] == pytest.approx((hinge(c), np.mean(1 / (off + 1)), 1))
    c = at["lane"]
    same = np.mean(z[:, c].argmax(1) == y[:, c].argmax(1))
    assert got["one-hot", "lane"] == pytest.approx((hinge(c), same, 1))

    def dev(v):
        return np.abs(v - v.mean()).mean()

    c = at["participants.0.u"]
    assert got["spread", "participants.0.u"][0] == pytest.approx(abs(dev(z[:, c] * 1.5) - dev(y[:, c])) / 1.5)
    a, b = at["participants.0.u"], at["participants.5.u"]
    gap = np.abs(np.abs(z[:, a] - z[:, b]) - np.abs(y[:, a] / 1.5 - y[:, b] / 1.5)).mean() / 10
    assert got["team_gap", "participants.*.u"][0] == pytest.approx(gap)
    assert len(got) == 2 + 2 + 2 + 1 + 4 + 2
    row = metrics.combine(metrics.eval_parts(df, FIELDS)).first()
    assert row["loss"] == pytest.approx(np.mean([v[0] for v in got.values()]))
    assert row["accuracy"] == pytest.approx(
        sum(v[1] for v in got.values() if v[1] is not None) / sum(v[2] for v in got.values())
    )


def test_ignored_fields_are_left_out(scored):
    df, _, _ = scored
    got = table(metrics.eval_parts(df, FIELDS, ignored={"participants.0.u", "lane"}))
    assert ("unary", "participants.0.u") not in got and ("one-hot", "lane") not in got
    assert ("spread", "participants.0.u") not in got


def test_win_metrics(spark):
    rows = [(30.0, 1.0), (-30.0, 1.0), (0.5, 0.0), (-2.0, 0.0)]
    r = metrics.eval_win(spark.createDataFrame(rows, "z double, y double")).first()
    ce = sum(math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z)) for z, y in rows)
    assert r["loss"] == pytest.approx(ce) and r["accuracy"] == 0.5 and r["n"] == 4


def test_histogram_edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("f", v) for v in (-1.0, 0.0, 0.9, 1.0, 9.99, 10.0, 11.0)], "field string, value double")
    got = {r["bucket"]: r["n"] for r in metrics.histogram(df, F.lit(0.0), F.lit(10.0), 10).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 10: 1, 11: 2}


def test_sketch_buckets_hold_their_values_in_order(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([
        rng.normal(size=300) * 10.0 ** rng.integers(-30, 30, 300), [0.0, -0.0, 1.0, 2.0, 1024.0, 0.5, -4.0, 5e-324, 1.7e308, -1.7e308, 3.0],
        np.nextafter(2.0 ** np.arange(-40, 40), 0), 2.0 ** np.arange(-40, 40),
    ])
    rows = [("a" if i % 2 else "b", float(v)) for i, v in enumerate(values)] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "field string, value double").repartition(3)
    got = metrics.sketch_ranges(df.selectExpr("value", f"{metrics.sketch_bucket('value')} as bucket").where("bucket is not null")).orderBy("value").collect()
    assert len(got) == len(values) and [r.bucket for r in got] == sorted(r.bucket for r in got)
    for r in got:
        inside = r.low <= r.value < r.high if r.bucket > 0 else r.low < r.value <= r.high if r.bucket else r.value == 0
        # The ends of a bucket of the very smallest numbers are rounded to each other.
        assert abs(r.value) < 1e-300 or inside and abs(r.high / 2 - r.low / 2) <= abs(r.value / 2) / 16
    whole = metrics.sketch(df)
    parts = metrics.merge_sketches(metrics.sketch(df.where("value < 1")), metrics.sketch(df.where("value >= 1")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.where("bucket is not null").collect()))
    for r in metrics.sketch_quantiles(whole, (0.0, 0.25, 0.5, 1.0)).collect():
        own = sorted(v for f, v in rows if f == r.field and v is not None and v == v)
        exact = own[max(1, math.ceil(r.share * len(own))) - 1]
        assert r.low <= exact <= r.high
