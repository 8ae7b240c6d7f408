"""Evaluation aggregates over encoded truth and logits.

Batches are summed in the tasks that read them; a shuffle carries one row per
task, metric and field.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.decode import argmax, count_above, cut
from fieldloom.functions.evaluation import Plan, mean_sums, part_sums, report_sums
from fieldloom.functions.network import apply_heads, forward, row_batches, to_matrix
from fieldloom.functions.text import literal, name
from fieldloom.schema import OUTCOME, Dictionary
from fieldloom.session import ship_package


def accumulate(df: DataFrame, inputs, fn, dtype="float64") -> DataFrame:
    """(metric, field, loss, accuracy, n) sums over all rows.

    ``fn(*matrices)`` gives the sums of one batch; each task adds up its batches
    and emits one row per metric and field, however many records it read.
    """
    ship_package(df.sparkSession)
    inputs = list(inputs)

    def run(batches):
        sums: dict = {}
        rows = 0
        for batch in row_batches(batches):
            rows += batch.num_rows
            for key, (loss, accuracy) in fn(*[to_matrix(batch.column(c), dtype, c) for c in inputs]).items():
                before = sums.get(key, (0.0, 0.0))
                sums[key] = (before[0] + float(loss), before[1] + float(accuracy))
        if sums:
            yield pa.RecordBatch.from_pydict(
                {
                    "metric": [k[0] for k in sums],
                    "field": [k[1] for k in sums],
                    "loss": [v[0] for v in sums.values()],
                    "accuracy": [v[1] for v in sums.values()],
                    "n": pa.array([rows] * len(sums), pa.int64()),
                }
            )

    parts = df.select(*inputs).mapInArrow(run, "metric string, field string, loss double, accuracy double, n bigint")
    return parts.groupBy("metric", "field").agg(
        F.sum("loss").alias("loss"), F.sum("accuracy").alias("accuracy"), F.sum("n").alias("n")
    )


def _spans(dictionary: Dictionary, handlings, ignored=()) -> list[tuple]:
    return [
        (s.field.path, s.start, s.width, float(s.field.sd) if s.field.sd else 1.0)
        for s in dictionary.portion_spans(OUTCOME)
        if s.field.handling in handlings and s.field.path not in ignored
    ]


def continuous_runs(dictionary: Dictionary, ignored=()) -> list[tuple]:
    """Runs of adjacent continuous columns, named by their range."""
    runs: list[list[int]] = []
    for _, start, width, _ in _spans(dictionary, ("continuous",), ignored):
        if runs and runs[-1][1] == start:
            runs[-1][1] = start + width
        else:
            runs.append([start, start + width])
    return [(f"{a}:{b}", a, b - a) for a, b in runs]


def team_gap_terms(dictionary: Dictionary, ignored=(), team: int = 5) -> list[tuple]:
    """(statistic, weight, signed members): (+) first team, (-) second.

    Per-participant statistics are summed over the members and weigh 1/10,
    per-team statistics 1/2.
    """
    grouped: dict[str, list] = {}
    for s in dictionary.portion_spans(OUTCOME):
        f = s.field
        if f.handling not in ("unary", "continuous") or f.occurrence == "single" or f.path in ignored:
            continue
        slot = int(f.path.split(".")[1])
        participant = f.occurrence == "per-participant"
        sign = 1.0 if slot < (team if participant else 1) else -1.0
        _, members = grouped.setdefault(f.family, (0.1 if participant else 0.5, []))
        members.append((s.start, s.width, sign, float(f.mean), float(f.sd)))
    return [(stat, weight, members) for stat, (weight, members) in grouped.items()]


PARTS = ("continuous", "bool", "unary", "one-hot", "spread", "team_gap")


def evaluation_plan(dictionary: Dictionary, ignored=(), parts=PARTS) -> Plan:
    """Which encoded columns each part of the loss looks at."""
    plan = Plan()
    if "continuous" in parts:
        plan.runs = continuous_runs(dictionary, ignored)
    if "bool" in parts:
        plan.bools = _spans(dictionary, ("bool",), ignored)
    if "unary" in parts:
        plan.unaries = _spans(dictionary, ("unary",), ignored)
    if "one-hot" in parts:
        plan.onehots = _spans(dictionary, ("one-hot",), ignored)
    if "spread" in parts:
        plan.spreads = _spans(dictionary, ("unary", "continuous"), ignored)
    if "team_gap" in parts:
        plan.gaps = team_gap_terms(dictionary, ignored)
    return plan


def logits_of(network, activation: str = "leaky-relu"):
    """Logits from the input matrix inside a task; identity without a network.

    ``network`` is a broadcast handle, opened on the executor.
    """
    if network is None:
        return lambda x: x
    return lambda x: forward(x, [(w.astype(x.dtype), b.astype(x.dtype)) for w, b in network.value], activation)


def eval_parts(
    df: DataFrame,
    dictionary: Dictionary,
    ignored=(),
    parts=PARTS,
    y: str = "y",
    x: str = "z",
    network=None,
    activation: str = "leaky-relu",
    dtype: str = "float64",
) -> DataFrame:
    """Parts of the combined loss: (metric, field, loss, accuracy, accuracy_weight).

    ``x`` holds logits, or the inputs of ``network``, which is then applied in
    the same pass.  The spread compares deviations from the overall means; these
    take a pass of their own and come to the driver, one row per field.
    """
    plan = evaluation_plan(dictionary, ignored, parts)
    logits = logits_of(network, activation)
    if plan.spreads:
        means = accumulate(df, [y, x], lambda t, v: mean_sums(t, logits(v), plan), dtype)
        plan.means = {r["field"]: (r["accuracy"] / r["n"], r["loss"] / r["n"]) for r in means.collect()}
    sums = accumulate(df, [y, x], lambda t, v: part_sums(t, logits(v), plan), dtype)
    widths = [(name, float(width)) for name, _, width in plan.runs]
    widths += [(name, float(width)) for name, _, width, _ in plan.bools]
    sds = [(name, sd) for name, _, _, sd in plan.spreads]
    return _finish(sums, dict(widths), dict(sds))


def _lookup(values: dict, default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = [F.lit(v) for item in values.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("field")), F.lit(default))


def _finish(sums: DataFrame, widths: dict, sds: dict) -> DataFrame:
    loss, accuracy = F.col("loss") / F.col("n"), F.col("accuracy") / F.col("n")
    spread, gap = F.col("metric") == "spread", F.col("metric") == "team_gap"
    weight = F.when(F.col("metric").isin("continuous", "bool"), _lookup(widths, 1.0)).otherwise(F.lit(1.0))
    return sums.select(
        "metric",
        "field",
        F.when(spread, F.abs(loss - accuracy) / _lookup(sds, 1.0)).otherwise(loss).alias("loss"),
        F.when(~(spread | gap), accuracy).alias("accuracy"),
        F.when(spread | gap, F.lit(0.0)).otherwise(weight).alias("accuracy_weight"),
    )


def eval_continuous(df: DataFrame, dictionary: Dictionary, ignored=()) -> DataFrame:
    """Absolute error and closeness per run of continuous columns."""
    return eval_parts(df, dictionary, ignored, ("continuous",))


def eval_bool(df: DataFrame, dictionary: Dictionary, ignored=()) -> DataFrame:
    """Hinge loss and sign agreement of boolean columns."""
    return eval_parts(df, dictionary, ignored, ("bool",))


def eval_unary(df: DataFrame, dictionary: Dictionary, ignored=()) -> DataFrame:
    """Hinge loss and closeness of the counted level."""
    return eval_parts(df, dictionary, ignored, ("unary",))


def eval_onehot(df: DataFrame, dictionary: Dictionary, ignored=()) -> DataFrame:
    """Hinge loss and agreement of the largest column."""
    return eval_parts(df, dictionary, ignored, ("one-hot",))


def eval_spread(df: DataFrame, dictionary: Dictionary, ignored=()) -> DataFrame:
    """Gap between the mean deviations of prediction and truth, per field.  The
    prediction is scaled by the field's deviation and the truth is not, as in
    the definition."""
    return eval_parts(df, dictionary, ignored, ("spread",))


def eval_team_gap(df: DataFrame, dictionary: Dictionary, ignored=()) -> DataFrame:
    """How well the distance between the teams is met, per statistic."""
    return eval_parts(df, dictionary, ignored, ("team_gap",))


def eval_l2(model: DataFrame, penalty: float) -> DataFrame:
    """Weight penalty: ``penalty`` times half the squared weights, all layers."""
    squares = F.aggregate("w", F.lit(0.0), lambda acc, v: acc + v * v)
    return model.agg((F.sum(squares) / 2 * penalty).alias("loss")).select(
        F.lit("l2").alias("metric"),
        F.lit("weights").alias("field"),
        "loss",
        F.lit(None).cast("double").alias("accuracy"),
        F.lit(0.0).alias("accuracy_weight"),
    )


def combine(parts: DataFrame) -> DataFrame:
    """Mean of the part losses; accuracies over their total weight."""
    return parts.agg(
        (F.sum("loss") / F.count("loss")).alias("loss"),
        (F.sum("accuracy") / F.sum("accuracy_weight")).alias("accuracy"),
        F.count("loss").alias("losses"),
    )


def eval_report(df: DataFrame, dictionary: Dictionary, kinds, z: str = "z", y: str = "y") -> DataFrame:
    """Per-field quality of the predictions that the heads ``kinds`` make of the
    logits."""
    plan = evaluation_plan(dictionary, parts=("bool", "unary", "one-hot"))
    plan.spreads = _spans(dictionary, ("continuous",))
    sums = accumulate(df, [y, z], lambda t, v: report_sums(t, apply_heads(v, kinds), plan))
    return sums.select("field", F.col("metric").alias("measure"), (F.col("loss") / F.col("n")).alias("value"))


def prediction_values(df: DataFrame, dictionary: Dictionary, z: str = "z") -> DataFrame:
    """(field, value) of every record's decoded prediction, from the logits.

    The heads do not change which column is largest, and a probability is above
    one half where its logit is positive.
    """
    z = name(z)
    cells = []
    for s in dictionary.portion_spans(OUTCOME):
        f = s.field
        if f.handling == "one-hot":
            value = argmax(cut(z, s.start, s.width))
        elif f.handling == "unary":
            value = count_above(cut(z, s.start, s.width))
        else:
            p = f"get({z}, {s.start})"
            p = p if f.handling == "continuous" else f"(1D / (1D + exp(-{p})))"
            value = f"{p} * {literal(float(f.sd or 1.0))} + {literal(float(f.mean or 0.0))}"
        cells.append(f"struct({literal(f.path)} as field, cast({value} as double) as value)")
    return df.selectExpr(f"inline(array({', '.join(cells)}))")


def histogram(values: DataFrame, low, high, buckets: int = 10, by=("field",)) -> DataFrame:
    """Equal-width counts; bucket 0 and ``buckets + 1`` hold the rest."""
    bucket = F.width_bucket(F.col("value"), low, high, F.lit(buckets)).cast("int")
    return values.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


#: Parts of the values between a power of two and the next, and what keeps their numbers above zero.
SKETCH_PARTS, SKETCH_SHIFT = 16, 1100


def sketch_bucket(value: str) -> str:
    """SQL for a value's bucket, a whole number that grows with the value; zero is 0, a missing value has none.

    Every power of two is cut into ``SKETCH_PARTS`` equal parts, so a bucket is at most a
    sixteenth as wide as its values are large, whatever their range.
    """
    size = f"abs({value})"
    power = f"floor(log2({size}))"
    # The logarithm may round across a power of two.
    power = f"({power} + if({size} < pow(2D, {power}), -1, if({size} >= pow(2D, {power} + 1), 1, 0)))"
    part = f"least({SKETCH_PARTS - 1}, floor(({size} / pow(2D, {power}) - 1) * {SKETCH_PARTS}))"
    number = f"cast(({power} + {SKETCH_SHIFT}) * {SKETCH_PARTS} + {part} + 1 as int)"
    return f"case when {value} is null or isnan({value}) then null when {value} = 0 then 0 when {value} > 0 then {number} else -{number} end"


def sketch(values: DataFrame, by=("field",)) -> DataFrame:
    """(by..., bucket, n): counts by bucket, in one pass and without ranges. Sketches are merged by ``merge_sketches``."""
    bucket = F.expr(sketch_bucket("value")).alias("bucket")
    return values.select(*by, bucket).where("bucket is not null").groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(*sketches: DataFrame, by=("field",)) -> DataFrame:
    whole = reduce(DataFrame.unionByName, sketches)
    return whole.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_ranges(counts: DataFrame) -> DataFrame:
    """A sketch with the ``low`` and ``high`` end of every bucket."""
    k = "(abs(bucket) - 1)"
    unit = f"pow(2D, {k} div {SKETCH_PARTS} - {SKETCH_SHIFT})"
    near, far = (f"{unit} * (1 + ({k} % {SKETCH_PARTS} + {i}) / {SKETCH_PARTS}D)" for i in (0, 1))
    low = f"case when bucket = 0 then 0D when bucket > 0 then {near} else -({far}) end"
    high = f"case when bucket = 0 then 0D when bucket > 0 then {far} else -({near}) end"
    return counts.withColumns({"low": F.expr(low), "high": F.expr(high)})


def sketch_quantiles(counts: DataFrame, shares, by=("field",)) -> DataFrame:
    """(by..., share, low, high): the bucket that holds each share of the values; one row per bucket and group is ordered."""
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("bucket"))
    placed = sketch_ranges(counts).select(*by, "low", "high", "n", upto.alias("upto"), F.sum("n").over(group).alias("total"))
    asked = placed.withColumn("share", F.explode(F.lit([float(s) for s in shares])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total")))
    return asked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(*by, "share", "low", "high")


def model_values(model: DataFrame) -> DataFrame:
    """(field, value) of all weights and biases, per layer."""
    one = F.concat(F.col("name"), F.lit("_"), F.col("layer").cast("string"))
    arrays = F.array(
        F.struct(F.lit("weights").alias("name"), F.col("w").alias("v")),
        F.struct(F.lit("biases").alias("name"), F.col("b").alias("v")),
    )
    return model.select("layer", F.inline(arrays)).select(one.alias("field"), F.explode("v").alias("value"))


def cross_entropy(z: Column, target: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * target + F.log1p(F.exp(-F.abs(z)))


def eval_win(df: DataFrame, z: str = "z", y: str = "y") -> DataFrame:
    """Summed cross-entropy, accuracy and mean error of one scalar logit."""
    zc, yc = F.col(z).cast("double"), F.col(y).cast("double")
    return df.agg(
        F.sum(cross_entropy(zc, yc)).alias("loss"),
        F.avg(((zc > 0) == (yc > 0.5)).cast("double")).alias("accuracy"),
        F.avg(F.abs(1 / (1 + F.exp(-zc)) - yc)).alias("error"),
        F.count(F.lit(1)).alias("n"),
    )


def two_sample(real: DataFrame, generated: DataFrame) -> DataFrame:
    """Real rows (target 1) and generated rows (target 0) in one table."""
    tagged = [
        df.select("*", F.lit(name).alias("source"), F.lit(t).alias("target"))
        for df, name, t in ((real, "real", 1.0), (generated, "generated", 0.0))
    ]
    return tagged[0].unionByName(tagged[1])


def eval_two_sample(df: DataFrame, z: str = "z") -> DataFrame:
    """Discriminator loss and accuracy per source."""
    zc = F.col(z).cast("double")
    return df.groupBy("source").agg(
        F.avg(cross_entropy(zc, F.col("target"))).alias("loss"),
        F.avg(((zc > 0) == (F.col("target") > 0.5)).cast("double")).alias("accuracy"),
        F.avg(1 / (1 + F.exp(-zc))).alias("mean_score"),
        F.count(F.lit(1)).alias("n"),
    )
