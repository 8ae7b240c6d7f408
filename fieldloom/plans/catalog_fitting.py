"""Fitting queries on the encoded records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.objectives import LogisticObjective
from fieldloom.functions.optimizers import Optimizer
from fieldloom import jobs
from fieldloom.operators import fitting, metrics
from fieldloom.operators.records import encode_records
from fieldloom.plans.matches import DICTIONARY, MIN_DURATION, records
from fieldloom.plans.models import GENERATOR, N_KNOWN, N_UNKNOWN, encoded, formula_network
from fieldloom.plans.oracle import draw, last_bias, sql, weight
from fieldloom.plans.registry import query
from fieldloom.session import new_folder, stored
from fieldloom.sources.models import load_network, network_frame, network_table, save_network

LINEAR = formula_network([N_KNOWN + N_UNKNOWN, 1], 100.0)
RATE = 0.01


def win_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.get("win", F.lit(0)).cast("double"))


def win_gradient_values(spark: SparkSession, sf_dir: str):
    rows = win_target(encoded(spark, sf_dir))
    return fitting.gradient_sum(rows, LINEAR, LogisticObjective(), ["known", "unknown"], "target")


def gradient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, g, n): mean gradient of the linear win net; the bias is last."""

    def build():
        n, _, grad = win_gradient_values(spark, sf_dir)
        return spark.createDataFrame([(i, float(g), n) for i, g in enumerate(grad)], "pos bigint, g double, n bigint")

    return stored(spark, ("win-gradient", sf_dir), build)


_INPUTS = {
    "inputs": "select rec_id, pos, 1.0::double as x from nz union all select rec_id, 390 + j, y from truth",
    "resid": f"""select rec_id, 1 / (1 + exp(-({last_bias('0', 100.0)} + s))) - t0_win::int::double as r
        from (select rec_id, sum(x * {weight('pos', '0', 100.0)}) as s from inputs group by rec_id) q join filled using (rec_id)""",
    "grad": """select p.pos, coalesce(g, 0) as g, (select count(*) from filled) as n from range(954) p(pos) left join (
            select pos, sum(r * x) as g from inputs join resid using (rec_id) group by pos
            union all select 953, sum(r) from resid) q on q.pos = p.pos""",
    "params": f"""select pos, g / n as g, case when pos < 953 then {weight('pos', '0', 100.0)} else {last_bias('0', 100.0)} end as w
        from grad""",
}
_BASE = ("nz", "truth", "filled")


@query("win_gradient", sql("select pos, round(g, 4) as gradient from grad", *_BASE, extra=_INPUTS))
def win_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gradient_table(spark, sf_dir)
    return rows.select("pos", F.round(F.col("g") * F.col("n"), 4).alias("gradient"))


# Every part of the generator's loss by the cell it falls on.
_MIXED = {
    "cells": """select rec_id, j, y, z + (j * j % 101) * 0.0001::double as z, field, fam, slot, handling, sd, mean,
            case handling when 'unary' then 49 when 'one-hot' then 3 else 1 end as width
        from truth join logits using (rec_id, j) join lay using (j)""",
    "centres": """select field, avg(z) as mz, avg(y) as my from cells where handling in ('unary', 'continuous') group by field""",
    "spreads": """select field, any_value(mz) as mz, sign(avg(abs(z - mz)) * any_value(sd) - avg(abs(y - my))) as direction,
            avg(sign(z - mz)) as side
        from cells join centres using (field) group by field""",
    "signed": """select rec_id, j, z, (y - mean) / sd as real, case when fam = 'team_price' then 0 else j % 56 end as elem, fam,
            case when fam = 'team_price' then 0.5 else 0.1 end::double / width as w,
            case when coalesce(slot < 5, j = 560) then 1 else -1 end as s
        from cells where handling in ('unary', 'continuous') and fam <> 'duration'""",
    "gaps": """select rec_id, fam, elem, sign(abs(sum(s * z)) - abs(sum(s * real))) * sign(sum(s * z)) as direction
        from signed group by rec_id, fam, elem""",
    "slopes": """select j, case when handling = 'continuous' then sign(z - y)
                else -(2 * y - 1) * (1 - (2 * y - 1) * z > 0)::int / width end as g from cells
        union all select j, direction * (sign(z - mz) - side) / width from cells join spreads using (field)
        union all select j, w * s * direction from signed join gaps using (rec_id, fam, elem)""",
}


def uneven_generator():
    """The formula repeats from slot to slot; uneven biases keep team gaps off exact zeros."""
    *inner, (w, b) = GENERATOR
    return [*inner, (w, b + np.arange(N_UNKNOWN) ** 2 % 101 * 0.0001)]


@query(
    "mixed_gradient",
    sql(
        "select j as pos, round(sum(g) / 88 / (select count(*) from filled), 7) as gradient from slopes group by j",
        "truth", "logits", "lay", "filled", extra=_MIXED,
    ),
)
def mixed_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the generator's whole loss by its last biases, over all records."""
    objective = fitting.mixed_objective(DICTIONARY)
    _, _, grad = fitting.gradient_sum(encoded(spark, sf_dir, ("known", "unknown")), uneven_generator(), objective, ["known"], "unknown")
    rows = [(i, round(float(g), 7)) for i, g in enumerate(grad[-N_UNKNOWN:])]
    return spark.createDataFrame(rows, "pos bigint, gradient double")


_STEPS = {
    "sgd": f"{RATE} * c",
    "momentum": f"{RATE} * c",
    "adagrad": f"{RATE} * c / sqrt(0.1::double + c * c)",
    "adadelta": f"{RATE} * sqrt(0.0001::double) / sqrt(0.05::double * c * c + 0.0001::double) * c",
    "adam": f"{RATE} * sqrt(0.001::double) / 0.1::double * (0.1::double * c) / (sqrt(0.001::double * c * c) + 0.0001::double)",
}


def stepped(spark: SparkSession, sf_dir: str, optimizer: str):
    rows = sorted(gradient_table(spark, sf_dir).collect(), key=lambda r: r["pos"])
    grad = np.array([r["g"] for r in rows])
    flat = Optimizer(optimizer, RATE).update(fitting.flatten(LINEAR), grad)
    return fitting.unflatten(flat, LINEAR)


@query(
    "clip_and_update",
    sql(
        " union all ".join(
            f"select '{name}' as optimizer, pos, round(w - {step}, 7) as value from (select *, least(greatest(g, -5), 5) as c from params) q"
            for name, step in _STEPS.items()
        ),
        *_BASE, extra=_INPUTS,
    ),
)
def clip_and_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (name, i, float(v)) for name in _STEPS for i, v in enumerate(fitting.flatten(stepped(spark, sf_dir, name)))
    ]
    return spark.createDataFrame(rows, "optimizer string, pos bigint, value double").withColumn("value", F.round("value", 7))


@query(
    "load_network",
    sql(
        f"select 0 as layer, 953 as n_in, 1 as n_out, pos, round(w - {_STEPS['sgd']}, 7) as value "
        "from (select *, least(greatest(g, -5), 5) as c from params) q",
        *_BASE, extra=_INPUTS,
    ),
)
def load_network_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network fitted by one step, saved, loaded with its checks, and shown."""
    path = new_folder(spark, "network")
    save_network(spark, stepped(spark, sf_dir, "sgd"), path)
    model = network_frame(spark, load_network(spark, path))
    values = F.posexplode(F.concat("w", "b")).alias("pos", "value")
    rows = model.select("layer", "n_in", "n_out", values)
    return rows.withColumns({"pos": F.col("pos").cast("bigint"), "value": F.round("value", 7)})


def stepped_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "network")
    save_network(spark, stepped(spark, sf_dir, "sgd"), path)
    return network_table(spark, path)


@query(
    "eval_l2",
    sql(
        f"""select 'l2' as metric, 'weights' as field, round(0.5::double * sum(v * v) / 2, 6) as loss from (
            select w - {_STEPS['sgd']} as v from (select *, least(greatest(g, -5), 5) as c from params) q where pos < 953) p""",
        *_BASE, extra=_INPUTS,
    ),
)
def eval_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.eval_l2(stepped_model(spark, sf_dir), 0.5)
    return out.select("metric", "field", F.round("loss", 6).alias("loss"))


@query(
    "model_histogram",
    sql(
        f"""select field, case when v < lo then 0 when v >= hi then 9 else floor((v - lo) / (hi - lo) * 8)::int + 1 end as bucket,
            count(*) as n
        from (select case when pos < 953 then 'weights_0' else 'biases_0' end as field, w - {_STEPS['sgd']} as v,
                -0.05003::double as lo, 0.05001::double as hi
            from (select *, least(greatest(g, -5), 5) as c from params) q) p group by 1, 2""",
        *_BASE, extra=_INPUTS,
    ),
)
def model_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = metrics.model_values(stepped_model(spark, sf_dir))
    return metrics.histogram(values, F.lit(-0.05003), F.lit(0.05001), 8)


def log_rows(spark: SparkSession, result) -> DataFrame:
    return result.log_frame(spark).withColumn("value", F.round("value", 6))


def fit_options(rows: DataFrame) -> dict:
    """A tenth of the records is evaluated and a tenth kept back."""
    n = rows.count()
    tenth = max(n // 10, 1)
    return {"held_out": tenth, "evaluation": tenth, "groups": 2, "steps": 4, "samples_per_evaluation": 2 * n}


@query("fit_network")
def fit_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator fit on augmented rows; the metric log of the run."""
    rows = records(spark, sf_dir)
    result = jobs.train_generator(
        spark, rows, ["rec_id"], DICTIONARY, duration="duration", shortest=MIN_DURATION, hidden=(32,), penalty=1e-4,
        learning_rate=0.02, stop="samples100000000000:stagnant", run="generator", **fit_options(rows),
    )
    return log_rows(spark, result)


@query("fit_win")
def fit_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win fit on known and generated fields; abandoned games stay in."""
    rows = records(spark, sf_dir)
    result = jobs.train_win(
        spark, rows, ["rec_id"], DICTIONARY, GENERATOR, hidden=(16,), learning_rate=0.01, run="win",
        **fit_options(rows),
    )
    return log_rows(spark, result)


@query("fit_two_sample")
def fit_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discriminator fit: real records against generated ones."""
    rows = records(spark, sf_dir)
    result = jobs.train_two_sample(
        spark, rows, ["rec_id"], DICTIONARY, GENERATOR, duration="duration", shortest=MIN_DURATION, hidden=(16,),
        optimizer="adagrad", learning_rate=0.05, run="two-sample", **fit_options(rows),
    )
    return log_rows(spark, result)


def _rounds(n: str) -> dict[str, str]:
    """Two steps of a one-layer net by the whole gradient, from ``inputs`` (row, pos, x) and ``targets`` (row, y)."""
    out = {"w0": f"select pos, case when pos < 953 then {weight('pos', '0', 100.0)} else {last_bias('0', 100.0)} end as w from range(954) p(pos)"}
    for t in (0, 1):
        out |= {
            f"z{t}": f"""select t.row, y, (select w from w{t} where pos = 953) + coalesce(s, 0) as z from targets t left join
                (select row, sum(x * w) as s from inputs join w{t} using (pos) group by row) q on q.row = t.row""",
            f"g{t}": f"""select pos, sum((1 / (1 + exp(-z)) - y) * x) / ({n}) as g from inputs join z{t} using (row) group by pos
                union all select 953, sum(1 / (1 + exp(-z)) - y) / ({n}) from z{t}""",
            f"w{t + 1}": f"select w.pos, w - {RATE} * coalesce(g, 0) as w from w{t} w left join g{t} g on g.pos = w.pos",
        }
    return out


_ROUND_ROWS = """select 'weight' as part, pos::bigint as pos, round(w, 7) as value from w2
    union all select 'loss', 0, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 7) from z0
    union all select 'loss', 1, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 7) from z1"""
_WIN_ROWS = {
    "inputs": "select rec_id as row, pos, 1.0::double as x from nz union all select rec_id, 390 + j, y from truth",
    "targets": "select rec_id as row, t0_win::int::double as y from filled",
}
_PAIR_ROWS = {
    "inputs": """select (rec_id, s) as row, pos, 1.0::double as x from nz cross join range(2) r(s)
        union all select (rec_id, 1), 390 + j, y from truth union all select (rec_id, 0), 390 + j, p from probs""",
    "targets": "select (rec_id, s) as row, s::double as y from filled cross join range(2) r(s)",
}


def two_rounds(train: DataFrame, prepare) -> DataFrame:
    """Weights and losses of two rounds of a one-layer net.

    A chunk is one step, whose gradients add up to that of all rows: so the mean of the chunks'
    networks is the network after one whole step. ``train`` is raw: ``prepare`` encodes as it reads.
    """
    result = fitting.fit(
        train, LINEAR, LogisticObjective(), ["known", "unknown"], "target", lambda network: (0.0, 0.0), steps=2, prepare=prepare,
        optimizer="sgd", learning_rate=RATE, stop="never", local_batch=2 * fitting.CHUNK_ROWS, samples_per_evaluation=1, dtype="float64",
    )
    rows = [("weight", i, float(v)) for i, v in enumerate(fitting.flatten(result.last))]
    rows += [("loss", step, value) for _, step, _, split, _, value in result.log if split == "train"]
    return train.sparkSession.createDataFrame(rows, "part string, pos bigint, value double").withColumn("value", F.round("value", 7))


@query("fit_win_rounds", sql(_ROUND_ROWS, *_BASE, extra=_WIN_ROWS | _rounds("select count(*) from targets")))
def fit_win_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the win fit on all records, as they are."""
    return two_rounds(records(spark, sf_dir), lambda rows, epoch: win_target(encode_records(rows, DICTIONARY, keep=("rec_id", *jobs.CHUNK))))


@query("fit_two_sample_rounds", sql(_ROUND_ROWS, *_BASE, "probs", extra=_PAIR_ROWS | _rounds("select count(*) from targets")))
def fit_two_sample_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the discriminator fit: every record, real and generated."""

    def prepare(rows, epoch):
        both = encode_records(rows, DICTIONARY, ("known", "unknown"), ("rec_id", *jobs.CHUNK))
        return jobs.real_and_generated(both, DICTIONARY, GENERATOR)

    return two_rounds(records(spark, sf_dir), prepare)


@query(
    "fit_network_step",
    sql(
        f"""select j as pos, round({last_bias('j', 10.0)} + (j * j % 101) * 0.0001::double
            - {RATE} * greatest(-5, least(5, sum(g) / 88 / (select count(*) from filled))), 7) as value from slopes group by j""",
        "truth", "logits", "lay", "filled", extra=_MIXED,
    ),
)
def fit_network_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last biases after the first step of the generator fit with its whole loss, over all records."""
    result = fitting.fit(
        encoded(spark, sf_dir, ("known", "unknown")), uneven_generator(), fitting.mixed_objective(DICTIONARY), ["known"], "unknown",
        lambda network: (0.0, 0.0), steps=1, optimizer="sgd", learning_rate=RATE, stop="never", dtype="float64",
    )
    rows = [(i, round(float(v), 7)) for i, v in enumerate(result.last[-1][1])]
    return spark.createDataFrame(rows, "pos bigint, value double")


def _uniform(*what: str) -> str:
    return draw(f"'{TRIAL_SEED}'", "trial", *what)


def _spread(u: str, low: float, high) -> str:
    """A draw between two values on a log scale."""
    return f"exp(ln({low}::double) + {u} * (ln(({high})::double) - ln({low}::double)))"


TRIAL_SEED = 3
_TRIALS = {
    "layered": f"""select trial, (1 + floor({_uniform("'layers'")} * 5))::int as layers
        from (select distinct d.t as trial from (values (0), (1)) d(t), (select count(*) as n from lineitem) l where n > 0) q""",
    "widths": f"""select trial, layers, i, greatest(1, round({_spread(_uniform("'width' || i"), 1, '[8192, 8192, 4096, 2048, 1024][layers]')}))::int as width
        from layered, unnest(range(layers)) u(i)""",
}


@query(
    "search_trials",
    sql(
        f"""select trial, round(ln({_spread(_uniform("'rate'"), 0.000001, 0.1)}), 9) as log_rate,
            (select string_agg(width, ',' order by i) from widths w where w.trial = t.trial) as hidden,
            ['adam', 'adagrad', 'momentum', 'adadelta', 'sgd'][(1 + floor({_uniform("'optimizer'")} * 5))::int] as optimizer,
            round({_spread(_uniform("'batch'"), 512, 8192)})::int as batch_size,
            ['relu', 'leaky-relu', 'sigmoid', 'tanh'][(1 + floor({_uniform("'activation'")} * 4))::int] as activation, 'ok' as status
        from layered t""",
        extra=_TRIALS,
    ),
)
def search_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two seeded trials of the generator fit in one pass over the whole training split, each in
    steps of the drawn batch size: what was drawn, and that every fit ended with a finite loss."""
    rows = records(spark, sf_dir)
    tenth = max(rows.count() // 10, 1)
    table = jobs.search_generator(
        spark, rows, ["rec_id"], DICTIONARY, new_folder(spark, "trials"), 2, tenth, tenth, "duration", MIN_DURATION,
        seed=TRIAL_SEED, passes=1,
    )
    return table.select(
        "trial", F.round(F.log("learning_rate"), 9).alias("log_rate"), F.array_join("hidden", ",").alias("hidden"), "optimizer",
        "batch_size", "activation", F.when(F.col("loss").between(0, 1), F.col("status")).alias("status"),
    )
