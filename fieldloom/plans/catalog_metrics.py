"""Evaluation queries on the scored records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.network import apply_heads, forward
from fieldloom.operators import metrics
from fieldloom.operators.scoring import map_matrices
from fieldloom.plans.matches import DICTIONARY
from fieldloom.plans.models import KINDS, WIN_NETWORK, scored
from fieldloom.plans.oracle import bias, last_bias, leaky, sql, weight
from fieldloom.plans.registry import query

# Truth, logit and layout of every cell.
CELLS = "select rec_id, j, y, z, field, fam, slot, handling, sd, mean from truth join logits using (rec_id, j) join lay using (j)"
_HINGE = "greatest(0, 1 - (2 * y - 1) * z)"

PARTS = {
    "continuous": f"""select 'continuous' as metric, run as field, sum(loss) as loss, sum(accuracy) as accuracy,
            count(*)::double as accuracy_weight from (
        select j, case when j >= 560 then '560:563' else (slot * 56 + 50) || ':' || (slot * 56 + 52) end as run,
            avg(abs(y - z)) as loss, avg(1 / (abs(y - z) + 1)) as accuracy
        from ({CELLS}) c where handling = 'continuous' group by j, run) r group by run""",
    "bool": f"""select 'bool' as metric, field, avg({_HINGE}) as loss,
            avg(((z > 0) = (y > 0))::int::double) as accuracy, 1.0::double as accuracy_weight
        from ({CELLS}) c where handling = 'bool' group by field""",
    "unary": f"""select 'unary' as metric, field, avg(loss) as loss, avg(1 / (abs(n_pos - n_true) / 14.432::double + 1)) as accuracy,
            1.0::double as accuracy_weight
        from (select rec_id, field, avg({_HINGE}) as loss, count(*) filter (z > 0) as n_pos, sum(y) as n_true
              from ({CELLS}) c where handling = 'unary' group by rec_id, field) q group by field""",
    "one-hot": f"""select 'one-hot' as metric, field, avg(loss) as loss, avg((guess = real)::int::double) as accuracy,
            1.0::double as accuracy_weight
        from (select rec_id, field, avg({_HINGE}) as loss, arg_max(j, (z, -j)) as guess, arg_max(j, (y, -j)) as real
              from ({CELLS}) c where handling = 'one-hot' group by rec_id, field) q group by field""",
    "spread": f"""select 'spread' as metric, field, abs(avg(abs(z * sd - mz)) - avg(abs(y - my))) / any_value(sd) as loss,
            null::double as accuracy, 0.0::double as accuracy_weight
        from ({CELLS}) c join (select field, avg(z * sd) as mz, avg(y) as my from ({CELLS}) c group by field) m using (field)
        where handling in ('unary', 'continuous') group by field""",
    "team_gap": f"""select 'team_gap' as metric, stat as field, avg(abs(abs(pz) - abs(py))) * any_value(w) as loss,
            null::double as accuracy, 0.0::double as accuracy_weight
        from (select rec_id, stat, elem, any_value(w) as w, sum(sign * z) as pz, sum(sign * (y - mean) / sd) as py
              from (select rec_id, z, y, mean, sd,
                case when fam = 'team_price' then 'teams.*.price' else 'participants.*.' || fam end as stat,
                case when fam = 'team_price' then 0 else j % 56 end as elem,
                case when fam = 'team_price' then 0.5 else 0.1 end::double as w,
                case when coalesce(slot < 5, j = 560) then 1 else -1 end as sign
              from ({CELLS}) c where handling in ('unary', 'continuous') and fam <> 'duration') s
              group by rec_id, stat, elem) q group by stat""",
}
_NEEDS = ("truth", "logits", "lay")


def _rounded(part: str) -> str:
    return sql(
        f"""select metric, field, round(loss, 6) as loss, round(accuracy, 6) as accuracy, accuracy_weight
        from ({PARTS[part]}) p""",
        *_NEEDS,
    )


def _round(df: DataFrame) -> DataFrame:
    return df.select(
        "metric", "field", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"), "accuracy_weight"
    )


@query("eval_continuous", _rounded("continuous"))
def eval_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.eval_continuous(scored(spark, sf_dir), DICTIONARY))


@query("eval_bool", _rounded("bool"))
def eval_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.eval_bool(scored(spark, sf_dir), DICTIONARY))


@query("eval_unary", _rounded("unary"))
def eval_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.eval_unary(scored(spark, sf_dir), DICTIONARY))


@query("eval_onehot", _rounded("one-hot"))
def eval_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.eval_onehot(scored(spark, sf_dir), DICTIONARY))


@query("eval_spread", _rounded("spread"))
def eval_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.eval_spread(scored(spark, sf_dir), DICTIONARY))


@query("eval_team_gap", _rounded("team_gap"))
def eval_team_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.eval_team_gap(scored(spark, sf_dir), DICTIONARY))


@query(
    "eval_combined",
    sql(
        f"""select round(sum(loss) / count(*), 6) as loss, round(sum(accuracy) / sum(accuracy_weight), 6) as accuracy,
            count(*) as losses from (select metric, field, loss, accuracy, accuracy_weight from cells_all) p""",
        *_NEEDS,
        extra={"cells_all": " union all ".join(f"({text})" for text in PARTS.values())},
    ),
)
def eval_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = metrics.eval_parts(scored(spark, sf_dir), DICTIONARY)
    return metrics.combine(parts).select(
        F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"), "losses"
    )


@query(
    "eval_report",
    sql(
        """select field, measure, round(value, 6) as value from (
            select field, 'accuracy' as measure, avg(1 / (abs(n_pos - n_true) / sd + 1)) as value
              from (select rec_id, field, any_value(sd) as sd, count(*) filter (p > 0.5) as n_pos, sum(y) as n_true
                from cells where handling in ('unary', 'bool') group by rec_id, field) q group by field
            union all
            select field, 'accuracy', avg((guess = real)::int::double)
              from (select rec_id, field, arg_max(j, (p, -j)) as guess, arg_max(j, (y, -j)) as real
                from cells where handling = 'one-hot' group by rec_id, field) q group by field
            union all
            select field, 'error', avg(abs(p - y)) from cells where handling = 'continuous' group by field) u""",
        "truth", "probs", "lay",
        extra={
            "cells": "select rec_id, j, y, p, field, handling, sd from truth join probs using (rec_id, j) join lay using (j)"
        },
    ),
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.eval_report(scored(spark, sf_dir), DICTIONARY, KINDS).withColumn("value", F.round("value", 6))


BUCKETS = 12
_BUCKET = "case when value < lo then 0 when value >= hi then 13 else floor((value - lo) / (hi - lo) * 12)::int + 1 end"


@query(
    "prediction_histogram",
    sql(
        f"""select field, {_BUCKET} as bucket, count(*) as n from (
            select field, value, case h when 'one-hot' then -0.5 when 'unary' then -0.5 else m - 2.05 * sd end::double as lo,
                case h when 'one-hot' then 11.5 when 'unary' then 59.5 else m + 2.05 * sd end::double as hi
            from (
                select rec_id, field, any_value(handling) as h, any_value(sd) as sd, any_value(mean) as m,
                    case any_value(handling) when 'one-hot' then (arg_max(j, (p, -j)) - min(j))::double
                        when 'unary' then (count(*) filter (p > 0.5))::double
                        else max(p) * any_value(sd) + any_value(mean) end as value
                from probs join lay using (j) group by rec_id, field) a) b group by 1, 2""",
        "probs", "lay",
    ),
)
def prediction_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, ("z",))
    bounds = []
    for f in DICTIONARY.select(4):
        if f.handling in ("one-hot", "unary"):
            low, high = -0.5, 11.5 if f.handling == "one-hot" else 59.5
        else:
            low, high = ((f.mean or 0.0) + k * 2.05 * (f.sd or 1.0) for k in (-1, 1))
        bounds.append({"field": f.path, "low": low, "high": high})
    table = rows.sparkSession.createDataFrame(
        [(b["field"], b["low"], b["high"]) for b in bounds], "field string, low double, high double"
    )
    values = metrics.prediction_values(rows, DICTIONARY).join(F.broadcast(table), "field")
    return metrics.histogram(values, F.col("low"), F.col("high"), BUCKETS)


_POWER = "(floor(log2(abs(value))) + case when abs(value) < pow(2, floor(log2(abs(value)))) then -1 when abs(value) >= pow(2, floor(log2(abs(value))) + 1) then 1 else 0 end)"


@query(
    "prediction_sketch",
    sql(
        f"""select field, bucket, count(*) as n from (
            select field, case when value = 0 then 0 else (sign(value) * ((p + 1100) * 16 + least(15, floor((abs(value) / pow(2, p) - 1) * 16)) + 1))::int end as bucket
            from (select field, value, case when value <> 0 then {_POWER} end as p from (
                select rec_id, field, case any_value(handling) when 'one-hot' then (arg_max(j, (p, -j)) - min(j))::double
                    when 'unary' then (count(*) filter (p > 0.5))::double
                    else max(p) * any_value(sd) + any_value(mean) end as value
                from probs join lay using (j) group by rec_id, field) a) b) c group by 1, 2""",
        "probs", "lay",
    ),
)
def prediction_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every field in buckets that need no ranges: two halves of the records, merged."""
    values = metrics.prediction_values(scored(spark, sf_dir, ("z",), "rec_id % 2 = 0"), DICTIONARY)
    others = metrics.prediction_values(scored(spark, sf_dir, ("z",), "rec_id % 2 <> 0"), DICTIONARY)
    return metrics.merge_sketches(metrics.sketch(values), metrics.sketch(others))


@query(
    "eval_win",
    sql(
        """select round(sum(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 4) as loss,
            round(avg(((z > 0) = (y > 0.5))::int::double), 6) as accuracy, round(avg(abs(1 / (1 + exp(-z)) - y)), 6) as error,
            count(*) as n
        from (select z, t0_win::int::double as y from win_logits join filled using (rec_id)) q""",
        "win_logits", "filled",
    ),
)
def eval_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, ("win", "win_logit")).select(
        F.get("win_logit", F.lit(0)).alias("z"), F.get("win", F.lit(0)).cast("double").alias("y")
    )
    out = metrics.eval_win(rows)
    return out.select(
        F.round("loss", 4).alias("loss"), F.round("accuracy", 6).alias("accuracy"), F.round("error", 6).alias("error"), "n"
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and generated records with the discriminator's logit ``z``."""


    def run(known, real, logits):
        return [forward(np.hstack([known, x]), WIN_NETWORK) for x in (real, apply_heads(logits, KINDS))]

    rows = scored(spark, sf_dir, ("known", "y", "z"))
    rows = map_matrices(rows, ["known", "y", "z"], ["real", "generated"], run, drop=("known", "y", "z"))
    pair = [
        F.struct(F.lit(source).alias("source"), F.lit(t).alias("target"), F.get(source, F.lit(0)).alias("z"))
        for source, t in (("real", 1.0), ("generated", 0.0))
    ]
    return rows.select("rec_id", F.inline(F.array(*pair)))


# Real and generated records under the formula discriminator.
_JUDGED = {
    "known_part": f"select rec_id, k, sum({weight('pos', 'k', 100.0)}) as v from nz cross join range(8) t(k) group by rec_id, k",
    "parts": """select rec_id, 'real' as source, list(y order by j) as x from truth group by rec_id
        union all select rec_id, 'generated', list(p order by j) from probs group by rec_id""",
    "wcols": f"""select k, list({weight('j + 390', 'k', 100.0)} order by j) as w
        from range(563) t(j) cross join range(8) u(k) group by k""",
    "judged": f"""select source, t, {last_bias('0', 100.0)} + sum(({leaky('v')}) * {weight('k', '0', 100.0)}) as z
        from (select rec_id, source, case source when 'real' then 1.0 else 0.0 end as t, k, sum(v) + {bias('k', 100.0)} as v
            from (select rec_id, source, k, v from known_part cross join (values ('real'), ('generated')) s(source)
                union all select rec_id, source, k, list_dot_product(x, w) from parts cross join wcols) u
            group by rec_id, source, k) h group by rec_id, source, t""",
}


@query(
    "eval_two_sample",
    sql(
        f"""select source, round(avg(greatest(z, 0) - z * t + ln(1 + exp(-abs(z)))), 6) as loss,
            round(avg(((z > 0) = (t > 0.5))::int::double), 6) as accuracy, round(avg(1 / (1 + exp(-z))), 6) as mean_score, count(*) as n
        from judged group by source""",
        "nz", "truth", "probs",
        extra=_JUDGED,
    ),
)
def eval_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.eval_two_sample(judged(spark, sf_dir))
    return out.select(
        "source", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "mean_score")], "n"
    )


@query(
    "score_histogram",
    sql(
        """select field, least(greatest(floor((value - 0.00001) / 0.99999 * 20)::int + 1, 0), 21) as bucket, count(*) as n from (
            select 'discriminator_' || source as field, 1 / (1 + exp(-z)) as value from judged
            union all select 'win', 1 / (1 + exp(-z)) from win_logits) q group by 1, 2""",
        "nz", "truth", "probs", "win_logits",
        extra=_JUDGED,
    ),
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of win probabilities and of discriminator scores per source."""
    score = (1 / (1 + F.exp(-F.col("z")))).alias("value")
    judges = judged(spark, sf_dir).select(F.concat(F.lit("discriminator_"), "source").alias("field"), score)
    wins = scored(spark, sf_dir, ("win_logit",)).select(F.get("win_logit", F.lit(0)).alias("z")).select(F.lit("win").alias("field"), score)
    return metrics.histogram(judges.unionByName(wins), F.lit(0.00001), F.lit(1.0), 20)
