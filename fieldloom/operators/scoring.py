"""Dense scoring: Arrow batches in, matrix products, Arrow batches out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.network import (
    HEAD_LINEAR,
    HEAD_NONE,
    HEAD_SIGMOID,
    apply_heads,
    forward,
    row_batches,
    to_lists,
    to_matrix,
)
from fieldloom.schema import OUTCOME, Dictionary
from fieldloom.session import ship_package
from fieldloom.sources.models import check_network

def head_kinds(dictionary: Dictionary, ignored=(), mask: int = OUTCOME) -> list[int]:
    """Head of every encoded column of a portion."""
    kinds = []
    for s in dictionary.portion_spans(mask):
        if s.field.path in ignored:
            kind = HEAD_NONE
        else:
            kind = HEAD_LINEAR if s.field.handling == "continuous" else HEAD_SIGMOID
        kinds += [kind] * s.width
    return kinds


def probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def output_heads(z: Column, kinds: list[int]) -> Column:
    """Logits to predictions: sigmoid, identity, or 0 for ignored columns."""
    return F.zip_with(
        z,
        F.lit(kinds),
        lambda v, k: F.when(k == HEAD_SIGMOID, probability(v))
        .when(k == HEAD_LINEAR, v)
        .otherwise(F.lit(0.0)),
    )


def map_matrices(df: DataFrame, inputs, outputs, fn, drop=(), dtype="float64") -> DataFrame:
    """Append the matrices ``fn(*input matrices)`` as array columns.

    Other columns pass through untouched; ``drop`` names the ones not needed
    after scoring, so that they are not sent back.
    """
    ship_package(df.sparkSession)
    element = T.DoubleType() if dtype == "float64" else T.FloatType()
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + [T.StructField(o, T.ArrayType(element)) for o in outputs])
    keep_names = [f.name for f in kept]
    inputs, outputs = list(inputs), list(outputs)

    def run(batches):
        for batch in row_batches(batches):
            mats = fn(*[to_matrix(batch.column(c), dtype, c) for c in inputs])
            columns = [batch.column(c) for c in keep_names]
            columns += [to_lists(m.astype(dtype, copy=False)) for m in mats]
            yield pa.RecordBatch.from_arrays(columns, names=keep_names + outputs)

    return df.mapInArrow(run, schema)


def score_dense(
    df: DataFrame,
    network,
    inputs=("known",),
    out: str = "logit",
    activation: str = "leaky-relu",
    drop=(),
    dtype: str = "float64",
    kinds: list[int] | None = None,
) -> DataFrame:
    """Logits of one network on the concatenated input columns; with ``kinds``
    the predictions after the output heads."""
    check_network(network)
    shared = df.sparkSession.sparkContext.broadcast([(w.astype(dtype), b.astype(dtype)) for w, b in network])

    def run(*mats):
        x = mats[0] if len(mats) == 1 else np.hstack(mats)
        z = forward(x, shared.value, activation)
        return (z if kinds is None else apply_heads(z, kinds),)

    return map_matrices(df, inputs, [out], run, drop, dtype)


def score_chain(
    df: DataFrame,
    generator,
    win_network,
    kinds: list[int],
    chain_input: str = "probability",
    activation: str = "leaky-relu",
    outputs=("win_logit",),
    drop=(),
    dtype: str = "float64",
) -> DataFrame:
    """known -> unknown -> win in one pass over the batch.

    ``chain_input`` is what the win network sees of the generated part:
    ``"probability"`` after the output heads, as it is fitted, or ``"logit"``.
    Ignored columns, whose head is none, are 0 in both.
    Possible outputs: ``unknown_logit``, ``win_logit``.
    """
    if chain_input not in ("probability", "logit"):
        raise ValueError(f"unknown chain input {chain_input!r}")
    check_network(generator)
    check_network(win_network)
    nets = [[(w.astype(dtype), b.astype(dtype)) for w, b in net] for net in (generator, win_network)]
    shared = df.sparkSession.sparkContext.broadcast(nets)
    outputs = list(outputs)

    def run(known):
        first, second = shared.value
        logit = forward(known, first, activation)
        if outputs == ["unknown_logit"]:
            return [logit]
        if chain_input == "probability":
            unknown = apply_heads(logit, kinds)
        else:
            unknown = np.where(np.asarray(kinds) == HEAD_NONE, logit.dtype.type(0), logit)
        made = {
            "unknown_logit": logit,
            "win_logit": forward(np.hstack([known, unknown]), second, activation),
        }
        return [made[o] for o in outputs]

    return map_matrices(df, ["known"], outputs, run, drop, dtype)


def win_probability(z: Column) -> Column:
    """Probability of the first win column."""
    return probability(F.get(z, F.lit(0)))
