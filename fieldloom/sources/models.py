"""Networks as a small table: one row per layer."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_SCHEMA = "layer int, n_in int, n_out int, w array<double>, b array<double>"

# A network's size follows from its declared layers, never from the data.
MAX_MODEL_BYTES = 2 << 30


def network_frame(spark: SparkSession, network) -> DataFrame:
    rows = [
        (i, int(w.shape[0]), int(w.shape[1]), w.ravel().tolist(), b.ravel().tolist())
        for i, (w, b) in enumerate(network)
    ]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def save_network(spark: SparkSession, network, path: str) -> None:
    """Add a version of the network; earlier ones stay until it is complete and
    after, so that an interrupted write loses nothing."""
    network_frame(spark, network).coalesce(1).write.parquet(f"{path}/version={time.time_ns()}")


def newest_version(spark: SparkSession, path: str) -> int:
    return spark.read.schema(f"{MODEL_SCHEMA}, version bigint").parquet(path).agg(F.max("version")).first()[0]


def network_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Layers of a version, the newest by default."""
    table = spark.read.schema(f"{MODEL_SCHEMA}, version bigint").parquet(path)
    version = newest_version(spark, path) if version is None else version
    return table.where(F.col("version") == version).drop("version")


def check_network(network, max_bytes: int = MAX_MODEL_BYTES) -> None:
    size = sum(w.nbytes + b.nbytes for w, b in network)
    if size > max_bytes:
        raise ValueError(f"network of {size} bytes is above the broadcast bound {max_bytes}")
    for i, (w, b) in enumerate(network):
        if w.ndim != 2 or b.shape != (w.shape[1],):
            raise ValueError(f"layer {i}: weights {w.shape} and biases {b.shape} do not fit")
        if i and network[i - 1][0].shape[1] != w.shape[0]:
            raise ValueError(f"layer {i} takes {w.shape[0]} inputs, layer {i - 1} gives another count")


def load_network(spark: SparkSession, path: str, max_bytes: int = MAX_MODEL_BYTES, version: int | None = None):
    """Layers as (weights, biases); shapes are checked before the arrays travel."""
    table = network_table(spark, path, version)
    shapes = table.selectExpr("layer", "n_in", "n_out", "size(w) w_len", "size(b) b_len").collect()
    if sum(8 * (r.w_len + r.b_len) for r in shapes) > max_bytes:
        raise ValueError("stored network is above the broadcast bound")
    for r in shapes:
        if r.w_len != r.n_in * r.n_out or r.b_len != r.n_out:
            raise ValueError(f"layer {r.layer}: stored arrays do not fit {r.n_in}x{r.n_out}")
    rows = sorted(table.collect(), key=lambda r: r.layer)
    network = [(np.array(r.w).reshape(r.n_in, r.n_out), np.array(r.b)) for r in rows]
    check_network(network, max_bytes)
    return network
