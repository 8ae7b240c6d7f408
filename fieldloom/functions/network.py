"""Dense layers on the rows of one Arrow batch.

A network is a list of (weights n_in x n_out, biases n_out); the activation
sits between layers and the last layer is linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LEAK = 0.2  # fixed value: slope of the leaky activation below zero


def sigmoid(v):
    out = np.exp(-np.abs(v))
    return np.where(v >= 0, 1.0, out) / (1.0 + out)


# name -> (value, derivative from the input v and the activated value a)
ACTIVATIONS = {
    "leaky-relu": (lambda v: np.where(v > 0, v, v * LEAK), lambda v, a: np.where(v > 0, 1.0, LEAK).astype(v.dtype)),
    "relu": (lambda v: np.maximum(v, 0), lambda v, a: (v > 0).astype(v.dtype)),
    "sigmoid": (sigmoid, lambda v, a: a * (1 - a)),
    "tanh": (np.tanh, lambda v, a: 1 - a * a),
}


# What an output head does.
HEAD_NONE, HEAD_SIGMOID, HEAD_LINEAR = 0, 1, 2


def apply_heads(z, kinds):
    """Logits to predictions, column by column kind."""
    kinds = np.asarray(kinds)
    return np.where(kinds == HEAD_SIGMOID, sigmoid(z), np.where(kinds == HEAD_LINEAR, z, z.dtype.type(0)))


def forward(x, network, activation="leaky-relu"):
    """Logits of every row."""
    act, _ = ACTIVATIONS[activation]
    for i, (w, b) in enumerate(network):
        x = (act(x) if i else x) @ w + b
    return x


def gradients(x, network, objective, activation="leaky-relu"):
    """(loss, [(dw, db), ...]) of ``objective(logit) -> (loss, dlogit)``."""
    act, slope = ACTIVATIONS[activation]
    inputs, before = [x], []
    for i, (w, b) in enumerate(network):
        if i:
            inputs.append(act(before[-1]))
        before.append(inputs[-1] @ w + b)
    loss, delta = objective(before[-1])
    out = []
    for i in range(len(network) - 1, -1, -1):
        out.append((inputs[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = (delta @ network[i][0].T) * slope(before[i - 1], inputs[i])
    return loss, out[::-1]


def flatten(network) -> np.ndarray:
    """All weights and biases as one vector."""
    return np.concatenate([part.ravel() for layer in network for part in layer])


def unflatten(flat: np.ndarray, like):
    """The vector cut back into the shapes of ``like``."""
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def initial_network(sizes, seed=0, scale=0.05):
    """Normal(0, ``scale``) weights and biases."""
    rng = np.random.default_rng(seed)
    return [
        (rng.normal(0, scale, (n_in, n_out)), rng.normal(0, scale, n_out))
        for n_in, n_out in zip(sizes[:-1], sizes[1:])
    ]


BATCH_ROWS = 2048  # fixed value: rows that are worked on together


def row_batches(batches, rows: int = BATCH_ROWS):
    """Arrow batches cut to at most ``rows`` rows; empty ones are dropped."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def to_matrix(column: pa.Array, dtype, name: str = "input") -> np.ndarray:
    """Rows of a list column of equal lengths; a plain column is one wide.

    A missing row would move all others up, so it is an error.
    """
    if column.null_count:
        raise ValueError(f"column {name!r} is null in {column.null_count} rows")
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
    else:
        flat = column.to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=dtype).reshape(len(column), -1)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))
