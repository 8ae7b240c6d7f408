"""Sums behind the evaluation metrics, for the rows of one batch.

Every function takes truth ``y`` and logits (or predictions) ``z`` as matrices
and returns ``{(metric, field): (loss_sum, accuracy_sum)}``; sums of batches
add up to sums over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Plan:
    """Encoded columns of each part, as (name, start, width, sd, ...) tuples."""

    runs: list = field(default_factory=list)  # (name, start, width)
    bools: list = field(default_factory=list)  # (name, start, width, sd)
    unaries: list = field(default_factory=list)
    onehots: list = field(default_factory=list)
    spreads: list = field(default_factory=list)
    gaps: list = field(default_factory=list)  # (name, weight, [(start, width, sign, mean, sd)])
    means: dict = field(default_factory=dict)  # name -> (mean of y, mean of z)


def _columns(spans):
    """Index of all columns of the spans and where each span begins in it."""
    index = np.concatenate([np.arange(s[1], s[1] + s[2]) for s in spans])
    starts = np.cumsum([0] + [s[2] for s in spans[:-1]])
    return index, starts


def _hinge_sums(y, z, spans):
    index, starts = _columns(spans)
    margin = np.maximum(0.0, 1 - (2 * y[:, index] - 1) * z[:, index]).sum(axis=0)
    widths = np.array([s[2] for s in spans])
    return np.add.reduceat(margin, starts) / widths


def span_sums(x, spans):
    """Row-wise sums per span."""
    index, starts = _columns(spans)
    return np.add.reduceat(x[:, index], starts, axis=1)


def closeness(y, z, spans, threshold):
    """Summed closeness of the counted level, per span."""
    gap = np.abs(span_sums((z > threshold).astype(z.dtype), spans) - span_sums(y, spans))
    return (1 / (gap / np.array([s[3] for s in spans]) + 1)).sum(axis=0)


def agreement(y, z, spans):
    """How many rows have their largest column in the same place, per span."""
    return [
        float((y[:, s : s + w].argmax(axis=1) == z[:, s : s + w].argmax(axis=1)).sum()) for _, s, w, *_ in spans
    ]


def part_sums(y, z, plan: Plan) -> dict:
    """Loss and accuracy sums of all parts in the plan."""
    out = {}
    for name, start, width in plan.runs:
        error = np.abs(y[:, start : start + width] - z[:, start : start + width])
        out["continuous", name] = error.sum(), (1 / (error + 1)).sum()
    if plan.bools:
        index, starts = _columns(plan.bools)
        same = ((z[:, index] > 0) == (y[:, index] > 0)).sum(axis=0)
        for s, loss, acc in zip(plan.bools, _hinge_sums(y, z, plan.bools), np.add.reduceat(same, starts)):
            out["bool", s[0]] = loss, acc
    if plan.unaries:
        for s, loss, acc in zip(plan.unaries, _hinge_sums(y, z, plan.unaries), closeness(y, z, plan.unaries, 0)):
            out["unary", s[0]] = loss, acc
    if plan.onehots:
        for s, loss, acc in zip(plan.onehots, _hinge_sums(y, z, plan.onehots), agreement(y, z, plan.onehots)):
            out["one-hot", s[0]] = loss, acc
    for name, start, width, sd in plan.spreads:
        mean_y, mean_z = plan.means.get(name, (0.0, 0.0))
        cols = slice(start, start + width)
        # Deviations of prediction and truth; their gap is taken after summing.
        out["spread", name] = np.abs(z[:, cols] - mean_z).sum() * sd / width, np.abs(y[:, cols] - mean_y).sum() / width
    for name, weight, members in plan.gaps:
        guess = sum(sign * z[:, a : a + w] for a, w, sign, _, _ in members)
        real = sum(sign * (y[:, a : a + w] - mean) / sd for a, w, sign, mean, sd in members)
        out["team_gap", name] = weight * np.abs(np.abs(guess) - np.abs(real)).mean(axis=1).sum(), 0.0
    return out


def mean_sums(y, z, plan: Plan) -> dict:
    """Sums of the spread fields' row means, of prediction and truth."""
    return {
        ("mean", name): (z[:, a : a + w].mean(axis=1).sum(), y[:, a : a + w].mean(axis=1).sum())
        for name, a, w, _ in plan.spreads
    }


def report_sums(y, p, plan: Plan) -> dict:
    """Per-field quality sums of predictions after the output heads."""
    out = {}
    counted = plan.bools + plan.unaries
    if counted:
        for s, acc in zip(counted, closeness(y, p, counted, 0.5)):
            out["accuracy", s[0]] = acc, 0.0
    for s, acc in zip(plan.onehots, agreement(y, p, plan.onehots)):
        out["accuracy", s[0]] = acc, 0.0
    for name, start, width, _ in plan.spreads:
        cols = slice(start, start + width)
        out["error", name] = np.abs(y[:, cols] - p[:, cols]).mean(axis=1).sum(), 0.0
    return out
