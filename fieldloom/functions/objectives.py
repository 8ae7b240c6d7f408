"""Losses and their gradients by the logits, for one batch of rows.

Each objective returns the batch's mean loss and its gradient; partial results
of several batches are combined with their row counts as weights.  The spread
part compares deviations over all rows of a step, so a step first adds up
``spread_means`` and ``spread_deviations`` of its batches and hands the result of
``settled`` to every batch.  A batch on its own is a whole step.
"""

from __future__ import annotations

import numpy as np

from fieldloom.functions.network import sigmoid


class MixedObjective:
    """Mean of the part losses of the generator (see ``operators.metrics``)."""

    def __init__(self, width, plan, extra_losses=0):
        hinges = plan.bools + plan.unaries + plan.onehots
        self.spreads, self.gaps = plan.spreads, plan.gaps
        self.parts = len(plan.runs) + len(hinges) + len(plan.spreads) + len(plan.gaps) + extra_losses
        # Every hinge part averages over its own columns.
        self.hinge_weight, self.absolute = np.zeros(width, "float32"), np.zeros(width, "float32")
        for _, start, n, _ in hinges:
            self.hinge_weight[start : start + n] = 1.0 / n
        for _, start, n in plan.runs:
            self.absolute[start : start + n] = 1.0

    def spread_means(self, z, y):
        """Per spread: cells, sum of logits, sum of targets."""
        cuts = [slice(start, start + width) for _, start, width, _ in self.spreads]
        return np.array(
            [(z[:, c].size, z[:, c].sum(dtype="float64"), y[:, c].sum(dtype="float64")) for c in cuts], "float64"
        ).reshape(-1, 3)

    def spread_deviations(self, z, y, means):
        """Per spread: sums of distances from the means and of the logits' sides."""
        out = []
        for (_, start, width, _), (n, z_sum, y_sum) in zip(self.spreads, means):
            cut = slice(start, start + width)
            off = z[:, cut].astype("float64") - z_sum / n
            out.append((np.abs(off).sum(), np.abs(y[:, cut] - y_sum / n).sum(dtype="float64"), np.sign(off).sum()))
        return np.array(out, "float64").reshape(-1, 3)

    def settled(self, means, deviations):
        """Per spread: mean logit, direction of its gradient, mean side, loss."""
        out = []
        for (_, _, _, sd), (n, z_sum, _), (z_off, y_off, side) in zip(self.spreads, means, deviations):
            gap = z_off / n * sd - y_off / n
            out.append((z_sum / n, np.sign(gap), side / n, abs(gap) / sd))
        return out

    def __call__(self, z, y, spreads=None):
        n = len(z)
        if spreads is None:
            means = self.spread_means(z, y)
            spreads = self.settled(means, self.spread_deviations(z, y, means))
        sign = 2 * y - 1
        margin = 1 - sign * z
        active = (margin > 0) * self.hinge_weight
        error = (z - y) * self.absolute
        loss = float(np.sum(margin * active, dtype="float64") + np.abs(error).sum(dtype="float64")) / n
        grad = (np.sign(error) - sign * active) / n
        for (_, start, width, _), (mean, direction, side, part) in zip(self.spreads, spreads):
            cut = slice(start, start + width)
            grad[:, cut] += direction * (np.sign(z[:, cut] - mean) - side) / (n * width)
            loss += part
        for _, weight, members in self.gaps:
            loss += self._gap(z, y, weight, members, grad)
        return loss / self.parts, grad / self.parts

    @staticmethod
    def _gap(z, y, weight, members, grad):
        guess = sum(s * z[:, a : a + w] for a, w, s, _, _ in members)
        real = sum(s * (y[:, a : a + w] - m) / sd for a, w, s, m, sd in members)
        off = np.abs(guess) - np.abs(real)
        step = weight * np.sign(off) * np.sign(guess) / off.size
        for a, w, s, _, _ in members:
            grad[:, a : a + w] += s * step
        return weight * np.abs(off).mean()


class LogisticObjective:
    """Cross-entropy of one logit column."""

    def __call__(self, z, y):
        loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
        return loss.mean(), (sigmoid(z) - y) / z.size
