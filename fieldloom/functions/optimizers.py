"""Parameter updates from clipped gradients; the state is as large as the model."""

from __future__ import annotations

import numpy as np

CLIP = 5.0  # fixed value: gradients are cut to [-CLIP, CLIP]

# Fixed values of the five optimizers.
ADAM_BETA1, ADAM_BETA2, ADAM_EPSILON = 0.9, 0.999, 1e-4
ADAGRAD_START = 0.1
ADADELTA_RHO, ADADELTA_EPSILON = 0.95, 1e-4
MOMENTUM = 0.1


class Optimizer:
    """``adam`` | ``adagrad`` | ``adadelta`` | ``sgd`` | ``momentum``."""

    def __init__(self, name: str, learning_rate: float):
        rules = {
            "adam": self._adam,
            "adagrad": self._adagrad,
            "adadelta": self._adadelta,
            "sgd": self._sgd,
            "momentum": self._momentum,
        }
        if name not in rules:
            raise ValueError(f"unknown optimizer {name!r}")
        self.rule, self.rate, self.steps, self.state = rules[name], learning_rate, 0, {}
        #: Names of the vectors that the state holds after a step.
        self.slots = {"adam": ("m", "v"), "adagrad": ("a",), "adadelta": ("a", "u"), "momentum": ("a",)}.get(name, ())

    def update(self, parameters, gradient):
        """New flat parameters."""
        self.steps += 1
        return parameters - self.rule(np.clip(gradient, -CLIP, CLIP))

    def _slot(self, name, like, start=0.0):
        return self.state.get(name, np.full_like(like, start))

    def _adam(self, g):
        m = self.state["m"] = ADAM_BETA1 * self._slot("m", g) + (1 - ADAM_BETA1) * g
        v = self.state["v"] = ADAM_BETA2 * self._slot("v", g) + (1 - ADAM_BETA2) * g * g
        rate = self.rate * np.sqrt(1 - ADAM_BETA2**self.steps) / (1 - ADAM_BETA1**self.steps)
        return rate * m / (np.sqrt(v) + ADAM_EPSILON)

    def _adagrad(self, g):
        a = self.state["a"] = self._slot("a", g, ADAGRAD_START) + g * g
        return self.rate * g / np.sqrt(a)

    def _adadelta(self, g):
        a = self.state["a"] = ADADELTA_RHO * self._slot("a", g) + (1 - ADADELTA_RHO) * g * g
        u = self._slot("u", g)
        step = np.sqrt(u + ADADELTA_EPSILON) / np.sqrt(a + ADADELTA_EPSILON) * g
        self.state["u"] = ADADELTA_RHO * u + (1 - ADADELTA_RHO) * step * step
        return self.rate * step

    def _sgd(self, g):
        return self.rate * g

    def _momentum(self, g):
        a = self.state["a"] = MOMENTUM * self._slot("a", g) + g
        return self.rate * a
