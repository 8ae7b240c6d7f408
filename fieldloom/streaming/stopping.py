"""Stop rules on a metric log as it grows: state per run, one stop per run."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from fieldloom.operators.runs import CriteriaSpec
from fieldloom.session import ship_package

#: Steps so far (-1 after the stop), first time in microseconds, place of the first loss kept, losses.
STATE = "steps bigint, started bigint, first bigint, losses array<double>"


def stream_stops(log: DataFrame, spec: str, batch_size: int, order=("ts",), run: str = "run", loss: str = "loss", ts: str = "ts") -> DataFrame:
    """(run, stop_step) of every run, once, when the first criterion of ``spec`` is met.

    The result is that of ``stop_any`` on all rows, if each run's rows arrive in their order; within
    a micro-batch they are put in ``order``. A run's state is its number of steps, its first time and,
    with a stagnation rule, the losses that a later step may still look back to (from its smallest
    checkpoint on); a run that has stopped keeps none. A missing loss never stagnates.
    """
    criteria = CriteriaSpec.parse(spec)
    ship_package(log.sparkSession)
    out = StructType([log.schema[run], StructField("stop_step", LongType())])
    back = min((p for _, points in criteria.stagnant for p in points), default=None)
    order = list(order)

    def follow(key, pieces, state: GroupState):
        steps, started, first, losses = state.get if state.exists else (0, None, 0, [])
        rows = pd.concat(list(pieces))
        if steps < 0:
            return
        rows = rows.sort_values(order, kind="stable")
        times = rows[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        started = int(times.min()) if started is None else started
        kept = np.concatenate([np.array(losses, "float64"), rows[loss].to_numpy("float64")])
        for k, time in enumerate(times.tolist()):
            n = steps + k + 1
            if _stops(criteria, n, n * batch_size, kept, first, (time - started) / 1e6):
                state.update((-1, started, 0, []))
                yield pd.DataFrame({run: [key[0]], "stop_step": [n]})
                return
        steps += len(rows)
        begin = steps if back is None else math.floor(back * steps)
        state.update((steps, started, begin, kept[begin - first :].tolist()))

    names = list(dict.fromkeys([run, *order, loss, ts]))
    return log.select(*names).groupBy(run).applyInPandasWithState(follow, out, STATE, "append", GroupStateTimeout.NoTimeout)


def _stops(criteria: CriteriaSpec, n: int, samples: int, kept: np.ndarray, first: int, elapsed: float) -> bool:
    """Whether step ``n`` stops the run; ``kept`` are the losses from place ``first`` (from 0) on."""

    def stagnates(min_log, points):
        return n >= min_log and all(kept[math.floor(p * (n - 1)) - first] < kept[n - 1 - first] for p in points)

    return (
        any(samples >= most for most in criteria.samples)
        or any(stagnates(m, p) for m, p in criteria.stagnant)
        or any(elapsed >= s for s in criteria.seconds)
    )
