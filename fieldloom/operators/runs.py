"""Run management as queries on a metric log (run, step, value, ts, ...)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from fieldloom.operators.ordering import Running, with_running

# Stagnation defaults.
MIN_LOG = 30
CHECKPOINTS = (0.75, 0.8)

STEP_BLOCK = 1_000_000


@dataclass(frozen=True)
class CriteriaSpec:
    """``samplesN:stagnantM,c1,c2:secondsN``; ``never`` disables stopping."""

    samples: tuple[int, ...] = ()
    stagnant: tuple[tuple[int, tuple[float, ...]], ...] = ()
    seconds: tuple[float, ...] = ()

    @staticmethod
    def parse(spec: str | None) -> CriteriaSpec:
        samples, stagnant, seconds = [], [], []
        words = [] if not spec or spec == "never" else spec.split(":")
        for word in words:
            if word.startswith("samples"):
                samples.append(int(float(word.removeprefix("samples"))))
            elif word.startswith("stagnant"):
                first, *rest = word.removeprefix("stagnant").split(",")
                points = tuple(float(p) for p in rest) or CHECKPOINTS
                stagnant.append((int(first) if first else MIN_LOG, points))
            elif word.startswith("seconds"):
                seconds.append(float(word.removeprefix("seconds")))
            else:
                raise ValueError(f"unknown stop criterion {word!r}")
        return CriteriaSpec(tuple(samples), tuple(stagnant), tuple(seconds))

    def should_stop(self, samples: int, losses: list[float], elapsed: float) -> bool:
        """The same rules on the values of a fit in progress."""

        def stagnates(min_log, points):
            last = len(losses) - 1
            return len(losses) >= min_log and all(losses[math.floor(p * last)] < losses[-1] for p in points)

        return (
            any(samples >= n for n in self.samples)
            or any(stagnates(m, p) for m, p in self.stagnant)
            or any(elapsed >= s for s in self.seconds)
        )


def number_steps(log: DataFrame, order, run: str = "run", partitions: int | None = None) -> DataFrame:
    """1-based ``step`` of each row within its run."""
    return with_running(log, [run], order, {"step": Running("number")}, partitions=partitions)


def best_checkpoint(
    log: DataFrame, order, value: str = "accuracy", run: str = "run", partitions: int | None = None
) -> DataFrame:
    """Rows that strictly improve on everything before them in their run."""
    runs = {"step": Running("number"), "_best": Running("max_before", value)}
    marked = with_running(log, [run], order, runs, partitions=partitions)
    return marked.where(F.col("_best").isNull() | (F.col(value) > F.col("_best"))).drop("_best")


def stop_max_samples(steps: DataFrame, batch_size: int, maximum: int, run: str = "run") -> DataFrame:
    """First step of each run with ``step * batch_size >= maximum``."""
    reached = steps.where(F.col("step") * batch_size >= maximum)
    return reached.groupBy(run).agg(F.min("step").alias("stop_step"))


def stop_stagnation(steps: DataFrame, min_log: int = MIN_LOG, checkpoints=CHECKPOINTS, run: str = "run", loss: str = "loss") -> DataFrame:
    """First step whose loss is above the loss at every relative checkpoint.

    Each step looks up its earlier rows with an equi-join on (run, step): rows
    of a long run spread over all tasks.
    """
    late = steps.where(F.col("step") >= min_log).select(run, "step", F.col(loss).alias("last"))
    points = F.explode(F.lit([float(c) for c in checkpoints]))
    asked = late.select(run, "step", "last", points.alias("cp")).select(
        run, "step", "last", (F.floor(F.col("cp") * (F.col("step") - 1)) + 1).alias("at")
    )
    earlier = steps.select(F.col(run).alias("_run"), F.col("step").alias("_step"), F.col(loss).alias("then"))
    met = asked.join(earlier, (F.col(run) == F.col("_run")) & (F.col("at") == F.col("_step")))
    above = met.groupBy(run, "step").agg(F.bool_and(F.col("then") < F.col("last")).alias("stagnant"))
    return above.where("stagnant").groupBy(run).agg(F.min("step").alias("stop_step"))


def stop_elapsed(steps: DataFrame, seconds: float, run: str = "run", ts: str = "ts") -> DataFrame:
    """First step at least ``seconds`` after the run's first row.

    Starts are joined per block of steps, so that a long run is spread over as
    many join keys as it has blocks.
    """
    block = F.floor(F.col("step") / STEP_BLOCK).cast("bigint")
    starts = steps.groupBy(run).agg(F.min(ts).alias("_start"), F.max(block).alias("_last"))
    starts = starts.select(
        F.col(run).alias("_run"), "_start", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_at")
    )
    same = (F.col(run) == F.col("_run")) & (F.col("_block") == F.col("_at"))
    wait = F.make_dt_interval(secs=F.lit(float(seconds)))
    late = steps.withColumn("_block", block).join(starts, same).where(F.col(ts) >= F.col("_start") + wait)
    return late.groupBy(run).agg(F.min("step").alias("stop_step"))


def stop_any(steps: DataFrame, spec: str, batch_size: int, run: str = "run", loss: str = "loss", ts: str = "ts") -> DataFrame:
    """Earliest stop over all criteria of ``spec``; no row if none fires."""
    criteria = CriteriaSpec.parse(spec)
    parts = [stop_max_samples(steps, batch_size, n, run) for n in criteria.samples]
    parts += [stop_stagnation(steps, m, p, run, loss) for m, p in criteria.stagnant]
    parts += [stop_elapsed(steps, s, run, ts) for s in criteria.seconds]
    if not parts:
        return steps.select(run, F.col("step").alias("stop_step")).where(F.lit(False))
    stops = reduce(DataFrame.unionByName, parts)
    return stops.groupBy(run).agg(F.min("stop_step").alias("stop_step"))


def evaluation_cadence(
    steps: DataFrame,
    batch_size: int,
    per_evaluation: int = 50_000,
    per_train_evaluation: int = 100_000,
    keep_remainder: bool = False,
) -> DataFrame:
    """Which steps evaluate: the first, then whenever enough samples passed.

    The counters restart at each evaluation, so the pattern repeats and needs
    no look at other rows.  With ``keep_remainder`` the surplus over the
    threshold counts towards the next evaluation.  Train evaluations that are more
    frequent then depend on earlier steps, but repeat too: one round of them is listed from
    the sizes, and every row finds its answer in it.
    """
    index = F.col("step") - 1
    if keep_remainder:
        if batch_size >= per_evaluation:
            test = F.lit(True)
        else:
            crossed = F.floor(index * batch_size / per_evaluation) > F.floor((index - 1) * batch_size / per_evaluation)
            test = (index == 0) | crossed
        train = test
        if per_train_evaluation < per_evaluation and batch_size < per_evaluation:
            steps = _with_train(steps, batch_size, per_evaluation, per_train_evaluation)
            train = F.col("_train")
    else:
        period = math.ceil(per_evaluation / batch_size)
        train_period = math.ceil(per_train_evaluation / batch_size)
        test = index % period == 0
        train = (index % period) % train_period == 0
    return steps.select(
        "*",
        (index * batch_size).alias("samples"),
        test.alias("evaluates"),
        train.alias("train_evaluates"),
    ).drop("_train")


def _train_events(batch_size: int, per_evaluation: int, per_train: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Steps of a period, the first period that repeats, how many there are up to the last,
    and the places (from 0) of their evaluations with the train counter after each.

    Evaluations repeat after a fixed number of steps. At one, the train counter keeps what
    is above its threshold or restarts, so it depends on the last evaluation and the steps
    since. Periods are listed until one starts with a counter seen before: their number
    follows from the sizes alone, not from the log.
    """

    def after(counter: int, steps: int) -> int:
        counter = (counter + steps * batch_size) % per_train
        return counter if counter < batch_size else 0

    common = math.gcd(batch_size, per_evaluation)
    period, evaluations = per_evaluation // common, batch_size // common
    starts, places, counters, counter = {}, [], [], 0
    while counter not in starts:
        first, before = len(starts) * period, 0
        starts[counter] = len(starts)
        for k in range(evaluations):
            place = -(-k * per_evaluation // batch_size)
            counter = after(counter, place - before) if k else counter
            places.append(first + place)
            counters.append(counter)
            before = place
        counter = after(counter, period - before)
    return period, starts[counter], len(starts), np.array(places, np.int64), np.array(counters, np.int64)


def _with_train(steps: DataFrame, batch_size: int, per_evaluation: int, per_train: int) -> DataFrame:
    """``steps`` with ``_train``, whether each evaluates on train rows; none below step 1.

    Every row is answered by itself from the list of one round of evaluations.
    """
    if batch_size >= per_train:
        return steps.withColumn("_train", F.expr("if(step >= 1, true, null)"))
    period, first, periods, places, counters = _train_events(batch_size, per_evaluation, per_train)

    def answer(batches):
        for batch in batches:
            step = batch.column("_number")
            index = step.fill_null(0).to_numpy(zero_copy_only=False) - 1
            number = index // period
            number = np.where(number < periods, number, first + (number - first) % (periods - first))
            index = np.where(index < 0, 0, number * period + index % period)
            last = np.searchsorted(places, index, side="right") - 1
            since = index - places[last]
            trains = (since == 0) | ((counters[last] + since * batch_size) % per_train < batch_size)
            known = pc.greater_equal(step, 1)
            column = pc.if_else(known, pa.array(trains), pa.scalar(None, pa.bool_()))
            rest = [c for c, name in zip(batch.columns, batch.schema.names) if name != "_number"]
            yield pa.RecordBatch.from_arrays([*rest, column], names=[*(n for n in batch.schema.names if n != "_number"), "_train"])

    schema = StructType([*steps.schema.fields, StructField("_train", BooleanType())])
    return steps.withColumn("_number", F.col("step").cast("bigint")).mapInArrow(answer, schema)
