"""Data-parallel fitting: per step one broadcast, one partial gradient per
task, one elementwise sum on the executors and one update on the driver.

Only weights, summed gradients and metric values reach the driver; their size
follows from the declared network.
"""

from __future__ import annotations

import copy
import hashlib
import itertools
import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.hashing import draw_text
from fieldloom.functions.network import (
    flatten,
    forward,
    gradients,
    initial_network,
    row_batches,
    to_matrix,
    unflatten,
)
from fieldloom.functions.objectives import LogisticObjective, MixedObjective
from fieldloom.functions.optimizers import Optimizer
from fieldloom.functions.text import literal, name
from fieldloom.operators.metrics import (
    combine,
    eval_l2,
    eval_parts,
    eval_win,
    evaluation_plan,
)
from fieldloom.operators.ordering import chunk_count
from fieldloom.operators.runs import CriteriaSpec
from fieldloom.operators.scoring import score_dense
from fieldloom.schema import KNOWN, OUTCOME, Dictionary
from fieldloom.session import drop_folders, new_folder, scratch, ship_package, write_stage
from fieldloom.sources.models import check_network, load_network, network_frame, save_network

BLOCK = 1 << 16
FAN_IN = 128
#: Rows that a task of a local round trains on before networks are averaged.
CHUNK_ROWS = 1 << 14
#: Bytes of networks that one scan of a search trains at a time.
SCAN_BYTES = 1 << 28
LOG_SCHEMA = "run string, step bigint, samples bigint, split string, metric string, value double"


def mixed_objective(dictionary: Dictionary, ignored=(), extra_losses: int = 0) -> MixedObjective:
    """The generator's loss for a dictionary's unknown fields."""
    plan = evaluation_plan(dictionary, ignored)
    return MixedObjective(dictionary.width(OUTCOME), plan, extra_losses)


def gradient_sum(
    df: DataFrame, network, objective, inputs, target: str, activation="leaky-relu", dtype="float64"
):
    """(rows, mean loss, flat mean gradient) over all rows of ``df``.

    Each task adds up its own batches and emits its sum in blocks; the blocks
    are added on the executors, so the driver gets one copy of the gradient.  Spread
    losses need the rows' means and deviations first, which are two passes before;
    how rows are dealt to tasks and batches changes nothing but rounding.
    """
    check_network(network)
    spark = df.sparkSession
    ship_package(spark)
    typed = [(w.astype(dtype), b.astype(dtype)) for w, b in network]
    inputs = list(inputs)
    if getattr(objective, "spreads", None):
        means = _spread_sums(df, typed, objective, inputs, target, activation, dtype)
        if not len(means):
            raise ValueError("no rows to fit on")
        deviations = _spread_sums(df, typed, objective, inputs, target, activation, dtype, means)
        settled = (objective.settled(means, deviations),)
    else:
        settled = ()
    shared = spark.sparkContext.broadcast((typed, objective, settled))

    def partial(batches):
        net, loss_of, settled = shared.value
        rows, loss_sum, grad_sum = 0, 0.0, None
        for batch in row_batches(batches):
            n = batch.num_rows
            mats = [to_matrix(batch.column(c), dtype, c) for c in inputs]
            x = mats[0] if len(mats) == 1 else np.hstack(mats)
            y = to_matrix(batch.column(target), dtype, target)
            loss, grad = gradients(x, net, lambda z: loss_of(z, y, *settled), activation)  # noqa: B023
            flat = flatten(grad).astype("float64") * n
            rows, loss_sum = rows + n, loss_sum + loss * n
            grad_sum = flat if grad_sum is None else grad_sum + flat
        if grad_sum is not None:
            yield from _blocks(0, rows, loss_sum, grad_sum)

    sums = _added(df.select(*inputs, target).mapInArrow(partial, SUMS))
    shared.destroy()
    if not sums:
        raise ValueError("no rows to fit on")
    n, loss, grad = sums[0]
    return n, loss / n, grad / n


SUMS = "trainee int, block int, n bigint, loss double, g array<double>"


def _blocks(trainee: int, rows: int, loss: float, flat: np.ndarray):
    """A task's sums as rows of ``SUMS``, the vector in blocks."""
    for i in range(0, len(flat), BLOCK):
        values = [[trainee], [i // BLOCK], [rows], [loss], [flat[i : i + BLOCK]]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [c.split()[0] for c in SUMS.split(", ")])


def _added(parts: DataFrame) -> dict[int, tuple[int, float, np.ndarray]]:
    """(rows, loss, vector) per trainee, added up on the executors."""
    sums = [F.sum("n").alias("n"), F.sum("loss").alias("loss"), Summarizer.sum(F.col("v")).alias("v")]
    # Two levels, so that no reducer adds up more than FAN_IN tasks' vectors.
    branch = F.floor(F.spark_partition_id() / FAN_IN).alias("branch")
    vectors = parts.select("trainee", "block", branch, "n", "loss", array_to_vector("g").alias("v"))
    found: dict[int, list] = {}
    for row in vectors.groupBy("trainee", "block", "branch").agg(*sums).groupBy("trainee", "block").agg(*sums).collect():
        found.setdefault(row["trainee"], []).append(row)
    out = {}
    for trainee, blocks in found.items():
        blocks.sort(key=lambda r: r["block"])
        out[trainee] = blocks[0]["n"], blocks[0]["loss"], np.concatenate([r["v"].toArray() for r in blocks])
    return out


@dataclass(frozen=True)
class Trainee:
    """A network and how tasks train it, each on rows of its own.

    ``penalty`` is per loss part; ``summed`` steps by the sum of a batch's losses.
    """

    network: list
    objective: object
    batch_size: int = 2048
    optimizer: str = "adam"
    learning_rate: float = 0.001
    activation: str = "leaky-relu"
    penalty: float = 0.0
    summed: bool = False
    #: What the optimizer remembers of earlier rounds: its number of steps and its vectors.
    steps: int = 0
    memory: dict = field(default_factory=dict)

    def train(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of row losses, flat network with the optimizer's memory) after one small step per
        batch, from the first row to the last."""
        rule, flat, total = Optimizer(self.optimizer, self.learning_rate), flatten(self.network), 0.0
        rule.steps, rule.state = self.steps, dict(self.memory)
        weights = flatten([(np.ones_like(w), np.zeros_like(b)) for w, b in self.network]) if self.penalty else None
        for start in range(0, len(x), self.batch_size):
            xs, ys = x[start : start + self.batch_size], y[start : start + self.batch_size]
            net = unflatten(flat.astype(x.dtype), self.network)
            loss, grad = gradients(xs, net, lambda z: self.objective(z, ys), self.activation)  # noqa: B023
            # A short last batch of a summed loss weighs by its rows.
            scale = len(xs) if self.summed else 1
            loss, grad = loss * scale, flatten(grad).astype("float64") * scale
            if self.penalty:
                grad = grad + self.penalty * flat * weights
                loss += self.penalty * float((flat * weights) @ flat) / 2
            total += loss * len(xs)
            flat = rule.update(flat, grad)
        return total, np.concatenate([flat, [rule.steps], *(rule.state[k] for k in sorted(rule.state))])

    def moved(self, mean: np.ndarray) -> Trainee:
        """The trainee with the mean of what ``train`` gave."""
        names = sorted(Optimizer(self.optimizer, self.learning_rate).slots)
        size = sum(w.size + b.size for w, b in self.network)
        parts = np.split(mean[size + 1 :], len(names)) if names else []
        return replace(self, network=unflatten(mean[:size], self.network), steps=max(1, round(mean[size])), memory=dict(zip(names, parts)))


def local_round(df: DataFrame, trainees: list[Trainee], inputs, target: str, chunk: str = "chunk", dtype="float32") -> list[tuple]:
    """(rows, mean loss, trainee) of each trainee after a round of small steps.

    One scan serves all trainees. Every run of rows of one ``chunk`` (of ``CHUNK_ROWS``, if it is
    longer) starts from the trainee's network, takes its steps in row order and counts by its rows
    in the mean of the networks and of what their optimizers remember, which is added up on the executors.
    """
    spark = df.sparkSession
    ship_package(spark)
    for trainee in trainees:
        check_network(trainee.network)
    inputs, most = list(inputs), CHUNK_ROWS
    shared = spark.sparkContext.broadcast(trainees)

    def partial(batches):
        sums = [[0, 0.0, None] for _ in shared.value]

        def settle(held):
            xs, ys = (np.concatenate(part) for part in zip(*held))
            for own, trainee in zip(sums, shared.value):
                loss, flat = trainee.train(xs, ys)
                own[0] += len(xs)
                own[1] += loss
                own[2] = flat * len(xs) if own[2] is None else own[2] + flat * len(xs)

        held, rows, now = [], 0, None
        for batch in batches:
            numbers = batch.column(chunk).to_numpy(zero_copy_only=False)
            mats = [to_matrix(batch.column(c), dtype, c) for c in inputs]
            x = mats[0] if len(mats) == 1 else np.hstack(mats)
            y = to_matrix(batch.column(target), dtype, target)
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (rows == most or numbers[a] != now):
                        settle(held)
                        held, rows = [], 0
                    end = min(b, a + most - rows)
                    held.append((x[a:end], y[a:end]))
                    rows, now, a = rows + end - a, numbers[a], end
        if held:
            settle(held)
            for trainee, (n, loss, flat) in enumerate(sums):
                yield from _blocks(trainee, n, loss, flat)

    found = _added(df.select(*inputs, target, chunk).mapInArrow(partial, SUMS))
    shared.destroy()
    if not found:
        raise ValueError("no rows to fit on")
    out = []
    for i, trainee in enumerate(trainees):
        n, loss, flat = found[i]
        out.append((n, loss / n, trainee.moved(flat / n)))
    return out


def _spread_sums(df: DataFrame, network, objective, inputs, target, activation, dtype, means=None) -> np.ndarray:
    """Sums over all rows of the spreads' means, or of their deviations from ``means``.

    Only the logits' columns that spreads look at are worked out.
    """
    columns = sorted({c for _, start, width, _ in objective.spreads for c in range(start, start + width)})
    place = {c: i for i, c in enumerate(columns)}
    *inner, (w, b) = network
    narrow = copy.copy(objective)
    narrow.spreads = [(path, place[start], width, sd) for path, start, width, sd in objective.spreads]
    shared = df.sparkSession.sparkContext.broadcast([*inner, (w[:, columns], b[columns])])

    def partial(batches):
        sums = None
        for batch in row_batches(batches):
            mats = [to_matrix(batch.column(c), dtype, c) for c in inputs]
            z = forward(mats[0] if len(mats) == 1 else np.hstack(mats), shared.value, activation)
            y = to_matrix(batch.column(target), dtype, target)[:, columns]
            part = narrow.spread_means(z, y) if means is None else narrow.spread_deviations(z, y, means)
            sums = part if sums is None else sums + part
        if sums is not None:
            names = ["spread", "a", "b", "c"]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), *map(pa.array, sums.T)], names=names)

    parts = df.select(*inputs, target).mapInArrow(partial, "spread int, a double, b double, c double")
    # One row per declared spread.
    rows = parts.groupBy("spread").agg(*[F.sum(c).alias(c) for c in "abc"]).orderBy("spread").collect()
    shared.destroy()
    return np.array([(r["a"], r["b"], r["c"]) for r in rows], "float64").reshape(-1, 3)


def step_groups(df: DataFrame, groups: int, seed=0, key: str = "rec_id") -> DataFrame:
    """Rows laid out by step group, so that a step scans few files.

    Groups are range-partitioned and ordered, with a file per partition, sized by rows,
    however many groups there are; a step's filter skips files and row groups by their
    bounds.  A single group needs no layout.
    """
    if groups == 1:
        return df.withColumn("step_group", F.lit(0))
    spark = df.sparkSession
    path = new_folder(spark, "steps")
    draw = draw_text(seed, literal("step"), name(key))
    rows = df.withColumn("step_group", F.expr(f"cast(floor({draw} * {groups}) as int)"))
    spread = F.xxhash64(key)
    ordered = rows.repartitionByRange(chunk_count(df, rows.count()), "step_group", spread).sortWithinPartitions("step_group")
    return write_stage(ordered, path)


def local_groups(df: DataFrame, groups: int = 1, seed=0, key: str = "rec_id", rows: int = CHUNK_ROWS * 3 // 4) -> DataFrame:
    """Rows laid out by step group and, within it, by chunk and a drawn order.

    Group, chunk and order follow from the seed and the key, so that a task finds the same
    rows in the same order on every run. A chunk has about ``rows`` rows; a file holds whole chunks.
    """
    spark = df.sparkSession
    count = df.count()
    chunks = max(1, -(-count // (groups * rows)))
    draw = lambda what: draw_text(seed, literal(what), name(key))
    drawn = {"step_group": f"cast(floor({draw('step')} * {groups}) as int)", "chunk": f"cast(floor({draw('chunk')} * {chunks}) as int)"}
    path = new_folder(spark, "chunks")
    table = df.withColumns({c: F.expr(e) for c, e in drawn.items()})
    files = max(chunk_count(df, count), min(groups * chunks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["step_group", "chunk", F.expr(draw("order")), F.col(key)]
    return write_stage(table.repartitionByRange(files, "step_group", "chunk").sortWithinPartitions(*order), path)


@dataclass
class Fit:
    """The network of the best seen accuracy, that accuracy, the metric log and the last network."""

    network: list
    best_accuracy: float | None = None
    log: list = field(default_factory=list)
    last: list | None = None

    def log_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG_SCHEMA)


def as_is(rows: DataFrame, epoch: int) -> DataFrame:
    return rows


def fit(
    train: DataFrame,
    network,
    objective,
    inputs,
    target: str,
    evaluate,
    steps: int | None = None,
    passes: int | None = None,
    prepare=as_is,
    groups: int = 1,
    rows_per_step: int | None = None,
    batch_size: int = 2048,
    optimizer: str = "adam",
    learning_rate: float = 0.001,
    activation: str = "leaky-relu",
    penalty: float = 0.0,
    loss_parts: int = 1,
    summed: bool = False,
    samples_per_evaluation: int = 50_000,
    stop: str = "seconds1800:stagnant",
    save_to: str | None = None,
    run: str = "fit",
    seed=0,
    key: str = "rec_id",
    keep_remainder: bool = False,
    local_batch: int | None = None,
    dtype: str = "float32",
) -> Fit:
    """Shared loop: gradient, clip, update; evaluate and keep the best state.

    With ``local_batch`` a step is a round: every chunk of the step's rows takes many small steps,
    of so many rows each, and the networks are averaged (see ``local_round``); the loss logged is the
    mean over these steps. Without, a step is one gradient over all its rows.

    ``evaluate(network) -> (loss, accuracy)`` runs after the first and the last
    step and whenever enough samples have passed; ``keep_remainder`` counts the surplus
    towards the next evaluation.  The state kept, and written to
    ``save_to``, is the one whose evaluation accuracy strictly improved last.  The
    fit ends after ``steps`` or when ``stop`` says so.  ``summed`` fits the sum of
    the row losses of ``batch_size`` rows instead of their mean, however many rows a step
    has.  One step uses one of ``groups`` parts of the rows; ``rows_per_step`` sets
    their number by their size, and ``passes`` the steps by how often all parts are read.  Raw rows are laid out once; ``prepare(rows, epoch)`` draws and
    encodes the rows of a step as it reads them, so that encoded rows, many times
    larger, are never stored.
    """
    criteria = CriteriaSpec.parse(stop)
    if steps is None and passes is None and criteria == CriteriaSpec():
        raise ValueError("a fit needs a number of steps or a stop criterion")
    with scratch() as made:
        if rows_per_step:
            groups = max(1, -(-train.count() // rows_per_step))
        if passes is not None:
            steps = passes * groups
        data = local_groups(train, groups, seed, key) if local_batch else step_groups(train, groups, seed, key)
    rule = Optimizer(optimizer, learning_rate)
    trainee = Trainee(network, objective, local_batch or batch_size, optimizer, learning_rate, activation, penalty / loss_parts, summed)
    result, samples, since, losses, started = Fit(network), 0, 0, [], None
    for step in itertools.count() if steps is None else range(steps):
        rows = prepare(data.where(F.col("step_group") == step % groups), step // groups)
        if local_batch:
            n, loss, trainee = local_round(rows, [trainee], inputs, target, dtype=dtype)[0]
            moved = trainee.network
        else:
            n, loss, grad = gradient_sum(rows, network, objective, inputs, target, activation, dtype)
            if summed:
                loss, grad = loss * batch_size, grad * batch_size
            flat = flatten(network)
            if penalty:
                weight_only = flatten([(w, np.zeros_like(b)) for w, b in network])
                grad = grad + penalty * weight_only / loss_parts
                loss += penalty * float(weight_only @ weight_only) / 2 / loss_parts
            moved = unflatten(rule.update(flat, grad), network)
        if not math.isfinite(loss):
            raise FloatingPointError(f"loss of step {step} is {loss}")
        result.log.append((run, step, samples, "train", "loss", float(loss)))
        network = result.last = moved
        samples, since = samples + n, since + n
        if step and since < samples_per_evaluation and step + 1 != steps:
            continue
        since = max(0, since - samples_per_evaluation) if keep_remainder else 0
        started = started or time.monotonic()
        eval_loss, accuracy = evaluate(network)
        losses.append(eval_loss)
        result.log.append((run, step, samples, "evaluation", "loss", float(eval_loss)))
        result.log.append((run, step, samples, "evaluation", "accuracy", float(accuracy)))
        if result.best_accuracy is None or accuracy > result.best_accuracy:
            result.best_accuracy, result.network = accuracy, network
            if save_to:
                save_network(train.sparkSession, network, save_to)
        if criteria.should_stop(samples, losses, time.monotonic() - started):
            break
    drop_folders(train.sparkSession, made)
    return result


def evaluated(held: DataFrame, network, dictionary: Dictionary, activation: str, penalty: float = 0.0, ignored=()) -> tuple:
    """(loss, accuracy) of the generator on encoded rows."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(network)
    parts = eval_parts(held, dictionary, ignored, y="unknown", x="known", network=shared, activation=activation, dtype="float32")
    if penalty:
        parts = parts.unionByName(eval_l2(network_frame(spark, network), penalty))
    row = combine(parts).first()
    shared.destroy()
    return row["loss"], row["accuracy"]


def fit_network(
    train: DataFrame,
    evaluation: DataFrame,
    dictionary: Dictionary,
    hidden=(256,),
    penalty: float = 0.0,
    activation: str = "leaky-relu",
    ignored=(),
    seed=0,
    **options,
) -> Fit:
    """Fit the generator (known -> unknown) on encoded records.

    ``evaluation`` is read anew by every evaluation and never stored: encoded as it is read, it
    takes no disk.
    """
    objective = mixed_objective(dictionary, ignored, extra_losses=1 if penalty else 0)
    sizes = [dictionary.width(KNOWN), *hidden, dictionary.width(OUTCOME)]
    held = evaluation.select("known", "unknown")

    def evaluate(network):
        return evaluated(held, network, dictionary, activation, penalty, ignored)

    return fit(
        train, initial_network(sizes, seed), objective, ["known"], "unknown", evaluate,
        activation=activation, penalty=penalty, loss_parts=objective.parts, seed=seed, **options,
    )


def fit_binary(
    train: DataFrame,
    evaluation: DataFrame,
    inputs,
    n_inputs: int,
    target: str,
    hidden=(256,),
    activation="leaky-relu",
    seed=0,
    **options,
) -> Fit:
    """Fit one logit on the concatenated inputs: the win net (inputs known and
    generated unknown) or the two-sample net (target 1 real, 0 generated).

    ``evaluation`` is read anew by every evaluation, as in ``fit_network``.
    """
    sizes = [n_inputs, *hidden, 1]
    held = evaluation.select(*inputs, target)

    def evaluate(network):
        scored = score_dense(held, network, inputs, "z", activation, drop=tuple(inputs))
        row = eval_win(scored.select(F.get("z", F.lit(0)).alias("z"), F.col(target).cast("double").alias("y"))).first()
        return row["loss"], row["accuracy"]

    return fit(
        train, initial_network(sizes, seed), LogisticObjective(), inputs, target, evaluate,
        activation=activation, summed=True, seed=seed, **options,
    )


# The search space.
RATE_RANGE = (1e-6, 1e-1)
WIDTH_CAPS = {1: 1 << 13, 2: 1 << 13, 3: 1 << 12, 4: 1 << 11, 5: 1 << 10}
BATCH_RANGE = (1 << 9, 1 << 13)
TRIAL_OPTIMIZERS = ("adam", "adagrad", "momentum", "adadelta", "sgd")
TRIAL_ACTIVATIONS = ("relu", "leaky-relu", "sigmoid", "tanh")
TRIAL_SCHEMA = (
    "trial int, learning_rate double, hidden array<int>, optimizer string, batch_size int, "
    "activation string, status string, loss double, passes int"
)


def draw_trial(seed, trial: int) -> dict:
    """One draw of the search space, from md5 prefixes of seed, trial and name."""

    def uniform(what):
        return int(hashlib.md5(f"{seed}:{trial}:{what}".encode()).hexdigest()[:8], 16) / 2**32

    def log_uniform(what, lo, hi):
        return math.exp(math.log(lo) + uniform(what) * (math.log(hi) - math.log(lo)))

    def choice(what, values):
        return values[int(uniform(what) * len(values))]

    layers = choice("layers", tuple(WIDTH_CAPS))
    return {
        "trial": trial,
        "learning_rate": log_uniform("rate", *RATE_RANGE),
        "hidden": [max(1, round(log_uniform(f"width{i}", 1, WIDTH_CAPS[layers]))) for i in range(layers)],
        "optimizer": choice("optimizer", TRIAL_OPTIMIZERS),
        "batch_size": round(log_uniform("batch", *BATCH_RANGE)),
        "activation": choice("activation", TRIAL_ACTIVATIONS),
    }


def _lots(draws: list[dict], sizes: dict[int, int]) -> list[list[dict]]:
    """Trials whose networks are trained in one scan, by declared size."""
    lots, held = [[]], 0
    for draw in draws:
        if lots[-1] and held + sizes[draw["trial"]] > SCAN_BYTES:
            lots.append([])
            held = 0
        lots[-1].append(draw)
        held += sizes[draw["trial"]]
    return [lot for lot in lots if lot]


def search_trials(spark: SparkSession, path: str, trials: int, start, train, evaluate, passes: int = 1, keep: float = 0.5, seed=0) -> DataFrame:
    """Fit drawn trials side by side, a pass over the rows at a time; after each pass the worse part is dropped.

    ``start(draw) -> network``; ``train(draws, networks, epoch) -> [(loss, network)]`` is one scan that
    trains several; ``evaluate(draw, network) -> accuracy``. After a pass the best ``keep`` of the trials go on
    (one at least), until ``passes`` are made. So the number of jobs follows from trials and
    passes, not from the rows.

    A trial that ends is appended to the table at ``path``, a non-finite loss or accuracy as failed; the
    networks that go on are kept beside it, so that a rerun skips what is done and goes on with the pass that was cut.
    """
    try:
        ended = {r["trial"] for r in spark.read.schema(TRIAL_SCHEMA).parquet(f"{path}/trials").select("trial").collect()}
    except AnalysisException:
        ended = set()
    alive = [draw_trial(seed, t) for t in range(trials) if t not in ended]
    done, best = _last_pass(spark, path)
    networks = {
        d["trial"]: load_network(spark, f"{path}/networks/pass={done}/trial={d['trial']}") if d["trial"] in best else start(d) for d in alive
    }

    def end(some, epoch, status="ok"):
        rows = [(*d.values(), status, 1.0 - best[d["trial"]] if status == "ok" else None, epoch) for d in some]
        if rows:
            spark.createDataFrame(rows, TRIAL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/trials")

    for epoch in range(done, passes):
        sizes = {d["trial"]: sum(w.nbytes + b.nbytes for w, b in networks[d["trial"]]) for d in alive}
        failed = []
        for lot in _lots(alive, sizes):
            for draw, (loss, network) in zip(lot, train(lot, [networks[d["trial"]] for d in lot], epoch)):
                accuracy = float(evaluate(draw, network)) if math.isfinite(loss) else math.nan
                if not math.isfinite(accuracy):
                    failed.append(draw)
                    continue
                networks[draw["trial"]] = network
                best[draw["trial"]] = max(accuracy, best.get(draw["trial"], -math.inf))
        end(failed, epoch + 1, "fail")
        alive = sorted((d for d in alive if d not in failed), key=lambda d: (-best[d["trial"]], d["trial"]))
        if epoch + 1 < passes and alive:
            stay = max(1, math.ceil(len(alive) * keep))
            end(alive[stay:], epoch + 1)
            alive = alive[:stay]
            for draw in alive:
                save_network(spark, networks[draw["trial"]], f"{path}/networks/pass={epoch + 1}/trial={draw['trial']}")
            marks = [(epoch + 1, d["trial"], best[d["trial"]]) for d in alive]
            spark.createDataFrame(marks, PASS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/passes")
    end([d for d in alive if d["trial"] in best], passes)
    return spark.read.schema(TRIAL_SCHEMA).parquet(f"{path}/trials")


#: A row per trial that goes on after a pass, written once its network is.
PASS_SCHEMA = "pass int, trial int, best double"


def _last_pass(spark: SparkSession, path: str) -> tuple[int, dict[int, float]]:
    """The last pass that was finished, and the best accuracy of each trial that goes on."""
    try:
        rows = spark.read.schema(PASS_SCHEMA).parquet(f"{path}/passes").collect()
    except AnalysisException:
        return 0, {}
    done = max((r["pass"] for r in rows), default=0)
    return done, {r["trial"]: r["best"] for r in rows if r["pass"] == done}
