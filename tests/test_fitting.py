import numpy as np
import pytest

from fieldloom.functions.network import ACTIVATIONS, flatten, forward, gradients, initial_network, unflatten
from fieldloom.functions.objectives import LogisticObjective
from fieldloom.functions.optimizers import Optimizer
from fieldloom.operators import fitting
from fieldloom.plans import catalog_fitting
from tests.conftest import SMALL
from tests.test_metrics import FIELDS

WIDTH = FIELDS.width(4)


def batch(n=9, n_in=6, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, n_in)), (rng.random((n, WIDTH)) > 0.4).astype(float)


@pytest.mark.parametrize("activation", list(ACTIVATIONS))
def test_gradient_against_differences(activation):
    x, y = batch()
    net = initial_network([6, 5, WIDTH], seed=1, scale=0.7)
    objective = fitting.mixed_objective(FIELDS)

    def loss(flat):
        return objective(forward(x, unflatten(flat, net), activation), y)[0]

    value, grad = gradients(x, net, lambda z: objective(z, y), activation)
    flat = flatten(net)
    assert value == pytest.approx(loss(flat), rel=1e-6)
    step = 1e-6
    for i in np.random.default_rng(0).choice(len(flat), 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        assert flatten(grad)[i] == pytest.approx((loss(up) - loss(down)) / (2 * step), abs=2e-5)


def test_loss_equals_the_metric(spark):
    from fieldloom.operators.metrics import combine, eval_parts

    _, y = batch(20)
    z = np.random.default_rng(8).normal(size=y.shape)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(y, z)], "y array<double>, z array<double>")
    want = combine(eval_parts(df.coalesce(1), FIELDS)).first()["loss"]
    assert fitting.mixed_objective(FIELDS)(z, y)[0] == pytest.approx(want, rel=1e-6)


def test_gradient_sum_does_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(fitting, "FAN_IN", 2)
    monkeypatch.setattr(fitting, "BLOCK", 7)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 4)), (rng.random((50, 1)) > 0.5).astype(float)
    net = initial_network([4, 3, 1], seed=5, scale=0.5)
    df = spark.createDataFrame([(a.tolist(), float(b[0])) for a, b in zip(x, y)], "x array<double>, y double")
    loss, grad = gradients(x, net, lambda z: LogisticObjective()(z, y))
    for parts in (1, 5):
        n, got_loss, got = fitting.gradient_sum(df.repartition(parts), net, LogisticObjective(), ["x"], "y")
        assert n == 50 and got_loss == pytest.approx(loss)
        assert np.allclose(got, flatten(grad))


def test_mixed_gradient_does_not_depend_on_the_partitioning(spark):
    x, y = batch(600)
    net = initial_network([6, 5, WIDTH], seed=1, scale=0.7)
    objective = fitting.mixed_objective(FIELDS)
    assert objective.spreads and objective.gaps
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    loss, grad = gradients(x, net, lambda z: objective(z, y))
    for parts in (1, 4, 60):
        n, got_loss, got = fitting.gradient_sum(df.repartition(parts), net, objective, ["x"], "y")
        assert n == 600 and got_loss == pytest.approx(loss, rel=1e-6)
        assert np.abs(got - flatten(grad)).max() < 1e-9


def test_a_missing_row_is_named(spark):
    df = spark.createDataFrame([([1.0], 1.0), (None, 0.0)], "x array<double>, y double")
    with pytest.raises(Exception, match="column 'x' is null"):
        fitting.gradient_sum(df.coalesce(1), initial_network([1, 1]), LogisticObjective(), ["x"], "y")


@pytest.mark.parametrize("name", ["adam", "adagrad", "adadelta", "sgd", "momentum"])
def test_optimizers_descend_and_clip(name):
    rule = Optimizer(name, 0.5 if name != "adadelta" else 50.0)
    x = np.array([40.0, -3.0])
    first = x.copy()
    for _ in range(200):
        x = rule.update(x, 2 * x)
    assert np.all(np.abs(x) < np.abs(first))
    assert Optimizer("sgd", 1.0).update(np.zeros(1), np.array([99.0])) == -5.0
    with pytest.raises(ValueError):
        Optimizer("newton", 0.1)


def test_binary_fit_learns_and_keeps_the_best(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] > 0).astype(float)
    rows = [(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "rec_id bigint, x array<double>, t double")
    fit = fitting.fit_binary(
        df, df, ["x"], 3, "t", hidden=(8,), steps=30, groups=2, learning_rate=0.05, samples_per_evaluation=2000, run="r"
    )
    losses = [v for _, _, _, split, metric, v in fit.log if (split, metric) == ("evaluation", "loss")]
    assert losses[-1] < 0.6 * losses[0] and fit.best_accuracy > 0.85
    assert [row[1] for row in fit.log if row[4] == "accuracy"][0] == 0
    with pytest.raises(ValueError, match="stop criterion"):
        fitting.fit_binary(df, df, ["x"], 3, "t", stop="never")
    stopped = fitting.fit_binary(
        df, df, ["x"], 3, "t", hidden=(2,), steps=30, groups=2, samples_per_evaluation=1, stop="samples400"
    )
    assert len({row[1] for row in stopped.log}) == 2


def logistic_rows(n=500, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.3, n) > 0).astype(float)
    return x, y


def chunked(spark, x, y, chunks):
    rows = [(int(c), a.tolist(), float(b)) for c, a, b in zip(chunks, x, y)]
    return spark.createDataFrame(rows, "chunk int, x array<double>, t double")


def test_a_local_round_is_the_mean_of_plain_fits(spark):
    x, y = logistic_rows()
    chunks = np.repeat([0, 1, 2], [200, 180, 120])
    net = initial_network([3, 4, 1], seed=2, scale=0.4)
    trainees = [
        fitting.Trainee(net, LogisticObjective(), 64, "adam", 0.05),
        fitting.Trainee(initial_network([3, 1], seed=3), LogisticObjective(), 50, "sgd", 0.1, "tanh", 0.01, True),
    ]
    got = fitting.local_round(chunked(spark, x, y, chunks).coalesce(1), trainees, ["x"], "t", dtype="float64")
    for trainee, (n, loss, moved) in zip(trainees, got):
        total, mean = 0.0, 0.0
        for c in range(3):
            rule, flat = Optimizer(trainee.optimizer, trainee.learning_rate), flatten(trainee.network)
            weights = flatten([(np.ones_like(w), 0 * b) for w, b in trainee.network])
            own, want = x[chunks == c], y[chunks == c][:, None]
            for i in range(0, len(own), trainee.batch_size):
                xs, ys = own[i : i + trainee.batch_size], want[i : i + trainee.batch_size]
                value, grad = gradients(xs, unflatten(flat, trainee.network), lambda z: LogisticObjective()(z, ys), trainee.activation)  # noqa: B023
                scale = len(xs) if trainee.summed else 1
                decay = trainee.penalty * flat * weights
                total += (value * scale + decay @ flat / 2) * len(xs)
                flat = rule.update(flat, flatten(grad) * scale + decay)
            mean = mean + flat * len(own)
        assert n == 500 and loss == pytest.approx(total / 500)
        assert np.allclose(flatten(moved.network), mean / 500)
        assert sorted(moved.memory) == sorted(rule.state) and moved.steps == round(sum(len(x[chunks == c]) * -(-len(x[chunks == c]) // trainee.batch_size) for c in range(3)) / 500)


def test_rounds_go_on_where_the_optimizer_was(spark):
    x, y = logistic_rows(300)
    for name in ("adam", "adagrad", "adadelta", "sgd", "momentum"):
        trainee = fitting.Trainee(initial_network([3, 1], seed=3), LogisticObjective(), 30, name, 0.1)
        rule, flat = Optimizer(name, 0.1), flatten(trainee.network)
        for _ in range(2):
            _, _, trainee = fitting.local_round(chunked(spark, x, y, [0] * 300).coalesce(1), [trainee], ["x"], "t", dtype="float64")[0]
            for i in range(0, 300, 30):
                ys = y[i : i + 30][:, None]
                flat = rule.update(flat, flatten(gradients(x[i : i + 30], unflatten(flat, trainee.network), lambda z: LogisticObjective()(z, ys))[1]))  # noqa: B023
        assert np.allclose(flatten(trainee.network), flat) and trainee.steps == 20 == rule.steps


def test_a_long_chunk_is_cut_and_an_empty_table_named(spark, monkeypatch):
    monkeypatch.setattr(fitting, "CHUNK_ROWS", 90)
    x, y = logistic_rows(200)
    trainee = fitting.Trainee(initial_network([3, 1], seed=3), LogisticObjective(), 1000, "sgd", 0.1)
    one = fitting.local_round(chunked(spark, x, y, [0] * 200).coalesce(1), [trainee], ["x"], "t", dtype="float64")[0]
    cut = fitting.local_round(chunked(spark, x, y, [0] * 90 + [1] * 90 + [2] * 20).coalesce(1), [trainee], ["x"], "t", dtype="float64")[0]
    assert one[0] == 200 and np.allclose(flatten(one[2].network), flatten(cut[2].network))
    with pytest.raises(ValueError, match="no rows"):
        fitting.local_round(chunked(spark, [], [], []), [trainee], ["x"], "t")


def test_the_same_rows_and_seed_give_the_same_log(spark):
    x, y = logistic_rows(900)
    rows = [(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "rec_id bigint, x array<double>, t double")
    options = {"hidden": (8,), "learning_rate": 0.02, "stop": "never", "samples_per_evaluation": 1}
    logs = [
        fitting.fit_binary(table, df, ["x"], 3, "t", steps=3, local_batch=32, run="r", **options).log
        for table in (df.repartition(1), df.repartition(7))
    ]
    assert [row[:5] for row in logs[0]] == [row[:5] for row in logs[1]]
    assert [row[5] for row in logs[0]] == pytest.approx([row[5] for row in logs[1]], rel=1e-5)
    whole = fitting.fit_binary(df, df, ["x"], 3, "t", steps=1, run="r", **options).log
    after = lambda log: [v for _, step, _, split, metric, v in log if (step, split, metric) == (0, "evaluation", "loss")]
    assert after(logs[0])[0] < after(whole)[0]


def test_chunks_follow_from_the_seed(spark):
    df = spark.range(3000).withColumnRenamed("id", "rec_id")
    first, again, other = (
        {r.rec_id: (r.step_group, r.chunk) for r in fitting.local_groups(table, 2, seed, rows=100).collect()}
        for table, seed in ((df, 0), (df.repartition(9), 0), (df, 1))
    )
    assert first == again != other and len(first) == 3000 and len(set(first.values())) == 30
    laid = fitting.local_groups(df, 2, 0, rows=100).selectExpr("input_file_name() f", "step_group g", "chunk c").distinct().collect()
    assert len(laid) == 30


class Trials:
    """Networks of one number; accuracies that tell the trials apart."""

    def __init__(self, accuracies, cut_at=None):
        self.accuracies, self.cut_at, self.scans, self.started = accuracies, cut_at, [], []

    def start(self, draw):
        self.started.append(draw["trial"])
        return [(np.zeros((1, 1)), np.zeros(1))]

    def train(self, draws, networks, epoch):
        if epoch == self.cut_at:
            raise KeyboardInterrupt
        self.scans.append((epoch, [d["trial"] for d in draws]))
        return [(self.accuracies[d["trial"]] and 1.0, [(w + 1, b) for w, b in n]) for d, ((n)) in zip(draws, networks)]

    def evaluate(self, draw, network):
        return self.accuracies[draw["trial"]] * network[0][0][0, 0]

    def run(self, spark, path, passes):
        table = fitting.search_trials(spark, path, len(self.accuracies), self.start, self.train, self.evaluate, passes)
        return {r["trial"]: (r["status"], r["loss"], r["passes"]) for r in table.collect()}


def test_half_of_the_trials_end_after_each_pass(spark, tmp_path):
    trials = Trials([0.125, 0.25, 0.0625, float("nan"), 0.1875])
    got = trials.run(spark, str(tmp_path / "t"), 3)
    assert trials.scans == [(0, [0, 1, 2, 3, 4]), (1, [1, 4]), (2, [1])]
    assert got == {3: ("fail", None, 1), 2: ("ok", 0.9375, 1), 0: ("ok", 0.875, 1), 4: ("ok", 0.625, 2), 1: ("ok", 0.25, 3)}
    for trial in range(50):
        draw = fitting.draw_trial(0, trial)
        cap = fitting.WIDTH_CAPS[len(draw["hidden"])]
        assert all(1 <= w <= cap for w in draw["hidden"])
        assert 1e-6 <= draw["learning_rate"] <= 0.1 and 512 <= draw["batch_size"] <= 8192


def test_a_search_goes_on_with_the_pass_that_was_cut(spark, tmp_path):
    path, accuracies = str(tmp_path / "t"), [0.125, 0.25, 0.0625, 0.1875]
    with pytest.raises(KeyboardInterrupt):
        Trials(accuracies, cut_at=1).run(spark, path, 3)
    again = Trials(accuracies)
    got = again.run(spark, path, 3)
    assert again.started == [] and again.scans == [(1, [1, 3]), (2, [1])]
    assert got == Trials(accuracies).run(spark, str(tmp_path / "u"), 3)
    more = Trials([*accuracies, 0.5])
    assert more.run(spark, path, 3)[4][0] == "ok" and more.started == [4]


def test_lots_follow_from_declared_sizes(monkeypatch):
    monkeypatch.setattr(fitting, "SCAN_BYTES", 100)
    draws = [{"trial": t} for t in range(5)]
    lots = fitting._lots(draws, {0: 60, 1: 40, 2: 1, 3: 500, 4: 2})
    assert [[d["trial"] for d in lot] for lot in lots] == [[0, 1], [2], [3], [4]]


def test_a_search_is_a_scan_a_pass_whatever_the_rows(spark, monkeypatch):
    seen, local_round = [], fitting.local_round

    def watched(df, trainees, *args, **options):
        out = local_round(df, trainees, *args, **options)
        seen.append((df.count(), len(trainees), [n for n, _, _ in out], [t.batch_size for t in trainees]))
        return out

    draw_trial = fitting.draw_trial
    monkeypatch.setattr(fitting, "local_round", watched)
    monkeypatch.setattr(fitting, "draw_trial", lambda seed, trial: draw_trial(seed, trial) | {"batch_size": 100 - trial, "hidden": [2]})
    assert catalog_fitting.search_trials(spark, SMALL).count() == 2
    assert len(seen) == 1
    rows, trainees, counted, batches = seen[0]
    assert trainees == 2 and counted == [rows, rows] and rows > 300 and batches == [100, 99]


def test_steps_of_a_declared_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), float(rng.random() > 0.5)) for i in range(600)]
    df = spark.createDataFrame(rows, "rec_id bigint, x array<double>, t double")
    assert fitting.step_groups(df, 40).groupBy("step_group").count().count() == 40

    def samples(rows_per_step):
        done = fitting.fit_binary(df, df, ["x"], 3, "t", hidden=(2,), steps=3, rows_per_step=rows_per_step, optimizer="sgd", stop="never")
        return [row[2] for row in done.log if row[4] == "loss" and row[3] == "train"]

    small, large = samples(60), samples(300)
    assert 0 < small[1] < 130 < large[1] < 400 and small != large

    def moved(table):
        start = fitting.initial_network([3, 2, 1])
        done = fitting.fit_binary(table, table, ["x"], 3, "t", hidden=(2,), steps=1, optimizer="sgd", batch_size=64, stop="never")
        return np.abs(flatten(done.network) - flatten(start)).max()

    tenfold = df.crossJoin(spark.range(10).select("id")).drop("id")
    assert moved(tenfold) == pytest.approx(moved(df), rel=1e-3)
