import datetime
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import network as nn
from fieldloom.operators import scoring
from fieldloom.operators.records import encode_records
from fieldloom.plans.matches import DICTIONARY
from fieldloom.plans.models import GENERATOR, KINDS, WIN_NETWORK
from fieldloom.schema import KNOWN
from fieldloom.sources import tables
from fieldloom.operators import runs
from fieldloom.sources import models
from fieldloom.streaming.scoring import predict_known, read_newest_scores, score_known, write_newest_scores, write_scores
from fieldloom.streaming.stopping import stream_stops


def leaky_by_hand(row, net):
    x = row
    for i, (w, b) in enumerate(net):
        if i:
            x = [v if v > 0 else 0.2 * v for v in x]
        x = [sum(x[k] * w[k][j] for k in range(len(x))) + b[j] for j in range(len(b))]
    return x


def test_dense_matches_plain_loops(spark):
    rng = np.random.default_rng(0)
    net = nn.initial_network([3, 4, 2], seed=2, scale=1.0)
    rows = [(i, rng.normal(size=2).tolist(), rng.normal(size=1).tolist()) for i in range(7)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>").repartition(3)
    got = {r["id"]: r["z"] for r in scoring.score_dense(df, net, ("a", "b"), "z", drop=("b",)).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(leaky_by_hand(a + b, net))


def test_heads_agree_in_column_and_batch_form(spark):
    z = np.array([[-800.0, 3.0, 2.0], [0.0, -1.0, 5.0]])
    kinds = [scoring.HEAD_SIGMOID, scoring.HEAD_LINEAR, scoring.HEAD_NONE]
    df = spark.createDataFrame([(r.tolist(),) for r in z], "z array<double>")
    rows = [r["p"] for r in df.select(scoring.output_heads(F.col("z"), kinds).alias("p")).collect()]
    assert np.allclose(rows, nn.apply_heads(z, kinds))
    assert np.allclose(rows, [[0.0, 3.0, 0.0], [0.5, -1.0, 0.0]])


def test_ignored_fields_have_no_head():
    kinds = scoring.head_kinds(DICTIONARY, ignored={"participants.0.psize"})
    assert kinds[0] == scoring.HEAD_NONE and kinds[1] == scoring.HEAD_SIGMOID


def test_chain_equals_two_scores(spark, records):
    enc = encode_records(records, DICTIONARY, ("known",)).limit(50)
    for chain_input in ("probability", "logit"):
        kinds = KINDS if chain_input == "probability" else None
        step = scoring.score_dense(enc, GENERATOR, out="u", kinds=kinds)
        two = scoring.score_dense(step, WIN_NETWORK, ("known", "u"), "w", drop=("known", "u"))
        one = scoring.score_chain(enc, GENERATOR, WIN_NETWORK, KINDS, chain_input, drop=("known",))
        want = {r["rec_id"]: r["w"][0] for r in two.collect()}
        got = {r["rec_id"]: r["win_logit"][0] for r in one.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    with pytest.raises(ValueError):
        scoring.score_chain(enc, GENERATOR, WIN_NETWORK, KINDS, "odds")


def test_stream_equals_batch_and_resumes(spark, records, tmp_path):
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    ids = records.select("rec_id").orderBy("rec_id").limit(40)
    rows = records.join(ids, "rec_id", "left_semi")
    tables.write_known(rows.where("rec_id % 2 = 0"), source, DICTIONARY, id_field="rec_id")

    def run():
        arriving = tables.stream_known(spark, source, DICTIONARY, id_field="rec_id")
        write_scores(score_known(arriving, DICTIONARY, GENERATOR, WIN_NETWORK), out, check)

    run()
    more = rows.where("rec_id % 2 = 1")
    columns = [DICTIONARY[p].column for p in DICTIONARY.known_order]
    more.select("rec_id", *columns).write.mode("append").csv(source, nullValue="", emptyValue="")
    run()
    batch = score_known(rows, DICTIONARY, GENERATOR, WIN_NETWORK)
    got = spark.read.parquet(out)
    assert got.count() == batch.count() == 40
    assert got.exceptAll(batch).count() == 0


def test_streamed_records_equal_batch(spark, records, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    tables.write_known(records, source, DICTIONARY, id_field="rec_id")
    args = (DICTIONARY, GENERATOR, WIN_NETWORK, "logit")
    write_scores(
        predict_known(tables.stream_known(spark, source, DICTIONARY, "rec_id"), *args), out, str(tmp_path / "check")
    )
    batch = predict_known(tables.read_known(spark, source, DICTIONARY, "rec_id"), *args)
    got = spark.read.parquet(out)
    assert got.columns == batch.columns and got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_known_part_alone_is_read(spark, records):
    enc = encode_records(records, DICTIONARY.subset(KNOWN), ("known",))
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "participants_0_price" not in plan and "participants_0_brand" in plan


def arrive(spark, source, rows, schema, **options):
    """Append one file to a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).options(**options).parquet(source)


def test_streamed_stops_equal_the_batch(spark, tmp_path):
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    logs = {r: [rng.randrange(30) / rng.randint(1, 3) for _ in range(n)] for r, n in ((1, 160), (2, 12), (3, 90), (4, 41), (5, 70))}
    logs[1] = [1000.0 - i for i in range(160)]
    logs[3] = [abs(60.0 - i) for i in range(90)]
    rows = [(r, start + datetime.timedelta(seconds=i * (60 if r == 5 else 1)), i, float(v)) for r, vs in logs.items() for i, v in enumerate(vs)]
    schema = "run int, ts timestamp, at int, loss double"
    spec = "samples1100:stagnant10,0.5,0.9:seconds1800"
    seen = []
    for low in range(0, 170, 34):
        piece = [r for r in rows if low <= r[2] < low + 34]
        rng.shuffle(piece)
        write_scores(stream_stops(arrive(spark, source, piece, schema), spec, 10, ["at"]), out, check)
        seen.append(spark.read.schema("run int, stop_step bigint").parquet(out).count())
    steps = runs.number_steps(spark.createDataFrame(rows, schema), ["at"])
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, runs.stop_any(steps, spec, 10).collect())) and len(got) >= 3
    assert seen == sorted(seen) and seen[0] < seen[-1]


def test_a_batch_is_scored_once_by_the_newest_networks(spark, records, tmp_path):
    source, out, check, generator, win = (str(tmp_path / d) for d in ("in", "out", "check", "generator", "win"))
    columns = [DICTIONARY[p].column for p in DICTIONARY.known_order]
    models.save_network(spark, GENERATOR, generator)
    *inner, (w, b) = WIN_NETWORK
    expected = []
    for k in range(3):
        if k < 2:
            models.save_network(spark, [*inner, (w, b + k)], win)
        rows = records.where(F.col("rec_id") % 3 == k).orderBy("rec_id").limit(20)
        rows.select("rec_id", *columns).coalesce(1).write.mode("append").csv(source, nullValue="", emptyValue="")
        write_newest_scores(tables.stream_known(spark, source, DICTIONARY, "rec_id"), DICTIONARY, generator, win, out, check)
        expected.append(score_known(rows, DICTIONARY, GENERATOR, [*inner, (w, b + min(k, 1))]))
    got = read_newest_scores(spark, out)
    want = expected[0].union(expected[1]).union(expected[2])
    assert got.count() == 60 and got.select("rec_id", "win_probability").exceptAll(want).count() == 0
    assert got.select("batch", "win").distinct().groupBy("win").count().orderBy("win").select("count").collect() == [(1,), (2,)]

    before = {tuple(r) for r in got.collect()}
    models.save_network(spark, [*inner, (w, b + 9)], win)
    # Spark hands out the last batch again when its own commit was lost.
    commits = sorted(Path(check, "commits").glob("[0-9]*"))
    commits[-1].unlink()
    Path(check, "commits", f".{commits[-1].name}.crc").unlink(missing_ok=True)
    write_newest_scores(tables.stream_known(spark, source, DICTIONARY, "rec_id"), DICTIONARY, generator, win, out, check)
    assert {tuple(r) for r in read_newest_scores(spark, out).collect()} == before
    assert read_newest_scores(spark, str(tmp_path / "none")).count() == 0
