"""The data-folder contract, end to end."""

import os

import pytest
from pyspark.sql import functions as F

from fieldloom import jobs
from fieldloom.operators.layout import encoded_layout, field_spans
from fieldloom.plans import measured
from fieldloom.plans.matches import DICTIONARY, MIN_DURATION
from fieldloom.functions.network import initial_network
from fieldloom.schema import ALL, EXTRA, KNOWN, OUTCOME, WIN
from fieldloom.session import shared_root
from fieldloom.sources import models, tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def folder(spark, records, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "columns").mkdir()
    (root / "columns/known").write_text("\n".join(DICTIONARY.known_order) + "\n")
    (root / "columns/unknown").write_text("\n".join(f.path for f in DICTIONARY if f.portion != KNOWN) + "\n")
    rows = measured.measured_dictionary(spark, SMALL).coalesce(1).sortWithinPartitions("line")
    rows.select(*tables.DICTIONARY_HEADER).write.csv(str(root / "columns/interesting.csv"), header=True)
    wide = records.select("rec_id", *[F.col(f.column) for f in DICTIONARY])
    wide.toDF("rec_id", *[f.path for f in DICTIONARY]).write.csv(str(root / "Matches.csv"), header=True, nullValue="")
    tables.write_known(records, str(root / "known-csv"), DICTIONARY, id_field="rec_id")
    return str(root)


@pytest.fixture(scope="module")
def fields(spark, folder):
    return jobs.load_dictionary(spark, folder, measured.OPTIONAL_PATTERNS)


def test_dictionary_is_the_declared_one_with_measured_numbers(spark, fields):
    assert [(f.path, f.kind, f.handling, f.portion, f.optional) for f in fields] == [
        (f.path, f.kind, f.handling, f.portion, f.optional) for f in DICTIONARY
    ]
    assert fields.known_order == DICTIONARY.known_order
    assert fields["participants.0.brand"].levels[-1] == "" and fields["participants.0.brand"].default == ""
    assert isinstance(fields["duration"].default, float) and isinstance(fields["participants.0.psize"].default, int)


def test_layout_table_and_driver_layout_agree(spark, fields):
    spans = field_spans(encoded_layout(measured.measured_fields(spark, SMALL))).collect()
    assert {(r["path"], r["start"], r["stop"]) for r in spans} == {(s.field.path, s.start, s.stop) for s in fields.spans}


def test_corpus_is_encoded_once(spark, folder, fields, records, tmp_path):
    path = str(tmp_path / "corpus")
    for _ in range(2):
        corpus = jobs.load_corpus(spark, folder, fields, path, "duration", MIN_DURATION, id_field="rec_id")
    assert corpus.count() == records.where(F.col("duration") > MIN_DURATION).count()
    row = corpus.first()
    assert [len(row[c]) for c in ("known", "unknown", "win")] == [fields.width(m) for m in (KNOWN, OUTCOME, WIN)]


def test_small_steps_do_no_worse_in_a_pass_than_one_large(spark, records, fields):
    options = {"held_out": 60, "evaluation": 60, "batch_size": 64, "steps": 2, "hidden": (8,), "duration": "duration", "shortest": MIN_DURATION}

    logs = [jobs.train_generator(spark, records, ["rec_id"], fields, samples_per_evaluation=1, **options, **more).log for more in ({}, {"local_batch": None})]
    for kind in ("train", "evaluation"):
        small, large = ([v for *_, split, metric, v in log if (split, metric) == (kind, "loss")] for log in logs)
        assert small[-1] < large[-1] and small[0] < large[0]


def test_train_then_generate_and_predict(spark, folder, fields, records, tmp_path):
    options = {"held_out": 60, "evaluation": 60, "batch_size": 64, "groups": 1, "steps": 3, "hidden": (6,), "local_batch": None}
    folders = lambda: sorted(os.listdir(f"{shared_root(spark)}/fieldloom/{spark.sparkContext.applicationId}"))
    before = folders()
    generator = jobs.train_generator(
        spark, records, ["rec_id"], fields, duration="duration", shortest=MIN_DURATION, learning_rate=0.05,
        save_to=str(tmp_path / "best"), **options,
    )
    assert folders() == before
    losses = [v for *_, split, metric, v in generator.log if (split, metric) == ("evaluation", "loss")]
    assert losses[-1] < losses[0] and 0 < generator.best_accuracy < 1
    win = jobs.train_win(spark, records, ["rec_id"], fields, generator.network, **options)
    judge = jobs.train_two_sample(
        spark, records, ["rec_id"], fields, generator.network, duration="duration", shortest=MIN_DURATION, **options
    )
    assert judge.log_frame(spark).where("metric = 'accuracy'").count() == 2
    jobs.search_generator(
        spark, records, ["rec_id"], fields, str(tmp_path / "trials"), 1, 60, 60, "duration", MIN_DURATION, seed=9
    )
    assert folders() == before
    loaded = models.load_network(spark, str(tmp_path / "best"))
    assert all((w == v).all() for (w, _), (v, _) in zip(loaded, generator.network))

    known, out = f"{folder}/known-csv", str(tmp_path / "out")
    jobs.generate(spark, known, fields, loaded, out, id_field="rec_id")
    lines = spark.read.text(out)
    assert lines.count() == records.count()
    assert lines.where(F.size(F.split("value", ",", -1)) != 1 + len(fields.select(ALL - WIN))).count() == 0

    for chain_input in ("probability", "logit"):
        chances, full = jobs.predict(spark, known, fields, loaded, win.network, "rec_id", chain_input)
        assert chances.where("win_probability between 0 and 1").count() == records.count()
        same = chances.join(full, "rec_id").where((F.col("win_probability") > 0.5) != F.col("teams_0_win"))
        assert same.count() == 0
        brands = full.join(records, "rec_id").where(
            full["participants_0_brand"] != records["participants_0_brand"]
        )
        assert brands.count() == 0


def test_ignored_fields_come_out_as_defaults(spark, folder, fields, records, tmp_path):
    gen = initial_network([fields.width(KNOWN), 4, fields.width(OUTCOME)], seed=2, scale=0.5)
    win = initial_network([fields.width(KNOWN) + fields.width(OUTCOME), 1], seed=2)
    ignored = {"participants.4.returnflag", "participants.4.quantity", "duration", "teams.1.price"}
    out = str(tmp_path / "out")
    jobs.generate(spark, f"{folder}/known-csv", fields, gen, out, "rec_id", ignored)
    names = ["rec_id"] + [f.column for f in fields.select(ALL - WIN)]
    rows = spark.read.csv(out).toDF(*names)
    for path in ignored:
        f = fields[path]
        (value,) = {r[0] for r in rows.select(f.column).distinct().collect()}
        assert value == f.default if f.kind == "enum" else float(value) == pytest.approx(f.default)
    assert rows.select("participants_3_price").distinct().count() > 10
    for chain_input in ("probability", "logit"):
        chances, full = jobs.predict(
            spark, f"{folder}/known-csv", fields, gen, win, "rec_id", chain_input, ignored
        )
        assert chances.where("win_probability is null or isnan(win_probability)").count() == 0
        assert full.where("duration is not null or participants_4_returnflag is not null").count() == 0


def test_a_wide_network_of_one_layer(spark, fields):
    net = initial_network([fields.width(KNOWN), fields.width(OUTCOME)])
    models.check_network(net)
    with pytest.raises(ValueError):
        models.check_network(net, max_bytes=1000)


def test_a_data_folder_without_ids_from_load_to_predict(spark, folder, fields, records, tmp_path):
    """The file has no id column: rows are numbered in file order."""
    root = tmp_path / "plain"
    (root / "columns").mkdir(parents=True)
    for name in ("known", "unknown"):
        (root / "columns" / name).write_text(open(f"{folder}/columns/{name}").read())
    (root / "columns/interesting").write_text("duration\n")
    (root / "columns/unknown").write_text("\n".join(f.path for f in DICTIONARY if f.portion != KNOWN and f.path != "duration") + "\n")
    measured.measured_dictionary(spark, SMALL).coalesce(1).sortWithinPartitions("line").select(*tables.DICTIONARY_HEADER).write.csv(
        str(root / "columns/interesting.csv"), header=True
    )
    wide = records.orderBy("rec_id").select(*[F.col(f.column) for f in DICTIONARY]).coalesce(1)
    wide.toDF(*[f.path for f in DICTIONARY]).write.csv(str(root / "Matches.csv"), header=True, nullValue="")
    own = jobs.load_dictionary(spark, str(root), measured.OPTIONAL_PATTERNS)
    assert own["duration"].portion == EXTRA and own.width(OUTCOME) == fields.width(OUTCOME) - 1

    rows = jobs.load_records(spark, str(root), own)
    numbered = rows.select("rec_id", "duration", "participants_0_brand").orderBy("rec_id").collect()
    first = records.orderBy("rec_id").select("duration", "participants_0_brand").collect()
    assert [r[0] for r in numbered] == list(range(len(first))) and [tuple(r[1:]) for r in numbered] == [tuple(r) for r in first]

    corpus = jobs.load_corpus(spark, str(root), own, str(tmp_path / "corpus"), "duration", MIN_DURATION)
    assert corpus.count() == records.where(F.col("duration") > MIN_DURATION).count()
    options = {"held_out": 60, "evaluation": 60, "batch_size": 64, "steps": 2, "hidden": (4,)}
    generator = jobs.train_generator(spark, rows, ["rec_id"], own, duration="duration", shortest=MIN_DURATION, **options)
    renamed = rows.withColumnRenamed("rec_id", "game")
    win = jobs.train_win(spark, renamed, ["game"], own, generator.network, key="game", **options)
    jobs.train_two_sample(
        spark, renamed, ["game"], own, generator.network, duration="duration", shortest=MIN_DURATION, key="game", **options
    )
    chances, _ = jobs.predict(spark, f"{folder}/known-csv", own, generator.network, win.network, "rec_id")
    assert chances.count() == records.count()
