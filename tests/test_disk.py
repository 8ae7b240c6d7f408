"""What stages leave on disk: raw rows rather than encoded ones, no spent stages, no spent shuffles."""

import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import types as T

from fieldloom import jobs
from fieldloom.plans import catalog_fitting, catalog_metrics, catalog_records
from fieldloom.plans.matches import DICTIONARY, build_records
from fieldloom.plans.models import GENERATOR, scored
from fieldloom.session import _STORED, materialize, scratch, stored

from .conftest import SMALL


@pytest.fixture
def written(monkeypatch):
    """Schemas of all stages written as Parquet."""
    schemas, parquet = [], DataFrameWriter.parquet

    def run(self, *args, **options):
        schemas.append(self._df.schema)
        return parquet(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", run)
    return schemas


def arrays(schemas):
    return [f.name for s in schemas for f in s.fields if isinstance(f.dataType, T.ArrayType)]


def test_scored_records_are_not_stored(spark, records):
    with scratch() as made:
        rows = scored(spark, SMALL, ("known", "y", "z", "win", "win_logit"))
        assert rows.columns == ["rec_id", "known", "y", "z", "win", "win_logit"] and rows.count() == records.count()
        for query in (catalog_records.decode_bool_enum, catalog_records.assign_portion, catalog_metrics.prediction_sketch, catalog_metrics.eval_two_sample):
            assert query(spark, SMALL).count()
    assert made == []


def test_parts_of_the_scored_records(spark):
    whole = {r.rec_id: r for r in scored(spark, SMALL, ("known", "y", "z", "win", "win_logit")).collect()}
    assert {r.rec_id: list(r.z) for r in scored(spark, SMALL, ("z",), "rec_id % 2 = 0").collect()} == {
        k: pytest.approx(r.z) for k, r in whole.items() if k % 2 == 0
    }
    assert {r.rec_id: list(r.win_logit) for r in scored(spark, SMALL, ("win", "win_logit")).collect()} == {
        k: pytest.approx(r.win_logit) for k, r in whole.items()
    }


@pytest.mark.parametrize("query", [catalog_fitting.fit_win_rounds, catalog_fitting.fit_two_sample_rounds])
def test_rounds_lay_out_raw_rows(spark, records, written, query):
    assert query(spark, SMALL).count()
    assert written and not arrays(written)


def test_fits_store_raw_rows(spark, records, written):
    options = {"held_out": 60, "evaluation": 60, "steps": 1, "hidden": (2,), "stop": "never"}
    jobs.train_generator(spark, records, ["rec_id"], DICTIONARY, duration="duration", shortest=1500, **options)
    jobs.train_win(spark, records, ["rec_id"], DICTIONARY, GENERATOR, **options)
    jobs.train_two_sample(spark, records, ["rec_id"], DICTIONARY, GENERATOR, duration="duration", shortest=1500, **options)
    assert len(written) >= 6 and not arrays(written)


def test_a_stored_stage_leaves_no_other(spark, tmp_path):
    def build():
        inner = stored(spark, ("inner", str(tmp_path)), lambda: spark.range(3))
        return materialize(inner, "spent")

    with scratch() as made:
        assert stored(spark, ("outer", str(tmp_path)), build).count() == 3
    assert len(made) == 2 and {path for path, _ in _STORED.values()} >= set(made)
    assert stored(spark, ("inner", str(tmp_path)), build).count() == 3


def test_a_stage_leaves_no_shuffle(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = held.getAllFiles()
        return {name for name in (str(files.apply(i)) for i in range(files.size())) if "shuffle_" in name}

    before, until = shuffles(), time.time() + 30
    assert materialize(spark.range(1000).repartition(3, "id"), "shuffled").rdd.count() == 1000
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before


def test_records_keep_one_table_of_lines(spark):
    with scratch() as made:
        rows = build_records(spark, SMALL)
    assert [path.rsplit("/", 1)[1].split("-")[0] for path in made] == ["lines"] and rows.count()
