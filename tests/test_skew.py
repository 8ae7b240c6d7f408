import random
import statistics
"""A third of all rows on one supplier and one run: the chunked path."""

import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from fieldloom.operators import runs
from fieldloom.plans.catalog_runs import ORDER, metric_log
from fieldloom.plans.matches import DICTIONARY, build_records
from fieldloom.plans.oracle import sql
from fieldloom.operators import profile
from fieldloom.operators.profile import field_levels, profile_fields
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """Copies of the tables in which every third row shares one key."""
    root = tmp_path_factory.mktemp("skewed")
    for f in Path(SMALL).glob("*.parquet"):
        shutil.copyfile(f, root / f.name)
    con = duckdb.connect()
    for table, key, order in (("lineitem", "l_suppkey", "l_orderkey"), ("events", "user_id", "event_id")):
        con.execute(
            f"copy (select * replace (case when {order} % 3 = 0 then 1 else {key} end as {key}) "
            f"from '{SMALL}/{table}.parquet') to '{root}/{table}.parquet' (format parquet)"
        )
    return str(root)


def test_records_with_a_hot_supplier(spark, skewed):
    got = build_records(spark, skewed, partitions=9).select(
        "rec_id", "n_slots", "duration", "teams_0_price", "teams_1_price", "participants_3_brand", "teams_1_bans_2_priority"
    )
    text = sql(
        """select r.rec_id, n_slots, duration, t0_price as teams_0_price, t1_price as teams_1_price,
            max(brand) filter (slot = 3) as participants_3_brand,
            max(priority) filter (slot = 7) as teams_1_bans_2_priority
        from recs r join slots s using (rec_id) group by all""",
        "recs", "slots",
    )
    assert check.compare(got, check.oracle(skewed), text) is None


def test_checkpoints_of_a_hot_run(spark, skewed):
    got = runs.best_checkpoint(metric_log(spark, skewed), ORDER, partitions=9).select("run", "step", "accuracy")
    text = sql(
        """select run, step, accuracy from (select *, max(accuracy) over (partition by run order by step
            rows between unbounded preceding and 1 preceding) as best from log) q where best is null or accuracy > best""",
        "log",
    )
    assert check.compare(got, check.oracle(skewed), text) is None


def test_median_on_the_chunked_path(spark, records):
    fields = [(f.path, f.column, f.kind) for f in DICTIONARY if f.kind in ("int", "float")]
    whole = profile_fields(records, fields)
    chunked = profile_fields(records, fields, partitions=23)
    columns = ["path", "n", "median", F.round("sd", 9), F.round("md", 9)]
    assert whole.select(*columns).exceptAll(chunked.select(*columns)).count() == 0


def test_no_level_is_lost(spark):
    """More different texts than any list should hold, and a hot one."""
    rows = spark.range(150_000).selectExpr("if(id % 3 = 0, 'hot', concat('level ', id)) as t", "id % 2 = 0 as b")
    fields = [("t", "t", "enum"), ("b", "b", "bool")]
    levels = field_levels(rows, fields, partitions=11)
    assert levels.where("path = 't'").agg(F.count("*"), F.countDistinct("level"), F.max("rank")).first() == (100_001,) * 3
    ordered = levels.selectExpr("path", "level", "rank", "row_number() over (partition by path order by level) as place")
    assert ordered.where("rank <> place").count() == 0
    profile = {r["path"]: r for r in profile_fields(rows, fields).collect()}
    assert profile["t"]["n_levels"] == 100_001 and profile["t"]["mode_txt"] == "hot" and profile["b"]["n_levels"] == 2


@pytest.mark.parametrize("few, ranges", [(10_000, 1024), (3, 8), (0, 2)])
def test_medians_by_narrowing(spark, monkeypatch, few, ranges):
    """Counted ranges, whatever is left over for the sort at the end."""
    monkeypatch.setattr(profile, "FEW", few)
    monkeypatch.setattr(profile, "RANGES", ranges)
    rng = random.Random(3)
    columns = {
        "even": [rng.gauss(0, 1) for _ in range(500)],
        "odd": [rng.gauss(0, 1) ** 5 for _ in range(501)],
        "hot": [7.0] * 300 + [rng.random() for _ in range(199)],
        "two": [1.0] * 50 + [2.0] * 50,
        "one": [4.0],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)],
        "ends": [-1.7e308, 1.7e308, 0.0],
        "same": [5.0] * 9,
    }
    rows = [(path, v, columns[path].count(v)) for path in columns for v in set(columns[path])]
    numeric = spark.createDataFrame(rows, "path string, num double, c bigint").repartition(3)
    bounds = [(p, len(v), min(v), max(v)) for p, v in columns.items()] + [("none", 0, None, None)]
    got = profile.exact_medians(numeric, bounds)
    assert got == pytest.approx({p: statistics.median(v) for p, v in columns.items()})
