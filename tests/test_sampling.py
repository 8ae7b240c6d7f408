import math

from pyspark.sql import functions as F

from fieldloom.operators import sampling
from fieldloom.operators.ordering import with_position
from fieldloom.plans.matches import DICTIONARY


def test_split_sizes(spark):
    ids = spark.range(100).withColumnRenamed("id", "rec_id")
    for held, evaluation, want in ((10, 20, (70, 20, 10)), (0, 20, (80, 20, 0)), (90, 20, (0, 10, 90))):
        split = sampling.split_positional(ids, ["rec_id"], held, evaluation)
        counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
        assert tuple(counts.get(s, 0) for s in ("train", "evaluation", "held_out")) == want
        first = split.where("split = 'evaluation'").agg(F.min("rec_id")).first()[0]
        assert first == want[0]


def test_last_batch_may_be_short(spark):
    placed = with_position(spark.range(10).withColumnRenamed("id", "rec_id"), ["rec_id"])
    sizes = sampling.batch_rows(placed, 4).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in sizes] == [4, 4, 2]


def test_permutation_moves_members_whole(spark, records):
    placed = sampling.batch_rows(with_position(records, ["rec_id"]), 64)
    moved = sampling.permute_slots(placed, DICTIONARY, seed=5)
    assert moved.columns == placed.columns

    def members(df, t):
        slot = [
            F.struct(
                F.col(f"participants_{t * 5 + m}_brand").alias("a"),
                F.col(f"participants_{t * 5 + m}_price").alias("b"),
                F.col(f"teams_{t}_bans_{m}_priority").alias("c"),
            )
            for m in range(5)
        ]
        return df.select("rec_id", F.to_json(F.array_sort(F.array(*slot))).alias("m"))

    for t in (0, 1):
        before, after = members(placed, t), members(moved, t)
        assert before.exceptAll(after).count() == 0
    changed = placed.join(moved.select("rec_id", F.col("participants_0_price").alias("p")), "rec_id")
    assert changed.where("participants_0_price <> p").count() > 0
    # One order per batch and team.
    assert moved.select("rec_id", "duration").exceptAll(placed.select("rec_id", "duration")).count() == 0


def test_blanked_share(spark, records):
    full = records.where("n_slots = 10")
    n = full.count()
    out = sampling.blank_optional(full, DICTIONARY, 0.5, 0.5, seed=1)
    untouched = 1 - math.exp(-0.5)
    blank = out.where("participants_0_brand = ''").count() / n
    want = (1 - untouched) * (1 - math.exp(-0.5))
    assert abs(blank - want) < 4 * math.sqrt(want / n)
    again = sampling.blank_optional(full, DICTIONARY, 0.5, 0.5, seed=1)
    assert out.exceptAll(again).count() == 0
    assert sampling.blank_optional(full, DICTIONARY, 0.0, 0.0).exceptAll(full).count() == 0


def test_shuffle_keeps_batches_and_differs_by_epoch(spark):
    placed = sampling.batch_rows(with_position(spark.range(200).withColumnRenamed("id", "rec_id"), ["rec_id"]), 50)
    orders = [
        [(r["batch_id"], r["place"], r["rec_id"]) for r in sampling.shuffle_rows(placed, 3, e).orderBy("batch_id", "place").collect()]
        for e in (0, 1)
    ]
    assert orders[0] != orders[1]
    for order in orders:
        assert [(b, p) for b, p, _ in order] == [(b, p) for b in range(4) for p in range(50)]
        assert {r for _, _, r in order} == set(range(200))
