"""The encoded layout as a DataFrame: one row per encoded column.

The single-partition windows below run over the layout, whose size is the
declared width of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.dictionary import family_bounds, family_of
from fieldloom.schema import ALL, KNOWN, OUTCOME, WIN

PORTION_MASKS = (KNOWN, WIN, OUTCOME, WIN | OUTCOME, ALL - WIN, ALL)


def encoded_layout(fields: DataFrame) -> DataFrame:
    """Each field's encoded columns with their positions.

    Order: known, unknown, win; dictionary order within; parts in level order.
    """
    bounds = family_bounds(fields)
    joined = (
        fields.where("portion != 0")
        .withColumn("family", family_of(F.col("path")))
        .join(bounds, "family", "left")
    )
    lo, hi = F.col("family_min").cast("int"), F.col("family_max").cast("int")
    steps = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(F.array().cast("array<int>"))
    parts = (
        F.when((F.col("handling") == "one-hot") & (F.col("kind") == "bool"), F.array(F.lit("True"), F.lit("False")))
        .when(F.col("handling") == "one-hot", F.col("levels"))
        .when(F.col("handling") == "unary", steps.cast("array<string>"))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    kind = (
        F.when(F.col("handling") == "one-hot", "level")
        .when(F.col("handling") == "unary", "number")
        .otherwise("value")
    )
    rank = F.when(F.col("portion") == KNOWN, 0).when(F.col("portion") == OUTCOME, 1).otherwise(2)
    exploded = joined.select(
        "line", "path", "portion", "handling", kind.alias("part_kind"), rank.alias("_rank"),
        F.posexplode(parts).alias("_part", "part_key"),
    )
    position = F.row_number().over(Window.orderBy("_rank", "line", "_part")).cast("bigint") - 1
    return exploded.withColumn("pos", position).drop("_rank", "_part")


def field_spans(layout: DataFrame) -> DataFrame:
    """First and one-past-last position per field."""
    return layout.groupBy("path", "portion", "handling").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")
    )


def portion_slices(layout: DataFrame, masks=PORTION_MASKS) -> DataFrame:
    """Position range per portion mask; a mask without columns has no row."""
    tagged = layout.select("pos", "portion", F.explode(F.lit(list(masks))).alias("mask"))
    inside = tagged.where(F.col("portion").bitwiseAND(F.col("mask")) != 0)
    return inside.groupBy("mask").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count("pos").alias("width")
    )


def portion_indices(layout: DataFrame, mask: int) -> DataFrame:
    """Every encoded position of a portion, once."""
    if not mask & ALL or mask & ~ALL:
        raise LookupError(f"portion {mask} is not contained")
    return layout.where(F.col("portion").bitwiseAND(F.lit(mask)) != 0).select("pos")


def column_lookup(layout: DataFrame, paths) -> DataFrame:
    """Encoded positions of the named fields."""
    return layout.where(F.col("path").isin(list(paths))).select("path", "part_key", "pos")


def _islands(layout: DataFrame, label: Column) -> DataFrame:
    """Numbered maximal runs of adjacent positions with an equal label."""
    by_pos = Window.orderBy("pos")
    labelled = layout.select("pos", label.alias("label"))
    turn = F.coalesce(~F.lag("label").over(by_pos).eqNullSafe(F.col("label")), F.lit(True))
    turn = F.when(F.row_number().over(by_pos) == 1, 1).otherwise(turn.cast("int"))
    numbered = labelled.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(by_pos))
    return numbered.groupBy("_run", "label").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")
    )


def contiguous_runs(layout: DataFrame, predicate: Column, max_runs: int | None = None) -> DataFrame:
    """Maximal runs of adjacent columns whose field satisfies ``predicate``."""
    runs = _islands(layout, predicate).where("label").select("start", "stop")
    if max_runs is not None:
        runs = runs.orderBy("start").limit(max_runs)
    return runs


def handling_runs(layout: DataFrame, ignored=()) -> DataFrame:
    """Runs of equal handling; ignored fields count as ``none``."""
    label = F.when(F.col("path").isin(list(ignored)), "none").otherwise(F.col("handling"))
    return _islands(layout, label).select("start", "stop", F.col("label").alias("handling"))
