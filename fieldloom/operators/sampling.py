"""Splits, batches and augmentation, keyed by record id and a seed."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.hashing import below_text, digest_text
from fieldloom.functions.text import name
from fieldloom.operators.ordering import with_position
from fieldloom.schema import Dictionary

TEAM = 5
DRAWS = 4  # draws per digest


def split_positional(df: DataFrame, order, held_out: int = 1 << 14, evaluation: int = 1 << 14) -> DataFrame:
    """``split``: train is the head, evaluation the next rows, the last
    ``held_out`` rows are kept back.  Also adds the dense position ``pos``."""
    placed = with_position(df, order)
    n = placed.count()
    train_end = max(n - held_out - evaluation, 0)
    eval_end = max(n - held_out, 0)
    split = (
        F.when(F.col("pos") < train_end, "train")
        .when(F.col("pos") < eval_end, "evaluation")
        .otherwise("held_out")
    )
    return placed.withColumn("split", split)


def batch_rows(placed: DataFrame, batch_size: int = 2048) -> DataFrame:
    """Consecutive batches by position; the last may be short."""
    return placed.withColumn("batch_id", F.floor(F.col("pos") / batch_size).cast("bigint"))


def member_order(seed, batch: str, team: int) -> str:
    """One seeded permutation of the team's members per batch."""
    digest = digest_text(seed, name(batch), team)
    keyed = [f"struct(substring({digest}, {6 * m + 1}, 6) as h, {m} as m)" for m in range(TEAM)]
    return f"sort_array(array({', '.join(keyed)})).m"


def _member_columns(dictionary: Dictionary, present, team: int):
    """Per member of the team, suffix -> column of everything that moves along."""
    members = [{} for _ in range(TEAM)]
    for f in dictionary:
        if f.column not in present:
            continue
        for m in range(TEAM):
            for prefix in (f"participants.{team * TEAM + m}.", f"teams.{team}.bans.{m}."):
                if f.path.startswith(prefix):
                    members[m][(prefix.split(".")[0], f.path[len(prefix):])] = f.column
    return members


def permute_slots(df: DataFrame, dictionary: Dictionary, seed=0, batch: str = "batch_id") -> DataFrame:
    """Per batch and team, move all of a member's fields and the member's ban
    together to a permuted slot.  Teams are not swapped."""
    ordered = df.selectExpr("*", *[f"{member_order(seed, batch, t)} as _order_{t}" for t in (0, 1)])
    moved = {}
    for t in (0, 1):
        members = _member_columns(dictionary, set(df.columns), t)
        for m, columns in enumerate(members):
            for key, column in columns.items():
                pool = ", ".join(name(other[key]) for other in members)
                moved[column] = f"get(array({pool}), get(_order_{t}, {m})) as {name(column)}"
    return ordered.selectExpr(*[moved.get(c, name(c)) for c in df.columns])


def coverage(share: float) -> float:
    """Expected share of rows hit by ``n * share`` draws with replacement."""
    return 1 - exp(-share)


def blank_optional(
    df: DataFrame, dictionary: Dictionary, blank: float = 0.5, keep: float = 0.5, seed=0, key: str = "rec_id"
) -> DataFrame:
    """Blank optional fields at random; a share of rows is left untouched."""
    fields = [f for f in dictionary if f.optional and f.column in df.columns]
    # Draw 0 decides on the row, the others on one field each.
    digests = [f"{digest_text(seed, i, name(key))} as _d{i}" for i in range(len(fields) // DRAWS + 1)]
    kept = below_text("_d0", 0, coverage(keep))
    out = {}
    for i, f in enumerate(fields, 1):
        hit = below_text(f"_d{i // DRAWS}", i % DRAWS, coverage(blank))
        out[f.column] = f"if({hit} AND NOT {kept}, '', {name(f.column)}) as {name(f.column)}"
    drawn = df.selectExpr("*", *digests)
    return drawn.selectExpr(*[out.get(c, name(c)) for c in df.columns])


def shuffle_rows(df: DataFrame, seed=0, epoch: int = 0, key: str = "rec_id", batch: str = "batch_id") -> DataFrame:
    """A seeded order within each batch, other per epoch.  A group is one batch,
    whose size is the batch size."""
    order = [F.expr(digest_text(seed, epoch, name(key))), F.col(key)]
    window = Window.partitionBy(batch).orderBy(*order)
    return df.select("*", F.lit(epoch).alias("epoch"), (F.row_number().over(window).cast("bigint") - 1).alias("place"))
