"""Running values in a declared row order, safe for hot groups.

A plain window puts a whole group into one task.  Rows are therefore range-
partitioned on (keys, order) and written out with their chunk number.  A window
then runs inside each (keys, chunk), and what earlier chunks of the same group
contribute is added from a table with at most one row per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import materialize

CHUNK_ROWS = 2_000_000
CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """``number`` | ``sum`` (inclusive) | ``max_before`` (exclusive) | ``lag``."""

    kind: str
    value: str | None = None


def chunk_count(df: DataFrame, rows: int) -> int:
    """Partitions for a range shuffle: as configured, more where chunks would be
    too long to sort in one task."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-rows // CHUNK_ROWS))


def ordered_chunks(df: DataFrame, keys, order, partitions: int | None = None) -> DataFrame:
    """Rows with a chunk number that grows with (keys, order), written out.

    There are ``partitions`` chunks, or as many as the session shuffles into.
    """
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return materialize(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _local(run: Running, window) -> Column:
    if run.kind == "number":
        return F.row_number().over(window).cast("bigint")
    if run.kind == "sum":
        return F.sum(run.value).over(window.rowsBetween(Window.unboundedPreceding, 0))
    if run.kind == "max_before":
        return F.max(run.value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    if run.kind == "lag":
        return F.lag(run.value).over(window)
    raise ValueError(f"unknown running kind {run.kind!r}")


def _chunk_total(run: Running, order) -> Column:
    if run.kind == "number":
        return F.count(F.lit(1))
    if run.kind == "sum":
        return F.sum(run.value)
    if run.kind == "max_before":
        return F.max(run.value)
    return F.max_by(F.struct(F.col(run.value)), F.struct(*order))


def _carried(run: Running, total: str, by_key) -> Column:
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    if run.kind in ("number", "sum"):
        return F.sum(total).over(before)
    if run.kind == "max_before":
        return F.max(total).over(before)
    return F.lag(total).over(by_key)


def with_running(
    df: DataFrame,
    keys,
    order,
    runs: dict[str, Running],
    partitions: int | None = None,
) -> DataFrame:
    """Add running columns over ``keys`` groups in ``order`` (ascending).

    ``order`` must be total within a group for the result to be unique.
    """
    keys, order = list(keys), list(order)
    chunks = ordered_chunks(df, keys, order, partitions)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    first = "_first"
    local = chunks.select(
        "*",
        F.row_number().over(inner).alias(first),
        *[_local(r, inner).alias(c) for c, r in runs.items()],
    )
    totals = chunks.groupBy(*keys, CHUNK).agg(
        *[_chunk_total(r, order).alias(f"_t_{c}") for c, r in runs.items()]
    )
    # One row per (group, chunk); a group has at most one row per chunk.
    by_key = Window.partitionBy(*keys).orderBy(CHUNK)
    carries = (
        totals.select(
            *keys,
            CHUNK,
            F.row_number().over(by_key).alias("_nth"),
            *[_carried(r, f"_t_{c}", by_key).alias(f"_c_{c}") for c, r in runs.items()],
        )
        # Only a group continued from an earlier chunk carries anything in, and
        # a chunk continues at most one group: bounded by the chunk count.
        .where("_nth > 1")
        .drop("_nth")
        .withColumnsRenamed({k: f"_k_{k}" for k in keys})
        .withColumnRenamed(CHUNK, "_k_chunk")
    )
    match = F.col(CHUNK) == F.col("_k_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carries), match, "left")
    finals = {}
    for c, r in runs.items():
        carry = F.col(f"_c_{c}")
        if r.kind == "number":
            finals[c] = F.col(c) + F.coalesce(carry, F.lit(0))
        elif r.kind == "sum":
            finals[c] = F.when(carry.isNull(), F.col(c)).otherwise(
                F.coalesce(F.col(c) + carry, carry)
            )
        elif r.kind == "max_before":
            finals[c] = F.greatest(F.col(c), carry)
        else:
            finals[c] = F.when(F.col(first) == 1, carry[r.value]).otherwise(F.col(c))
    return joined.select(*df.columns, *[finals[c].alias(c) for c in runs])


def with_position(df: DataFrame, order, out: str = "pos", partitions: int | None = None) -> DataFrame:
    """Dense 0-based global position in ``order``, which must identify a row.

    Rows are range-partitioned, sorted and written once with their index in the
    partition; what earlier partitions hold is added from one row per partition,
    so the rows are not moved a second time.
    """
    parts = partitions or chunk_count(df, df.count())
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The low 33 bits of the generated id count the rows of a partition.
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(
        ranged.withColumns({CHUNK: F.spark_partition_id(), "_index": index}), "positions"
    )
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col(CHUNK).alias("_k_chunk"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    placed = rows.join(F.broadcast(offsets), F.col(CHUNK) == F.col("_k_chunk"))
    return placed.select(*df.columns, (F.col("_index") + F.col("_before")).alias(out))
