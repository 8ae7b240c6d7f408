"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) per node u that is not its class's smallest node v.

    ``edges`` has the columns u and v of an ordered type, without nulls. Large-star and
    small-star steps alternate until the edges are stars; every step takes minima with a
    map-side combine, so a node of many edges is no group in one task. Each round is
    written to the shared folder, which cuts the lineage. Loops and repeated edges do
    no harm; an empty table gives an empty one.
    """
    stars = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(stars)
    while mark[0]:
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        stars = materialize(small.union(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(stars)
        if before == mark:
            break
    return stars
