"""Field statistics of a record table: the numbers a dictionary freezes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.ordering import Running, with_running
from fieldloom.session import materialize


def value_histogram(df: DataFrame, fields) -> DataFrame:
    """(path, num, txt, c): how often each field takes each value.

    ``fields`` are (path, column, kind).  Counting values first collapses the
    long form map-side; everything after works on distinct values.  Numbers and texts are
    counted apart, each from plain arrays of their own columns.
    """
    numbers = [f for f in fields if f[2] not in ("enum", "bool")]
    texts = [f for f in fields if f[2] in ("enum", "bool")]
    none = {"num": F.lit(None).cast("double"), "txt": F.lit(None).cast("string")}
    counted = []
    if numbers:
        rows = _counted(df, numbers, [F.col(c).cast("double") for _, c, _ in numbers], "num")
        counted.append(rows.withColumn("txt", none["txt"]))
    if texts:
        values = [F.col(c) if kind == "enum" else F.initcap(F.col(c).cast("string")) for _, c, kind in texts]
        rows = _counted(df, texts, values, "txt")
        flags = [path for path, _, kind in texts if kind == "bool"]
        flag = F.when(F.col("path").isin(flags), (F.col("txt") == "True").cast("double")) if flags else none["num"]
        counted.append(rows.withColumn("num", flag))
    return reduce(DataFrame.unionByName, counted).select("path", "num", "txt", "c")


def _counted(df: DataFrame, fields, values: list, name: str) -> DataFrame:
    """(path, value, c) of fields of one type."""
    long = df.select(F.posexplode(F.array(*values)).alias("i", name)).where(F.col(name).isNotNull())
    path = F.get(F.lit([path for path, _, _ in fields]), F.col("i"))
    return long.groupBy("i", name).agg(F.count(F.lit(1)).alias("c")).select(path.alias("path"), name, "c")


def field_levels(df: DataFrame, fields, partitions: int | None = None) -> DataFrame:
    """(path, level, rank): the different texts of enum and bool fields, in text order.

    It is a long table, however many levels a field has.
    """
    texts = [f for f in fields if f[2] in ("enum", "bool")]
    if not texts:
        return df.sparkSession.createDataFrame([], "path string, level string, rank bigint")
    found = value_histogram(df, texts).select("path", F.col("txt").alias("level")).where("level is not null")
    return with_running(found, ["path"], ["level"], {"rank": Running("number")}, partitions)


#: Ranges that a pass counts per field, distinct values that are small enough to order, and most passes.
RANGES, FEW, PASSES = 1024, 10_000, 5


def exact_medians(numeric: DataFrame, bounds: list[tuple], partitions: int | None = None) -> dict[str, float]:
    """The mean of the two middle values of every path, from (path, num, c).

    ``bounds`` are (path, n, min, max). A pass counts the values in ``RANGES`` equal parts of what is
    left of each path, map-side, and keeps the part with the middle; where few distinct values are
    left, these are put in order. Only values that five passes do not tell apart go through a
    sort. One row per path and pass comes to the driver.
    """
    spark = numeric.sparkSession
    found, left = {}, {path: (lo, hi, 0, (n + 1) // 2, (n + 2) // 2) for path, n, lo, hi in bounds if n and lo is not None}
    schema = "path string, lo double, hi double, before bigint, low bigint, high bigint"

    def inside():
        table = spark.createDataFrame([(p, float(lo), float(hi), *rest) for p, (lo, hi, *rest) in left.items()], schema)
        return numeric.join(F.broadcast(table), "path").where("num between lo and hi")

    few = False
    for _ in range(PASSES):
        if not left or few:
            break
        part = F.expr(f"if(hi > lo, least({RANGES - 1}, floor((num / 2 - lo / 2) / (hi / 2 - lo / 2) * {RANGES})), 0)")
        counts = inside().groupBy("path", "before", "low", "high", part.alias("part")).agg(
            F.sum("c").alias("c"), F.count("*").alias("values"), F.min("num").alias("least"), F.max("num").alias("most")
        )
        upto = F.col("before") + F.sum("c").over(Window.partitionBy("path").orderBy("part"))
        hit = counts.withColumn("upto", upto).where("upto >= low and upto - c < high").orderBy("path", "part")
        parts: dict[str, list] = {}
        for row in hit.collect():
            parts.setdefault(row["path"], []).append(row)
        few = True
        for path, rows in parts.items():
            first, last = rows[0], rows[-1]
            if len(rows) > 1 or first["least"] == first["most"]:
                # The middle lies between two parts, or all values of the part are one.
                found[path] = (first["most"] + last["least"]) / 2
                del left[path]
            else:
                left[path] = (first["least"], first["most"], first["upto"] - first["c"], first["low"], first["high"])
                few = few and first["values"] <= FEW
    if left:
        if few:
            running = inside().withColumn("upto", F.sum("c").over(Window.partitionBy("path").orderBy("num")))
        else:
            running = with_running(inside(), ["path"], ["num"], {"upto": Running("sum", "c")}, partitions)
        upto = F.col("before") + F.col("upto")

        def middle(rank):
            return F.max(F.when((upto - F.col("c") < F.col(rank)) & (F.col(rank) <= upto), F.col("num")))

        for row in running.groupBy("path").agg(((middle("low") + middle("high")) / 2).alias("median")).collect():
            found[row["path"]] = row["median"]
    return found


def profile_fields(df: DataFrame, fields, partitions: int | None = None) -> DataFrame:
    """Mean, population deviations, bounds, exact median, mode and number of levels.

    Ties of the mode go to the smallest value.  The median is the mean of the two
    middle values, found by narrowing counted ranges of distinct values.
    """
    hist = materialize(value_histogram(df, fields), "histogram")
    first = materialize(hist.groupBy("path").agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("num") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        F.min_by(F.struct("num", "txt"), F.struct(-F.col("c"), "num", "txt")).alias("m"),
        F.count("txt").alias("n_levels"),
    ), "field-facts")
    # One row per declared field: small whatever the data.
    means = F.broadcast(first.select("path", "mean", "n"))
    numeric = hist.where("num is not null").drop("txt")
    gap = F.col("num") - F.col("mean")
    spread = (
        numeric.join(means, "path")
        .groupBy("path")
        .agg(
            F.sqrt(F.sum(gap * gap * F.col("c")) / F.first("n")).alias("sd"),
            (F.sum(F.abs(gap) * F.col("c")) / F.first("n")).alias("md"),
        )
    )
    bounds = [tuple(r) for r in first.where("min is not null").select("path", "n", "min", "max").collect()]
    medians = numeric.sparkSession.createDataFrame(list(exact_medians(numeric, bounds, partitions).items()), "path string, median double")
    return (
        first.join(F.broadcast(spread), "path", "left")
        .join(F.broadcast(medians), "path", "left")
        .select(
            "path",
            "n",
            "mean",
            "sd",
            "md",
            "min",
            "max",
            "median",
            F.col("m.num").alias("mode_num"),
            F.col("m.txt").alias("mode_txt"),
            "n_levels",
        )
    )
