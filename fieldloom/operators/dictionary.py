"""Dictionary rows as a DataFrame: parse, type, default, portion, bounds.

A dictionary has one row per declared field, so every table here is bounded by
the schema and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.schema import ALL, EXTRA, HANDLINGS, KNOWN, OCCURRENCES, OUTCOME, WIN, Dictionary, Field


def _one_of(value: Column, allowed, what: str) -> Column:
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))
    return F.when(value.isin(list(allowed)), value).otherwise(F.raise_error(message))


def optional_flag(path: Column, patterns) -> Column:
    """Fields a user may leave open, named by regular expressions."""
    return F.coalesce(*[F.when(path.rlike(p), True) for p in patterns], F.lit(False))


def parse_fields(raw: DataFrame, optional_patterns=(), known_optional: bool = True) -> DataFrame:
    """Dictionary text rows to typed rows.

    With ``known_optional`` the level list of an optional enum ends in ``""``.
    """
    path, fmt = F.col("Property Path"), F.col("Format")
    is_enum = fmt.startswith("enum(")
    levels = F.split(F.substring(fmt, F.lit(6), F.length(fmt) - 6), r"\|")
    optional = optional_flag(path, optional_patterns)
    if known_optional:
        levels = F.when(optional, F.array_append(levels, F.lit(""))).otherwise(levels)
    return raw.select(
        "line",
        path.alias("path"),
        F.when(is_enum, "enum").otherwise(_one_of(fmt, ("int", "bool", "float"), "format")).alias("kind"),
        F.when(is_enum, levels).alias("levels"),
        _one_of(F.col("Recommended Handling"), HANDLINGS, "handling").alias("handling"),
        _one_of(F.col("Occurrence"), OCCURRENCES, "occurrence").alias("occurrence"),
        optional.alias("optional"),
        F.col("Default").alias("default_column"),
        F.col("Mean").cast("double").alias("mean"),
        F.col("Standard Deviation").cast("double").alias("sd"),
        F.col("Mean Deviation").cast("double").alias("md"),
        F.col("Min").alias("min"),
        F.col("Max").alias("max"),
        F.col("Median").alias("median"),
        F.col("Mode").alias("mode"),
    )


def infer_storage_type(fields: DataFrame) -> DataFrame:
    """Smallest storage type per field (``storage``)."""
    wide = "decimal(38,0)"
    lo = F.when(F.col("kind") == "int", F.col("min")).cast(wide)
    hi = F.when(F.col("kind") == "int", F.col("max")).cast(wide)
    signed = lo < 0
    extreme = F.greatest(F.abs(lo), F.abs(hi))
    width = F.lit(None).cast("int")
    for size in (8, 4, 2, 1):
        bound = F.when(signed, F.lit(str(1 << (8 * size - 1)))).otherwise(F.lit(str(1 << (8 * size))))
        width = F.when(extreme < bound.cast(wide), F.lit(size)).otherwise(width)
    text = F.concat(F.when(signed, "i").otherwise("u"), width.cast("string"))
    too_large = F.raise_error(F.concat(F.col("path"), F.lit(": no integer storage is wide enough")))
    storage = (
        F.when(F.col("kind") == "enum", "category")
        .when(F.col("kind") == "float", "f4")
        .when(F.col("kind") == "bool", "bool")
        .otherwise(F.when(width.isNull(), too_large.cast("string")).otherwise(text))
    )
    return fields.withColumn("storage", storage)


def resolve_default(fields: DataFrame) -> DataFrame:
    """The default named by ``Default``; optional fields default to ``""``."""
    named = F.col("default_column")
    default = (
        F.when(F.col("optional"), F.lit(""))
        .when(named == "Mean", F.col("mean").cast("string"))
        .when(named == "Standard Deviation", F.col("sd").cast("string"))
        .when(named == "Mean Deviation", F.col("md").cast("string"))
        .when(named == "Min", F.col("min"))
        .when(named == "Max", F.col("max"))
        .when(named == "Median", F.col("median"))
        .when(named == "Mode", F.col("mode"))
    )
    return fields.withColumn("default", default)


def with_portion(
    fields: DataFrame, known: DataFrame, unknown: DataFrame, win_paths, interesting: DataFrame | None = None
) -> DataFrame:
    """Portion bit per field from the list files and the win paths.

    A field that only the list of interesting ones names belongs to no network: it is
    read and selected, but has no encoded columns.
    """
    k = known.select("path").distinct().withColumn("_known", F.lit(True))
    u = unknown.select("path").distinct().withColumn("_unknown", F.lit(True))
    bit = (
        F.when(F.col("path").isin(list(win_paths)), WIN)
        .when(F.col("_known"), KNOWN)
        .when(F.col("_unknown"), OUTCOME)
    )
    joined = fields.join(k, "path", "left").join(u, "path", "left")
    if interesting is not None:
        joined = joined.join(interesting.select("path").distinct().withColumn("_extra", F.lit(True)), "path", "left")
        bit = bit.when(F.col("_extra"), EXTRA)
    return joined.withColumn("portion", bit.otherwise(0)).drop("_known", "_unknown", "_extra")


def select_portion(fields: DataFrame, mask: int) -> DataFrame:
    """Fields of a portion mask."""
    if not mask & ALL or mask & ~ALL:
        raise ValueError(f"unknown portion {mask}")
    return fields.where(F.col("portion").bitwiseAND(F.lit(mask)) != 0)


def family_of(path: Column) -> Column:
    return F.regexp_replace(path, r"^(participants|teams)\.\d+\.", "$1.*.")


def family_bounds(fields: DataFrame) -> DataFrame:
    """Least minimum and greatest maximum over all slots of each family."""
    numeric = fields.where(F.col("kind").isin("int", "float"))
    return numeric.groupBy(family_of(F.col("path")).alias("family")).agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.col("min").cast("double")).alias("family_min"),
        F.max(F.col("max").cast("double")).alias("family_max"),
    )


def _value(kind: str, text: str | None):
    """A dictionary text as a value of the field's kind."""
    if text is None or kind == "enum":
        return text
    if kind == "bool":
        return text == "True"
    return float(text) if kind == "float" or "." in text else int(text)


def collect_dictionary(fields: DataFrame, known_order=None) -> Dictionary:
    """The driver-side dictionary of parsed rows with ``portion`` and ``default``.

    One row per declared field reaches the driver.
    """
    out = []
    for r in fields.where("portion != 0").orderBy("line").collect():
        # A mean as the default of an int field stays fractional.
        kind = "float" if r["default_column"] in ("Mean", "Standard Deviation", "Mean Deviation") else r["kind"]
        out.append(
            Field(
                r["path"], r["kind"], r["handling"], r["portion"], r["occurrence"],
                levels=tuple(r["levels"] or ()), optional=r["optional"],
                default=r["default"] if r["optional"] else _value(kind, r["default"]),
                mean=r["mean"], sd=r["sd"], md=r["md"],
                min=_value(r["kind"], r["min"]), max=_value(r["kind"], r["max"]),
                median=_value(r["kind"], r["median"]), mode=_value(r["kind"], r["mode"]),
            )
        )
    return Dictionary(out, known_order)
