"""A data dictionary measured from the records, in the dictionary file's form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.dictionary import parse_fields, with_portion
from fieldloom.operators.layout import encoded_layout
from fieldloom.operators.profile import field_levels, profile_fields
from fieldloom.plans.matches import DICTIONARY, records
from fieldloom.schema import KNOWN, OUTCOME, WIN
from fieldloom.session import stored

OPTIONAL_PATTERNS = (
    r"^participants\.\d+\.(brand|ptype)$",
    r"^teams\.\d+\.bans\.\d+\.priority$",
)
WIN_PATHS = tuple(f.path for f in DICTIONARY.select(WIN))

# Which statistic a field's default is taken from.
DEFAULT_COLUMNS = {"psize": "Median", "quantity": "Median", "price": "Mean", "discount": "Mean", "duration": "Mean"}


FIELDS = [(f.path, f.column, f.kind) for f in DICTIONARY]


def measured_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_levels(records(spark, sf_dir), FIELDS)


def measured_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile with the levels of the declared enum and bool fields as arrays."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "level")))
    levels = measured_levels(spark, sf_dir).groupBy("path").agg(F.transform(ranked, lambda x: x["level"]).alias("levels"))
    return profile_fields(records(spark, sf_dir), FIELDS).join(levels, "path", "left")


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame(
        [
            (i, f.path, f.kind, f.handling, f.occurrence, DEFAULT_COLUMNS.get(f.path.split(".")[-1], "Mode"))
            for i, f in enumerate(DICTIONARY)
        ],
        "line bigint, path string, kind string, handling string, occurrence string, default_column string",
    )
    kind = F.col("kind")
    number = "decimal(38,3)"

    def stat(name):
        return F.when(kind != "enum", F.col(name).cast(number).cast("string"))

    def typed(name):
        return (
            F.when(kind == "int", F.floor(name).cast("bigint").cast("string"))
            .when(kind == "float", F.col(name).cast(number).cast("string"))
        )

    def bound(name):
        return typed(name).when(kind == "bool", F.when(F.col(name) > 0, "True").otherwise("False"))

    joined = declared.join(measured_profile(spark, sf_dir), "path")
    levels = F.concat(F.lit("enum("), F.array_join("levels", "|"), F.lit(")"))
    return joined.select(
        "line",
        F.col("path").alias("Property Path"),
        F.when(kind == "enum", levels).otherwise(kind).alias("Format"),
        F.col("handling").alias("Recommended Handling"),
        F.col("default_column").alias("Default"),
        F.col("occurrence").alias("Occurrence"),
        stat("mean").alias("Mean"),
        stat("sd").alias("Standard Deviation"),
        stat("md").alias("Mean Deviation"),
        bound("min").alias("Min"),
        bound("max").alias("Max"),
        typed("median").alias("Median"),
        typed("mode_num").when(kind.isin("enum", "bool"), F.col("mode_txt")).alias("Mode"),
    )


def measured_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary text rows with their ``line``; measured once per application."""
    return stored(spark, ("dictionary", sf_dir), lambda: _build(spark, sf_dir))


def path_list(spark: SparkSession, sf_dir: str, mask: int) -> DataFrame:
    """Paths of a portion that occur in the data, in list order."""
    order = DICTIONARY.known_order if mask == KNOWN else [f.path for f in DICTIONARY.select(mask)]
    wanted = spark.createDataFrame(list(enumerate(order)), "line bigint, path string")
    seen = measured_dictionary(spark, sf_dir).select(F.col("Property Path").alias("path"))
    return wanted.join(seen, "path", "left_semi").select("line", "path")


def measured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed dictionary rows with their portion bit."""
    parsed = parse_fields(measured_dictionary(spark, sf_dir), OPTIONAL_PATTERNS)
    return with_portion(parsed, path_list(spark, sf_dir, KNOWN), path_list(spark, sf_dir, OUTCOME), WIN_PATHS)


def measured_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_layout(measured_fields(spark, sf_dir))
