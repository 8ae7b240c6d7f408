"""CSV and text sources and sinks of the data contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.ordering import with_position
from fieldloom.schema import Dictionary

# Header of the dictionary file.
DICTIONARY_HEADER = [
    "Property Path",
    "Format",
    "Recommended Handling",
    "Default",
    "Occurrence",
    "Mean",
    "Standard Deviation",
    "Mean Deviation",
    "Min",
    "Max",
    "Median",
    "Mode",
]

_CSV = {"nullValue": "", "emptyValue": "", "mode": "FAILFAST"}


def read_field_list(spark: SparkSession, path: str) -> DataFrame:
    """One field path per line, with its line number in a one-file list."""
    lines = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    listed = F.posexplode(F.split(F.regexp_replace("body", r"\n$", ""), "\n"))
    return lines.select(listed.alias("line", "path")).withColumn("line", F.col("line").cast("bigint"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``id,name`` dimension."""
    return spark.read.schema("id bigint, name string").csv(path, **_CSV)


def label_ids(df: DataFrame, names: DataFrame, id_col: str, out: str) -> DataFrame:
    """Look up labels; the optimizer broadcasts the names only when small."""
    lookup = names.select(F.col("id").alias("_id"), F.col("name").alias(out))
    return df.join(lookup, df[id_col] == F.col("_id"), "left").drop("_id")


def read_dictionary(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Dictionary rows in file order (``line``), restricted to ``wanted`` paths.

    The file is a driver-sized declaration: one partition keeps its line order.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in DICTIONARY_HEADER])
    rows = spark.read.schema(schema).csv(path, header=True, **_CSV)
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    if wanted is not None:
        rows = rows.join(
            wanted.select(F.col("path").alias("Property Path")).distinct(),
            "Property Path",
            "left_semi",
        )
    return rows


def read_records(
    spark: SparkSession, path, dictionary: Dictionary, id_field: str | None = None, number_as: str | None = None, file_as: str | None = None
) -> DataFrame:
    """Typed CSV with a header of dotted paths; only the empty string is null.

    ``id_field`` names an id column of the file; ``number_as`` adds one instead, the row's
    place in the order of files and lines, written out once so that it stays. ``file_as`` adds the
    file's name.
    """
    schema = dictionary.schema(dotted=True)
    if id_field:
        schema = T.StructType([T.StructField(id_field, T.LongType()), *schema.fields])
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, **_CSV)
    if file_as:
        df = df.withColumn(file_as, F.col("_metadata.file_path"))
    if not number_as:
        return df.toDF(*[c.replace(".", "_") for c in df.columns])
    order = {
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_row": F.monotonically_increasing_id(),
    }
    placed = df.withColumns(order)
    placed = placed.toDF(*[c.replace(".", "_") for c in placed.columns])
    return with_position(placed, list(order), number_as).drop(*order)


def known_schema(dictionary: Dictionary, id_field: str | None = None) -> T.StructType:
    """Positional schema of the known stream, in known-list order."""
    schema = dictionary.schema(dictionary.known_order)
    if id_field:
        schema = T.StructType([T.StructField(id_field, T.LongType()), *schema.fields])
    return schema


def read_known(spark: SparkSession, path, dictionary: Dictionary, id_field: str | None = None) -> DataFrame:
    """Headerless positional CSV in known-list order."""
    return spark.read.schema(known_schema(dictionary, id_field)).csv(path, **_CSV)


def stream_known(spark: SparkSession, path, dictionary: Dictionary, id_field: str | None = None) -> DataFrame:
    """Streaming twin of :func:`read_known`."""
    return spark.readStream.schema(known_schema(dictionary, id_field)).csv(path, **_CSV)


def output_columns(dictionary: Dictionary, mask: int) -> list[Column]:
    """Decoded fields in dictionary order, nulls replaced by field defaults."""
    out = []
    for f in dictionary.select(mask):
        value = F.col(f.column)
        if f.default is not None:
            value = F.coalesce(value, F.lit(f.default).cast(value_type(f)))
        out.append(value.alias(f.column))
    return out


def value_type(field):
    """Output type: a float default of an int field stays fractional."""
    if field.kind == "int" and isinstance(field.default, float):
        return T.DoubleType()
    return field.spark_type


def write_records(df: DataFrame, path: str, dictionary: Dictionary, mask: int, id_field: str | None = None):
    """Decoded records as CSV without header, in dictionary order."""
    keep = [F.col(id_field)] if id_field else []
    out = df.select(*keep, *output_columns(dictionary, mask))
    out.write.csv(path, header=False, nullValue="", emptyValue="")


def write_known(df: DataFrame, path: str, dictionary: Dictionary, id_field: str | None = None):
    """Known fields as headerless positional CSV."""
    keep = [id_field] if id_field else []
    columns = [dictionary[p].column for p in dictionary.known_order]
    df.select(*keep, *columns).write.csv(path, header=False, nullValue="", emptyValue="")
