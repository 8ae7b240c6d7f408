"""Encoded corpus kept as Parquet: written once, reused while it is valid."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldloom.schema import Dictionary
from fieldloom.session import side_by_side

MANIFEST = "fingerprint string, version string, finished timestamp"
#: One row per input file and encoding of it; ``records`` counts the file's rows, ``kept`` the encoded ones.
LEDGER = (
    "settings string, file string, length bigint, modified string, version string, source string, "
    "records bigint, kept bigint, row_schema string, finished timestamp"
)
#: Column that names the input file a row comes from, as ``_metadata.file_path`` does.
FILE = "source_file"


def input_files(spark: SparkSession, *paths: str) -> list[tuple]:
    """(path, length, modification time) of the files below the paths, in order.

    Only the file listing is read.
    """
    rows = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows += files.select("path", "length", F.col("modificationTime").cast("string")).collect()
    return sorted(tuple(r) for r in rows)


def listed_files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, file, length, modified) of the files below a path; only the listing is read.

    ``path`` is what a reader takes, ``file`` what ``_metadata.file_path`` says of its rows.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=names).load(path)
    about = ("_metadata.file_path as file", "_metadata.file_size as length", "cast(_metadata.file_modification_time as string) as modified")
    return files.selectExpr("path", *about)


def fingerprint(fields: Dictionary, files, **arguments) -> str:
    """Hash of every attribute of every field, the input files and the arguments."""
    text = repr((fields.fields, fields.known_order, list(files), sorted(arguments.items())))
    return hashlib.sha256(text.encode()).hexdigest()


def snapshot_corpus(spark: SparkSession, path: str, build, fingerprint: str) -> DataFrame:
    """Read the corpus at ``path``, or build and write it.

    Each build goes to a folder of its own; the manifest, appended last, names it. So
    data of an unfinished build are never read, nor are those of another fingerprint, and
    a reader of an older version keeps its files.
    """
    manifest = f"{path}/manifest"

    def finished():
        try:
            rows = spark.read.schema(MANIFEST).parquet(manifest).where(F.col("fingerprint") == fingerprint)
            return rows.orderBy(F.desc("finished"), "version").first()
        except AnalysisException:
            return None

    found = finished()
    if found is None:
        version = uuid.uuid4().hex
        build().write.parquet(f"{path}/data-{version}")
        row = spark.range(1).select(
            F.lit(fingerprint).alias("fingerprint"), F.lit(version).alias("version"), F.current_timestamp().alias("finished")
        )
        row.coalesce(1).write.mode("append").parquet(manifest)
        found = finished()
    return spark.read.parquet(f"{path}/data-{found['version']}")


def snapshot_files(spark: SparkSession, path: str, files: DataFrame, build, settings: str) -> tuple[DataFrame, DataFrame]:
    """Encoded rows of the input files, each file encoded once; and one ledger row per file.

    ``files`` is a table like ``listed_files``. Files that the ledger at ``path`` does not have with
    the same length, time and ``settings`` go to ``build(paths) -> (rows, counts)`` in one job:
    ``rows`` name their file in ``FILE``, ``counts`` is (FILE, records) or None. Each file's rows
    have a folder of their own; the ledger's rows are appended last, in one file, so an unfinished
    build is never read. Files that are not listed any more drop out of the result, which has the
    column ``source`` to join the ledger by. Two builds at once encode a file twice; one is read.
    """
    ledger, data = f"{path}/ledger", f"{path}/data"
    same = ["file", "length", "modified"]
    entries = _entries(spark, ledger, settings)
    missing = files if entries is None else files.join(entries, same, "left_anti")
    paths = sorted(row.path for row in missing.select("path").collect())
    if paths:
        version = uuid.uuid4().hex
        rows, counts = build(paths)
        schema = StructType([f for f in rows.schema.fields if f.name != FILE])
        key = F.substring(F.sha2(FILE, 256), 1, 32)
        with side_by_side(spark):
            rows.withColumn("source", key).drop(FILE).write.partitionBy("source").parquet(f"{data}/version={version}")
        kept = spark.read.schema(_keyed(schema)).option("basePath", data).parquet(f"{data}/version={version}").groupBy("source").agg(F.count("*").alias("kept"))
        new = missing.withColumn("source", F.substring(F.sha2("file", 256), 1, 32)).join(kept, "source", "left")
        if counts is None:
            new = new.withColumn("records", F.lit(None).cast("bigint"))
        else:
            new = new.join(counts.select(F.col(FILE).alias("file"), "records"), "file", "left").na.fill(0, ["records"])
        new = new.na.fill(0, ["kept"]).withColumns(
            {"settings": F.lit(settings), "version": F.lit(version), "row_schema": F.lit(schema.json()), "finished": F.current_timestamp()}
        )
        new.select([c.split()[0] for c in LEDGER.split(", ")]).coalesce(1).write.mode("append").parquet(ledger)
        entries = _entries(spark, ledger, settings)
    if entries is None:
        raise ValueError("no input files")
    entries = entries.join(files.select(same), same, "left_semi")
    # As many rows as input files, like the listing that every scan of them makes.
    listed = entries.select("version", "source", "kept", "row_schema").collect()
    schema = _keyed(StructType.fromJson(json.loads(listed[0].row_schema)))
    folders = [f"{data}/version={r.version}/source={r.source}" for r in listed if r.kept]
    if not folders:
        return spark.createDataFrame([], schema).drop("version"), entries
    return spark.read.schema(schema).option("basePath", data).parquet(*folders).drop("version"), entries


def _keyed(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("version", StringType()), StructField("source", StringType())])


def _entries(spark: SparkSession, ledger: str, settings: str) -> DataFrame | None:
    """The newest ledger row of each file and state of it."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger).where(F.col("settings") == settings)
    except AnalysisException:
        return None
    names = [c.split()[0] for c in LEDGER.split(", ")]
    newest = rows.groupBy("file", "length", "modified").agg(F.max_by(F.struct(*names[4:]), F.struct("finished", "version")).alias("e"))
    return newest.select("file", "length", "modified", "e.*")


def file_offsets(entries: DataFrame) -> DataFrame:
    """(source, offset): how many records the files before this one have, in the order of their names."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return entries.select("source", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("offset"))
