"""Session helpers: shared folder, scratch tables and stored stages."""

from __future__ import annotations

import itertools
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.RLock()
_LOCAL_ROOTS: dict[str, str] = {}
_STORED: dict[tuple, tuple] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="fieldloom-")
        return _LOCAL_ROOTS[app]


# Records are wide.  A whole-stage method over many fields grows past what the
# JVM compiles to machine code (8000 bytes of bytecode); below these bounds Spark
# generates split projections instead, which run several times faster.
TUNING = {
    "spark.sql.codegen.maxFields": "50",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Encoded rows hold thousands of cells: smaller batches to the Python workers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the bounds for wide records to the session."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


_MADE: dict[int, str] = {}
_MAKERS: dict[int, int] = {}
_NUMBERS = itertools.count()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (not created)."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/fieldloom/{app}/{label}-{uuid.uuid4().hex}"
    number = next(_NUMBERS)
    _MAKERS[number] = threading.get_ident()
    _MADE[number] = path
    return path


@contextmanager
def scratch():
    """Gives a list that holds, after the block, the folders named inside it by this thread."""
    start, made = next(_NUMBERS), []
    try:
        yield made
    finally:
        own = threading.get_ident()
        made.extend(path for number, path in list(_MADE.items()) if number > start and _MAKERS.get(number) == own)


def table_name(path: str) -> str:
    """Name of the catalog table kept in a folder of ``new_folder``, if there is one."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


def drop_folders(spark: SparkSession, paths) -> None:
    """Delete folders of ``new_folder`` whose readers are done, and their tables' names."""
    paths = set(paths)
    for path in paths:
        spark.sql(f"drop table if exists {table_name(path)}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _forget(paths)


def _forget(paths: set) -> None:
    for number in [n for n, path in list(_MADE.items()) if path in paths]:
        _MADE.pop(number, None)
        _MAKERS.pop(number, None)


def clean(spark: SparkSession) -> None:
    """Delete everything this application has left in the shared folder."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _STORED if k[0] == app]:
        del _STORED[key]
    kept = {table_name(path) for path in _MADE.values()}
    for name in [t.name for t in spark.catalog.listTables() if t.name in kept]:
        spark.sql(f"drop table if exists {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/fieldloom/{app}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _MADE.clear()
    _MAKERS.clear()


#: Files that a task writes side by side before Spark sorts the rest of its rows by folder.
OPEN_FILES = 32


@contextmanager
def side_by_side(spark: SparkSession):
    """Inside the block, a task's files of several folders are open together, so that rows that come
    folder by folder are not sorted."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside the block, what a query shuffles is deleted when it ends.

    Else shuffle files stay until the driver happens to collect its garbage, so a chain of
    written stages would hold all its shuffles at once.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read from there; its shuffles are deleted."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with a replicated table, so a lost executor costs a re-read and
    values that depend on partition ids stay as written.
    """
    return write_stage(df, new_folder(df.sparkSession, label))


def settled(spark: SparkSession, label: str, build) -> DataFrame:
    """``build()``, materialized; the folders that it made are deleted."""
    with scratch() as made:
        df = build()
    out = materialize(df, label)
    drop_folders(spark, made)
    return out


def _listing(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of the files right below a folder, or of their folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return ()
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(place)))


def stored(spark: SparkSession, key: tuple, build) -> DataFrame:
    """``build()`` once per application, key and state of the input folder, the key's last part.

    Two threads may build the same stage; the first to finish is kept. Folders that
    ``build`` made are deleted, but not other stored stages.
    """
    full = (spark.sparkContext.applicationId, *key, _listing(spark, key[-1]))
    if full not in _STORED:
        with scratch() as made:
            df = build()
        path = new_folder(spark, str(key[0]))
        write_stage(df, path)
        with _LOCK:
            _STORED.setdefault(full, (path, df.schema))
            kept = {path for path, _ in _STORED.values()}
        drop_folders(spark, set(made) - kept)
    path, schema = _STORED[full]
    return spark.read.schema(schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for functions that run in tasks."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app in _SHIPPED:
            return
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="fieldloom-zip-")) / "fieldloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, str(source.relative_to(package.parent)))
        # The driver only hands the archive to Spark, which serves it.
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
