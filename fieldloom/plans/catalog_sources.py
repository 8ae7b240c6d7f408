"""Source and sink queries: files written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import records as rec
from fieldloom.plans import measured as m
from fieldloom.plans.catalog_records import ENCODED_SQL, _encoded_checksums, plain_types
from fieldloom.plans.catalog_scoring import known_files
from fieldloom.plans.matches import DICTIONARY, MIN_DURATION, records, table
from fieldloom.plans.models import checksum, encoded
from fieldloom.plans.oracle import sql
from fieldloom.plans.registry import query
from fieldloom.schema import ALL, KNOWN
from fieldloom.session import new_folder
from fieldloom.sources import tables
from fieldloom.sources.snapshot import FILE, listed_files, snapshot_files


@query(
    "read_field_list",
    sql(
        """select row_number() over (order by rank, key) - 1 as line, path from (
            select path, case when path like 'teams%' then 0 when path like '%brand' then 1 else 2 end as rank, line as key
            from dict where portion = 1) q""",
        "dict",
    ),
)
def read_field_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "known-list")
    m.path_list(spark, sf_dir, KNOWN).coalesce(1).sortWithinPartitions("line").select("path").write.text(path)
    return tables.read_field_list(spark, path)


@query(
    "read_names",
    """select p_name as name, count(*) as n, sum(l_quantity)::bigint as quantity
    from lineitem left join part on l_partkey = p_partkey group by p_name""",
)
def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "names")
    table(spark, sf_dir, "part").select("p_partkey", "p_name").write.csv(path)
    names = tables.read_names(spark, path)
    # Count per id first: the labels then join one row per id.
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")
    )
    return (
        tables.label_ids(per_part, names, "l_partkey", "name")
        .groupBy("name")
        .agg(F.sum("n").alias("n"), F.sum("q").cast("bigint").alias("quantity"))
    )


@query(
    "read_dictionary",
    sql(
        """select line::bigint as line, path, format, handling, default_column, occurrence, mean, sd, md, min, max, median, mode
        from dict where portion = 1""",
        "dict",
    ),
)
def read_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "dictionary-csv")
    rows = m.measured_dictionary(spark, sf_dir).coalesce(1).sortWithinPartitions("line")
    rows.select(*tables.DICTIONARY_HEADER).write.csv(path, header=True)
    wanted = m.path_list(spark, sf_dir, KNOWN)
    back = tables.read_dictionary(spark, path, wanted)
    names = (
        "path", "format", "handling", "default_column", "occurrence", "mean", "sd", "md", "min", "max", "median", "mode"
    )
    return back.select("line", *[F.col(c).alias(n) for c, n in zip(tables.DICTIONARY_HEADER, names)])


def _wide_sql(source: str, record: str, value: dict[str, str]) -> str:
    """All declared fields of a record from slot and record rows."""
    picks = []
    for f in DICTIONARY:
        words = f.path.split(".")
        if words[0] == "participants":
            expr, slot = value.get(words[2], words[2]), words[1]
        elif ".bans." in f.path:
            expr, slot = "priority", str(int(words[1]) * 5 + int(words[3]))
        else:
            continue
        if f.kind == "int":
            expr = f"({expr})::bigint"
        picks.append(f"max({expr}) filter (slot = {slot}) as {f.column}")
    return f"select * from (select rec_id, {', '.join(picks)} from {source} group by rec_id) s join ({record}) r using (rec_id)"


@query(
    "read_records",
    sql(
        _wide_sql(
            "slots",
            """select rec_id, duration::bigint as duration, round(t0_price::float::double, 3) as teams_0_price,
                round(t1_price::float::double, 3) as teams_1_price, t0_price > t1_price as teams_0_win,
                t1_price > t0_price as teams_1_win from recs""",
            {"price": "round(price::float::double, 3)", "discount": "round(discount::float::double, 3)"},
        ),
        "slots", "recs",
    ),
)
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide CSV with a header of dotted paths, read with the declared types."""
    path = new_folder(spark, "records-csv")
    wide = records(spark, sf_dir).select("rec_id", *[F.col(f.column) for f in DICTIONARY])
    wide.toDF("rec_id", *[f.path for f in DICTIONARY]).write.csv(path, header=True, nullValue="")
    return plain_types(tables.read_records(spark, path, DICTIONARY, id_field="rec_id"))


@query(
    "read_known",
    sql(
        "select rec_id, 390 as width, count(*)::double as known_sum, sum(pos % 97)::double as known_dot from nz group by rec_id",
        "nz",
    ),
)
def read_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tables.read_known(spark, known_files(spark, sf_dir), DICTIONARY, id_field="rec_id")
    rows = rec.encode_records(known, DICTIONARY.subset(KNOWN), ("known",))
    return rows.select("rec_id", F.size("known").alias("width"), *checksum("known", "known"))


@query(
    "count_records",
    sql("select count(*) as records, sum(n_slots)::bigint as filled_slots, max(n_slots) as most_slots from recs", "recs"),
)
def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("n_slots").alias("filled_slots"),
        F.max("n_slots").alias("most_slots"),
    )


@query(
    "snapshot_corpus",
    sql(f"select e.* from ({ENCODED_SQL}) e join recs using (rec_id) where duration > {MIN_DURATION}", "nz", "truth", "filled"),
)
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus of the record files: every other file first, then the rest, then none again."""
    path, schema = new_folder(spark, "corpus"), records(spark, sf_dir).schema
    stored_files = sorted(records(spark, sf_dir).inputFiles())
    files = listed_files(spark, stored_files[0].rsplit("/", 1)[0], "*.parquet")
    every_other = [file.rsplit("/", 1)[1] for file in stored_files[::2]]
    encoded_files = []

    def build(paths):
        encoded_files.extend(paths)
        raw = spark.read.schema(schema).parquet(*paths).withColumn(FILE, F.col("_metadata.file_path"))
        return rec.encode_records(rec.drop_short(raw, "duration", MIN_DURATION), DICTIONARY, keep=["rec_id", FILE]), None

    some = files.where(F.substring_index("file", "/", -1).isin(every_other))
    for listing in (some, files, files):
        rows, _ = snapshot_files(spark, path, listing, build, sf_dir)
    if len(encoded_files) != len(set(encoded_files)):
        raise RuntimeError("a file of the corpus was encoded twice")
    return _encoded_checksums(rows.drop("source"))


def _z_round_trip(value: str, mean: float, sd: float) -> str:
    z = f"(({value} - {mean}::double) / {sd}::double)::float::double"
    return f"greatest({z} * {sd}::double + {mean}::double, 0)"


@query(
    "write_records",
    sql(
        _wide_sql(
            "grid",
            f"""select rec_id, trunc({_z_round_trip('duration', 2043.684, 277.555)})::bigint as duration,
                round(({_z_round_trip('t0_price', 264728.47, 67253.161)})::float::double, 3) as teams_0_price,
                round(({_z_round_trip('t1_price', 264728.47, 67253.161)})::float::double, 3) as teams_1_price,
                t0_win as teams_0_win, t1_win as teams_1_win from filled""",
            {
                "psize": "case when psize > 25.619 then 40 else 11 end",
                "price": f"round(({_z_round_trip('price', 53054.271, 30082.661)})::float::double, 3)",
                "discount": f"round(({_z_round_trip('discount', 0.05, 0.029)})::float::double, 3)",
            },
        ),
        "grid", "filled",
    ),
)
def write_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, write as headerless CSV in dictionary order, read back."""
    rows = encoded(spark, sf_dir)
    decoded = rec.decode_records(rows, DICTIONARY, {p: p for p in ("known", "unknown", "win")})
    path = new_folder(spark, "output-csv")
    tables.write_records(decoded, path, DICTIONARY, ALL, id_field="rec_id")
    schema = ", ".join(["rec_id bigint"] + [f"{f.column} {tables.value_type(f).simpleString()}" for f in DICTIONARY])
    back = plain_types(spark.read.schema(schema).csv(path))
    integral = [f.column for f in DICTIONARY if f.kind == "int"]
    return back.withColumns({c: F.col(c).cast("bigint") for c in integral}).na.fill("")
