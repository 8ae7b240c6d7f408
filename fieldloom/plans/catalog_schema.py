"""Dictionary and layout queries, on a dictionary measured from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import dictionary as d
from fieldloom.operators import layout as lay
from fieldloom.plans import measured as m
from fieldloom.plans.matches import table
from fieldloom.plans.oracle import sql
from fieldloom.plans.registry import query
from fieldloom.schema import ALL, KNOWN, OUTCOME, UNKNOWN, WIN


@query(
    "profile_fields",
    sql(
        """select path, n, round(mean, 6) as mean, round(sd, 6) as sd, round(md, 6) as md, min, max, median,
            mode_num, mode_txt, coalesce(array_to_string(levels, '|'), '') as levels
        from stats left join devs using (path) left join modes using (path)""",
        "stats", "devs", "modes",
    ),
)
def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.measured_profile(spark, sf_dir).select(
        "path",
        "n",
        F.round("mean", 6).alias("mean"),
        F.round("sd", 6).alias("sd"),
        F.round("md", 6).alias("md"),
        "min",
        "max",
        "median",
        "mode_num",
        "mode_txt",
        F.coalesce(F.array_join("levels", "|"), F.lit("")).alias("levels"),
    )


@query(
    "field_levels",
    sql(
        """select path, txt as level, row_number() over (partition by path order by txt) as rank
        from (select distinct path, txt from cells where txt is not null) q""",
        "cells",
    ),
)
def field_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.measured_levels(spark, sf_dir)


@query(
    "parse_fields",
    sql(
        """select path, kind, handling, occurrence, portion = 1 as optional, default_column,
            mean::double as mean, sd::double as sd, md::double as md, min, max, median, mode,
            case when kind = 'enum' then len(levels) + (portion = 1)::int end as n_levels,
            case when kind = 'enum' then array_to_string(levels, '/') || case when portion = 1 then '/' else '' end end as level_text
        from dict""",
        "dict",
    ),
)
def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = d.parse_fields(m.measured_dictionary(spark, sf_dir), m.OPTIONAL_PATTERNS)
    return parsed.select(
        "path", "kind", "handling", "occurrence", "optional", "default_column", "mean", "sd", "md",
        "min", "max", "median", "mode",
        F.when(F.col("levels").isNotNull(), F.size("levels")).cast("bigint").alias("n_levels"),
        F.array_join("levels", "/").alias("level_text"),
    )


# Integer columns of the raw tables: path, table, expression (same in both engines).
STORAGE_COLUMNS = (
    ("lineitem.l_orderkey", "lineitem", "l_orderkey"),
    ("lineitem.l_partkey", "lineitem", "l_partkey"),
    ("lineitem.l_linenumber", "lineitem", "l_linenumber"),
    ("lineitem.revenue_cents", "lineitem", "cast(floor(l_extendedprice * 100000) as bigint)"),
    ("orders.o_custkey", "orders", "o_custkey"),
    ("customer.c_acctbal", "customer", "cast(floor(c_acctbal) as bigint)"),
    ("customer.c_acctbal_cents", "customer", "cast(floor(c_acctbal * 1000) as bigint)"),
    ("customer.c_debt", "customer", "-c_nationkey"),
    ("part.p_size", "part", "p_size"),
    ("events.shifted", "events", "event_id - 1000"),
)


@query(
    "infer_storage_type",
    "with bounds as ("
    + " union all ".join(
        f"select '{p}' as path, min({e})::hugeint as lo, max({e})::hugeint as hi from {t}" for p, t, e in STORAGE_COLUMNS
    )
    + """)
    select path, lo::varchar as min, hi::varchar as max,
        case when lo < 0 then 'i' else 'u' end || case
            when x < (256::hugeint // s) then '1' when x < (65536::hugeint // s) then '2'
            when x < (4294967296::hugeint // s) then '4' else '8' end as storage
    from (select *, greatest(abs(lo), abs(hi)) as x, case when lo < 0 then 2 else 1 end as s from bounds) q""",
)
def infer_storage_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [
        table(spark, sf_dir, t).agg(
            F.min(F.expr(e)).cast("string").alias("min"), F.max(F.expr(e)).cast("string").alias("max")
        ).select(F.lit(p).alias("path"), F.lit("int").alias("kind"), "min", "max")
        for p, t, e in STORAGE_COLUMNS
    ]
    return d.infer_storage_type(reduce(DataFrame.unionByName, bounds)).drop("kind")


@query(
    "resolve_default",
    sql(
        """select path, case when portion = 1 then '' when default_column = 'Mean' then mean::double::varchar
            when default_column = 'Median' then median else mode end as default_value,
            case when kind = 'int' then case when max::bigint < 256 then 'u1' when max::bigint < 65536 then 'u2' else 'u4' end
                when kind = 'enum' then 'category' when kind = 'float' then 'f4' else 'bool' end as storage
        from dict""",
        "dict",
    ),
)
def resolve_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = d.infer_storage_type(d.resolve_default(m.measured_fields(spark, sf_dir)))
    return typed.select("path", F.col("default").alias("default_value"), "storage")


@query(
    "optional_fields",
    sql(
        """select path, len(levels) + 1 as n_levels, (list_append(levels, ''))[len(levels) + 1] as last_level,
            levels[len(levels)] as last_level_if_required
        from dict where portion = 1""",
        "dict",
    ),
)
def optional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = m.measured_dictionary(spark, sf_dir)
    optional = d.parse_fields(raw, m.OPTIONAL_PATTERNS).where("optional")
    required = d.parse_fields(raw, m.OPTIONAL_PATTERNS, known_optional=False).select(
        "path", F.element_at("levels", -1).alias("last_level_if_required")
    )
    return optional.select(
        "path", F.size("levels").cast("bigint").alias("n_levels"), F.element_at("levels", -1).alias("last_level")
    ).join(required, "path")


@query(
    "select_portion",
    sql(
        "select m as mask, path, portion from dict, (values (1), (2), (4), (6), (13), (15)) t(m) where portion & m <> 0",
        "dict",
    ),
)
def select_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = m.measured_fields(spark, sf_dir)
    parts = [
        d.select_portion(fields, mask).select(F.lit(mask).alias("mask"), "path", "portion")
        for mask in (KNOWN, WIN, OUTCOME, UNKNOWN, ALL - WIN, ALL)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "family_bounds",
    sql(
        """select regexp_replace(path, '^(participants|teams)\\.[0-9]+\\.', '\\1.*.') as family, count(*) as members,
            min(min::double) as family_min, max(max::double) as family_max
        from dict where kind in ('int', 'float') group by 1""",
        "dict",
    ),
)
def family_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.family_bounds(m.measured_fields(spark, sf_dir))


@query("encoded_layout", sql("select path, portion, handling, part_kind, part_key, pos from layout", "layout"))
def encoded_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.measured_layout(spark, sf_dir).select("path", "portion", "handling", "part_kind", "part_key", "pos")


@query(
    "portion_slice",
    sql(
        """select m as mask, min(pos) as start, max(pos) + 1 as stop, count(*) as width, sum(pos)::bigint as index_sum
        from layout, (values (1), (2), (4), (6), (13), (15)) t(m) where portion & m <> 0 group by m""",
        "layout",
    ),
)
def portion_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = m.measured_layout(spark, sf_dir)
    sums = [
        lay.portion_indices(layout, mask).agg(F.sum("pos").alias("index_sum")).select(F.lit(mask).alias("mask"), "index_sum")
        for mask in lay.PORTION_MASKS
    ]
    return lay.portion_slices(layout).join(reduce(DataFrame.unionByName, sums), "mask")


@query(
    "column_lookup",
    sql(
        """select l.path, part_key, pos, start, stop from layout l
        join (select path, min(pos) as start, max(pos) + 1 as stop from layout group by path) s using (path)
        where l.path in ('participants.3.brand', 'participants.3.quantity', 'teams.1.price', 'teams.0.win')""",
        "layout",
    ),
)
def column_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = m.measured_layout(spark, sf_dir)
    names = ("participants.3.brand", "participants.3.quantity", "teams.1.price", "teams.0.win")
    return lay.column_lookup(layout, names).join(lay.field_spans(layout).select("path", "start", "stop"), "path")


_ISLANDS = """select {pick} min(pos) as start, max(pos) + 1 as stop from (
    select *, sum(turn) over (order by pos) as run from (
        select pos, label, case when lag(label) over (order by pos) is distinct from label then 1 else 0 end as turn
        from (select pos, {label} as label from layout) a) b) c {where} group by run, label"""


@query(
    "contiguous_runs",
    sql(
        "select start, stop, rank <= 3 as among_first from (select *, row_number() over (order by start) as rank from ("
        + _ISLANDS.format(pick="", label="(handling = 'continuous')", where="where label")
        + ") r) q",
        "layout",
    ),
)
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = m.measured_layout(spark, sf_dir)
    predicate = F.col("handling") == "continuous"
    first = lay.contiguous_runs(layout, predicate, max_runs=3).select("start", F.lit(True).alias("first"))
    return (
        lay.contiguous_runs(layout, predicate)
        .join(first, "start", "left")
        .select("start", "stop", F.coalesce("first", F.lit(False)).alias("among_first"))
    )


@query(
    "handling_runs",
    sql(
        _ISLANDS.format(
            pick="label as handling,",
            label="case when path like 'teams.%.bans.%' or path = 'participants.2.price' then 'none' else handling end",
            where="",
        ),
        "layout",
    ),
)
def handling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.plans.matches import BAN_PATHS
    from fieldloom.schema import expand_ignored

    ignored = expand_ignored("bans:participants.2.price", BAN_PATHS)
    return lay.handling_runs(m.measured_layout(spark, sf_dir), ignored)
