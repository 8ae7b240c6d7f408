"""Fill, encode, project, decode and mask queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import decode, encode
from fieldloom.operators import records as rec
from fieldloom.plans.matches import BAN_PATHS, DICTIONARY, MIN_DURATION, SLOTS, records
from fieldloom.plans.models import checksum, encoded, scored
from fieldloom.plans.oracle import BRAND_LIST, FLAG_LIST, PRIORITY_LIST, TYPE_LIST, sql
from fieldloom.plans.registry import query
from fieldloom.schema import ALL, KNOWN, OUTCOME, UNKNOWN, WIN, expand_ignored

FAMILY_SPANS = {}
for _span in DICTIONARY.spans:
    FAMILY_SPANS.setdefault(_span.field.path.split(".")[-1], []).append(_span)


def _slot_frame(df: DataFrame, families, alias_of=None) -> DataFrame:
    """(rec_id, slot, families...) from wide columns."""
    cells = [
        F.struct(F.lit(i).alias("slot"), *[F.col(f"participants_{i}_{f}").alias(f) for f in families]) for i in range(SLOTS)
    ]
    return df.select("rec_id", F.inline(F.array(*cells)))


@query(
    "fill_defaults",
    sql(
        """select rec_id, slot, case when brand = '' or (rec_id + slot) % 50 = 0 then '' else brand end as brand,
            ptype, psize, quantity, round(price, 4) as price, round(discount, 6) as discount, returnflag, linestatus
        from grid""",
        "grid",
    ),
)
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = records(spark, sf_dir).withColumns(
        {
            f"participants_{i}_brand": F.when((F.col("rec_id") + i) % 50 == 0, "Brand#99").otherwise(
                F.col(f"participants_{i}_brand")
            )
            for i in range(SLOTS)
        }
    )
    families = ("brand", "ptype", "psize", "quantity", "price", "discount", "returnflag", "linestatus")
    rows = _slot_frame(rec.fill_defaults(noisy, DICTIONARY), families)
    return rows.withColumns(
        {"price": F.round(F.col("price").cast("double"), 4), "discount": F.round(F.col("discount").cast("double"), 6)}
    )


_LIT = """select rec_id, 'brand' as family, slot * 33 + list_position({brand}, brand) - 1 as pos from grid
    union all select rec_id, 'ptype', slot * 33 + 26 + list_position({ptype}, ptype) - 1 from grid
    union all select rec_id, 'priority', 330 + slot * 6 + list_position({priority}, priority) - 1 from grid
    union all select rec_id, 'returnflag', 390 + slot * 56 + 52 + list_position({flag}, returnflag) - 1 from grid"""
ONE_HOT = ("brand", "ptype", "priority", "returnflag")


@query(
    "encode_onehot",
    sql(
        """select rec_id, family, string_agg(pos::varchar, ',' order by pos) as lit, count(*)::double as total,
            case family when 'brand' then 260 when 'ptype' then 70 when 'priority' then 60 else 30 end as width
        from lit group by rec_id, family""",
        "grid",
        extra={"lit": _LIT.format(brand=BRAND_LIST, ptype=TYPE_LIST, priority=PRIORITY_LIST, flag=FLAG_LIST)},
    ),
)
def encode_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the one-hot fields: per record and family the places that are not zero, their sum, and the width."""
    cells = []
    for family in ONE_HOT:
        spans = FAMILY_SPANS[family]
        places = F.lit([s.start + k for s in spans for k in range(s.width)])
        lit = F.filter(F.arrays_zip(places.alias("pos"), F.col(family).alias("value")), lambda c: c["value"] != 0)
        total = F.aggregate(family, F.lit(0.0), lambda a, v: a + v)
        width = F.size(family).alias("width")
        cells.append(F.struct(F.lit(family).alias("family"), F.array_join(lit["pos"], ",").alias("lit"), total.alias("total"), width))
    arrays = [rec.encoded_array(FAMILY_SPANS[family]).alias(family) for family in ONE_HOT]
    return records(spark, sf_dir).select("rec_id", *arrays).select("rec_id", F.inline(F.array(*cells)))


@query(
    "encode_thermometer",
    sql(
        """select rec_id, slot, quantity - 1 as lit, (quantity * (quantity + 1) // 2 - 1)::bigint as level_sum, 49 as width
        from grid""",
        "grid",
    ),
)
def encode_thermometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = rec.fill_defaults(records(spark, sf_dir), DICTIONARY)
    cells = []
    for i, s in enumerate(FAMILY_SPANS["quantity"]):
        x = F.expr(encode.thermometer(s.field.column, s.lo, s.width))
        levels = F.transform(x, lambda v, k: F.when(v > 0, k + 2).otherwise(0))
        cells.append(
            F.struct(
                F.lit(i).alias("slot"),
                F.aggregate(x, F.lit(0.0), lambda a, v: a + v).cast("int").alias("lit"),
                F.aggregate(levels, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("level_sum"),
                F.size(x).alias("width"),
            )
        )
    return filled.select("rec_id", F.inline(F.array(*cells)))


def _single(df: DataFrame, family: str) -> DataFrame:
    """(rec_id, field, value) of fields encoded as one column."""
    cells = [
        F.struct(
            F.lit(s.field.path).alias("field"),
            F.get(rec.encoded_array([s]), F.lit(0)).cast("double").alias("value"),
        )
        for s in FAMILY_SPANS[family]
    ]
    return df.select("rec_id", F.inline(F.array(*cells)))


@query(
    "encode_bool_enum",
    sql(
        "select rec_id, 'participants.' || slot || '.linestatus' as field, (linestatus = 'O')::int::double as value from grid",
        "grid",
    ),
)
def encode_bool_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(records(spark, sf_dir), "linestatus")


@query(
    "encode_bool_numeric",
    sql(
        """select rec_id, 'participants.' || slot || '.psize' as field, (psize > 25.619)::int::double as value from grid
        union all select rec_id, 'teams.0.win', t0_win::int::double from filled
        union all select rec_id, 'teams.1.win', t1_win::int::double from filled""",
        "grid", "filled",
    ),
)
def encode_bool_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return _single(rows, "psize").unionByName(_single(rows, "win"))


@query(
    "encode_zscore",
    sql(
        """select rec_id, 'participants.' || slot || '.price' as field,
            round(((price - 53054.271::double) / 30082.661::double)::float::double, 6) as value from grid
        union all select rec_id, 'participants.' || slot || '.discount',
            round(((discount - 0.05::double) / 0.029::double)::float::double, 6) from grid
        union all select rec_id, 'teams.0.price', round(((t0_price - 264728.47::double) / 67253.161::double)::float::double, 6) from filled
        union all select rec_id, 'teams.1.price', round(((t1_price - 264728.47::double) / 67253.161::double)::float::double, 6) from filled
        union all select rec_id, 'duration', round(((duration - 2043.684::double) / 277.555::double)::float::double, 6) from filled""",
        "grid", "filled",
    ),
)
def encode_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    out = _single(rows, "price").unionByName(_single(rows, "discount")).unionByName(_single(rows, "duration"))
    return out.withColumn("value", F.round("value", 6))


ENCODED_SQL = """select k.rec_id, known_sum, known_dot, round(unknown_sum, 4) as unknown_sum,
    round(unknown_dot, 4) as unknown_dot, t0_win::int::double as win_0, t1_win::int::double as win_1
from (select rec_id, count(*)::double as known_sum, sum(pos % 97)::double as known_dot from nz group by rec_id) k
join (select rec_id, sum(y) as unknown_sum, sum(y * (j % 97)) as unknown_dot from truth group by rec_id) u using (rec_id)
join filled using (rec_id)"""


def _encoded_checksums(df: DataFrame) -> DataFrame:
    return df.select(
        "rec_id",
        *checksum("known", "known"),
        *checksum("unknown", "unknown"),
        *[F.get("win", F.lit(t)).cast("double").alias(f"win_{t}") for t in (0, 1)],
    )


@query("encode_records", sql(ENCODED_SQL, "nz", "truth", "filled"))
def encode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_checksums(encoded(spark, sf_dir))


@query(
    "project_portion",
    sql(
        """select rec_id, mask, n, round(total, 4) as total from (
            select rec_id, 1 as mask, 390 as n, count(*)::double as total from nz group by rec_id
            union all select rec_id, 4, 563, sum(y) from truth group by rec_id
            union all select rec_id, 2, 2, t0_win::int::double + t1_win::int::double from filled
            union all select rec_id, 6, 565, sum(v) from (select rec_id, y as v from truth union all
                select rec_id, t0_win::int::double + t1_win::int::double from filled) a group by rec_id
            union all select rec_id, 13, 953, sum(v) from (select rec_id, y as v from truth union all
                select rec_id, 1.0 from nz) a group by rec_id) q""",
        "nz", "truth", "filled",
    ),
)
def project_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(spark, sf_dir).select("rec_id", F.concat("known", "unknown", "win").alias("x"))
    cells = []
    for mask in (KNOWN, OUTCOME, WIN, UNKNOWN, ALL - WIN):
        part = rec.project_portion("x", DICTIONARY, mask)
        total = F.aggregate(part, F.lit(0.0), lambda a, v: a + v.cast("double"))
        cells.append(F.struct(F.lit(mask).alias("mask"), F.size(part).alias("n"), F.round(total, 4).alias("total")))
    return rows.select("rec_id", F.inline(F.array(*cells)))


@query(
    "assign_portion",
    sql(
        """select rec_id, 955 as width, 2 as blank, round(sum(v), 4) as total, round(sum(v * (p % 97)), 4) as weighted from (
            select rec_id, pos as p, 1.0::double as v from nz union all select rec_id, 390 + j, z from logits) q
        group by rec_id""",
        "nz", "logits",
    ),
)
def assign_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, ("known", "z"))
    full = rec.assign_portions(DICTIONARY, {"known": F.col("known"), "unknown": F.col("z")})
    rows = rows.select("rec_id", full.alias("x"))
    kept = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    return rows.select(
        "rec_id",
        F.size("x").alias("width"),
        F.size(F.filter("x", lambda v: v.isNull())).alias("blank"),
        F.round(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
        F.round(
            F.aggregate(F.transform(kept, lambda v, i: v * (i % 97)), F.lit(0.0), lambda a, v: a + v), 4
        ).alias("weighted"),
    )


@query(
    "drop_remakes",
    sql(f"select rec_id, duration, n_slots from recs where duration > {MIN_DURATION}", "recs"),
)
def drop_remakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.drop_short(records(spark, sf_dir), "duration", MIN_DURATION).select("rec_id", "duration", "n_slots")


@query(
    "drop_remakes_encoded",
    sql(f"select rec_id from recs where duration > {MIN_DURATION}", "recs"),
)
def drop_remakes_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.drop_short_encoded(encoded(spark, sf_dir, ("unknown",)), DICTIONARY, above=MIN_DURATION).select("rec_id")


def _decoded(spark: SparkSession, sf_dir: str, families: tuple, text: bool, digits: int | None = None) -> DataFrame:
    """(rec_id, field, value) of some families decoded from the generator's logits."""
    spans = {s.field.path: s for s in DICTIONARY.portion_spans(OUTCOME)}
    cells = []
    for s in (s for family in families for s in FAMILY_SPANS[family]):
        value = F.expr(decode.field_value("z", spans[s.field.path]))
        value = value if text else value.cast("double")
        if digits is not None:
            value = F.round(value, digits)
        cells.append(F.struct(F.lit(s.field.path).alias("field"), value.alias("value")))
    return scored(spark, sf_dir, ("z",)).select("rec_id", F.inline(F.array(*cells)))


def _decoded_sql(families: str, value: str) -> str:
    return sql(f"select rec_id, field, {value} as value from decoded where fam in ({families})", "decoded")


@query("decode_onehot", _decoded_sql("'returnflag'", "txt"))
def decode_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, ("returnflag",), text=True)


@query("decode_thermometer", _decoded_sql("'quantity'", "num"))
def decode_thermometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, ("quantity",), text=False)


@query("decode_bool_enum", _decoded_sql("'linestatus'", "txt"))
def decode_bool_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, ("linestatus",), text=True)


@query("decode_bool_numeric", _decoded_sql("'psize'", "num"))
def decode_bool_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, ("psize",), text=False)


@query(
    "decode_bool",
    sql("select rec_id, t0_win as win_0, t1_win as win_1 from filled", "filled"),
)
def decode_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = DICTIONARY.portion_spans(WIN)
    rows = encoded(spark, sf_dir, ("win",))
    return rows.select("rec_id", *[F.expr(decode.field_value("win", s)).alias(f"win_{t}") for t, s in enumerate(spans)])


@query("decode_zscore", _decoded_sql("'price', 'team_price', 'duration', 'discount'", "round(num, 3)"))
def decode_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, ("price", "duration", "discount"), False, 3)


def decoded_wide_sql(source: str = "decoded") -> str:
    """Wide form of the decoded logits, spelled out per field."""
    picks = []
    for f in DICTIONARY.select(OUTCOME):
        column = "txt" if f.kind == "enum" else ("round(num, 3)" if f.kind == "float" else "num::bigint")
        picks.append(f"max({column}) filter (field = '{f.path}') as {f.column}")
    return f"select rec_id, {', '.join(picks)} from {source} group by rec_id"


def plain_types(df: DataFrame) -> DataFrame:
    """Floats to rounded doubles and integers to bigint, for comparison."""
    out = []
    for f in df.schema.fields:
        name = f.dataType.typeName()
        c = F.col(f.name)
        if name in ("float", "double"):
            c = F.round(c.cast("double"), 3).alias(f.name)
        elif name in ("byte", "short", "integer"):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


@query("decode_records", sql(decoded_wide_sql(), "decoded"))
def decode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = rec.decode_records(scored(spark, sf_dir, ("z",)), DICTIONARY, {"unknown": "z"})
    return plain_types(decoded)


@query(
    "mask_ignored",
    sql(
        """select l.rec_id, 60 as known_blank, 10 as unknown_blank, round(known_sum, 4) as known_sum, round(sum(z) filter (fam <> 'price'), 4) as unknown_sum
        from logits l join lay using (j)
        join (select rec_id, count(*) filter (pos < 330)::double as known_sum from nz group by rec_id) k on k.rec_id = l.rec_id
        group by l.rec_id, known_sum""",
        "logits", "lay", "nz",
    ),
)
def mask_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ":".join(f"participants.{i}.price" for i in range(SLOTS))
    ignored = expand_ignored(f"bans:{prices}", BAN_PATHS)
    rows = scored(spark, sf_dir, ("known", "z"))
    masked = rows.select(
        "rec_id",
        rec.mask_ignored("known", DICTIONARY, ignored, KNOWN).alias("known"),
        rec.mask_ignored("z", DICTIONARY, ignored, OUTCOME).alias("z"),
    )

    def blank(c):
        return F.size(F.filter(c, lambda v: v.isNull()))

    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 4)

    return masked.select(
        "rec_id",
        blank("known").alias("known_blank"),
        blank("z").alias("unknown_blank"),
        total("known").alias("known_sum"),
        total("z").alias("unknown_sum"),
    )
