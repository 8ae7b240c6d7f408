"""Split, batch and augmentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import sampling
from fieldloom.operators.ordering import with_position
from fieldloom.plans.matches import DICTIONARY, records
from fieldloom.plans.oracle import draw, sql, text_list
from fieldloom.plans.registry import query

HELD_OUT, EVALUATION, BATCH = 150, 200, 256
SEED = 7


@query(
    "split_positional",
    sql(
        f"""select rec_id, pos, case when pos < greatest(n - {HELD_OUT} - {EVALUATION}, 0) then 'train'
            when pos < greatest(n - {HELD_OUT}, 0) then 'evaluation' else 'held_out' end as split
        from placed, (select count(*) as n from recs) c""",
        "placed",
    ),
)
def split_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = records(spark, sf_dir).select("rec_id")
    return sampling.split_positional(ids, ["rec_id"], HELD_OUT, EVALUATION)


@query(
    "batch_rows",
    sql(
        f"""select pos // {BATCH} as batch_id, count(*) as n, min(rec_id) as first_rec, max(rec_id) as last_rec
        from placed group by 1""",
        "placed",
    ),
)
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_position(records(spark, sf_dir).select("rec_id"), ["rec_id"])
    return (
        sampling.batch_rows(placed, BATCH)
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_rec"), F.max("rec_id").alias("last_rec"))
    )


@query(
    "permute_slots",
    sql(
        """select g.rec_id, (t.team * 5 + o.place)::int as slot, brand, ptype, psize, quantity, round(price, 2) as price,
            round(discount, 6) as discount, returnflag, linestatus, priority
        from placed p
        join orders_of o on o.batch_id = p.batch_id
        join (values (0), (1)) t(team) on t.team = o.team
        left join slots_all g on g.rec_id = p.rec_id and g.slot = o.team * 5 + o.member""".replace(
            "from placed p", f"from (select *, pos // {BATCH} as batch_id from placed) p"
        ),
        "placed", "slots",
        extra={
            "batches": f"select distinct pos // {BATCH} as batch_id from placed",
            "orders_of": f"""select batch_id, team, member, row_number() over (partition by batch_id, team
                order by substr(md5('{SEED}:' || batch_id || ':' || team), (6 * member + 1)::int, 6), member) - 1 as place
                from batches, (values (0), (1)) t(team), range(5) m(member)""",
            "slots_all": """select r.rec_id, s.slot, brand, ptype, psize, quantity, price, discount, returnflag, linestatus, priority
                from recs r cross join range(10) s(slot) left join slots q on q.rec_id = r.rec_id and q.slot = s.slot""",
        },
    ),
)
def permute_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("brand", "ptype", "psize", "quantity", "price", "discount", "returnflag", "linestatus")
    columns = [f"participants_{i}_{f}" for i in range(10) for f in fields]
    bans = [f"teams_{t}_bans_{m}_priority" for t in (0, 1) for m in range(5)]
    placed = with_position(records(spark, sf_dir).select("rec_id", *columns, *bans), ["rec_id"])
    moved = sampling.permute_slots(sampling.batch_rows(placed, BATCH), DICTIONARY, SEED)
    slots = [
        F.struct(
            F.lit(i).alias("slot"),
            *[F.col(f"participants_{i}_{f}").alias(f) for f in fields],
            F.col(f"teams_{i // 5}_bans_{i % 5}_priority").alias("priority"),
        )
        for i in range(10)
    ]
    return moved.select("rec_id", F.inline(F.array(*slots))).withColumns(
        {"price": F.round("price", 2), "discount": F.round("discount", 6)}
    )


# Optional fields in dictionary order, numbered from 1; draw 0 keeps the row.
OPTIONAL_FIELDS = [f.path for f in DICTIONARY if f.optional]


@query(
    "blank_optional",
    sql(
        f"""select rec_id, field, case when d < 1 - exp(-0.5::double) and not k < 1 - exp(-0.5::double) then '' else value end as value
        from (
            select *, ('0x' || substr(md5('{SEED}:' || (i // 4) || ':' || rec_id), (8 * (i % 4) + 1)::int, 8))::bigint / 4294967296.0::double as d,
                {draw(f"'{SEED}'", "'0'", 'rec_id')} as k
            from (select *, list_position({text_list(OPTIONAL_FIELDS)}, field) as i from (
                select r.rec_id, 'participants.' || g.slot || '.brand' as field, s.brand as value
                  from recs r cross join range(10) g(slot) left join slots s on s.rec_id = r.rec_id and s.slot = g.slot
                union all
                select r.rec_id, 'participants.' || g.slot || '.ptype', s.ptype
                  from recs r cross join range(10) g(slot) left join slots s on s.rec_id = r.rec_id and s.slot = g.slot
                union all
                select r.rec_id, 'teams.' || (g.slot // 5) || '.bans.' || (g.slot % 5) || '.priority', s.priority
                  from recs r cross join range(10) g(slot) left join slots s on s.rec_id = r.rec_id and s.slot = g.slot
            ) q) n) d""",
        "recs", "slots",
    ),
)
def blank_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    optional = [f for f in DICTIONARY if f.optional]
    known = records(spark, sf_dir).select("rec_id", *[f.column for f in optional])
    blanked = sampling.blank_optional(known, DICTIONARY, 0.5, 0.5, SEED)
    cells = [F.struct(F.lit(f.path).alias("field"), F.col(f.column).alias("value")) for f in optional]
    return blanked.select("rec_id", F.inline(F.array(*cells)))


@query(
    "shuffle_rows",
    sql(
        f"""select rec_id, batch_id, epoch, row_number() over (partition by epoch, batch_id
            order by md5('{SEED}:' || epoch || ':' || rec_id), rec_id) - 1 as place
        from (select *, pos // {BATCH} as batch_id from placed) p, (values (0), (1)) e(epoch)""",
        "placed",
    ),
)
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_position(records(spark, sf_dir).select("rec_id"), ["rec_id"])
    batches = sampling.batch_rows(placed, BATCH)
    epochs = [sampling.shuffle_rows(batches, SEED, epoch) for epoch in (0, 1)]
    return epochs[0].unionByName(epochs[1]).select("rec_id", "batch_id", "epoch", "place")
