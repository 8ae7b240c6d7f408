"""Match records over the order tables: the stand-in the queries run on.

A record is a block of ten consecutive line items of one supplier; slots 0-4
are team 0 and slots 5-9 team 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.ordering import Running, with_running
from fieldloom.schema import KNOWN, OUTCOME, WIN, Dictionary, Field
from fieldloom.session import settled, stored, tune

SLOTS = 10
TEAM = 5

# Fixed value: record ids are supplier * RECORD_STRIDE + block, wide enough for
# 1e11 line items of one supplier.
RECORD_STRIDE = 10_000_000_000
MIN_DURATION = 1500

# Enum levels of the stand-in, in dictionary order.
BRANDS = tuple(sorted(f"Brand#{i}" for i in range(1, 26)))
TYPES = ("PROMO", "STANDARD", "ECONOMY", "MEDIUM", "LARGE", "SMALL")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

SLOT_FIELDS = ("brand", "ptype", "psize", "quantity", "price", "discount", "returnflag", "linestatus")


def _slot_fields(i: int) -> list[Field]:
    base = f"participants.{i}."
    slot = {"occurrence": "per-participant"}
    # Frozen statistics of the stand-in dictionary.
    return [
        Field(base + "brand", "enum", "one-hot", KNOWN, levels=BRANDS + ("",), optional=True, default="", mode="Brand#2", **slot),
        Field(base + "ptype", "enum", "one-hot", KNOWN, levels=TYPES + ("",), optional=True, default="", mode="MEDIUM", **slot),
        Field(base + "psize", "int", "bool", OUTCOME, default=26, mean=25.619, sd=14.478, md=12.532, min=1, max=50, median=26, **slot),
        Field(base + "quantity", "int", "unary", OUTCOME, default=25, mean=25.402, sd=14.432, md=12.507, min=1, max=50, median=25, mode=18, **slot),
        Field(base + "price", "float", "continuous", OUTCOME, default=53054.271, mean=53054.271, sd=30082.661, md=26086.551, min=901.82, max=104997.88, median=53028.63, **slot),
        Field(base + "discount", "float", "continuous", OUTCOME, default=0.05, mean=0.05, sd=0.029, md=0.025, min=0.0, max=0.1, median=0.05, **slot),
        Field(base + "returnflag", "enum", "one-hot", OUTCOME, levels=("A", "N", "R"), default="R", mode="R", **slot),
        Field(base + "linestatus", "enum", "bool", OUTCOME, levels=("F", "O"), default="O", mode="O", **slot),
    ]


def _team_fields(t: int) -> list[Field]:
    base = f"teams.{t}."
    team = {"occurrence": "per-team"}
    bans = [
        Field(f"{base}bans.{m}.priority", "enum", "one-hot", KNOWN, levels=PRIORITIES + ("",), optional=True, default="", mode="3-MEDIUM", **team)
        for m in range(TEAM)
    ]
    price = Field(base + "price", "float", "continuous", OUTCOME, default=264728.47, mean=264728.47, sd=67253.161, md=54006.785, min=59798.07, max=475349.61, median=264923.94, **team)
    return [*bans, price]


def match_dictionary() -> Dictionary:
    fields = [f for i in range(SLOTS) for f in _slot_fields(i)]
    fields += [f for t in (0, 1) for f in _team_fields(t)]
    fields.append(
        Field("duration", "int", "continuous", OUTCOME, default=2043.684, mean=2043.684, sd=277.555, md=220.341, min=627, max=2497, median=2093)
    )
    fields += [
        Field(f"teams.{t}.win", "bool", "bool", WIN, occurrence="per-team", default=False, mean=0.495, sd=0.5, min=0, max=1, mode=False)
        for t in (0, 1)
    ]
    known = [f"teams.{t}.bans.{m}.priority" for t in (0, 1) for m in range(TEAM)]
    known += [f"participants.{i}.{f}" for f in ("brand", "ptype") for i in range(SLOTS)]
    return Dictionary(fields, known_order=known)


DICTIONARY = match_dictionary()
BAN_PATHS = tuple(f.path for f in DICTIONARY if ".bans." in f.path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_slots(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Long form: one row per filled slot.

    Lines go on from shuffle to shuffle through a written table, so that the disk holds one
    shuffle of them at a time.
    """
    lineitem = table(spark, sf_dir, "lineitem").drop("l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]

    def lines():
        return with_running(lineitem, ["l_suppkey"], order, {"rn": Running("number")}, partitions)

    # Both joins are on unique keys: they add no lines, and lines without a part or
    # an order stay.
    def parted():
        return settled(spark, "lines", lines).join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("l_partkey", "p_partkey")

    def ordered():
        whole = settled(spark, "lines", parted).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        return whole.drop("l_orderkey", "o_orderkey", "l_linenumber")

    numbered = settled(spark, "lines", ordered)
    return numbered.select(
        "l_suppkey",
        F.expr("(rn - 1) div 10").alias("block"),
        F.expr("cast((rn - 1) % 10 as int)").alias("slot"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("ptype"),
        F.col("p_size").alias("psize"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_shipdate").alias("shipdate"),
    )


def build_records(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Wide form.  At most ten slots per record are gathered."""
    slots = build_slots(spark, sf_dir, partitions)
    grouped = slots.groupBy("l_suppkey", "block").agg(
        F.array_sort(F.collect_list(F.struct("slot", *SLOT_FIELDS, "priority"))).alias("s"),
        F.datediff(F.max("shipdate"), F.min("shipdate")).alias("duration"),
    )

    def at(i: int, name: str):
        return F.get("s", F.lit(i))[name]

    def team_price(t: int):
        team = F.slice("s", t * TEAM + 1, TEAM)
        total = F.aggregate(team, F.lit(0.0), lambda acc, x: acc + x["price"])
        return F.when(F.size(team) > 0, F.round(total, 2))

    priced = grouped.select(
        (F.col("l_suppkey") * F.lit(RECORD_STRIDE) + F.col("block")).alias("rec_id"),
        F.size("s").cast("bigint").alias("n_slots"),
        "duration",
        "s",
        team_price(0).alias("teams_0_price"),
        team_price(1).alias("teams_1_price"),
    )
    wide = [
        at(i, name).alias(f"participants_{i}_{name}") for i in range(SLOTS) for name in SLOT_FIELDS
    ]
    bans = [
        at(t * TEAM + m, "priority").alias(f"teams_{t}_bans_{m}_priority")
        for t in (0, 1)
        for m in range(TEAM)
    ]
    return priced.select(
        "rec_id",
        "n_slots",
        *wide,
        *bans,
        "duration",
        "teams_0_price",
        "teams_1_price",
        (F.col("teams_0_price") > F.col("teams_1_price")).alias("teams_0_win"),
        (F.col("teams_1_price") > F.col("teams_0_price")).alias("teams_1_win"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide records, built once per application and kept as Parquet."""
    tune(spark)
    return stored(spark, ("records", sf_dir), lambda: build_records(spark, sf_dir))
