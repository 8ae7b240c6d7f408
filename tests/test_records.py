import pytest
from pyspark.sql import functions as F

from fieldloom.functions.decode import field_value
from fieldloom.operators import records as rec
from fieldloom.plans.matches import DICTIONARY
from fieldloom.schema import ALL, KNOWN, OUTCOME, WIN, Dictionary, Field

SMALL = Dictionary(
    [
        Field("tier", "enum", "one-hot", KNOWN, levels=("it's", "b", "c"), default="b", mode="c"),
        Field("flag", "bool", "one-hot", KNOWN, default=False),
        Field("debt", "int", "continuous", OUTCOME, default=-3, mean=-5.0, sd=2.0, min=-200, max=100),
        Field("level", "int", "unary", OUTCOME, default=2, min=2, max=5),
        Field("still", "float", "continuous", OUTCOME, default=1.5, mean=1.5, sd=0.0, min=0.0, max=9.0),
        Field("side", "enum", "bool", OUTCOME, levels=("L", "R"), default="L", mode="R"),
        Field("win", "bool", "bool", WIN, default=False, mean=0.5, sd=0.5, min=0, max=1),
    ]
)
SCHEMA = "id int, tier string, flag boolean, debt int, level int, still float, side string, win boolean"


def encoded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r for r in rec.encode_records(df, SMALL, keep=("id",)).collect()}


def test_encoding_of_edge_values(spark):
    got = encoded(
        spark,
        [
            (1, "it's", True, -7, 5, 1.5, "R", True),
            (2, None, None, None, None, None, None, None),
            (3, "zzz", False, 100, 9, 1.5, "", False),
            (4, "", False, -200, 1, 1.5, "L", False),
        ],
    )
    assert got[1]["known"] == [1, 0, 0, 1, 0]
    assert got[1]["unknown"] == [-1.0, 1, 1, 1, 0, 1]
    assert got[1]["win"] == [1]
    assert got[2]["known"] == [0, 1, 0, 0, 1]
    assert got[2]["unknown"] == [1.0, 0, 0, 0, 0, 0]
    assert got[3]["known"][:3] == [0, 1, 0] and got[3]["unknown"][1:4] == [1, 1, 1]
    assert got[4]["unknown"][0] == -97.5 and got[4]["unknown"][1:4] == [0, 0, 0]


def test_decode_takes_the_first_of_equal_columns_and_keeps_ignored_null(spark):
    spans = SMALL.portion_spans(ALL, rebase=True)
    by_path = {s.field.path: s for s in spans}
    x = "array(0.5D, 0.5D, 0.1D, 0.2D, 0.9D, cast(null as double), 2D, 1D, -1D, 0D, 3D, -0.5D)"
    df = spark.range(1).select(F.expr(x).alias("x"))
    row = df.select(*[F.expr(field_value("x", s)).alias(p.replace(".", "_")) for p, s in by_path.items()]).first()
    assert row["tier"] == "it's" and row["flag"] is False
    assert row["debt"] is None and row["level"] == 4
    assert row["side"] == "R" and row["win"] is False


def test_decode_base(spark):
    fields = [
        Field(f"participants.{i}.x", "int", "unary", OUTCOME, occurrence="per-participant", default=0, min=i, max=4)
        for i in (0, 2)
    ]
    d = Dictionary(fields)
    df = spark.createDataFrame([(0, 3, 4)], "id int, participants_0_x int, participants_2_x int")
    enc = rec.encode_records(df, d, ("unknown",), keep=("id",))
    for base, want in (("family", (3, 4)), ("field", (3, 6))):
        out = rec.decode_records(enc, d, {"unknown": "unknown"}, keep=("id",), decode_base=base).first()
        assert (out["participants_0_x"], out["participants_2_x"]) == want


def test_caps_and_floor(spark):
    d = Dictionary([Field("n", "int", "continuous", OUTCOME, default=0, mean=100.0, sd=50.0, min=0, max=200)])
    df = spark.createDataFrame([(1, [100.0]), (2, [-9.0]), (3, [None])], "id int, z array<double>")
    out = {r["id"]: r["n"] for r in rec.decode_records(df, d, {"unknown": "z"}, keep=("id",)).collect()}
    assert out == {1: 255, 2: 0, 3: None}
    signed = Dictionary([Field("n", "int", "continuous", OUTCOME, default=0, mean=0.0, sd=50.0, min=-100, max=100)])
    out = {r["id"]: r["n"] for r in rec.decode_records(df, signed, {"unknown": "z"}, keep=("id",)).collect()}
    assert out == {1: 127, 2: -127, 3: None}


def test_round_trip(spark, records):
    filled = rec.fill_defaults(records, DICTIONARY)
    enc = rec.encode_records(records, DICTIONARY)
    back = rec.decode_records(enc, DICTIONARY, {p: p for p in ("known", "unknown", "win")})
    both = filled.alias("a").join(back.alias("b"), "rec_id")
    exact = [f for f in DICTIONARY if f.handling in ("one-hot", "unary") or f.kind in ("enum", "bool")]
    wrong = [F.sum((~F.col(f"a.{f.column}").eqNullSafe(F.col(f"b.{f.column}"))).cast("int")) for f in exact]
    assert set(both.select(*[w.alias(str(i)) for i, w in enumerate(wrong)]).first()) == {0}
    close = [f for f in DICTIONARY if f.handling == "continuous" and f.kind == "float"]
    gaps = [F.max(F.abs(F.col(f"a.{f.column}") - F.col(f"b.{f.column}")) / f.sd) for f in close]
    assert max(both.select(*gaps).first()) < 1e-4


def test_properties_of_encoded_rows(spark, records):
    enc = rec.encode_records(records, DICTIONARY)
    for s in DICTIONARY.portion_spans(KNOWN)[:4]:
        part = F.slice("known", s.start + 1, s.width)
        assert enc.where(F.aggregate(part, F.lit(0.0), lambda a, v: a + v) != 1).count() == 0
    s = next(s for s in DICTIONARY.portion_spans(OUTCOME) if s.field.handling == "unary")
    part = F.slice("unknown", s.start + 1, s.width)
    assert enc.where(F.to_json(F.array_sort(part)) != F.to_json(F.reverse(part))).count() == 0


def test_the_two_filters_agree(spark, records):
    raw = rec.drop_short(records, "duration", 1500).select("rec_id")
    enc = rec.drop_short_encoded(rec.encode_records(records, DICTIONARY), DICTIONARY, above=1500).select("rec_id")
    assert raw.exceptAll(enc).count() == enc.exceptAll(raw).count() == 0


def test_short_filter_reaches_the_scan(spark, records):
    plan = rec.drop_short(records, "duration", 1500).select("rec_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(duration,1500)" in plan
    assert "participants_0_brand" not in plan


def test_mask_and_assign(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "id int, z array<double>")
    masked = df.select(rec.mask_ignored("z", SMALL, {"level", "side"}, fill=0).alias("m")).first()["m"]
    assert masked == [1.0, 0.0, 0.0, 0.0, 5.0, 0.0]
    full = df.select(rec.assign_portions(SMALL, {"unknown": F.col("z")}).alias("x")).first()["x"]
    assert full == [None] * 5 + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] + [None]


def test_unknown_portion_of_a_layout():
    with pytest.raises(LookupError):
        SMALL.subset(KNOWN).portion_slice(WIN)
