"""Scoring queries: one net, heads, the chained nets, batch files and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom import jobs
from fieldloom.functions.network import ACTIVATIONS, forward
from fieldloom.operators.scoring import map_matrices, output_heads, score_chain, score_dense, win_probability
from fieldloom.plans.catalog_records import decoded_wide_sql, plain_types
from fieldloom.plans.matches import DICTIONARY, records
from fieldloom.plans.models import GENERATOR, KINDS, WIN_NETWORK, checksum, encoded, scored
from fieldloom.plans.oracle import bias, sql, weight
from fieldloom.plans.registry import query
from fieldloom.schema import ALL, KNOWN, WIN
from fieldloom.session import new_folder
from fieldloom.sources import tables
from fieldloom.sources.models import save_network
from fieldloom.streaming.scoring import read_newest_scores, score_known, write_newest_scores, write_scores

LOGIT_SUMS = "round(sum(z), 4) as logit_sum, round(sum(z * (j % 97)), 4) as logit_dot"


@query("score_dense", sql(f"select rec_id, {LOGIT_SUMS} from logits group by rec_id", "logits"))
def score_dense_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_dense(encoded(spark, sf_dir, ("known",)), GENERATOR, drop=("known",))
    return rows.select("rec_id", *checksum("logit", "logit"))


_ACTIVATED = {
    "leaky-relu": "case when v > 0 then v else v * 0.2::double end",
    "relu": "greatest(v, 0)",
    "sigmoid": "1 / (1 + exp(-v))",
    "tanh": "tanh(v)",
}


@query(
    "score_activation",
    sql(
        f"""select rec_id, activation, round(sum(z), 4) as logit_sum, round(sum(z * (j % 97)), 4) as logit_dot
        from (select rec_id, activation, j, b + list_dot_product(h, w) as z from acts cross join outw) q
        group by rec_id, activation""",
        "nz", "outw",
        extra={
            "pre": f"""select rec_id, k, {bias('k', 10.0)} + sum({weight('pos', 'k', 10.0)}) as v
                from nz cross join range(8) t(k) group by rec_id, k""",
            "acts": " union all ".join(
                f"select rec_id, '{name}' as activation, list({text} order by k) as h from pre group by rec_id"
                for name, text in _ACTIVATED.items()
            ),
        },
    ),
)
def score_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All activations in one pass: the first layer comes before any of them."""
    (w, b), *rest = GENERATOR

    def run(x):
        first = x @ w + b
        return [forward(ACTIVATIONS[name][0](first), rest, name) for name in _ACTIVATED]

    outputs = [f"logit_{i}" for i in range(len(_ACTIVATED))]
    rows = map_matrices(encoded(spark, sf_dir, ("known",)), ["known"], outputs, run, drop=("known",))
    cells = [F.struct(F.lit(name).alias("activation"), F.col(c).alias("logit")) for name, c in zip(_ACTIVATED, outputs)]
    return rows.select("rec_id", F.inline(F.array(*cells))).select("rec_id", "activation", *checksum("logit", "logit"))


@query(
    "output_heads",
    sql("select rec_id, round(sum(p), 4) as p_sum, round(sum(p * (j % 97)), 4) as p_dot from probs group by rec_id", "probs"),
)
def output_heads_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, ("z",)).select("rec_id", output_heads(F.col("z"), KINDS).alias("p"))
    return rows.select("rec_id", *checksum("p", "p"))


def known_files(spark: SparkSession, sf_dir: str) -> str:
    """The known fields of all records as headerless positional CSV."""
    path = new_folder(spark, "known-csv")
    tables.write_known(records(spark, sf_dir), path, DICTIONARY, id_field="rec_id")
    return path


_KNOWN_WIDE = ", ".join(
    f"max({'brand' if f.path.endswith('brand') else 'ptype'}) filter (slot = {f.path.split('.')[1]}) as {f.column}"
    if f.path.startswith("participants")
    else f"max(priority) filter (slot = {int(f.path.split('.')[1]) * 5 + int(f.path.split('.')[3])}) as {f.column}"
    for f in DICTIONARY.select(KNOWN)
)


@query(
    "generate_outcomes",
    sql(
        f"""select * from (select rec_id, {_KNOWN_WIDE} from grid group by rec_id) k
        join ({decoded_wide_sql()}) d using (rec_id)""",
        "grid", "decoded",
    ),
)
def generate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known CSV in, generated records as CSV out, read back typed."""
    out, mask = new_folder(spark, "generated-csv"), ALL - WIN
    jobs.generate(spark, known_files(spark, sf_dir), DICTIONARY, GENERATOR, out, id_field="rec_id")
    schema = ", ".join(
        ["rec_id bigint"] + [f"{f.column} {tables.value_type(f).simpleString()}" for f in DICTIONARY.select(mask)]
    )
    back = plain_types(spark.read.schema(schema).csv(out))
    integral = [f.column for f in DICTIONARY.select(mask) if f.kind == "int"]
    return back.withColumns({c: F.col(c).cast("bigint") for c in integral}).na.fill("")


def win_scores(spark: SparkSession, sf_dir: str, chain_input: str) -> DataFrame:
    rows = encoded(spark, sf_dir, ("known",))
    rows = score_chain(rows, GENERATOR, WIN_NETWORK, KINDS, chain_input, drop=("known",))
    return rows.select(
        "rec_id",
        F.round(F.get("win_logit", F.lit(0)), 6).alias("win_logit"),
        F.round(win_probability(F.col("win_logit")), 6).alias("win_probability"),
    )


_WIN_SQL = "select rec_id, round(z, 6) as win_logit, round(1 / (1 + exp(-z)), 6) as win_probability from {}"


@query("score_win", sql(_WIN_SQL.format("win_logits"), "win_logits"))
def score_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_scores(spark, sf_dir, "probability")


@query("score_win_logit", sql(_WIN_SQL.format("win_logits_raw"), "win_logits_raw"))
def score_win_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_scores(spark, sf_dir, "logit")


@query(
    "score_records",
    sql(
        f"""select k.*, d.* exclude (rec_id), z > 0 as teams_0_win, z > 0 as teams_1_win
        from (select rec_id, {_KNOWN_WIDE} from grid group by rec_id) k
        join ({decoded_wide_sql()}) d using (rec_id) join win_logits using (rec_id)""",
        "grid", "decoded", "win_logits",
    ),
)
def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full decoded records that go with the win probabilities."""
    _, full = jobs.predict(spark, known_files(spark, sf_dir), DICTIONARY, GENERATOR, WIN_NETWORK, "rec_id")
    return plain_types(full)


@query(
    "stream_score",
    sql("select rec_id, round(1 / (1 + exp(-z)), 6) as win_probability from win_logits", "win_logits"),
)
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores, from files picked up by a stream."""
    arriving = tables.stream_known(spark, known_files(spark, sf_dir), DICTIONARY, id_field="rec_id")
    scores = score_known(arriving, DICTIONARY, GENERATOR, WIN_NETWORK)
    out = new_folder(spark, "stream-scores")
    write_scores(scores, out, new_folder(spark, "stream-checkpoint"))
    rows = spark.read.schema("rec_id bigint, win_probability double").parquet(out)
    return rows.select("rec_id", F.round("win_probability", 6).alias("win_probability"))


SHIFT = 0.5


@query(
    "stream_newest",
    sql(
        f"""select rec_id, rec_id % 2 as piece, round(1 / (1 + exp(-(z + {SHIFT} * (rec_id % 2)))), 6) as win_probability from win_logits""",
        "win_logits",
    ),
)
def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a stream that gets the records in two pieces, with a new win network in between."""
    source, out, checkpoint, generator, win = (new_folder(spark, f"newest-{part}") for part in ("in", "out", "checkpoint", "generator", "win"))
    save_network(spark, GENERATOR, generator)
    *inner, (w, b) = WIN_NETWORK
    columns = [DICTIONARY[p].column for p in DICTIONARY.known_order]
    for piece in (0, 1):
        save_network(spark, [*inner, (w, b + SHIFT * piece)], win)
        rows = records(spark, sf_dir).where(F.col("rec_id") % 2 == piece)
        rows.select("rec_id", *columns).write.mode("append").csv(source, nullValue="", emptyValue="")
        arriving = tables.stream_known(spark, source, DICTIONARY, id_field="rec_id")
        write_newest_scores(arriving, DICTIONARY, generator, win, out, checkpoint)
    scores = read_newest_scores(spark, out)
    piece = F.dense_rank().over(Window.orderBy("win")) - 1
    versions = scores.select("win").distinct().withColumn("piece", piece.cast("bigint"))
    return scores.join(versions, "win").select("rec_id", "piece", F.round("win_probability", 6).alias("win_probability"))
