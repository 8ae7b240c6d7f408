"""Score known records as they arrive: stateless, so no watermark is needed.

The functions take a batch or a streaming DataFrame and build the same plan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.records import decode_records, encode_records, mask_ignored
from fieldloom.operators.scoring import head_kinds, score_chain, win_probability
from fieldloom.schema import KNOWN, WIN, Dictionary
from fieldloom.sources.models import load_network, newest_version


def score_known(
    known: DataFrame,
    dictionary: Dictionary,
    generator,
    win_network,
    chain_input: str = "probability",
    keep=("rec_id",),
    ignored=(),
) -> DataFrame:
    """Win probability per known row."""
    encoded = encode_records(known, dictionary.subset(KNOWN), ("known",), keep)
    kinds = head_kinds(dictionary, ignored)
    scored = score_chain(encoded, generator, win_network, kinds, chain_input, drop=("known",))
    return scored.select(*keep, win_probability(F.col("win_logit")).alias("win_probability"))


def predict_known(
    known: DataFrame,
    dictionary: Dictionary,
    generator,
    win_network,
    chain_input: str = "probability",
    keep=("rec_id",),
    ignored=(),
) -> DataFrame:
    """Win probability and the decoded full record per known row, in one pass.

    Ignored fields are null.
    """
    encoded = encode_records(known, dictionary.subset(KNOWN), ("known",), keep)
    kinds = head_kinds(dictionary, ignored)
    scored = score_chain(
        encoded, generator, win_network, kinds, chain_input, outputs=("unknown_logit", "win_logit")
    )
    if ignored:
        scored = scored.withColumn("unknown_logit", mask_ignored("unknown_logit", dictionary, ignored))
    # One win logit is estimated; it fills every column of the win portion.
    first = F.get("win_logit", F.lit(0))
    scored = scored.withColumns(
        {"win_probability": win_probability(F.col("win_logit")), "win": F.array_repeat(first, dictionary.width(WIN))}
    )
    sources = {"known": "known", "unknown": "unknown_logit", "win": "win"}
    return decode_records(scored, dictionary, sources, (*keep, "win_probability"))


def write_scores(scores: DataFrame, path: str, checkpoint: str, **trigger):
    """Append scores as Parquet files, each input file once.

    Without a ``trigger`` the stream takes everything available and ends.
    """
    query = (
        scores.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
    if not trigger:
        query.awaitTermination()
    return query


#: One row per batch that is written, with the versions of the networks that scored it.
BATCHES = "batch bigint, generator bigint, win bigint"


def write_newest_scores(known: DataFrame, dictionary: Dictionary, generator: str, win: str, path: str, checkpoint: str, keep=("rec_id",), trigger=None, **options):
    """Score a stream of known records, each micro-batch by the newest networks stored at that time.

    ``generator`` and ``win`` are folders of ``save_network``. A batch's scores go to a folder of its
    own; a row in the table of batches, written after it, makes them count. So a batch that Spark gives
    a second time is not scored again, nor by other networks, and one that broke off is written anew.
    """
    held: dict[str, tuple] = {}

    def newest(spark: SparkSession, folder: str):
        version = newest_version(spark, folder)
        if held.get(folder, (None,))[0] != version:
            held[folder] = version, load_network(spark, folder, version=version)
        return held[folder]

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = written_batches(spark, path)
        if done is not None and not done.where(F.col("batch") == batch).isEmpty():
            return
        (first, generator_net), (second, win_net) = newest(spark, generator), newest(spark, win)
        scores = score_known(rows, dictionary, generator_net, win_net, keep=keep, **options)
        scores.write.mode("overwrite").parquet(f"{path}/scores/batch={batch}")
        spark.createDataFrame([(batch, first, second)], BATCHES).coalesce(1).write.mode("append").parquet(f"{path}/batches")

    query = known.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        query.awaitTermination()
    return query


def written_batches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(BATCHES).parquet(f"{path}/batches")
    except AnalysisException:
        return None


def read_newest_scores(spark: SparkSession, path: str, schema: str = "rec_id bigint, win_probability double") -> DataFrame:
    """The scores of all batches that count, with their batch and the versions of the networks."""
    batches = written_batches(spark, path)
    if batches is None:
        return spark.createDataFrame([], f"{schema}, {BATCHES}")
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/scores")
    return rows.join(batches.distinct(), "batch")
