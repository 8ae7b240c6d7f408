"""The corpus pipeline: stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents, with whatever other columns docs has.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.line_dedup import without_repeated_lines
from fieldloom.llm.mixing import mixed_documents
from fieldloom.llm.repetition import drop_repetitive
from fieldloom.llm.sentencepieces import encode_documents
from fieldloom.llm.simhash_anchors import one_of_each
from fieldloom.session import drop_folders, materialize, scratch

#: DuckDB has neither the stages' hashes nor their tokenizer; the tests hold the pipeline
#: against a plain Python version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; one without words fails them."""
    return drop_repetitive(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that came before; a text may become empty.

    ``n_chars``, where it is there, follows the text.
    """
    kept = without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text left: doc_id, n_tokens, ids_crc32, two checks, ids."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


_LEFT: dict[str, list] = {}


def alone(stage):
    """``stage``, which first deletes the tables that the stage before it needed.

    So a stage's result has to be written before the next stage is called.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_folders(spark, _LEFT.pop(spark.sparkContext.applicationId, []))
        with scratch() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = made
        return out

    return run_stage


STAGES = [
    ("quality rules", alone(quality)),
    ("line dedup", alone(lines)),
    ("SimHash near-dedup", alone(near_duplicates)),
    ("mixing sources to target weights", alone(mixing)),
    ("SentencePiece encoding and decoding", alone(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
