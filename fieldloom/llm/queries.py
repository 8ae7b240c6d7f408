"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import impact_search, line_dedup, mixing
from fieldloom.session import new_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_directly_addressable_codes")
def op1(spark, sf_dir):
    from fieldloom.llm.dac import read_documents, write_tokens

    path = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_documents(spark, path)


@query("op2_counterfactual_toxicity")
def op2(spark, sf_dir):
    from fieldloom.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_composite_text_density")
def op3(spark, sf_dir):
    from fieldloom.llm.html_density import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query("op4_source_mixing", mixing.ORACLE)
def op4(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_warc_derivatives")
def op5(spark, sf_dir):
    from fieldloom.llm.warc import derivative_report

    return derivative_report(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


@query("op6_repetition_coverage")
def op6(spark, sf_dir):
    from fieldloom.llm.repetition import repetition_report

    return repetition_report(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece_codec")
def op7(spark, sf_dir):
    from fieldloom.llm.sentencepieces import encode_documents

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(table(spark, sf_dir, "documents"), path, keep_ids=False)


@query("op8_impact_ordered_top_k", impact_search.ORACLE)
def op8(spark, sf_dir):
    vectors = impact_search.clean_vectors(table(spark, sf_dir, "embeddings"))
    return impact_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op9_line_segment_join", line_dedup.ORACLE)
def op9(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op10_simhash_anchors")
def op10(spark, sf_dir):
    from fieldloom.llm.simhash_anchors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_inverted_multi_index")
def op12(spark, sf_dir):
    from fieldloom.llm.multi_index import clean_vectors, nearest

    vectors = clean_vectors(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query("op13_variable_gram_index")
def op13(spark, sf_dir):
    from fieldloom.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op11_four_russians_repair")
def op11(spark, sf_dir):
    from fieldloom.llm.turn_repair import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")))
