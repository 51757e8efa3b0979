"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import block_knn, line_crf, lm_scoring, mixing, partenum, preference, sentencepiece_bpe, site_quality, url_filter, wordpiece_count
from millrace.llm._common import table

#: The tokenizer file of op1 and op6; a parameter of the operators.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), PIECES)


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.with_negative_replies(table(spark, sf_dir, "conversations")))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = site_quality.train(docs, table(spark, sf_dir, "labels"))
    return site_quality.classify(docs, model, F.col("source"), F.col("lang"))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(table(spark, sf_dir, "benchmark"), docs))


def op5_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_wordpiece_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, continuing = wordpiece_count.pieces_of((p, kind) for p, _, kind in sentencepiece_bpe.read_vocabulary(PIECES))
    return wordpiece_count.count_word_pieces(table(spark, sf_dir, "documents"), initial, continuing)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_epochs=3, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"), percent=80, k=5)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, transitions = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge_lines(docs, weights, transitions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_preference_format, op3_site_quality, op4_cross_entropy, op5_block_knn, op6_wordpiece_count, op7_source_mix, op8_partenum, op9_url_filter, op10_line_crf)}


def oracle_sql() -> dict[str, str]:
    return {"op2_preference_format": preference.ORACLE, "op5_block_knn": block_knn.ORACLE, "op7_source_mix": mixing.ORACLE, "op8_partenum": partenum.ORACLE, "op9_url_filter": url_filter.ORACLE}
