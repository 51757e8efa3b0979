"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_crf, mixing, partenum, sentencepiece_bpe, site_quality
from millrace.llm._common import table
from millrace.llm.queries import PIECES
from millrace.storage import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    weights, transitions = line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return line_crf.filter_documents(docs, weights, transitions)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's posterior reject go."""
    model = site_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return site_quality.filter_documents(docs, model, F.col("source"), F.col("lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return partenum.keep_one(docs, percent=80, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.expand(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of op1."""
    return sentencepiece_bpe.encode_documents(docs, PIECES, with_ids=True)


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("near duplicates", near_duplicates), ("mixing", mix_sources), ("tokens", tokenize)]

#: The stages that fit a model can't be written in SQL; tests hold each stage's rows against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
