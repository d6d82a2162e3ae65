"""The queries of this subpackage: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quantisation, bpe, html_text, jaccard_join, language, licences, mixing, near_vectors, quality, secrets
from .common import crc_mod, read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_components(read(spark, sf_dir, "embeddings"), least=0.98)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = quality.train(docs.select("doc_id", "text"), labels.where(~held_out))
    scored = quality.score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    network = language.train(docs.where(~held_out))
    return language.predict(docs, network, [F.col("doc_id"), held_out.alias("held_out")])


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.fit(secrets.labelled_findings(spark))
    return secrets.scan(read(spark, sf_dir, "documents"), forest)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantisation.neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(read(spark, sf_dir, "documents"), k=4, percent=85)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_near_vectors, op3_quality, op4_language, op5_html_text, op6_secrets, op7_neighbours, op8_mixing, op9_licences, op10_jaccard)}


def oracle_sql() -> dict[str, str]:
    return {"op9_licences": licences.oracle()}
