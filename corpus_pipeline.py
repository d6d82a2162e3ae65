"""The corpus pipeline: documents through quality, near duplicates, secrets, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's input.
All stages but the last return the columns of ``documents``. What names a row between an operator and its stage is a hash
of all its columns, so ids may be null or repeat; two different rows of n share a hash with probability below n²/2⁶⁵.
Copies of a row that the mix repeats are rows of their own.

Defined results: null texts count as empty ones in every stage; an empty table passes through; columns beyond those of
``documents`` are dropped by each stage; of near duplicates the row with the smallest doc_id stays, null ones last; rows
that are alike in all columns are near duplicates, those without words too, which otherwise have none; the mix takes
rows that are alike as often as it takes them all together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm import bpe, jaccard_join, mixing, quality, secrets
from payloom.llm.common import Cut, give_back, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neighbour votes score at 0.3 or more; labels are learned from all documents that have one."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    give_back(spark)
    return quality.score(docs, model, [F.col(c) for c in COLUMNS]).where("score >= 0.3").select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, a hash of all columns (a null is told from a missing value by its place)."""
    return docs.select(*COLUMNS).withColumn("__key", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more on five-word shingles connect: the one with the smallest id."""
    docs = _named(docs)
    found = jaccard_join.similar_components(docs.select(F.col("__key").alias("doc_id"), "text"))
    of = found.select(F.col("doc_id").alias("__key"), "component_id").distinct().join(docs.select("__key", "doc_id").distinct(), "__key")
    kept = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"].alias("__key"))
    return docs.dropDuplicates(["__key"]).join(kept.select("__key"), "__key", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets in their texts masked, and n_chars as it is then."""
    forest = secrets.fit(secrets.labelled_findings(spark))
    give_back(spark)
    masked = secrets.mask(docs.select(*COLUMNS), forest)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


#: Copies that one task makes of a row.
COPIES = 4096


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    docs = _named(docs)
    taken = mixing.mix(docs, id_col="__key").where("copies > 0").groupBy("__key").agg(F.sum("copies").alias("__copies"))
    taken = Cut(taken, "taken").df
    rows = docs.dropDuplicates(["__key"])
    repeated = lambda x: x.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*COLUMNS)
    out = repeated(rows.join(taken.where(F.col("__copies") <= COPIES), "__key"))
    many = taken.where(F.col("__copies") > COPIES)
    if many.isEmpty():
        return out
    parts = many.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(COPIES).cast("long"))))
    parts = parts.withColumn("__copies", F.least(F.col("__copies") - F.col("__from"), F.lit(COPIES)))
    return out.unionByName(repeated(rows.join(parts, "__key").repartition("__key", "__from")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of the bytes that they decode to."""
    give_back(spark)
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(docs.select("doc_id", "source", "text"), vocabulary)


STAGES = [
    ("quality", quality_filter),
    ("near duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: Training, random rounding and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Cut(stage(spark, docs, sf_dir), name.replace(" ", "_")).df
    return STAGES[-1][1](spark, docs, sf_dir)
