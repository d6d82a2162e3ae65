"""Quality of extractions against labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payloom.functions.scalar import compact


def normal(x: Column) -> Column:
    """F-17."""
    return F.coalesce(compact(F.lower(x.cast("string"))), F.lit(""))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1")]


def field_scores(pairs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """E-1: precision, recall and F1 by field; a wrong value is a false positive and a false negative. pairs: expected and
    predicted, structs of the fields."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), normal(F.col(f"expected.{f}")).alias("t"), normal(F.col(f"predicted.{f}")).alias("g")) for f in fields])
    x = pairs.select(F.inline(each))
    hit = (F.col("t") != "") & (F.col("t") == F.col("g"))
    y = x.groupBy("field").agg(F.count_if(hit).alias("tp"), F.count_if((F.col("g") != "") & ~hit).alias("fp"), F.count_if((F.col("t") != "") & (F.col("t") != F.col("g"))).alias("fn"))
    return y.select("field", "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def exact_match(pairs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """E-2: the share of documents all of whose fields agree (two empty ones do)."""
    same = F.lit(True)
    for f in fields:
        same = same & (normal(F.col(f"expected.{f}")) == normal(F.col(f"predicted.{f}")))
    return pairs.agg(F.count("*").alias("documents"), F.round(F.count_if(same) / F.count("*"), 6).alias("exact_match"))


def row_scores(pairs: DataFrame, cells: tuple[str, ...]) -> DataFrame:
    """E-3: rows are paired by position: whatever they hold, the shorter list's length is right. Cells of pairs count."""
    t, g = F.size("expected_rows"), F.size("predicted_rows")
    n = F.least(t, g)
    zipped = F.arrays_zip(F.slice("expected_rows", 1, n).alias("t"), F.slice("predicted_rows", 1, n).alias("g"))
    right = F.aggregate(zipped, F.lit(0), lambda s, z: s + sum((normal(z["t"][c]) == normal(z["g"][c])).cast("int") for c in cells))
    x = pairs.agg(F.sum(n).alias("tp"), F.sum(F.greatest(F.lit(0), g - t)).alias("fp"), F.sum(F.greatest(F.lit(0), t - g)).alias("fn"), F.sum(right).alias("right"), F.sum(n * len(cells)).alias("cells"))
    return x.select("tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")), F.round(F.coalesce(F.try_divide("right", "cells"), F.lit(0.0)), 6).alias("cell_accuracy"))


#: Ranges of values that are counted to find percentiles.
RANGES = 4096


def latencies(x: DataFrame, ms: str) -> DataFrame:
    """E-4: the median and the 95th percentile, which is the element at floor(0.95 n) - 1 of the sorted list. Values are
    counted, first by ranges (RANGES numbers reach the driver), and only values of the ranges that hold the elements asked
    for are put in order."""
    from pyspark.sql import Window

    counts = x.where(F.col(ms).isNotNull()).groupBy(F.col(ms).alias("v")).agg(F.count("*").alias("c"))
    low, high, n = counts.agg(F.min("v"), F.max("v"), F.sum("c")).first()
    if not n:
        return counts.agg(F.sum("c").alias("n"), F.max("v").alias("p50"), F.max("v").alias("p95"))
    place = F.least(F.lit(RANGES - 1), F.floor((F.col("v") - low) / (float(high - low) / RANGES or 1.0))).cast("int")
    held = sorted(counts.groupBy(place.alias("place")).agg(F.sum("c")).collect())
    found = {}
    for k in ((n - 1) // 2, n // 2, max(0, int(0.95 * n) - 1)):
        before = 0
        for range_, c in held:
            if before + c > k:
                break
            before += c
        found[k] = (range_, k - before)
    near = counts.withColumn("place", place).where(F.col("place").isin([r for r, _ in found.values()]))
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy("place").orderBy("v")))
    at = lambda k: F.min(F.when((F.col("place") == found[k][0]) & (F.col("upto") > found[k][1]), F.col("v")))
    return near.agg(F.lit(n).alias("n"), F.round((at((n - 1) // 2) + at(n // 2)) / 2, 4).alias("p50"), at(max(0, int(0.95 * n) - 1)).alias("p95"))


def sources(x: DataFrame) -> DataFrame:
    """E-5: documents by source and each one's share."""
    total = x.agg(F.count("*").alias("n"))
    return x.groupBy("source").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(total)).select("source", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))


#: Code points from which on words are spelled: two planes beyond all text, 131 068 characters, are private.
_PRIVATE, _WORDS = 0xF0000, 60_000


def word_distance(a: Column, b: Column) -> Column:
    """F-16 over words: each distinct word of both texts is one character of a private alphabet, then characters are
    compared. Pairs of more distinct words than it holds go word by word through an Arrow function instead."""
    @F.pandas_udf("int")
    def by_word(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None:
                return None
            s, t = np.unique(np.array([*s.split(" "), *t.split(" ")]), return_inverse=True)[1], len(s.split(" "))
            s, t = s[:t], s[t:]
            row, steps = np.arange(len(t) + 1), np.arange(len(t) + 1)
            for i, w in enumerate(s):
                least = np.minimum(row[1:] + 1, row[:-1] + (t != w))
                row = np.minimum.accumulate(np.concatenate([[i + 1], least]) - steps) + steps
            return int(row[-1])

        return pd.Series([one(s, t) for s, t in zip(x, y)], dtype="Int32")

    words = F.array_distinct(F.concat(F.split(a, " "), F.split(b, " ")))
    coded = lambda t: F.array_join(F.transform(F.split(t, " "), lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + _PRIVATE), 8, "0")), "UTF-32")), "")
    many = F.size(words) >= _WORDS
    return F.coalesce(F.when(~many, F.levenshtein(coded(a), coded(b))), by_word(F.when(many, a), F.when(many, b)))


def text_rates(x: DataFrame) -> DataFrame:
    """E-6: character and word error rates, errors of all texts over their lengths. x: expected, predicted."""
    t, g = normal(F.col("expected")), normal(F.col("predicted"))
    y = x.select(F.levenshtein(t, g).alias("ce"), F.length(t).alias("cn"), word_distance(t, g).alias("we"), F.size(F.split(t, " ")).alias("wn"))
    return y.agg(F.sum("ce").alias("char_errors"), F.sum("cn").alias("chars"), F.sum("we").alias("word_errors"), F.sum("wn").alias("words"), F.round(F.sum("ce") / F.sum("cn"), 6).alias("cer"), F.round(F.sum("we") / F.sum("wn"), 6).alias("wer"))


def report(metrics: dict[str, float]) -> str:
    """E-7: metrics as a Markdown table."""
    return "\n".join(["| metric | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in metrics.items())])
