"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and a join that adaptive execution may split, so that a
hub with a third of all nodes as neighbours is no single task's work. Each round's edges are written to the shared
folder; nothing but two numbers a round reaches the driver. Nodes are 64-bit integers; an edge of a node with itself
and repeated edges change nothing; an empty edge table has no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the edges (u, v): each node that has a smaller node in its component, with the smallest one."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
        if np.array_equal(label, before):
            break
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, batch.column(1).to_numpy(zero_copy_only=False)])
        u, v = spanning_forest(u, v)
    for i in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edge table (u, v); a component bears its smallest node's number."""
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v and u is not null and v is not null")
    now = Cut(edges.mapInArrow(_forests, "u long, v long").distinct(), "edges")
    mark = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = Cut(large, "large")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = Cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (now, large):
            old.drop()
        now = then
        new_mark = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new_mark == mark:
            break
        mark = new_mark
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
