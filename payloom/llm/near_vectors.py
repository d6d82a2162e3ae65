"""Near-duplicate embeddings: an exact cosine join within labels, tile against tile.

Vectors are normalised in double precision and rotated onto the principal axes of all vectors. Leading coordinates are
compared first: unit vectors of cosine c lie 2 - 2c apart in squared distance, so that those of a linked pair differ by
at most w = sqrt(2 - 2c) in any coordinate. Cells of width w on the two leading axes therefore need to meet only their
neighbours. Within a pair of tiles, products are accumulated over blocks of coordinates; what is still to come is at
most the product of the suffix norms (Cauchy-Schwarz), and pairs that cannot reach the threshold any more are left out
of later blocks. Pairs that remain are decided by the cosine of the original vectors in double precision.

Copies are one vector with a count. A pair of tiles gives link counts and a spanning forest of its links, never the
links themselves, so a hot group's output is in proportion to its size; a hot cell is cut into tiles that are dealt to
many tasks.

Defined results: null, empty or zero vectors, those with null or non-finite components and those with a null label link
with nothing and are components of their own; vectors of different lengths don't link; a null vec_id has a null
component and counts as a linked vector; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut
from .components import components, spanning_forest

#: Vectors of a tile, and coordinates that are added at once.
TILE = 1024
BLOCK = 16
#: What rounding in the rotated products may hide.
SLACK = 1e-9


def usable(vector: str):
    """Whether a vector can be compared: not null, not empty, not zero, all components finite numbers."""
    x = F.col(vector)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of outer products of this task's unit vectors, by length, a row for each of its entries' rows."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        for n in np.unique(lengths):
            x = _unit(_matrix(batch.column(0).filter(pa.array(lengths == n))))
            total[n] = total.get(n, 0) + x.T @ x
    for n, m in total.items():
        i = np.repeat(np.arange(n), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, n, np.int32)), pa.array(i.astype(np.int32)), pa.array(np.tile(np.arange(n), n).astype(np.int32)), pa.array(m.ravel())], ["n", "i", "j", "x"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length n of the vectors, an n x n rotation whose leading columns hold the most energy. What reaches the
    driver is n * n sums for each length that occurs."""
    out: dict[int, np.ndarray] = {}
    for n, i, j, x in vectors.mapInArrow(_moments, "n int, i int, j int, x double").groupBy("n", "i", "j").agg(F.sum("x")).collect():
        out.setdefault(n, np.zeros((n, n)))[i, j] = x
    return {n: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for n, m in out.items()}


def _cells(batches: Iterator[pa.RecordBatch], axes, width: float) -> Iterator[pa.RecordBatch]:
    """Adds the cell of each vector on its two leading axes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("vector"))
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        cell = np.zeros((len(lengths), 2), np.int64)
        for n in np.unique(lengths):
            at = lengths == n
            z = _unit(_matrix(column.filter(pa.array(at)))) @ axes.value[n][:, :2]
            cell[at, : z.shape[1]] = np.floor(z / width).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(cell[:, 0].copy()), pa.array(cell[:, 1].copy())], [*batch.schema.names, "n", "c1", "c2"])


def _tiles(batches: Iterator[pa.RecordBatch], task_of) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one cell, sorted, as tiles of TILE rows at most."""
    names = ["label", "n", "c1", "c2", "tile", "ids", "weights", "rows"]
    key, ids, weights, rows, count = None, [], [], [], 0
    task = task_of()

    def tile():
        nonlocal count
        count += 1
        ids_, weights_, rows_ = np.concatenate(ids), np.concatenate(weights), np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int64()), pa.array([key[3]], pa.int64()), pa.array([task * 1_000_000_000 + count], pa.int64()), pa.array([ids_.tobytes()]), pa.array([weights_.tobytes()]), pa.array([rows_.tobytes()])], names)

    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "n", "c1", "c2")], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            at = a
            while at < b:
                if key is not None and (key != tuple(keys[a]) or sum(map(len, ids)) >= TILE):
                    yield tile()
                    ids, weights, rows = [], [], []
                key = tuple(keys[a].tolist())
                end = min(b, at + TILE - sum(map(len, ids)))
                part = batch.slice(at, end - at)
                ids.append(part.column(part.schema.get_field_index("id")).to_numpy(zero_copy_only=False))
                weights.append(part.column(part.schema.get_field_index("weight")).to_numpy(zero_copy_only=False))
                rows.append(_matrix(part.column(part.schema.get_field_index("vector"))).astype(np.float32))
                at = end
    if ids:
        yield tile()


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float, upper_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y (original vectors) whose cosine is ``least`` or more; ``upper_only``: x is y, and i < j."""
    ux, uy = _unit(x), _unit(y)
    a, b = ux @ axes, uy @ axes
    tail = lambda z: np.sqrt(np.maximum(0, np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1]))
    ta, tb = tail(a), tail(b)
    n = a.shape[1]
    first = min(BLOCK, n)
    total = a[:, :first] @ b[:, :first].T
    rest = np.outer(ta[:, first], tb[:, first]) if first < n else 0
    alive = total + rest >= least - SLACK
    if upper_only:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    so_far = total[i, j]
    for start in range(first, n, BLOCK):
        if not len(i):
            break
        end = min(n, start + BLOCK)
        so_far = so_far + np.einsum("ij,ij->i", a[i, start:end], b[j, start:end])
        more = ta[i, end] * tb[j, end] if end < n else 0
        keep = so_far + more >= least - SLACK
        i, j, so_far = i[keep], j[keep], so_far[keep]
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), 100_000):
        keep[k : k + 100_000] = np.einsum("ij,ij->i", ux[i[k : k + 100_000]], uy[j[k : k + 100_000]]) >= least
    return i[keep], j[keep]


def _compare(batches: Iterator[pa.RecordBatch], axes, least: float) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles: link counts (id, null, links) and a spanning forest (id, smaller id, null)."""
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            ids, weights, rows = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("weights", np.int64), ("rows", np.float32)))
            same = row["other_ids"] is None
            ids2, weights2, rows2 = (ids, weights, rows) if same else (np.frombuffer(row["other_" + c], t) for c, t in (("ids", np.int64), ("weights", np.int64), ("rows", np.float32)))
            i, j = linked_pairs(rows.reshape(-1, n), rows2.reshape(-1, n), axes.value[n], least, same)
            if not len(i):
                continue
            count, count2 = np.bincount(i, weights2[j], len(ids)), np.bincount(j, weights[i], len(ids2))
            u, v = spanning_forest(ids[i], ids2[j])
            node = np.concatenate([ids[count > 0], ids2[count2 > 0], u])
            links = np.concatenate([count[count > 0], count2[count2 > 0], np.zeros(len(u))]).astype(np.int64)
            far = np.concatenate([np.zeros(len(node) - len(v), np.int64), v])
            is_edge = np.arange(len(node)) >= len(node) - len(v)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(far, mask=~is_edge), pa.array(links, mask=is_edge)], ["id", "far", "links"])


def near_components(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    width = float(np.sqrt(2 - 2 * least)) * (1 + 1e-9)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    rows = rows.withColumn("ok", usable("vector") & F.col("label").isNotNull())
    good = rows.where("ok")
    # Copies: one row for each distinct vector of a label, named by its smallest id.
    reps = good.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    reps = Cut(reps.withColumn("id", F.coalesce("low", F.xxhash64("label", "vector"))), "vectors").df
    axes = spark.sparkContext.broadcast(principal_axes(reps.select("vector")))
    celled = reps.select("id", "weight", "vector", "label").mapInArrow(lambda it: _cells(it, axes, width), "id long, weight long, vector array<float>, label long, n int, c1 long, c2 long")

    def task() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    sorted_ = celled.repartitionByRange("label", "n", "c1", "c2", F.xxhash64("id")).sortWithinPartitions("label", "n", "c1", "c2")
    tiles = sorted_.mapInArrow(lambda it: _tiles(it, task), "label long, n int, c1 long, c2 long, tile long, ids binary, weights binary, rows binary")
    tiles = Cut(tiles, "tiles").df

    shift = F.array(*[F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    meta = tiles.select("label", "n", "c1", "c2", "tile")
    near = meta.withColumn("d", F.explode(shift)).select("label", "n", (F.col("c1") + F.col("d.d1")).alias("c1"), (F.col("c2") + F.col("d.d2")).alias("c2"), F.col("tile").alias("one"))
    pairs = near.join(meta.withColumnRenamed("tile", "two"), ["label", "n", "c1", "c2"]).where("one < two").select("one", "two")
    pairs = pairs.unionByName(meta.select(F.col("tile").alias("one"), F.lit(None).cast("long").alias("two")))
    other = tiles.select(F.col("tile").alias("two"), F.col("ids").alias("other_ids"), F.col("weights").alias("other_weights"), F.col("rows").alias("other_rows"))
    both = pairs.join(tiles.select(F.col("tile").alias("one"), "n", "ids", "weights", "rows"), "one").join(other, "two", "left")
    both = both.select("n", "ids", "weights", "rows", "other_ids", "other_weights", "other_rows", "one", "two").repartition("one", "two")
    found = Cut(both.mapInArrow(lambda it: _compare(it, axes, least), "id long, far long, links long"), "found").df
    axes.destroy()  # the table is written, so nothing is made anew from it

    label = components(found.where("far is not null").select(F.col("id").alias("u"), F.col("far").alias("v")))
    links = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    of = reps.select("label", "vector", "id", "low", "weight").join(links, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    of = of.withColumn("component", F.coalesce("component", "id"))
    lowest = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(lowest, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = good.select("id", "label", "vector").join(of, ["label", "vector"]).select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
