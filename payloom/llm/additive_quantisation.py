"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of codewords, one from each of M full-dimensional codebooks. Codebooks start as those
of residual k-means and are then fitted jointly by least squares on a bounded sample (``SAMPLE`` vectors, those with the
smallest hash of their id and vector). Every row is encoded by beam search and kept with its codes and the squared norm of its
approximation. For a query, tables of its products with all codewords give each row's approximate distance by M
look-ups; the nearest ``SHORTLIST`` share of every block, and all ties with the last of them, are ranked again by the
Euclidean distance of the original vectors in double precision.

The index is blocks of rows in the shared folder; queries are blocks too, and every pair of blocks is one row that
adaptive execution may deal to any task. No block exceeds a fixed size.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, have a null id or another
length than most vectors take no part; of equal distances the smaller id is nearer; rows that bear the query's own id
are no candidates; repeated rows are candidates each, but one query (rows that share an id and differ in their vectors are
queries each, with ranks of their own); fewer candidates than asked for are all returned; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, smallest_hashes
from .near_vectors import _matrix, usable

#: Sample that codebooks are fitted on, codebooks, codewords of each, beam, rows of an index block and a query block.
SAMPLE = 16_384
BOOKS, WORDS, BEAM = 8, 256, 8
BLOCK, QUERIES = 4096, 1024
#: Share of a block that is ranked by exact distances, and its least number of rows.
SHORTLIST, SHORTLIST_LEAST = 1 / 10, 64
#: Components beyond this are cut to it in approximations, so that squares stay finite; exact distances use them whole.
MOST = 1e15


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, M) by beam search: a partial sum s scores |s|^2 - 2 x s, kept by products of codewords."""
    many, words, _ = books.shape
    x = np.clip(x, -MOST, MOST)
    flat = books.reshape(many * words, -1)
    gram, out = flat @ flat.T, []
    for start in range(0, len(x), 512):
        part = x[start : start + 512]
        dots = (part @ flat.T).reshape(len(part), many, words)
        codes = np.zeros((len(part), 1, 0), np.int64)
        scores = np.zeros((len(part), 1), x.dtype)
        for m in range(many):
            own = np.diagonal(gram)[m * words : (m + 1) * words]
            new = scores[:, :, None] + own - 2 * dots[:, None, m]
            for p in range(m):
                new += 2 * gram[p * words + codes[:, :, p], m * words : (m + 1) * words]
            new = new.reshape(len(part), -1)
            width = min(beam, new.shape[1])
            best = np.argpartition(new, width - 1, axis=1)[:, :width]
            scores = np.take_along_axis(new, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None], axis=1), (best % words)[:, :, None]], axis=2)
        out.append(codes[np.arange(len(part)), scores.argmin(axis=1)])
    return np.concatenate(out) if out else np.zeros((0, many), np.int64)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def fit(x: np.ndarray, many: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """Codebooks (M, K, d) for the sample x."""
    rng = np.random.default_rng(seed)
    x = np.clip(x.astype(np.float32), -MOST, MOST)
    rest, books = x.copy(), []
    for _ in range(many):
        centres = _kmeans(rest, words, rng)
        near = (-2 * rest @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        rest -= centres[near]
        books.append(centres)
    books = np.stack(books)
    for _ in range(rounds):
        at = encode(x, books, 4) + np.arange(many) * words
        both = np.zeros((many * words, many * words), np.float32)
        for a in range(many):
            for b in range(many):
                np.add.at(both, (at[:, a], at[:, b]), 1)
        sums = np.zeros((many * words, x.shape[1]), np.float32)
        for a in range(many):
            np.add.at(sums, at[:, a], x)
        books = np.linalg.solve(both + 0.05 * np.eye(many * words, dtype=np.float32), sums + 0.05 * books.reshape(many * words, -1)).reshape(books.shape).astype(np.float32)
    return books


def _blocks(batches: Iterator[pa.RecordBatch], size: int, books, task_of) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) as blocks of ``size`` at most; with codebooks, also codes and norms of the approximations."""
    count, ids, rows, task = 0, [], [], task_of()

    def block():
        nonlocal count
        count += 1
        i, x = np.concatenate(ids), np.concatenate(rows)
        out = {"block": [task * 1_000_000_000 + count], "ids": [i.tobytes()], "rows": [x.tobytes()], "d": [x.shape[1]]}
        if books is not None:
            codes = encode(x, books.value)
            near = decode(codes, books.value)
            out |= {"codes": [codes.astype(np.uint8).T.tobytes()], "norms": [(near * near).sum(axis=1).astype(np.float32).tobytes()]}
        types = {"block": pa.int64(), "d": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.binary())) for k, v in out.items()], list(out))

    for batch in batches:
        at = 0
        while at < len(batch):
            end = min(len(batch), at + size - sum(map(len, ids)))
            part = batch.slice(at, end - at)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            rows.append(_matrix(part.column(1)).astype(np.float32))
            at = end
            if sum(map(len, ids)) >= size:
                yield block()
                ids, rows = [], []
    if ids:
        yield block()


def _search(batches: Iterator[pa.RecordBatch], books, k: int) -> Iterator[pa.RecordBatch]:
    """For each pair of a query block and an index block: the k nearest rows of the block for each query."""
    book = books.value
    many, words, d = book.shape
    flat = book.reshape(many * words, d)
    for batch in batches:
        for row in batch.to_pylist():
            queries, rows = (np.frombuffer(row[c], np.float32).reshape(-1, d) for c in ("q_rows", "rows"))
            q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(many, -1).astype(np.intp)
            norms = np.frombuffer(row["norms"], np.float32)
            tables = (-2 * np.clip(queries, -MOST, MOST) @ flat.T).reshape(len(queries), many, words)
            short = min(len(ids), max(SHORTLIST_LEAST, k + 1, int(len(ids) * SHORTLIST)))
            exact = rows.astype(np.float64)
            out: list[tuple] = []
            for i, q in enumerate(queries.astype(np.float64)):
                score = norms.copy()
                for m in range(many):
                    score += tables[i, m][codes[m]]
                last = np.partition(score, short - 1)[short - 1]
                near = np.flatnonzero((score <= last) & (ids != q_ids[i]))
                gap = exact[near] - q
                far = np.sqrt((gap * gap).sum(axis=1))
                best = np.lexsort((ids[near], far))[:k]
                out.append((np.full(len(best), q_ids[i]), np.full(len(best), row["q_block"] * QUERIES + i), ids[near][best], far[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "query", "vec_id", "score"])


def neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that satisfies the column ``is_query``, its k nearest rows found."""
    spark = vectors.sparkSession
    good = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return empty
    good = good.where(F.size("vector") == lengths["n"])
    sample = smallest_hashes(good.select(F.xxhash64("id", "vector").alias("h"), "vector"), "h", SAMPLE, "vector").toArrow()
    books = spark.sparkContext.broadcast(fit(_matrix(sample.column("vector").combine_chunks())))

    def task() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    asked = good.where("asked").select("id", "vector").distinct()
    index = Cut(good.select("id", "vector").mapInArrow(lambda it: _blocks(it, BLOCK, books, task), "block long, ids binary, rows binary, d int, codes binary, norms binary"), "index").df
    tasks = max(1, -(-asked.count() // QUERIES))
    queries = Cut(asked.repartition(tasks, F.xxhash64("id")).mapInArrow(lambda it: _blocks(it, QUERIES, None, task), "block long, ids binary, rows binary, d int"), "queries").df

    numbers = [r.block for r in queries.select("block").collect()]  # one number for a thousand queries
    pairs = index.select("block").withColumn("q_block", F.explode(F.array(*map(F.lit, numbers)).cast("array<long>")))
    both = pairs.join(index, "block").join(queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "q_block")
    both = both.select("ids", "rows", "codes", "norms", "q_ids", "q_rows", "block", "q_block").repartition("block", "q_block")
    found = both.mapInArrow(lambda it: _search(it, books, k), "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
