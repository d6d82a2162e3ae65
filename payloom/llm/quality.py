"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are the hashed byte trigrams of its whole text, with a mark where it begins and ends, and a term for
each of a few distances at which a word occurs again. Square roots of their counts, weighted by inverse document
frequency over the labelled sample, are projected on its leading singular vectors. The labelled vectors (a bounded number of short ones) are broadcast; every document is compared with all of them
by exact cosine products, in blocks, and its NEAREST neighbours vote with their labels, weighted by a power of their
similarity.

The labelled sample is LABELLED rows at most, those with the smallest hash of their id; labels that are not 0 or 1 count
as missing, as do ids that bear both.

Defined results: null texts are empty ones; an empty text has its marks as terms and is scored by its neighbours too;
without labelled rows every score is 0.5; neighbours whose similarities agree to TIE are ties, which go to the smaller
hash of the id; repeated rows are scored alike; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share, shared, smallest_hashes, utf8_of
from .shingles import _Powers, word_hashes

#: Bound of the labelled sample, hashed trigram terms, latent dimensions, neighbours, power of the similarity, ties.
LABELLED, TERMS, LATENT, NEAREST, POWER, TIE = 4096, 2048, 48, 9, 4, 1e-5
#: Distances in words at which a repeated word counts, and what such a count weighs (a word has several trigrams).
AGAIN, AGAIN_WEIGHT = (1, 2, 3), 8
CHUNK_BYTES = 2_000_000
#: Labelled rows that are weighted at once.
CHUNK_ROWS = 256
#: Fixed weights that hash a trigram of bytes, and the mark of a text's ends, which is no byte of UTF-8.
_A, _B, _C = 2654435761, 40503 * 65537 % 2**32, 2246822519
_MARK = 255


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """A row of TERMS and AGAIN for each text: square roots of counts."""
    data, offsets = utf8_of(texts)
    start, rows, powers = 0, len(offsets) - 1, _Powers()
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1)
        end = min(end, start + 512)
        size = np.diff(offsets[start : end + 1]) + 2
        at = np.cumsum(size) - size
        wide = np.full(size.sum(), _MARK, np.uint32)
        inside = np.ones(len(wide), bool)
        inside[at] = inside[at + size - 1] = False
        wide[inside] = data[offsets[start] : offsets[end]]
        h = np.zeros(len(wide), np.int64)
        h[:-2] = ((wide[:-2] * np.uint32(_A) + wide[1:-1] * np.uint32(_B) + wide[2:] * np.uint32(_C)) >> np.uint32(12)) % np.uint32(TERMS)
        words, first = word_hashes(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], powers)
        out = np.zeros((end - start, TERMS + len(AGAIN)), np.float32)
        for i in range(end - start):
            np.sqrt(np.bincount(h[at[i] : at[i] + max(1, size[i] - 2)], minlength=TERMS), out=out[i, :TERMS], casting="unsafe")
            own = words[first[i] : first[i + 1]]
            out[i, TERMS:] = np.sqrt([AGAIN_WEIGHT * np.count_nonzero(own[far:] == own[:-far]) for far in AGAIN])
        yield out
        start = end


class Model:
    """Weights of terms, projection, labelled latent vectors and their labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, seed: int = 9):
        """``rows`` are weighted in place, as the driver has room for them once."""
        held, x = np.zeros(rows.shape[1], np.int64), rows
        for a in range(0, len(x), CHUNK_ROWS):
            held += np.count_nonzero(x[a : a + CHUNK_ROWS] > 0, axis=0)
        self.weight = np.log1p(len(rows) / (1 + held)).astype(np.float32)
        for a in range(0, len(x), CHUNK_ROWS):
            x[a : a + CHUNK_ROWS] = self.weighted(x[a : a + CHUNK_ROWS])
        rng = np.random.default_rng(seed)
        k = min(LATENT, *x.shape)
        basis = np.linalg.qr(x.T @ (x @ rng.normal(size=(x.shape[1], k + 16)).astype(np.float32)))[0]
        for _ in range(3):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, vectors = np.linalg.eigh((x @ basis).T @ (x @ basis))
        self.axes = (basis @ vectors[:, ::-1][:, :k]).astype(np.float32)
        self.known, self.labels = self._unit(x @ self.axes), labels.astype(np.float32)

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        x = rows * self.weight
        return x / np.maximum(1e-12, np.sqrt((x * x).sum(axis=1, keepdims=True)))

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return self._unit(self.weighted(rows) @ self.axes)

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(1e-12, np.sqrt((z * z).sum(axis=1, keepdims=True)))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        cosine = self.latent(rows) @ self.known.T
        k = min(NEAREST, cosine.shape[1])
        # Labelled rows are in order of their hashes, so a stable order settles ties.
        rounded = np.rint(cosine / TIE)
        near = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
        vote = np.maximum(1e-9, np.take_along_axis(cosine, near, axis=1)) ** POWER
        return np.clip((vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1), 0, 1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for rows in features(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), batch.column(1).slice(at, len(rows)), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], ["h", "label", "row"])
            at += len(rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> Model | None:
    """A model from LABELLED rows at most of ``docs`` joined with ``labels``."""
    sample = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col), F.lit(6)).alias("h"))
    sample = sample.groupBy("__id", "h").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    sample = smallest_hashes(sample, "h", LABELLED, "__id")
    docs = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    rows = docs.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("h", "label", "text")
    found = rows.mapInArrow(_feature_rows, "h long, label int, row binary").orderBy("h", "label", "row").toArrow()
    if not len(found):
        return None
    labels, packed = found.column("label").to_numpy(), found.column("row")
    x = np.empty((len(found), TERMS + len(AGAIN)), np.float32)
    for i, r in enumerate(packed):
        x[i] = np.frombuffer(zlib.decompress(r.as_buffer()), np.float32)
    return Model(x, labels)


def _scored(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    model = shared(known)
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        if model is None:
            score = [np.full(len(text), 0.5)]
        else:
            score = [model.scores(rows).astype(np.float64) for rows in features(text)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(score) if score else np.zeros(0))], [*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model | None, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) for each row of ``docs``."""
    known = share(docs.sparkSession, model)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _scored(it, known), f"{kept}, score double")
