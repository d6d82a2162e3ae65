"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Filters of several widths slide over the bytes of a window; each keeps its largest response (max pooling), and a softmax
layer turns these into languages. Bytes are first folded to classes: letters without case, bytes of other scripts and
accents (those of Latin-1 without case too), and one class for all the rest. As inputs are single bytes, a filter is a
table of weights by place and class; on texts, the tables of two neighbouring places are added beforehand, so that a
response is two look-ups. Training is on windows of a bounded sample of labelled rows; prediction averages the
probabilities of all fixed-length windows of a whole text.

Defined results: ``und`` with score 0 for null texts, for texts without a letter, and for every text if no row is
labelled; repeated rows and ties need no rule (of equal probabilities the language first in order wins); texts of any
length are read whole, in chunks of windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share, shared, smallest_hashes, utf8_of

#: Bound of the training sample in documents, bytes of a window, filter widths and filters of each width.
TRAIN_DOCS, WINDOW, WIDTHS, FILTERS = 6000, 256, (2, 3, 4), 10
#: Windows that are scored at once, and rows of a batch whose texts are held as Python strings at once.
CHUNK, ROWS = 128, 512


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    out[128:] = 27 + np.arange(128)
    return out


CLASSES = 27 + 128
_CLASS = _byte_classes()


def fold(data: np.ndarray) -> np.ndarray:
    """Byte classes; U+00C0..U+00DE (0xC3 0x80..0x9E) as their small letters."""
    out = _CLASS[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[1:][capital] += 0x20
    return out


def windows_of(data: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) classes of a text; windows overlap by a filter's width less one, the last is filled with 0."""
    step = WINDOW - max(WIDTHS) + 1
    count = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros(count * step + WINDOW, np.uint8)
    padded[: len(data)] = fold(data)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[: count * step : step]


class Network:
    """weights: for each width a table (place, class, filter); out, bias: the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.weights = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 4) -> None:
        """Adam on cross-entropy; a filter's gradient reaches only the place where its response is largest."""
        rng = np.random.default_rng(seed)
        params = [*self.weights, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        steps = 0
        places = WINDOW - max(WIDTHS) + 1
        for r in range(rounds):
            order = rng.permutation(len(x))
            for start in range(0, len(order), batch):
                at = order[start : start + batch]
                xb, yb, n = x[at], y[at], len(at)
                best, values = [], []
                for w, table in zip(WIDTHS, self.weights):
                    response = sum(table[j][xb[:, j : j + places]] for j in range(w))
                    top = response.argmax(axis=1)
                    best.append(top)
                    values.append(np.take_along_axis(response, top[:, None], axis=1)[:, 0])
                pooled = np.concatenate(values, axis=1)
                active = np.maximum(pooled, 0)
                logits = active @ self.out + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), yb] -= 1
                p /= n
                grads = [np.zeros_like(t) for t in self.weights] + [active.T @ p, p.sum(axis=0)]
                back = (p @ self.out.T) * (pooled > 0)
                for i, (w, top) in enumerate(zip(WIDTHS, best)):
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(grads[i][j], (xb[np.arange(n)[:, None], top + j], np.arange(FILTERS)), part)
                steps += 1
                for q, (value, g) in enumerate(zip(params, grads)):
                    first[q] += 0.1 * (g - first[q])
                    second[q] += 0.001 * (g * g - second[q])
                    step = rate * (0.3 if r >= rounds - 2 else 1) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
                    value -= step * first[q] / (np.sqrt(second[q]) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of neighbouring classes: what places 0 and 1, and places 2 and 3, add to every filter."""
        total = FILTERS * len(WIDTHS)
        places = np.zeros((4, CLASSES, total), np.float32)
        for i, (w, table) in enumerate(zip(WIDTHS, self.weights)):
            places[:w, :, i * FILTERS : (i + 1) * FILTERS] = table
        return tuple((places[k][:, None] + places[k + 1][None]).reshape(CLASSES * CLASSES, total) for k in (0, 2))

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        places = WINDOW - max(WIDTHS) + 1
        pair = windows[:, :-1].astype(np.int32) * CLASSES + windows[:, 1:]
        response = tables[0].take(pair[:, :places], axis=0)
        response += tables[1].take(pair[:, 2 : places + 2], axis=0)
        logits = np.maximum(response.max(axis=1), 0) @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """A network from a bounded sample of labelled rows: TRAIN_DOCS rows, those with the smallest hash of their id and text,
    and of each a stretch of WINDOW characters and a short one at places that the hash gives. A stretch is cut to WINDOW
    - 1 bytes, so that one of letters of two or three bytes holds half or a third as many."""
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(h.alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    place = lambda salt, width: (F.pmod(F.xxhash64("h", F.lit(salt)), F.greatest(F.lit(1), F.length("text") - width)) + 1).cast("int")
    cut = rows.select("h", "lang", F.substr("text", place(1, WINDOW), F.lit(WINDOW)).alias("long"), F.substr("text", place(2, 40), F.lit(12) + F.pmod("h", F.lit(60)).cast("int")).alias("short"))
    sample = smallest_hashes(cut, "h", TRAIN_DOCS, "lang", "long").toArrow()
    if not len(sample):
        return None
    lang = sample.column("lang").to_pylist()
    names = sorted(set(lang))
    x, y = [], []
    for column in ("long", "short"):
        for text, name in zip(sample.column(column).to_pylist(), lang):
            x.append(windows_of(np.frombuffer(text.encode()[: WINDOW - 1], np.uint8))[0])
            y.append(names.index(name))
    network = Network(names)
    network.fit(np.stack(x), np.array(y))
    return network


def _predicted(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    import regex

    network, letter = shared(known), regex.compile(r"\p{L}")
    tables = network.tables() if network else None
    for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, len(whole), ROWS)):
        text = batch.column(batch.num_columns - 1)
        has = np.array([bool(t) and letter.search(t) is not None and network is not None for t in text.to_pylist()], bool)
        data, offsets = utf8_of(text)
        pred, score = np.full(len(has), "und", object), np.zeros(len(has))
        todo, held, total = [], [], 0

        def run():
            count = [len(w) for w in held]  # noqa: B023
            windows = np.concatenate(held)  # noqa: B023
            p = np.concatenate([network.probabilities(windows[i : i + CHUNK], tables) for i in range(0, len(windows), CHUNK)])
            mean = np.add.reduceat(p, np.cumsum([0, *count[:-1]]), axis=0) / np.array(count)[:, None]
            best = mean.argmax(axis=1)
            pred[todo] = np.array(network.languages, object)[best]  # noqa: B023
            score[todo] = mean.max(axis=1)  # noqa: B023

        for i in np.flatnonzero(has):
            todo.append(i)
            held.append(windows_of(data[offsets[i] : offsets[i + 1]]))
            total += len(held[-1])
            if total > 16 * CHUNK:
                run()
                todo, held, total = [], [], 0
        if todo:
            run()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], [*batch.schema.names[:-1], "lang_pred", "score"])


def predict(docs: DataFrame, network: Network | None, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for each row of ``docs``."""
    known = share(docs.sparkSession, network)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _predicted(it, known), f"{kept}, lang_pred string, score double")
