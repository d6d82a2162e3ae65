"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, with offsets, and decoding.

A byte-level vocabulary is a rank file (base64 bytes and a rank a line). Each of the 256 bytes stands for one
printable character there, so the library sees text and never an unknown symbol. The tokenizer is built once, on the
driver, from the rank file whose path the caller gives; its JSON (a size fixed by the vocabulary) is broadcast.

A chunk of texts is cut into pieces by the vocabulary's pattern. Its distinct pieces go to the library, as a piece
never merges with its neighbours; ids are dealt back to the places where pieces occur. What a task remembers of earlier
chunks is bounded (MEMO_PIECES) and goes with the task. Pieces are told apart by a hash of their bytes; decoding every
chunk and comparing it with the text proves the ids right, and a chunk that differs is encoded piece by piece.

Decoding reverses the byte table: a token's characters become bytes again, laid end to end. Offsets follow from the
bytes of tokens and the characters that these bytes belong to; a character that several tokens share lies in the span
of each of them, and ``text_pieces`` shows it with the token that ends it.

Defined results: a null text encodes as an empty one; an empty text has no tokens and decodes to no bytes; texts of any
length are encoded whole, in chunks of a bounded number of bytes (a longer text is cut where white space begins, which
every piece respects); rows are independent, so ties, repeated rows and empty tables need no rule; columns of the
input stay, but for those named as the operator's own.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import add_arrays, utf8_of, with_columns
from .shingles import _BYTE, _Powers, mix

#: Bytes of text that are cut and encoded at once, and pieces that a task remembers.
CHUNK_BYTES = 1_000_000
MEMO_PIECES = 300_000

#: Fixed value: the pattern whose pieces ``piece_starts`` finds in whole chunks; other patterns go through ``regex``.
RUNS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the rest for U+0100 onwards, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in printable}
    table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
    return [table[b] for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A byte-level tokenizer of the library with these ranks: the merge that makes a token is what remains of its
    bytes when every merge of a lower rank has been applied. It takes pieces, which it doesn't cut further."""
    chars = byte_characters()
    spell = lambda token: "".join(chars[b] for b in token)

    def halves(token: bytes, rank: int) -> list[bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(pair := halves(token, rank)) == 2:
            merges.append([spell(pair[0]), spell(pair[1])])
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": level, "post_processor": None, "decoder": level,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {spell(t): r for t, r in ranks.items()}, "merges": merges},
    })


def _character_classes() -> bytes:
    """For each code point: letter, number, white space or other, as the pattern library has them."""
    import regex

    every, out = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out.tobytes()


class Vocabulary:
    """A rank file as executors need it, broadcast: the tokenizer's JSON, the pattern that cuts texts into pieces, and
    the classes of characters if that pattern is the one that needs them."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        classes = _character_classes() if pattern == RUNS_PATTERN else b""
        self.shared = spark.sparkContext.broadcast((tokenizer_json(load_ranks(path)), pattern, classes))


def token_bytes(text: str) -> list[bytes]:
    """The bytes of each id of a tokenizer's JSON: its vocabulary's characters, put back through the byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = json.loads(text)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for spelled, rank in vocabulary.items():
        out[rank] = bytes(map(back.__getitem__, spelled))
    return out


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 characters that begin at ``at``."""
    out = data[at].astype(np.int32)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        where = np.flatnonzero((out >= low) & (out < high) & (data[at] >= low))
        value = out[where] & (0x3F >> more)
        for k in range(1, more + 1):
            value = (value << 6) | (data[at[where] + k] & 0x3F)
        out[where] = value
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The bytes at which a piece of RUNS_PATTERN begins, in texts laid end to end.

    Pieces are runs of characters of one class. The last white space before other characters is a piece of its own, or
    part of the next one if it is a blank; an apostrophe that begins a piece takes the letters of a contraction."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return at
    points = _code_points(data, at)
    kind = classes[points]
    text = np.zeros(len(at) + 1, bool)  # where a text begins, and the end
    text[np.searchsorted(at, offsets)] = True
    run = text.copy()
    run[1:-1] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    start = run[:-1].copy()
    start[1:] &= text[1:-1] | space[1:] | (points[:-1] != 32)
    start |= space & run[1:] & ~text[1:]

    i = np.flatnonzero((points == 39) & start & run[:-1] & run[1:] & ~text[1:])
    i = i[kind[i + 1] == _LETTER]
    one = points[i + 1]
    two = np.where(text[i + 2], 0, points[np.minimum(i + 2, len(at) - 1)])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(long, 2, 0))
    i, taken = i[taken > 0], taken[taken > 0]
    start[i + 1] = False
    rest = (i + 1 + taken)[~run[i + 1 + taken]]
    start[rest] = True
    return at[start]


class Encoder:
    """What a task needs to encode and decode, built from what a vocabulary broadcasts."""

    def __init__(self, shared):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        text, pattern, classes = shared.value
        self.tokenizer = Tokenizer.from_str(text)
        self.classes = np.frombuffer(classes, np.uint8) if classes else None
        self.find = regex.compile(pattern).finditer
        tokens = token_bytes(text)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.powers = _Powers(CHUNK_BYTES)
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.many, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.classes is not None:
            return piece_starts(data, offsets, self.classes)
        out = []
        for a, b in zip(offsets, offsets[1:]):
            text = data[a:b].tobytes().decode()
            lead = np.append(np.flatnonzero((data[a:b] & 0xC0) != 0x80), b - a)
            out.append(a + lead[[m.start() for m in self.find(text)]])
        return np.unique(np.concatenate([np.zeros(0, np.int64), *out])).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these tokens, laid end to end."""
        return self.bytes[_spans(self.place[ids], self.length[ids])]

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, end to end, and how many each has."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ids of texts laid end to end, which begin and end at ``offsets``."""
        start = self.starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32)
        end = np.append(start[1:], len(data))
        up, down = self.powers.of(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
        name, index, which = np.unique(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), return_index=True, return_inverse=True)
        raw = data.tobytes()
        spell = lambda k: [raw[a:b].decode() for a, b in zip(start[k].tolist(), end[k].tolist())]
        at = np.searchsorted(self.known, name)
        new = np.ones(len(name), bool)
        new[at < len(self.known)] = self.known[at[at < len(self.known)]] != name[at < len(self.known)]
        if new.any():
            ids, many = self._library(spell(index[new]))
            if len(self.known) + len(many) > MEMO_PIECES:
                self.forget()
                ids, many = self._library(spell(index))
                new[:] = True
            order = np.argsort(known := np.concatenate([self.known, name[new]]), kind="stable")
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(many) - many])[order]
            self.known, self.many, self.ids = known[order], np.concatenate([self.many, many])[order], np.concatenate([self.ids, ids])
            at = np.searchsorted(self.known, name)
        at = at[which]
        out = self.ids[_spans(self.first[at], self.many[at])]
        if not np.array_equal(self.decode(out), data):  # two pieces share a hash
            out = self._library(spell(np.arange(len(start))))[0]
        return out


def _spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... (``many`` of them) of each span, end to end."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a long text may be cut: its ends, and the first white space after every CHUNK_BYTES that follows a character
    of ASCII that is none."""
    space = np.isin(data, [32, *range(9, 14)])
    fits = np.flatnonzero(space[1:] & ~space[:-1] & (data[:-1] < 0x80)) + 1
    wanted = np.arange(CHUNK_BYTES, len(data), CHUNK_BYTES)
    found = np.searchsorted(fits, wanted)
    return np.unique(np.concatenate([[0], fits[found[found < len(fits)]], [len(data)]]))


def encoded(texts: pa.Array, encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of whole texts [a, b): the ids end to end, where each text's begin, and the bytes and offsets of the run's texts."""
    data, offsets = utf8_of(texts)
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = min(rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1))
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) > CHUNK_BYTES:
            cut = _cuts(part)
            ids = np.concatenate([encoder.encode(part[x:y], np.array([0, y - x])) for x, y in zip(cut, cut[1:])])
        else:
            ids = encoder.encode(part, at)
        ends = np.cumsum(encoder.length[ids])
        yield a, b, ids, np.concatenate([[0], np.searchsorted(ends, at[1:], "right")]), part, at
        a = b


def token_spans(ids: np.ndarray, first: np.ndarray, part: np.ndarray, at: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of its text at which each token starts and ends, and whether it begins or ends within one."""
    end = np.cumsum(encoder.length[ids])
    start = end - encoder.length[ids]
    lead = np.append((part & 0xC0) != 0x80, True)
    before = np.cumsum(lead) - lead  # characters that begin before each byte
    text = np.repeat(before[at[:-1]], np.diff(first))
    return (before[start] - ~lead[start] - text).astype(np.int32), (before[end] - text).astype(np.int32), ~(lead[start] & lead[end])


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, pa.int32()))


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _encoded(batches: Iterator[pa.RecordBatch], shared, text_col: str, offsets: bool, decoded: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(shared)
    for batch in batches:
        for a, b, ids, first, part, at in encoded(batch.column(batch.schema.get_field_index(text_col)), encoder):
            new = {"token_ids": _lists(ids, first)}
            if offsets:
                starts, ends, _ = token_spans(ids, first, part, at, encoder)
                new |= {"token_starts": _lists(starts, first), "token_ends": _lists(ends, first)}
            if decoded:
                new["decoded"] = _binaries(encoder.decode(ids), np.append(0, np.cumsum(encoder.length[ids]))[first])
            yield add_arrays(batch.slice(a, b - a), new)


def _decoded(batches: Iterator[pa.RecordBatch], shared, pieces: bool) -> Iterator[pa.RecordBatch]:
    encoder, tokens = Encoder(shared), token_bytes(shared.value[0]) if pieces else None
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("token_ids"))
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        new = {"decoded": _binaries(encoder.decode(flat), np.append(0, np.cumsum(encoder.length[flat]))[first])}
        if pieces:
            new["token_texts"] = pa.array([text_pieces(flat[a:b].tolist(), tokens) for a, b in zip(first, first[1:])], pa.list_(pa.string()))
        yield add_arrays(batch, new)


_INTS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``; with ``offsets`` also ``token_starts`` and ``token_ends``, in characters of the text."""
    fields = [T.StructField(n, _INTS) for n in ("token_ids", *(("token_starts", "token_ends") if offsets else ()))]
    shared = vocabulary.shared
    return docs.mapInArrow(lambda it: _encoded(it, shared, text_col, offsets, False), with_columns(docs.schema, *fields))


def decode(docs: DataFrame, vocabulary: Vocabulary, pieces: bool = False) -> DataFrame:
    """``docs``, which has ``token_ids``, with ``decoded``: the bytes that its tokens stand for, laid end to end; with
    ``pieces`` also ``token_texts``, the text that each token completes."""
    shared = vocabulary.shared
    fields = [T.StructField("decoded", T.BinaryType())] + [T.StructField("token_texts", T.ArrayType(T.StringType()))] * pieces
    return docs.mapInArrow(lambda it: _decoded(it, shared, pieces), with_columns(docs.schema, *fields))


def text_pieces(ids: list[int], table: list[bytes]) -> list[str]:
    """The text that each token completes: a character split over tokens appears with the token that ends it."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(table[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``decoded``, both made in one pass through Python."""
    shared = vocabulary.shared
    schema = with_columns(docs.schema, T.StructField("token_ids", _INTS), T.StructField("decoded", T.BinaryType()))
    return docs.mapInArrow(lambda it: _encoded(it, shared, text_col, False, True), schema)


def digests(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256``, ``n_chars`` (where the last token's span ends) and ``n_split`` (tokens that hold part of a
    character only), derived from tokens, decoded bytes and offsets as they are made."""
    shared = vocabulary.shared
    own = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "n_chars": T.LongType(), "n_split": T.LongType()}
    kept = [f.name for f in docs.schema.fields if f.name != text_col and f.name not in own]

    def reduced(batches):
        encoder = Encoder(shared)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for a, b, ids, first, part, at in encoded(batch.column(batch.schema.get_field_index(text_col)), encoder):
                decoded, ends = encoder.decode(ids), np.append(0, np.cumsum(encoder.length[ids]))[first]
                _, last, split = token_spans(ids, first, part, at, encoder)
                little, some = ids.astype("<u4"), np.diff(first) > 0
                chars = np.zeros(b - a, np.int64)
                chars[some] = last[first[1:][some] - 1]
                splits = np.append(0, np.cumsum(split))[first]
                yield add_arrays(batch.slice(a, b - a).select(kept), {
                    "n_tokens": pa.array(np.diff(first), pa.int64()),
                    "ids_sha256": pa.array([sha(little[x:y]) for x, y in zip(first, first[1:])], pa.string()),
                    "decoded_sha256": pa.array([sha(decoded[x:y]) for x, y in zip(ends, ends[1:])], pa.string()),
                    "n_chars": pa.array(chars), "n_split": pa.array(np.diff(splits), pa.int64()),
                })

    return docs.mapInArrow(reduced, with_columns(T.StructType([f for f in docs.schema.fields if f.name in kept]), *[T.StructField(n, t) for n, t in own.items()]))
