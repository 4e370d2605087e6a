"""Byte-level BPE by sentencepiece: a model file serialised directly from a rank vocabulary, encoding and decoding.

Each of the 256 bytes is written as one printable character, so that the vocabulary is text; a piece's score is its
negative rank, so that the library's best-score merges are the lowest-rank merges of the rank file; normalisation is
the identity. Pre-tokens are encoded one by one, and decoding maps each piece back to its bytes.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, texts
from .pretokens import Chunks


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is a visible Latin-1 character, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    return [chr(rest.get(b, b)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _field(number: int, kind: int, body: bytes) -> bytes:
    """A protocol-buffers field; kind 2 is length-delimited, 0 a varint, 5 four bytes."""
    return _varint(number << 3 | kind) + (_varint(len(body)) if kind == 2 else b"") + body


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank vocabulary; piece numbers are ranks, one more piece is the unknown one."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every byte")
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [(("".join(letters[b] for b in token)), -float(rank), normal) for rank, token in enumerate(order)]
    pieces.append(("<unk>", 0.0, unknown))
    out = bytearray()
    for text, score, kind in pieces:
        piece = _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind))
        out += _field(1, 2, piece)
    trainer = _field(3, 0, _varint(bpe)) + _field(4, 0, _varint(len(pieces))) + _field(40, 0, _varint(len(order)))
    identity = _field(1, 2, b"identity") + _field(3, 0, b"\0") + _field(4, 0, b"\0") + _field(5, 0, b"\0")
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, identity))


class Codec:
    """Encoding and decoding by one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks, self.pattern = load_ranks(path), regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        letters = byte_letters()
        self.spell = {b: letters[b] for b in range(256)}
        unspell = {c: b for b, c in enumerate(letters)}
        self.bytes_of = [bytes(unspell[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.words: dict[str, list[int]] = {}
        self.memo = Chunks(self._chunks, most=350_000, most_chars=12_000_000)

    def _chunks(self, chunks: list[str], most: int = 280_000) -> tuple[list[int], list[int], list[int]]:
        """The ids of each chunk; a pre-token that is a token is that token, the others are merged."""
        if len(self.words) > most:
            self.words.clear()
        split = list(map(self.pattern.findall, chunks))
        words, ranks = self.words, self.ranks
        merge, spelt = [], []
        for w in {w for tokens in split for w in tokens if w not in words}:
            own = w.encode()
            if (rank := ranks.get(own)) is not None:
                words[w] = [rank]
            else:
                merge.append(w)
                spelt.append(own.decode("latin-1").translate(self.spell))
        words.update(zip(merge, self.model.encode(spelt, num_threads=1), strict=True))
        ids: list[int] = []
        lengths = []
        for tokens in split:
            at = len(ids)
            for w in tokens:
                ids += words[w]
            lengths.append(len(ids) - at)
        return ids, lengths, [0] * len(chunks)

    def encode(self, text: str) -> np.ndarray:
        runs = [self.memo.gather(run) for run in self.memo.runs(text)]
        return np.concatenate(runs) if runs else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker."""
    return Codec(path, pattern)


def _mapped(df: DataFrame, keep: Sequence[str], source: str, cast: str, target: str, each) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(target, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for start, stop in byte_slices(column, 4 << 20):
                out = pa.array(each(column, start, stop), pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[: len(keep)]), out], names=schema.names)

    return df.select(*keep, F.col(source).cast(cast).alias("__in")).mapInArrow(run, schema)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), target: str = "ids") -> DataFrame:
    """keep and the ids of every whole text, as unsigned little-endian 32-bit integers in a binary column.

    ranks is the path of a rank file, pattern the regular expression whose matches are encoded separately. No special
    tokens are added or recognised. Null text counts as empty: no ids. Repeated rows and null keys stay as they are;
    an empty table gives no rows; columns not named are not read.
    """

    def each(column: pa.Array, start: int, stop: int) -> list[bytes]:
        own = codec(ranks, pattern)
        return [own.encode(t).astype("<u4").tobytes() for t in texts(column, start, stop)]

    return _mapped(df, keep, text, "string", target, each)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",), target: str = "bytes") -> DataFrame:
    """keep and the bytes that the ids of encode() stand for; null ids give no bytes."""

    def each(column: pa.Array, start: int, stop: int) -> list[bytes]:
        own = codec(ranks, pattern)
        return [own.decode(np.frombuffer(b or b"", "<u4")) for b in column.slice(start, stop - start).to_pylist()]

    return _mapped(df, keep, ids, "binary", target, each)
