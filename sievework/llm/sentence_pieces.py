"""SentencePiece encoding with the place of every piece in the original text.

A text is normalised first: at each place the longest entry of the model's compiled character map replaces what it
matches, white space becomes one sign, and for every normalised character the byte of the source where it comes from is
kept. The library then encodes normalised text by a copy of the model whose own normalisation is the identity, so pieces
count normalised characters, and the record of sources takes each piece to the bytes of the original text.

No piece of the usual vocabularies holds the space sign after another character, so very long texts are cut before single
spaces, where no piece crosses. Other vocabularies are encoded text by text.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, texts

SPACE = "▁"
#: A space between two other characters, of which the first is not the space sign.
SAFE = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
#: Longer texts are cut into runs of about so many characters.
RUN_CHARS = 1 << 13
#: Stands for a null among ids.
NO_ID = -1
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """Number, value, start and end of each field of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        start = at
        number, kind = divmod(varint(), 8)
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = message[at : at + size]
            at += size
        yield number, value, start, at


class CharacterMap:
    """A compiled character map: a double array (a trie in two arrays), read as it is, and its targets, ended by zeros."""

    def __init__(self, compiled: bytes):
        (size,) = struct.unpack_from("<I", compiled)
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.targets = compiled[4 + size :]
        self.pairs: dict[str, tuple[bool, bool]] = {}

    def steps(self, key: bytes) -> Iterator[int | None]:
        """After each byte that a path of the trie has: where the target of what is read so far begins, if it has one."""
        below = lambda at, unit: at ^ (unit >> 10) << ((unit & 1 << 9) >> 6)
        at = below(0, self.units[0])
        for b in key:
            at ^= b
            if at >= len(self.units) or (unit := self.units[at]) & (1 << 31 | 0xFF) != b:
                return
            at = below(at, unit)
            yield self.units[at] & ((1 << 31) - 1) if unit & 1 << 8 else None

    def longest(self, text: str, at: int, most: int = 64) -> tuple[str, int] | None:
        """Target and number of characters of the longest entry that the text has at a place."""
        found, n = None, most
        key = text[at : at + most].encode()
        for i, value in enumerate(self.steps(key), 1):
            if value is not None:
                found, n = value, i
            if i == len(key) and len(text) > at + most:
                return self.longest(text, at, 4 * most)
        if found is None:
            return None
        return self.targets[found : self.targets.index(b"\0", found)].decode(), len(key[:n].decode())

    def known(self, key: str) -> tuple[bool, bool]:
        """Whether a string is an entry, and whether longer ones may begin with it."""
        if key not in self.pairs:
            raw = key.encode()
            found = list(self.steps(raw))
            whole = len(found) == len(raw)
            self.pairs[key] = whole and found[-1] is not None, whole
        return self.pairs[key]

    def places(self, text: str) -> re.Pattern | None:
        """Matches where an entry may begin: a character that is one, or that goes on with the next one; null where none does."""
        letters = sorted(set(text))
        alone = [c for c in letters if self.known(c)[0]]
        open_ = [c for c in letters if self.known(c)[1] and not self.known(c)[0]]
        second = [d for d in letters if any(self.known(c + d)[1] for c in open_)]
        of = lambda x: "[" + "".join(map(re.escape, x)) + "]"
        parts = ([of(alone)] if alone else []) + ([f"{of(open_)}(?={of(second)})"] if open_ and second else [])
        return re.compile("|".join(parts)) if parts else None


@dataclass
class Rules:
    """How a model normalises: character map, white space, and the sign for spaces."""

    map: CharacterMap | None
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    suffix: bool = False

    @property
    def plain(self) -> bool:
        """Whether a text is changed by nothing but the sign for spaces and the one added in front."""
        return not self.map and not self.trim and not self.suffix

    def _replaced(self, text: str) -> Iterator[tuple[str, int, bool]]:
        """Target, number of characters it replaces, and whether it stands for itself, in order."""
        at, places = 0, self.map.places(text) if self.map else None
        while at < len(text):
            hit = places.search(text, at) if places else None
            upto = hit.start() if hit else len(text)
            if upto > at:
                yield text[at:upto], upto - at, True
            at = upto
            if hit:
                target, n = found if (found := self.map.longest(text, at)) else (text[at], 1)
                yield target, n, found is None
                at += n

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text with plain spaces, and the source byte of each of its characters and of its end."""
        raw = np.frombuffer(text.encode(), np.uint8)
        byte_of = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
        if not text:
            return "", byte_of
        if self.plain:
            return (" " + text, np.insert(byte_of, 0, 0)) if self.dummy_prefix else (text, byte_of)
        out, sources, at, after_space = [], [], 0, self.trim
        first = None
        for target, n, own in self._replaced(text):
            source = np.arange(at, at + len(target)) if own else np.full(len(target), at)
            if self.trim and target:
                # spaces at the start, and those after a piece of the text that ends in one, go
                if own:
                    space = np.frombuffer(target.encode("utf-32-le"), np.uint32) == 32
                    before = np.insert(space[:-1], 0, after_space)
                    keep = ~(space & before)
                else:
                    keep = np.ones(len(target), bool)
                    keep[: len(target) - len(target.lstrip(" ")) if after_space else 0] = False
                if not keep.all():
                    target, source = "".join(np.array(list(target), object)[keep]), source[keep]
            if target:
                if first is None:
                    first = int(source[0])
                out.append(target)
                sources.append(source)
                after_space = self.trim and target.endswith(" ")
            at += n
        whole = "".join(out)
        if first is None:
            return "", byte_of[-1:]
        source = np.append(byte_of[np.concatenate(sources)], len(raw))
        if self.dummy_prefix and not self.suffix:
            whole, source = " " + whole, np.insert(source, 0, byte_of[first] if self.trim else 0)
        signs = " " + SPACE if self.escape else " "
        if self.trim and (cut := len(whole) - len(whole.rstrip(signs))):
            whole, source = whole[:-cut], source[: len(source) - cut]
        if self.dummy_prefix and self.suffix:
            whole, source = whole + " ", np.append(source, source[-1])
        return whole, source


class Pieces:
    """Ids of a text's pieces, and where each begins and ends in it, by the library."""

    def __init__(self, model: bytes, rules: Rules, cut: bool, spellings: list[tuple[str, int]]):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rules, self.cut = rules, cut
        self.sizes = np.array([len(s) for s, _ in spellings], np.int64)
        self.byte = np.array([kind == BYTE for _, kind in spellings])
        self.later = np.array([kind == BYTE and int(s[1:-1], 16) & 0xC0 == 0x80 for s, kind in spellings])
        self.all_bytes = int(self.byte.sum()) == 256

    def encoded(self, normalised: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends in characters. Where bytes stand in for unknown characters, the spellings of the pieces add up to the text."""
        escaped = normalised.replace(" ", SPACE) if self.rules.escape else normalised
        if not self.all_bytes:
            found = self.library.encode(escaped, return_type="offset_mapping")
            places = np.array(found["offsets"], np.int64).reshape(-1, 2)
            return np.array(found["ids"], np.int32), places[:, 0], places[:, 1]
        ids = self.library.encode(escaped, return_type="numpy")
        sizes = self.sizes[ids]
        if (byte := self.byte[ids]).any():
            sizes[byte] = ~np.append(self.later[ids[1:]], False)[byte]  # the last byte of a character stands for it
        ends = np.cumsum(sizes)
        return ids, ends - sizes, ends

    def placed(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and end of each piece's bytes in the text."""
        normalised, source = self.rules.apply(text)
        parts, at = [], 0
        for run in self._runs(normalised):
            ids, begins, ends = self.encoded(run)
            parts.append((ids, source[begins + at], source[ends + at]))
            at += len(run)
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int32),) * 3

    def _runs(self, normalised: str) -> Iterator[str]:
        """The text, cut before single spaces into runs of about RUN_CHARS characters where no piece crosses such a place."""
        at = 0
        while at < len(normalised):
            end = len(normalised)
            if self.cut and end - at > RUN_CHARS and (cut := SAFE.search(normalised, at + RUN_CHARS)):
                end = cut.start()
            yield normalised[at:end]
            at = end


class Codec:
    """A model file for encoding with places, and for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        rest, spec, suffix, safe = bytearray(), {}, False, True
        self.spellings: list[tuple[str, int]] = []
        for number, value, start, end in fields(model):
            if number == 3:
                spec = {n: v for n, v, *_ in fields(value)}
                continue
            rest += model[start:end]
            if number == 2:
                suffix = any(n == 24 and v for n, v, *_ in fields(value))
            elif number == 1:
                piece = {n: v for n, v, *_ in fields(value)}
                spelling, kind = piece.get(1, b"").decode(), piece.get(3, NORMAL)
                self.spellings.append((spelling, kind))
                if kind == USER_DEFINED:
                    raise ValueError("a model with user-defined pieces, which bypass normalisation, is not supported")
                safe &= kind != NORMAL or SPACE not in spelling.lstrip(SPACE)
                safe &= kind != UNUSED
        flag = lambda n: bool(spec.get(n, 1))
        self.rules = Rules(CharacterMap(spec[2]) if spec.get(2) else None, flag(3), flag(4), flag(5), suffix)
        identity = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.cut = safe and self.rules.escape and not suffix
        self.identity = bytes(rest) + b"\x1a" + bytes([len(identity)]) + identity
        self.path = path

    @functools.cached_property
    def pieces(self) -> Pieces:
        return Pieces(self.identity, self.rules, self.cut, self.spellings)

    @functools.cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each worker; what it does not use is not built."""
    return Codec(path)


def encode(df: DataFrame, model: str, text: str = "text", keep: Sequence[str] = ("doc_id",), end_id: bool = True) -> DataFrame:
    """keep, and ids, begins, ends (arrays of int) of the pieces of every whole text.

    model is the path of a sentencepiece .model file; ids are those of the library's encode, without sampling, with the
    end id last if end_id. begins and ends are bytes of the original text in UTF-8: of the characters that a piece comes
    from (the last byte piece of a character has them all, those before it and the end id none). Null text counts as
    empty. Repeated rows and null keys stay as they are; an empty table gives no rows; columns not named are not read.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "begins", "ends")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model).pieces
        last = pieces.library.eos_id()
        for batch in batches:
            column = batch.column(len(keep))
            for start, stop in byte_slices(column):
                columns: tuple[list, list, list] = ([], [], [])
                for t in texts(column, start, stop):
                    found = pieces.placed(t)
                    size = len(t.encode()) if end_id else 0
                    for c, x, more in zip(columns, found, (last, size, size), strict=True):
                        c.append(np.append(x, more).astype(np.int32) if end_id else x.astype(np.int32))
                lists = []
                for c in columns:
                    offsets = np.cumsum([0, *map(len, c)]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*c, np.empty(0, np.int32)]))))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[: len(keep)]), *lists], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",), target: str = "decoded") -> DataFrame:
    """keep and the text that the library's decode() gives for each list of ids; a null list gives an empty text, null ids in one count for nothing.

    Repeated rows and null keys stay as they are; an empty table gives no rows; columns not named are not read.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(target, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = codec(model).library
        for batch in batches:
            column = batch.column(len(keep))
            known = column.is_valid().to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy()
            numbers = column.values.fill_null(NO_ID).to_numpy()  # rows are read from the buffer, as Python lists of them cost as much as encoding
            for start in range(0, len(column), 64):
                rows = [numbers[ends[i] : ends[i + 1] if known[i] else ends[i]] for i in range(start, min(start + 64, len(column)))]
                if column.values.null_count:
                    rows = [x[x != NO_ID] for x in rows]
                part = [library.decode(x) if len(x) else "" for x in rows]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, 64) for c in batch.columns[: len(keep)]), pa.array(part, pa.string())], names=schema.names)

    return df.select(*keep, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(run, schema)
