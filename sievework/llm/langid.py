"""Language ID: blended-spectrum n-gram presence kernels, Nyström landmarks and one-versus-rest kernel ridge regression.

A window of a text is the set of its character n-grams of lengths 1 to 4, hashed into a fixed number of places. The
kernel of two windows is the share of n-grams they have in common, K(x, y) = |X and Y| / sqrt(|X| |Y|). Ridge regression
against one column for each language is solved in the space that a bounded number of landmark windows spans. A batch of
windows is scored by one product of its presence matrix with the landmarks' presence, already multiplied by the
coefficients. A text's scores are the means of all its windows', weighted by their letters, so that a long text fills
no more places than a short one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, lean, stored, texts

#: Places of the presence vectors, the lengths of n-grams, and characters of a window.
PLACES, LENGTHS, WINDOW = 1 << 15, (1, 2, 3, 4), 8192
#: Bounds of the training sample: rows for each language and, with very many languages, in all, though never fewer than
#: LEAST_ROWS for each; landmarks in all, or LANDMARKS_EACH for each language if that is more; ridge penalty.
ROWS_EACH, ROWS_IN_ALL, LEAST_ROWS = 400, 25_600, 8
LANDMARKS, LANDMARKS_EACH, PENALTY = 256, 4, 1e-3
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def windows(text: str) -> list[str]:
    """All of a text in windows; neighbours share three characters, so that no n-gram is lost."""
    return [text[max(0, at - 3) : at + WINDOW] for at in range(0, len(text), WINDOW)]


def presence(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each window with 1.0 at the places of its n-grams, and its number of letters.

    Lower case; characters that are no letters count as one space.
    """
    out = np.zeros((len(batch), PLACES), np.float32)
    letters = np.zeros(len(batch))
    for i, text in enumerate(batch):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letter_table()[codes]
        letters[i] = letter.sum()
        codes = np.where(letter, codes, np.uint32(32))
        grown = np.zeros(len(codes), np.uint32)
        for n in LENGTHS:
            if len(codes) < n:
                break
            grown = (grown[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
            grown ^= grown >> np.uint32(15)
            out[i, (grown * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)] = 1.0
    return out, letters


class Model:
    """Coefficients for each place and language."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: a score for each language, and its number of letters."""
        total, letters = np.zeros((len(batch), len(self.languages))), np.zeros(len(batch))
        parts = [(i, w) for i, text in enumerate(batch) for w in windows(text)]
        for at in range(0, len(parts), 64):
            number = np.array([i for i, _ in parts[at : at + 64]])
            found, n = presence([w for _, w in parts[at : at + 64]])
            own = (found @ self.weights) / np.sqrt(np.maximum(found.sum(1, keepdims=True), 1))
            np.add.at(total, number, own * n[:, None])
            np.add.at(letters, number, n)
        return total / np.maximum(letters, 1)[:, None], letters


@dataclass
class Landmarks:
    """Packed presence bits of the landmark windows, and the languages in order."""

    languages: list[str]
    bits: np.ndarray

    @functools.cached_property
    def marks(self) -> np.ndarray:
        marks = np.unpackbits(self.bits, axis=1).astype(np.float32)
        marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
        return marks

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((len(self.bits),) * 2), np.zeros((len(self.bits), len(self.languages)))

    def products(self, found: np.ndarray, own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What windows add to both sides of the normal equations. found: presence; own: number of the language."""
        k = ((found @ self.marks.T) / np.sqrt(np.maximum(found.sum(1, keepdims=True), 1))).astype(np.float64)
        return k.T @ (weight[:, None] * k), k.T @ (weight[:, None] * (own[:, None] == np.arange(len(self.languages))))

    def solved(self, normal: np.ndarray, aim: np.ndarray, weight: float) -> Model:
        """weight: the sum of all windows' weights."""
        normal = normal + PENALTY * weight * (self.marks @ self.marks.T).astype(np.float64) + 1e-8 * np.eye(len(self.bits))
        return Model(self.languages, (self.marks.T @ np.linalg.solve(normal, aim)).astype(np.float32))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """A model of every language, from at most ROWS_EACH rows for each, chosen by a hash of the key.

    All windows of a chosen text teach, and weigh as much together as any other text; languages weigh alike. Landmarks
    are one window for each of the first rows of every language, by its row's place in that order. Rows with null text or
    label teach nothing; without any other, the model has no languages. Only landmarks, and sums of the size of their
    pairs, reach the driver, however long the texts are.
    """
    rows = df.select(F.col(key).cast("string").alias("__key"), F.col(text).cast("string").alias("__text"), F.col(label).cast("string").alias("__label")).filter("__text IS NOT NULL AND __label IS NOT NULL")
    rows = rows.withColumn("__hash", F.xxhash64("__key", F.lit("landmark")))
    counts = rows.groupBy("__label").count().collect()
    if not counts:
        return Model([], np.zeros((PLACES, 0), np.float32))
    each = max(LEAST_ROWS, min(ROWS_EACH, ROWS_IN_ALL // len(counts)))
    # each language is thinned by its count before its first rows in hash order are taken, so that no task gathers a language
    shares = [(c["__label"], min(1.0, 3.0 * ROWS_EACH / c["count"])) for c in counts]
    share = F.broadcast(df.sparkSession.createDataFrame(shares, "__label string, __share double"))
    thin = rows.join(share, "__label").filter((F.pmod("__hash", F.lit(1 << 20)) / float(1 << 20)) < F.col("__share"))
    first = Window.partitionBy("__label").orderBy("__hash", "__key", F.sha2("__text", 256))
    # a language with few rows has a share of 1, and one with many keeps hundreds, so thinning leaves none out
    chosen = thin.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= each)
    return teach(stored(chosen.select(F.col("__label").alias("label"), F.col("__n").cast("long").alias("n"), F.col("__text").alias("text")), "langid-chosen"))


def teach(chosen: DataFrame) -> Model:
    """The model of label, n (a row's place among those of its label, from 1) and text, none of them null; some rows."""
    taught = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    languages = sorted(taught)
    marks = _landmarks(chosen, languages)
    rows_in_all = sum(taught.values())
    weight = {language: rows_in_all / len(languages) / n for language, n in taught.items()}
    sent = chosen.sparkSession.sparkContext.broadcast((languages, marks.bits, weight))  # LANDMARKS windows of PLACES bits

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, bits, weight = sent.value
        own = Landmarks(languages, bits)
        normal, aim = own.empty()
        number = {language: i for i, language in enumerate(languages)}
        for batch in lean(batches):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = windows(value)
                for at in range(0, len(parts), 64):
                    found, _ = presence(parts[at : at + 64])
                    more = own.products(found, np.full(len(found), number[name]), np.full(len(found), weight[name] / len(parts)))
                    normal, aim = normal + more[0], aim + more[1]
        yield pa.RecordBatch.from_arrays([pa.array([normal.tobytes()], pa.binary()), pa.array([aim.tobytes()], pa.binary())], names=["normal", "aim"])

    normal, aim = marks.empty()
    for r in chosen.select("label", "text").mapInArrow(summed, "normal binary, aim binary").toLocalIterator():
        normal += np.frombuffer(r["normal"]).reshape(normal.shape)
        aim += np.frombuffer(r["aim"]).reshape(aim.shape)
    return marks.solved(normal, aim, rows_in_all)


def _landmarks(chosen: DataFrame, languages: list[str]) -> Landmarks:
    """One window for each of the first rows of every language; LANDMARKS in all, LANDMARKS_EACH for each at least."""
    each = max(LANDMARKS_EACH, -(-LANDMARKS // len(languages)))

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for start, stop in rows_at_most(byte_slices(batch.column(2), 1 << 18), 64):
                numbers = batch.column(1).slice(start, stop - start).to_pylist()
                own = [w[n % len(w)] if (w := windows(t)) else "" for n, t in zip(numbers, texts(batch.column(2), start, stop), strict=True)]
                packed = np.packbits(presence(own)[0].astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, stop - start) for i in (0, 1)), pa.array([r.tobytes() for r in packed], pa.binary())], names=["label", "n", "bits"])

    found = chosen.filter(F.col("n") <= each).select("label", "n", "text").mapInArrow(bits, "label string, n long, bits binary")
    taken = sorted((r["n"], r["label"], bytes(r["bits"])) for r in found.toLocalIterator())
    return Landmarks(languages, np.frombuffer(b"".join(b for *_, b in taken), np.uint8).reshape(len(taken), -1))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, lang_pred string, score double for every row, from its whole text alone.

    lang_pred is a learned language, the first in order on ties, or `und` with score 0 where text is null or has no
    letter, or the model no languages. score is the regression's value for it, held to 0 to 1. Repeated rows and null keys stay as they are; an
    empty table gives no rows; other columns are not read. A text that is kept goes to the workers once.
    """
    names = [key, *keep]
    kept = text in names and isinstance(df.schema[text].dataType, T.StringType)
    at = names.index(text) if kept else len(names)
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.weights))  # PLACES numbers for each language

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in lean(batches):
            column = batch.column(at)
            for start, stop in rows_at_most(byte_slices(column, 1 << 18), 64):
                s, letters = own.scores(texts(column, start, stop))
                if not own.languages:
                    s, letters = np.zeros((stop - start, 1)), np.zeros(stop - start)
                best = s.argmax(1)
                top = np.clip(s[np.arange(len(s)), best], 0, 1).astype(float)
                pred = [own.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[: len(names)]), pa.array(pred, pa.string()), pa.array(np.where(letters, top, 0.0))], names=schema.names)

    return df.select(*names, *([] if kept else [F.col(text).cast("string").alias("__text")])).mapInArrow(scored, schema)


def rows_at_most(ranges: Iterable[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
    for start, stop in ranges:
        for at in range(start, stop, n):
            yield at, min(at + n, stop)
