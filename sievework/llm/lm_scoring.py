"""Cross-entropy difference of two matched n-gram models.

A target and a background bigram model share one vocabulary, every word of the whole corpus, one order and one smoothing.
All counts are over all documents, and every word and bigram counts, those that occur once too. A word's probability mixes
the estimate of its bigram with its own; after a word that a model has not seen, its own stands alone. A document is
part of the corpus that scores it, so what only it holds is less of a surprise to the background.

Documents are gathered in blocks of bounded size. A block sends each of its different words and bigrams once, packed by
ranges of their hashes, to where the whole corpus's counts of a range are summed, and gets the sums back in the same
order; so neither a key nor a document's bigrams travel twice, and a word that every document has costs one entry for
each block. The number of ranges follows the corpus, which bounds what one task holds.

A word and a bigram are known by 64-bit hashes: two of 5e8 different ones share one with a chance of 0.7 %, and would
count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, stored, texts

#: Weight of the bigram estimate where its first word is known.
BIGRAM_WEIGHT = 0.7
#: Words of a block, and words of the corpus for each range of hashes.
BLOCK_WORDS, RANGE_WORDS = 3 << 18, 3 << 18
#: Most target keys that are broadcast; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Words and documents with words, of the background and of the target.
TOTALS = ("n0", "n1", "d0", "d1")
#: The hash of what stands before a document's first word.
START = np.uint64(0x5851F42D4C957F2D)


def words(text: str) -> list[str]:
    """Lower-case words between white space."""
    return text.lower().split()


class Numbers(dict):
    """Small numbers of words in order of their first use; `hashes` gives the hash of each."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        self.hashes.append(int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        self[word] = n = len(self.hashes) - 1
        return n


@dataclass
class Model:
    """counts: range, keys, n0, n1, packed (columns 0 are the background's, 1 the target's); totals: of the whole corpus."""

    counts: DataFrame
    ranges: int
    totals: dict[str, int]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as 8 planes of bytes, so that planes of zeros vanish in compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def blocks(df: DataFrame, key: str, text: str, targets: DataFrame | None = None) -> DataFrame:
    """block, keys, lengths, marks, words, vocabulary, totals for each block of documents, stored.

    words are numbers of the block's own vocabulary, the most frequent first; vocabulary has their hashes.
    """
    docs = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    if targets is None:
        docs = docs.withColumn("__mark", F.lit(False))
    else:
        marks = targets.select(F.col(key).alias("__key")).filter("__key IS NOT NULL").distinct().withColumn("__mark", F.lit(True))
        few = marks.limit(MOST_SENT + 1).count() <= MOST_SENT
        docs = docs.join(F.broadcast(marks) if few else marks, "__key", "left").select("__key", "__text", F.coalesce("__mark", F.lit(False)).alias("__mark"))
    kind = df.schema[key].dataType
    fields = [("block", T.LongType()), ("keys", T.ArrayType(kind)), ("lengths", T.ArrayType(T.IntegerType())), ("marks", T.ArrayType(T.BooleanType())), ("words", T.BinaryType()), ("vocabulary", T.BinaryType()), *((c, T.LongType()) for c in TOTALS)]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, keys, ids, lengths, marked = Numbers(), [], [], [], []
        own, size = TaskContext.get().partitionId() << 33, 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            n, mark = np.array(lengths), pa.concat_arrays(marked)
            target = mark.to_numpy(zero_copy_only=False)
            totals = [n.sum(), n[target].sum(), (n > 0).sum(), (n[target] > 0).sum()]
            whole = [pa.array([own]), _one_list(pa.concat_arrays(keys)), _one_list(pa.array(lengths, pa.int32())), _one_list(mark)]
            packed = [pa.array([rank[flat].astype("<i4").tobytes()]), pa.array([np.array(numbers.hashes, "<u8")[order].tobytes()])]
            return pa.RecordBatch.from_arrays([*whole, *packed, *(pa.array([int(x)]) for x in totals)], names=schema.names)

        for batch in batches:
            for start, stop in byte_slices(batch.column(1)):
                for t in texts(batch.column(1), start, stop):
                    found = list(map(numbers.__getitem__, words(t)))
                    ids.append(np.array(found, np.int32))
                    lengths.append(len(found))
                    size += len(found)
                keys.append(batch.column(0).slice(start, stop - start))
                marked.append(batch.column(2).slice(start, stop - start))
                if size >= BLOCK_WORDS:
                    yield out()
                    numbers, keys, ids, lengths, marked = Numbers(), [], [], [], []
                    own, size = own + 1, 0
        if keys:
            yield out()

    return stored(docs.select("__key", "__text", "__mark").mapInArrow(gathered, schema), "lm-blocks", compression="zstd")


def _one_list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


class Block:
    """A block's different keys, even for words and odd for bigrams, in order; and where each of its words finds them."""

    def __init__(self, ids: bytes, vocabulary: bytes, lengths: np.ndarray):
        ids, h = np.frombuffer(ids, "<i4"), np.frombuffer(vocabulary, "<u8")
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.first = np.zeros(len(ids), bool)
        self.first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        x = np.where(self.first, START, h[np.where(self.first, 0, before)]) * np.uint64(0x9E3779B97F4A7C15) + h[ids] if len(ids) else np.empty(0, np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        pairs, pair = np.unique((x ^ (x >> np.uint64(32))) | np.uint64(1), return_inverse=True)
        keys = np.concatenate([h & ~np.uint64(1), pairs])
        self.keys, place = np.unique(keys, return_inverse=True)  # words that share a hash are one
        self.word, self.pair = place[ids], place[len(h) + pair]
        self.before = np.where(self.first, -1, self.word[np.maximum(np.arange(len(ids)) - 1, 0)]) if len(ids) else ids

    def counts(self, weight: np.ndarray | None = None) -> np.ndarray:
        n = len(self.keys)
        return (np.bincount(self.word, weight, n) + np.bincount(self.pair, weight, n)).astype(np.int64)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges follow the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _dealt(blocks_: DataFrame, ranges: int) -> DataFrame:
    """block, range, keys, n0, n1: a block's keys, packed for each range that has any."""

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, lengths, marks, ids, vocabulary in zip(*batch.columns, strict=True):
                lengths, marks = lengths.values.to_numpy(), marks.values.to_numpy(zero_copy_only=False)
                block = Block(ids.as_py(), vocabulary.as_py(), lengths)
                n0, n1 = block.counts(), block.counts(marks[block.doc].astype(float))
                found, at = np.unique(_range_of(block.keys, ranges), return_index=True)
                rows = list(zip(at, [*at[1:], len(block.keys)], strict=True))
                columns = [[planes(np.diff(block.keys[a:b], prepend=np.uint64(0))) for a, b in rows], *([planes(n[a:b]) for a, b in rows] for n in (n0, n1))]
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(rows), pa.int64()), pa.array(found.astype(np.int64)), *(pa.array(c, pa.binary()) for c in columns)], names=["block", "range", "keys", "n0", "n1"])

    return blocks_.select("block", "lengths", "marks", "words", "vocabulary").mapInArrow(dealt, "block long, range long, keys binary, n0 binary, n1 binary")


class Sums:
    """Counts of a range: of all its rows together."""

    def __init__(self, rows: pa.Table):
        each = [np.cumsum(unplanes(b), dtype=np.uint64) for b in rows.column("keys").to_pylist()]
        self.ends = np.cumsum([0, *map(len, each)])
        self.keys, self.place = np.unique(np.concatenate([*each, np.empty(0, np.uint64)]), return_inverse=True)
        n0, n1 = (np.bincount(self.place, np.concatenate([*map(unplanes, rows.column(c).to_pylist()), np.empty(0, np.uint64)]), len(self.keys)).astype(np.int64) for c in ("n0", "n1"))
        self.new_words = int((self.keys & np.uint64(1) == 0).sum())
        self.n = n0, n1

    def answers(self, n: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
        """Counts n of all keys, packed for each row."""
        return [pa.array([planes(c[self.place[a:b]]) for a, b in zip(self.ends, self.ends[1:], strict=False)], pa.binary()) for c in n]


ANSWER = "block long, range long, n0 binary, n1 binary, new_words long"


def _answered(rows: pa.Table) -> pa.Table:
    """The whole corpus's counts of what each block has sent, in the block's order; new_words once for the range."""
    sums = Sums(rows)
    return pa.table([rows.column("block"), rows.column("range"), *sums.answers(sums.n), pa.array([sums.new_words] + [0] * (len(rows) - 1), pa.int64())], names=["block", "range", "n0", "n1", "new_words"])


def _looked_up(rows: pa.Table, model: pa.Table) -> pa.Table:
    """As _answered, but from a model's counts of the range; 0 for keys that it hasn't."""
    sums, n = Sums(rows), []
    known = np.cumsum(unplanes(model.column("keys")[0].as_py()), dtype=np.uint64) if len(model) else np.empty(0, np.uint64)
    at = np.minimum(np.searchsorted(known, sums.keys), max(len(known) - 1, 0))
    for c in ("n0", "n1"):
        counts = unplanes(model.column(c)[0].as_py()).astype(np.int64) if len(known) else np.zeros(1, np.int64)
        n.append(counts[at] * (known[at] == sums.keys) if len(known) else np.zeros(len(sums.keys), np.int64))
    return pa.table([rows.column("block"), rows.column("range"), *sums.answers(tuple(n)), pa.array([0] * len(rows), pa.int64())], names=["block", "range", "n0", "n1", "new_words"])


def _totals(blocks_: DataFrame) -> dict[str, int]:
    row = blocks_.agg(*(F.sum(c).alias(c) for c in TOTALS)).first()
    return {k: v or 0 for k, v in row.asDict().items()}


def _scored(blocks_: DataFrame, answers: DataFrame, totals: dict[str, int], key: str) -> DataFrame:
    kind = blocks_.schema["keys"].dataType.elementType
    fields = [T.StructField(key, kind), T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss"))]
    schema = T.StructType(fields)

    def scored(block: pa.Table, counts: pa.Table) -> pa.Table:
        if not len(block):
            return schema_table([], [[], [], []])
        lengths = block.column("lengths")[0].values.to_numpy()
        own = Block(block.column("words")[0].as_py(), block.column("vocabulary")[0].as_py(), lengths)
        counts = counts.sort_by("range")
        loss = []
        for i in (1, 0):
            n = np.concatenate([*map(unplanes, counts.column(f"n{i}").to_pylist()), np.empty(0, np.uint64)]).astype(float)
            p = (n[own.word] + 1) / (totals[f"n{i}"] + totals["size"])
            before = np.where(own.first, totals[f"d{i}"], n[own.before])
            p = np.where(before > 0, BIGRAM_WEIGHT * n[own.pair] / np.maximum(before, 1) + (1 - BIGRAM_WEIGHT) * p, p)
            loss.append(np.bincount(own.doc, -np.log(p), len(lengths)) / np.maximum(lengths, 1))
        return schema_table(block.column("keys")[0].values, [lengths.astype(np.int64), *loss])

    def schema_table(keys, columns) -> pa.Table:
        return pa.table([pa.array(keys), *(pa.array(np.asarray(c), t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64()), strict=True))], names=schema.names)

    together = blocks_.select("block", "keys", "lengths", "words", "vocabulary").groupBy("block").cogroup(answers.select("block", "range", "n0", "n1").groupBy("block"))
    return together.applyInArrow(scored, schema).withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def _ranges(totals: dict[str, int]) -> int:
    return max(1, -(-totals["n0"] // RANGE_WORDS))


def train(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Background counts over all rows of df, target counts over those whose key is in `targets`, to score other documents.

    Null texts and null keys count for the background only. Keys repeated in targets count once. Without any word both
    models are uniform; columns not named are not read.
    """
    corpus = blocks(df, key, text, targets)
    totals = _totals(corpus)

    def summed(rows: pa.Table) -> pa.Table:
        sums = Sums(rows)
        columns = [planes(np.diff(sums.keys, prepend=np.uint64(0))), *map(planes, sums.n)]
        return pa.table([rows.column("range").slice(0, 1), *(pa.array([c], pa.binary()) for c in columns), pa.array([sums.new_words], pa.int64())], names=["range", "keys", "n0", "n1", "new_words"])

    dealt = _dealt(corpus, ranges := _ranges(totals))
    counts = stored(dealt.groupBy("range").applyInArrow(summed, "range long, keys binary, n0 binary, n1 binary, new_words long"), "lm-counts")
    return Model(counts.drop("new_words"), ranges, _sized(totals, counts))


def _sized(totals: dict[str, int], counts: DataFrame) -> dict[str, int]:
    """With the size of the vocabulary, the unknown word included."""
    return totals | {"size": (counts.agg(F.sum("new_words")).first()[0] or 0) + 1}


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words long, target_loss, background_loss, difference (target less background) double for every row.

    Losses are means of nats for each word of the whole text; the smaller the difference, the more a text is like the
    target. Words that the corpus hasn't are one unknown word. Texts without words, null ones included, have 0 words and
    losses of 0. Repeated rows and null keys stay as they are; an empty table gives no rows; columns not named are not
    read.
    """
    own = blocks(df, key, text)
    met = _dealt(own, model.ranges).groupBy("range").cogroup(model.counts.groupBy("range"))
    return _scored(own, met.applyInArrow(_looked_up, ANSWER), model.totals, key)


def score_corpus(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What score(df, train(df, targets)) gives, with each key moved once: the sums go straight back to the blocks."""
    corpus = blocks(df, key, text, targets)
    totals = _totals(corpus)
    answers = stored(_dealt(corpus, _ranges(totals)).groupBy("range").applyInArrow(_answered, ANSWER), "lm-answers", compression="zstd")
    return _scored(corpus, answers, _sized(totals, answers), key)
