"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, texts
from .pretokens import Chunks

#: ASCII or Latin-1 letters, then perhaps ASCII punctuation without an apostrophe or a sign of special strings.
WORD = re.compile(r"([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([.,;:!?)\]\"]*)")


class Lengths:
    """Token counts of chunks by one tokenizers file; the library sees each distinct lower-case word of a worker once."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[str, int] = {}
        self.memo = Chunks(self._chunks)

    def _chunks(self, chunks: list[str]) -> tuple[list[int], list[int], list[int]]:
        """mark is a chunk's number of tokens. A space or a line end ends every pre-token and yields none itself."""
        if len(self.words) > self.most:
            self.words.clear()
        split = [[w for w in c.replace("\n", " ").split(" ") if w] for c in chunks]
        simple = [WORD.fullmatch(w[0]) if len(w) == 1 else None for w in split]
        # letters and then one run of punctuation are two pre-tokens; the letters count alike in either case
        units = [(m[1].lower(), m[2]) if m else tuple(w) for m, w in zip(simple, split, strict=True)]
        words = self.words
        asked = list({u for unit in units for u in unit if u and u not in words})
        words.update(zip(asked, map(len, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)), strict=True))
        count = words.__getitem__
        return [], [0] * len(chunks), [sum(count(u) for u in unit if u) for unit in units]

    def count(self, text: str) -> int:
        return sum(int(self.memo.mark[run].sum()) for run in self.memo.runs(text))


@functools.lru_cache(maxsize=1)
def lengths(path: str) -> Lengths:
    """One for each worker."""
    return Lengths(path)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """keep, n_bytes long, n_tokens long, over_limit boolean for every row.

    vocabulary is the path of a tokenizers .json file whose pre-tokenizer splits at white space. Special strings
    inside a text are handled as that library does by default; none are added. Batches go to the library by bytes,
    and long texts are cut where a single space stands between two other characters, which no pre-token crosses.
    A chunk that a worker has already encoded is not encoded again.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys are kept as they are; an empty table
    gives no rows. Columns of df that are not named in keep, clashing names included, are not read.
    """
    if not vocabulary.endswith(".json"):
        raise ValueError("pieces of this vocabulary cross white space; give a tokenizers .json file")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lengths(vocabulary).count
        for batch in batches:
            column = batch.column(len(keep))
            n = []
            for start, stop in byte_slices(column):
                n += map(count, texts(column, start, stop))
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], size, pa.array(np.array(n, np.int64))], names=schema.names)

    counted = df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(counts, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
