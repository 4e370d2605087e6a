"""Packing: order-preserving dynamic programming over document, sentence and forced cuts.

Each task packs the token stream of its rows in their order, a bounded stretch at a time, so that nothing is shuffled
and no task holds more than a stretch and one document. A window ends at a document's end at no cost, at a sentence's
end at a small one and elsewhere, where text has no sentence ends, at a large one; to that comes its padding. The best
windows follow from best[j] = min(best[i] + pos[i]) + capacity - pos[j] + penalty[j] over the i within capacity,
which a queue kept in increasing order yields in constant time, and from windows that need no padding.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import load_ranks
from .common import byte_slices, lean, texts
from .pretokens import SAFE, RUN_CHARS

#: Costs of a cut, in tokens of padding: for each window, inside a document after a sentence, elsewhere.
WINDOW_COST, SENTENCE_COST, FORCED_COST = 16, 1, 32
#: In a sentence that fits no window, a forced cut is offered this often.
FORCED_EVERY = 128
#: Tokens that are packed at a time.
STRETCH = 400_000


def best_cuts(pos: list[int], penalty: list[int], capacity: int) -> list[int]:
    """Indices of the cuts of least total cost, first and last included; neighbours lie at most capacity apart.

    A window's cost is WINDOW_COST, its end's penalty and its padding up to capacity; a window whose length is a power
    of two has no padding.
    """
    at = np.asarray(pos)
    exact: dict[int, list[int]] = {}
    p = 64
    while p < capacity:
        i = np.searchsorted(at, at - p)
        for j in np.nonzero(at[np.minimum(i, len(at) - 1)] == at - p)[0].tolist():
            exact.setdefault(j, []).append(int(i[j]))
        p *= 2
    n = len(pos)
    best, back, key = [0] * n, [0] * n, [0] * n  # key[i] = best[i] + pos[i]
    queue = deque([0])
    for j in range(1, n):
        here = pos[j]
        while here - pos[queue[0]] > capacity:
            queue.popleft()
        i = queue[0]
        cost = key[i] + capacity - here
        for k in exact.get(j, ()):
            if best[k] < cost:
                i, cost = k, best[k]
        best[j] = cost = cost + penalty[j] + WINDOW_COST
        back[j] = i
        key[j] = value = cost + here
        while queue and key[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Encoder:
    """Ids of whole texts as tokenizers gives them for a byte-level BPE .json file.

    The ranks give the same ids sooner; a text that holds one of the file's added special strings, which only the
    .json file knows, goes to tokenizers itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = list(added)
        largest = max([*model["model"]["vocab"].values(), *added.values()])
        del model
        ranks = load_ranks(ranks_path)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(largest + 1, len(ranks))
        self.ends, self.opens = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?", b"\n")) or b"\n" in token
            self.opens[i] = token[:1] in b" \n\t\r"

    @functools.cached_property
    def whole(self):
        """The file's own tokenizer, read when a text first needs it, as it fills some 30 MB of a worker."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.json_path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def ids(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > RUN_CHARS and (cut := SAFE.search(text, at + RUN_CHARS)):
                end = cut.start()
            part = text[at:end]
            if any(s in part for s in self.special):
                parts.append(np.array(self.whole.encode(part, add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self.fast.encode_to_numpy(part, disallowed_special=()))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of tokens after which a sentence or a line is over."""
        return np.nonzero(self.ends[ids[:-1]] & (self.opens[ids[1:]] | self.opens[ids[:-1]]))[0] + 1


@functools.lru_cache(maxsize=1)
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(json_path, ranks_path, pattern)


class Packer:
    """The tokens of documents that are not yet packed, and how to pack them."""

    def __init__(self, encoder: Encoder, capacity: int, end_id: int, first_sequence: int):
        self.encoder, self.capacity, self.end_id, self.sequence = encoder, capacity, end_id, first_sequence
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.pos: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.cost: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.docs: list[tuple] = []  # key, first token in the stretch (negative: before it), tokens

    def add(self, key: object, text: str) -> None:
        ids = self.encoder.ids(text)
        ends = self.encoder.sentence_ends(ids)
        n = len(ids) + 1
        cuts = np.append(ends, n)
        cost = np.full(len(cuts), SENTENCE_COST)
        cost[-1] = 0
        gaps = np.diff(cuts, prepend=0)
        if gaps.max() > self.capacity:
            every = min(FORCED_EVERY, self.capacity)
            more = np.concatenate([np.arange(c - g + every, c, every) for c, g in zip(cuts.tolist(), gaps.tolist(), strict=True) if g > self.capacity])
            cuts, cost = np.append(cuts, more), np.append(cost, np.full(len(more), FORCED_COST))
            order = np.argsort(cuts, kind="stable")
            cuts, cost = cuts[order], cost[order]
        self.ids += [ids.astype("<u4"), np.array([self.end_id], "<u4")]
        self.docs.append((key, self.size, n))
        self.pos.append(cuts + self.size)
        self.cost.append(cost)
        self.size += n

    def flush(self, last: bool) -> list[tuple]:
        """The pieces of all windows that later documents can't change: key, start, length, crc, tokens, sequence, offset."""
        if not self.size:
            return []
        ids, pos, cost = np.concatenate(self.ids), np.concatenate(self.pos), np.concatenate(self.cost)
        ends = pos[best_cuts(pos.tolist(), cost.tolist(), self.capacity)]
        if not last:
            ends = ends[:-4] if len(ends) > 8 else ends[:1]
        done = int(ends[-1])
        first = np.array([d[1] for d in self.docs])
        starts = np.unique(np.concatenate([ends[:-1], np.maximum(first[first < done], 0)])) if done else np.empty(0, np.int64)
        stops = np.append(starts[1:], done)
        window = np.searchsorted(ends, starts, "right") - 1
        doc = np.searchsorted(first, starts, "right") - 1
        out = []
        for s, e, w, d in zip(starts.tolist(), stops.tolist(), window.tolist(), doc.tolist(), strict=False):
            key, begin, tokens = self.docs[d]
            out.append((key, s - begin, e - s, zlib.crc32(ids[s:e]), tokens, self.sequence + w, s - int(ends[w])))
        self.sequence += len(ends) - 1
        kept = int(np.searchsorted(pos, done))
        self.ids, self.size = [ids[done:]], len(ids) - done
        self.pos, self.cost = [pos[kept:] - done], [cost[kept:]]
        self.docs = [(k, b - done, n) for k, b, n in self.docs if b + n > done]
        return out


def pack(df: DataFrame, json_path: str, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of at most capacity tokens: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and then end_id; each id lies in exactly one piece, and pieces follow each
    other without gaps in a sequence. The rows of an input partition keep their order; which rows share a sequence
    follows from how the input is split, as in any scan, while the pieces of each document always cover it exactly.

    Null text counts as empty: the one token end_id. Rows with null or repeated keys are documents like others; an empty
    table gives no rows; columns not named are not read. Any length of text is cut, never dropped.
    """
    schema = T.StructType(
        [df.schema[key]] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(encoder(json_path, ranks_path, pattern), capacity, end_id, TaskContext.get().partitionId() << 36)
        for batch in lean(batches):
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            for start, stop in byte_slices(column):
                for k, t in zip(keys[start:stop], texts(column, start, stop), strict=True):
                    packer.add(k, t)
                    if packer.size > STRETCH and (rows := packer.flush(last=False)):
                        yield frame(rows)
        if rows := packer.flush(last=True):
            yield frame(rows)

    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(packed, schema)
