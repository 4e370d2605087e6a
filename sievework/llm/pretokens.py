"""Memoised encoding of whitespace-delimited chunks.

Natural text repeats its words, so a tokenizer has to see each distinct chunk once per worker and not once per
occurrence. A text is cut before every single space that stands between two other characters; no pre-token of the
patterns used here crosses such a place, so the pieces of the chunks, joined, are the pieces of the text.
The memo is emptied when it is full, so that a worker's memory is bounded whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

#: A space between two characters that are not white space.
SAFE = regex.compile(r"(?<=\S) (?=\S)")
#: Longer texts are cut into runs of about so many characters.
RUN_CHARS = 1 << 18
#: Marks the first chunk of a text, which has no space before it; no text in UTF-8 holds this character.
HEAD = "\ud800"


class Chunks(dict):
    """chunk -> number; numbers of unseen chunks are dealt out on lookup and encoded in one batch by settle().

    encode: list of strings -> (ids of all, one after another; how many each has; a mark for each, any small integer).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[int], list[int], list[int]]], most: int = 500_000, most_chars: int = 16_000_000):
        super().__init__()
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.size = self.chars = self.used = 0
        self.flat = np.empty(1 << 16, np.int32)
        self.start = np.empty(1 << 12, np.int64)
        self.length = np.empty(1 << 12, np.int32)
        self.mark = np.empty(1 << 12, np.int32)
        self.ragged = np.empty(1 << 12, bool)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = self.size
        self.size = n + 1
        self.new.append(chunk)
        return n

    def settle(self) -> None:
        """Encode what lookups have found to be new."""
        if not self.new:
            return
        new, self.new = self.new, []
        at, end = self.size - len(new), self.size
        if end > len(self.start):
            more = max(end, 2 * len(self.start)) - len(self.start)
            for name in ("start", "length", "mark", "ragged"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.empty(more, old.dtype)]))
        ids, lengths, marks = self.encode([c[1:] if c.startswith(HEAD) else " " + c for c in new])
        top = self.used + len(ids)
        if top > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(top, len(self.flat)), np.int32)])
        self.flat[self.used : top] = ids
        self.length[at:end], self.mark[at:end] = lengths, marks
        ends = np.cumsum(lengths)
        self.start[at:end] = self.used + ends - lengths
        self.ragged[at:end] = [not c or c[0].isspace() or c[-1].isspace() or c == HEAD or c.startswith(HEAD) and c[1].isspace() for c in new]
        self.used = top
        self.chars += sum(map(len, new))

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of a text's chunks, in order, a run of the text at a time; use each before the next is asked for."""
        at, head = 0, True
        while at < len(text):
            end = len(text)
            if end - at > RUN_CHARS and (cut := SAFE.search(text, at + RUN_CHARS)):
                end = cut.start()
            yield self._numbers(text[at:end], head)
            at, head = end + 1, False

    def _numbers(self, text: str, head: bool) -> np.ndarray:
        if self.size > self.most or self.chars > self.most_chars:
            self.reset()
        found = self._look_up(text.split(" "), head)
        if len(found) > 1 and self.ragged[found].any():
            found = self._look_up(SAFE.split(text), head)
        return found

    def _look_up(self, parts: list[str], head: bool) -> np.ndarray:
        if head:
            parts[0] = HEAD + parts[0]
        got = list(map(self.__getitem__, parts))
        self.settle()
        return np.array(got, np.int32)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these chunks, one after another."""
        n = self.length[numbers]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.int32)
        at = np.arange(ends[-1]) + np.repeat(self.start[numbers] - (ends - n), n)
        return self.flat[at]
