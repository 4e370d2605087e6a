"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Two different words are one inserted, deleted or replaced code point apart exactly when their common prefix and their
common suffix together reach the longer length less one, m. Then one of both reaches half of m, rounded up. So words
meet only where they share such a prefix or suffix: small groups are packed into bins, a group beyond BLOCK words is
dealt into blocks and every pair of its blocks is a task of its own. Inside a task, blocks of words stand as padded
matrices of code points, aligned left for prefixes and right for suffixes, and whole blocks are compared with each other.

A pair belongs to one m, and to the suffix group only if its prefix is too short for the prefix group, so each pair is
found once and no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Most words of a group that are compared in one task.
BLOCK = 2048
#: Keyed words of a bin of small groups, and their code points.
BIN_ROWS, BIN_POINTS = 1 << 14, 1 << 21
#: Rows and code points of a tile's side.
SIDE, SIDE_POINTS = 256, 1 << 21
#: Most groups, or links from a word to its form, that are broadcast (about 40 bytes each and the words).
MOST_SENT = 200_000

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """Maximal runs of ASCII and Latin-1 letters (with the two signs among them), A to Z in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))


def with_planted_slips(key: Column, run: Column, one_in: int) -> Column:
    """run, or without one code point where one_in divides the CRC-32 of `<key>:<run>`; which one follows from it too."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, slips_one_in: int | None = 97) -> DataFrame:
    """word, n long: distinct runs of at least least_length code points that occur least_count times in all texts.

    slips_one_in plants slips (see with_planted_slips); None takes the runs as they are. Null texts have no runs, a null
    key counts as empty; each repeated row counts; other columns are not read.
    """
    each = df.select(F.col(key).alias("__key"), F.explode(runs(F.col(text).cast("string"))).alias("__run"))
    word = F.col("__run") if slips_one_in is None else with_planted_slips(F.col("__key"), F.col("__run"), slips_one_in)
    found = each.filter(F.length("__run") >= least_length).select(word.alias("word")).filter(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(words: DataFrame) -> DataFrame:
    """m, suffix, key, word, n: the four groups of each word, as the longer and as the shorter of a pair."""
    size = F.length("word")
    longer, shorter = size - 1, size
    half = lambda m: F.ceil(m / 2).cast("int")

    def group(m: Column, suffix: bool) -> Column:
        part = F.substring(F.col("word"), size - half(m) + 1 if suffix else F.lit(1), half(m))
        return F.struct(m.alias("m"), F.lit(suffix).alias("suffix"), F.xxhash64(m, F.lit(suffix), part).alias("key"))

    groups = F.array(*(group(m, suffix) for m in (longer, shorter) for suffix in (False, True)))
    return words.select("word", "n", F.explode(groups).alias("g")).select("g.*", "word", "n")


def _few(df: DataFrame) -> DataFrame:
    """With a broadcast hint where the rows are few; a stored table, as it is read twice."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def _dealt(keyed: DataFrame, rows: int, points: int) -> DataFrame:
    """keyed with bin, i, j (a task), left and right (which sides of the task's pairs a word stands on)."""
    bins = max(1, -(-rows // BIN_ROWS), -(-points // BIN_POINTS))
    large = stored(keyed.groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("blocks")), "spelling-large")
    met = keyed.join(_few(large), "key", "left")
    small = met.filter("blocks IS NULL").select("m", "suffix", "key", "word", "n", F.pmod("key", F.lit(bins)).alias("bin"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    own = F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("own")
    pairs = met.filter("blocks IS NOT NULL").select("*", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    split = pairs.select("m", "suffix", "key", "word", "n", F.col("key").alias("bin"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    return small.unionByName(split)


class Side:
    """A block of words as matrices of code points, padded with 0 at the right (prefixes) and at the left (suffixes)."""

    def __init__(self, words: list[str], groups: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.groups, self.left, self.right = groups, left, right
        self.sizes = np.array(list(map(len, words)), np.int32)
        widest = int(self.sizes.max())
        self.front = np.array([w.ljust(widest, "\0") for w in words], f"<U{widest}").view("<u4").reshape(len(words), widest)
        self.back = np.array([w.rjust(widest, "\0") for w in words], f"<U{widest}").view("<u4").reshape(len(words), widest)[:, ::-1]


def common_lengths(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of a with every row of b, at most `most`."""
    equal = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones(equal.shape, bool)
    for at in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, at, None] == b[None, :, at]
        if not alive.any():
            break
        equal += alive
    return np.minimum(equal, most)


def _cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SIDE rows and SIDE_POINTS padded code points; one row at least."""
    at = 0
    while at < len(sizes):
        rows = max(1, min(SIDE, len(sizes) - at))
        while rows > 1 and rows * int(sizes[at : at + rows].max()) > SIDE_POINTS:
            rows //= 2
        yield at, at + rows
        at += rows


LINK = "word string, n long, other string, n_other long"


def _tile(rows: pa.Table) -> pa.Table:
    """Both directions of every link that a task's words have with each other."""
    rows = rows.sort_by([("m", "ascending"), ("suffix", "ascending"), ("key", "ascending"), ("left", "ascending")])
    words = np.array(rows.column("word").to_pylist(), object)
    n, m, suffix, key, left, right = (rows.column(c).to_numpy() for c in ("n", "m", "suffix", "key", "left", "right"))
    group = np.cumsum(np.r_[0, (m[1:] != m[:-1]) | (suffix[1:] != suffix[:-1]) | (key[1:] != key[:-1])])
    blocks = [(at, Side(list(words[at:end]), group[at:end], left[at:end], right[at:end])) for at, end in _cut(np.array(list(map(len, words)), np.int64))]
    first, second = [], []
    for x, (at, a) in enumerate(blocks):
        for to, b in blocks[x:]:
            if b.groups[0] > a.groups[-1]:
                break
            longest = np.maximum(a.sizes[:, None], b.sizes[None, :])
            wanted = (a.groups[:, None] == b.groups[None, :]) & (longest == m[at : at + len(a.sizes), None] + 1)
            wanted &= (a.left[:, None] & b.right[None, :]) | (a.right[:, None] & b.left[None, :])
            if at == to:
                wanted = np.triu(wanted, 1)
            if not wanted.any():
                continue
            shortest = np.minimum(a.sizes[:, None], b.sizes[None, :])
            before = common_lengths(a.front, b.front, shortest)
            near = wanted & (before + common_lengths(a.back, b.back, shortest) >= longest - 1)
            near &= ~suffix[at : at + len(a.sizes), None] | (before < longest // 2)  # half of m, rounded up
            i, j = np.nonzero(near)
            first.append(i + at)
            second.append(j + to)
    i, j = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (first, second))
    a, b = np.r_[i, j], np.r_[j, i]
    return pa.table([pa.array(words[a], pa.string()), pa.array(n[a]), pa.array(words[b], pa.string()), pa.array(n[b])], names=["word", "n", "other", "n_other"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, n_other: every ordered pair of different words one edit apart. words: word (distinct), n; each 2 code points long at least."""
    keyed = _keyed(words)
    rows, points = words.agg(F.count("*") * 4, F.coalesce(F.sum(F.length("word")), F.lit(0)) * 4).first()
    return _dealt(keyed, rows, points).groupBy("bin", "i", "j").applyInArrow(_tile, LINK)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms ends. The way is halved in each round, as each root is replaced by its own root."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.join(_few(at.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        on = stored(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = on.select("word", "root")
        if on.filter("moved").isEmpty():
            return at


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word. words: word (distinct, not null), n.

    form is the near word (one edit apart) of largest n, the smallest in code-point order of several, if that n is at
    least `times` (more than 1) the word's own; else null, as is form_n, its n. root: from word, forms followed to the
    last; word itself without one. n_near: near words, 0 if none. An empty table gives no rows.
    """
    if times <= 1:
        raise ValueError("forms must have more occurrences than their words, or they would go in circles")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("fewest"), F.col("other").alias("form"))).alias("best"))
    good = -F.col("best.fewest") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, -F.col("best.fewest")).alias("form_n")
    )
    found = stored(found, "spelling-found")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", **counting) -> DataFrame:
    """group_variants over the words of all whole texts (word_counts)."""
    return group_variants(stored(word_counts(df, key, text, **counting), "spelling-words"))
