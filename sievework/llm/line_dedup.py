"""Near-duplicate lines by a segment-partition edit join.

A line of which at most k characters are edited keeps one of k + 1 segments whole. So each line is indexed by its
segments, keyed by its length and the segment's number, and probes the lengths up to its own with the substrings that can
start where the segment would be. What meets is verified by a banded bit-parallel edit distance. Lines are deduplicated
first and travel as hashes of their segments; the characters of those that have met are fetched for the verification.
Before they are, each line is held against two broadcast tables of residues of the hashes that have met, of at most
RESIDUES rows each, so that text of other lines hardly moves. What passes by chance is left out by the join that follows.

A segment that at most FEW different lines have is met pair by pair. The lines of a more frequent one are cut into
blocks, and each two blocks are compared in a task that gives the number of links of each line and only the links that
join what others have not joined: rows stand for a line in a block, never for a pair.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored
from .graph import components, forest

#: Edits that two lines may be apart: EDITS at most, and one for each EACH characters of the shorter line.
EDITS, EACH = 2, 6
#: Different lines of a segment that are met pair by pair; more are compared in blocks of so many lines and characters.
FEW, BLOCK, BLOCK_CHARS = 16, 256, 2_000_000
#: Bytes of lines that are hashed together, and characters whose powers are held.
TOGETHER_BYTES = 1 << 19
#: Base of the hash of a substring, sum of character * BASE^place modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Residues of a hash: the most rows of a table that is broadcast.
RESIDUES = 1 << 20
#: Lines up to this length are verified many at once.
TOGETHER = 400


def allowed(length: int, edits: int = EDITS) -> int:
    """Edits that a line of this length and a longer one may be apart."""
    return min(edits, length // EACH)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 segments of a line; the last ones are longer by one where it doesn't divide."""
    short, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = short + (i >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, own: int, edits: int) -> Iterator[tuple[int, int, int]]:
    """Segment number, and start and length of the substrings of a line of `own` characters that can be that segment of a shorter line.

    Seen from the left, segment i is shifted by at most i edits; seen from the right, by what is left of them.
    """
    apart = own - length
    for i, (at, n) in enumerate(segments(length, edits)):
        low = max(0, at - i, at + apart - (edits - i))
        high = min(own - n, at + i, at + apart + (edits - i))
        for start in range(low, high + 1):
            yield i, start, n


@functools.lru_cache(maxsize=50_000)
def places(length: int, own: int, edits: int) -> tuple[tuple[int, int, int], ...]:
    return tuple(probes(length, own, edits))


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: bit-parallel, in a band of 2 edits + 1 diagonals.

    Equal ends are left off first. Bit d of reach[e] says that diagonal d - edits can be followed this far with e edits.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    at = _common(a, b, n)
    a, b = a[at:], b[at:]
    n = min(len(a), len(b))
    tail = _common(a[::-1], b[::-1], n)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    band = 2 * edits + 1
    full = (1 << band) - 1
    reach = [0] * (edits + 1)
    reach[0] = 1 << edits
    for e in range(1, edits + 1):  # characters of b taken before any of a
        reach[e] = reach[e - 1] | reach[e - 1] << 1 & full
    for i, c in enumerate(a):
        match = 0
        for d in range(band):  # diagonal d pairs a[i] with b[i + d - edits]
            j = i + d - edits
            if 0 <= j < len(b) and b[j] == c:
                match |= 1 << d
        before = reach
        reach = [before[0] & match]
        for e in range(1, edits + 1):
            new = before[e] & match  # taken as equal
            new |= before[e - 1]  # replaced
            new |= before[e - 1] >> 1  # left out of a
            new |= reach[e - 1] << 1 & full  # put in from b
            reach.append(new)
        if not any(reach):
            return False
    return bool(reach[edits] >> (len(b) - len(a) + edits) & 1)


def _common(a: str, b: str, n: int) -> int:
    """Length of the common beginning, at most n, by halving."""
    low = 0
    while low < n:
        mid = (low + n + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid - 1
    return low


def within_many(a: list[str], b: list[str], allowed_: np.ndarray, edits: int) -> np.ndarray:
    """within() for many pairs at once; each may have its own number of edits, up to `edits`."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a), bool)
    fits = np.abs(la - lb) <= allowed_
    for i in np.flatnonzero(fits & (np.maximum(la, lb) > TOGETHER)).tolist():
        out[i] = within(a[i], b[i], int(allowed_[i]))
    rest = np.flatnonzero(fits & (np.maximum(la, lb) <= TOGETHER))
    rest = rest[np.argsort(-la[rest], kind="stable")]
    full = np.uint8((1 << (2 * edits + 1)) - 1)
    for at in range(0, len(rest), 4096):
        own = rest[at : at + 4096]
        n, width = len(own), int(la[own[0]])
        left = _matrix([a[i] for i in own], la[own], width, 0, 0xFFFFFFFE)
        right = _matrix([b[i] for i in own], lb[own], width + 2 * edits + 1, edits, 0xFFFFFFFF)
        reach = [np.full(n, 1 << edits, np.uint8)]
        for e in range(1, edits + 1):
            reach.append(reach[e - 1] | (reach[e - 1] << 1 & full))
        live = np.searchsorted(-la[own], -np.arange(width), side="left")  # lines longer than each place
        for i in range(width):
            k = int(live[i])
            match = np.zeros(k, np.uint8)
            for d in range(2 * edits + 1):
                match |= (left[:k, i] == right[:k, i + d]).view(np.uint8) << np.uint8(d)
            before = [r[:k].copy() for r in reach]
            reach[0][:k] = before[0] & match
            for e in range(1, edits + 1):
                reach[e][:k] = before[e] & match | before[e - 1] | before[e - 1] >> 1 | (reach[e - 1][:k] << 1 & full)
        last = np.stack(reach)[allowed_[own], np.arange(n)]
        out[own] = last >> (lb[own] - la[own] + edits).astype(np.uint8) & 1
    return out


def _matrix(lines: list[str], sizes: np.ndarray, width: int, start: int, pad: int) -> np.ndarray:
    """A row of character codes for each line, from column `start` on."""
    out = np.full((len(lines), width), pad, np.uint32)
    place = np.arange(width)[None, :] - start
    out[(place >= 0) & (place < sizes[:, None])] = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _lines(docs: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """__key, line_no, line, id: a 64-bit hash of the line's characters, moved on where different lines share one."""
    lines = docs.select("__key", F.posexplode(F.split("__text", "\n")).alias("line_no", "line")).withColumn("id", F.xxhash64("line"))
    if clashes is None:
        return lines
    moved = lines.withColumn("digest", F.sha2("line", 256)).join(clashes, ["id", "digest"], "left")
    return moved.withColumn("id", F.col("id") + F.coalesce("step", F.lit(0))).drop("digest", "step")


def _clashes(docs: DataFrame) -> DataFrame | None:
    """id, digest, step: what sets lines apart whose hash is the same and whose SHA-256 is not; None without any, as nearly always."""
    lines = docs.select(F.explode(F.split("__text", "\n")).alias("line")).select(F.xxhash64("line").alias("id"), F.sha2("line", 256).alias("digest"))
    shared = lines.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most")
    shared = stored(shared.select("id"), "line-clashes")
    if shared.isEmpty():
        return None
    different = lines.join(shared, "id", "left_semi").distinct()
    return different.join(different.withColumnRenamed("digest", "other"), "id").groupBy("id", "digest").agg(F.count_if(F.col("other") < F.col("digest")).alias("step"))


@functools.lru_cache(maxsize=1)
def _letter_bits() -> np.ndarray:
    """Of each code point, one of 31 bits."""
    return (np.int32(1) << np.arange(31, dtype=np.int32))[np.arange(0x110000) % 31]


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers from 0 to n, modulo 2^64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (BASE, INVERSE))


def _hashes(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What gives the hashes of substrings by their starts and lengths: from sums up to each place, or in parts where these would be too many."""
    power, inverse = _powers(TOGETHER_BYTES)
    if len(codes) <= TOGETHER_BYTES:
        upto = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * power[: len(codes)], out=upto[1:])
        return lambda start, size: (upto[start + size] - upto[start]) * inverse[start]

    def one(start: int, size: int) -> int:
        total = 0
        for at in range(0, size, TOGETHER_BYTES):
            part = codes[start + at : start + min(at + TOGETHER_BYTES, size)]
            total += pow(BASE, at, 1 << 64) * int((part * power[: len(part)]).sum())
        return total % (1 << 64)

    return lambda start, size: np.array([one(a, n) for a, n in zip(start.tolist(), size.tolist(), strict=True)], np.uint64)


def _line_keys(codes: np.ndarray, start: np.ndarray, size: np.ndarray, edits: int, probing: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of lines and a key for each: of all their segments in order, and of the other places that they probe.

    A key is a hash of the shorter line's length, the segment's number and its characters; the last bit is 0 for a
    line's own segments. A line probes these, too, so no further row says so.
    """
    hashed = _hashes(codes)
    for apart in range(edits + 1 if probing else 1):
        length = size - apart
        allowed_ = np.minimum(edits, length // EACH)
        for most in range(apart, edits + 1):
            lines = np.flatnonzero((length >= EACH) & (allowed_ == most))
            if not len(lines):
                continue
            short, longer = np.divmod(length[lines], most + 1)
            for i in range(most + 1):  # as in segments() and probes()
                n = short + (i >= most + 1 - longer)
                at = i * short + np.maximum(0, i - (most + 1 - longer))
                seed = (length[lines] * 16 + i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                for shift in range(max(-i, apart - (most - i)), min(i, apart + most - i) + 1):
                    own = apart == shift == 0
                    if not own and not probing:
                        continue
                    fits = (at + shift >= 0) & (at + shift + n <= size[lines])
                    each = slice(None) if fits.all() else fits
                    h = hashed(start[lines[each]] + at[each] + shift, n[each]) + seed[each]
                    for right, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
                        h = (h ^ (h >> np.uint64(right))) * np.uint64(factor)
                    h = (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFFFFFE) | np.uint64(not own)
                    yield lines[each], h.view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _segment_keys(lines: list[str], edits: int) -> list[list[int]]:
    """The keys of each line's segments in order, without the last bit, which is 0."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    out: list[list[int]] = [[] for _ in lines]
    for own, key in _line_keys(_codes("".join(lines)), np.cumsum(size) - size, size, edits, probing=False):
        for i, k in zip(own.tolist(), key.tolist(), strict=True):
            out[i].append(k >> 1)
    return out


def _parts(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Row ranges of a string column with about TOGETHER_BYTES each, their bytes, and where each row begins in them, and the last ends."""
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, int(at[start]) + TOGETHER_BYTES, "right")) - 1)
        yield start, stop, data[int(at[start]) : int(at[stop])].to_pybytes() if at[stop] > at[start] else b"", at[start : stop + 1].astype(np.int64) - int(at[start])
        start = stop


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """key, id, letters: a row for each segment of a line and for each of its other probes, which the last bit of the key tells apart.

    letters says which characters occur an odd number of times: one of 31 bits for each; an edit changes at most two.
    """

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in lean(batches):
            ids = batch.column(0).to_numpy()
            for start, stop, raw, at in _parts(batch.column(1)):
                text = raw.decode()
                if len(text) < len(raw):  # from places of bytes to places of characters
                    at = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[at]
                own = ids[start:stop]
                fresh = np.flatnonzero(np.diff(at) >= EACH)
                fresh = fresh[[x not in seen and not seen.add(x) for x in own[fresh].tolist()]] if len(fresh) else fresh
                if len(seen) > 500_000:
                    seen.clear()
                if not len(fresh):
                    continue
                codes = _codes(text)
                odd = np.concatenate([np.zeros(1, np.int32), np.bitwise_xor.accumulate(_letter_bits()[codes])])
                letters = (odd[at[1:]] ^ odd[at[:-1]])[fresh]
                found = list(_line_keys(codes, at[fresh], np.diff(at)[fresh], edits))
                line, key = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[fresh][line]), pa.array(letters[line])], names=["key", "id", "letters"])

    return lines.select("id", "line").mapInArrow(keyed, "key long, id long, letters int")


def _met(keys: DataFrame, edits: int) -> DataFrame:
    """x, y of lines that meet in a segment of few lines; or key, side, x, letters of each line of a frequent segment.

    Rows arrive in order of their keys, so the lines that have a segment come before those that only probe it, and at
    most FEW of them are held. Those that have it probe it as well, once all are known; side is 0 for having a
    frequent segment and 1 for probing it.
    """

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the last key that have the segment
        waiting = False  # whether these have yet to probe
        last, frequent = None, False
        for batch in itertools.chain(batches, [None]):
            if batch is None and not waiting:
                break
            if batch is not None and not batch.num_rows:
                continue
            columns = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int32)] if batch is None else [c.to_numpy() for c in batch.columns]
            again = len(columns[0]) > 0 and columns[0][0] >> 1 == last
            fresh = np.ones(len(columns[0]), bool)
            if held is not None and (again or waiting):
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
                fresh = np.concatenate([np.full(len(held[0]), waiting), fresh])
            key, side = columns[0] >> 1, (columns[0] & 1).astype(np.int8)
            own, letters = columns[1:]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(key)]))
            have = np.bincount(group, side == 0, len(starts)).astype(np.int64)
            hot = have > FEW
            hot[0] |= again and frequent
            waiting = bool(batch is not None and side[-1] == 0 and not hot[-1])
            if waiting:
                fresh[starts[-1] :] = False
            probing = np.flatnonzero(fresh & ~hot[group] & (have[group] > (side == 0)))
            n = have[group[probing]]
            x = np.repeat(probing, n)
            y = starts[group[x]] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            ok = (own[x] != own[y]) & (np.bitwise_count(letters[x] ^ letters[y]) <= 2 * edits)
            x, y, many = own[x[ok]], own[y[ok]], np.flatnonzero(hot[group])
            if len(x) or len(many):
                having = many[side[many] == 0]
                sides = np.concatenate([side[many], np.ones(len(having), np.int8)])
                many = np.concatenate([many, having])
                none = lambda size, kind: pa.nulls(size, kind)
                rows = [
                    pa.concat_arrays([none(len(x), pa.int64()), pa.array(key[many])]),
                    pa.concat_arrays([none(len(x), pa.int8()), pa.array(sides)]),
                    pa.array(np.concatenate([x, own[many]])),
                    pa.concat_arrays([pa.array(y), none(len(many), pa.int64())]),
                    pa.concat_arrays([none(len(x), pa.int32()), pa.array(letters[many])]),
                ]
                yield pa.RecordBatch.from_arrays(rows, names=["key", "side", "x", "y", "letters"])
            last, frequent = key[-1], bool(hot[-1])
            keep = slice(starts[-1], starts[-1] + int(have[-1]))
            held = None if frequent else [c[keep] for c in columns]

    # sorted by one number, which Spark does by its digits
    return keys.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(met, "key long, side byte, x long, y long, letters int")


def _of_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines whose id is one of ids; few others are shuffled as long as ids are few beside RESIDUES."""
    for shift in (0, 20):
        residue = F.pmod(F.shiftright("id", shift), F.lit(RESIDUES))
        lines = lines.join(F.broadcast(ids.select(residue.alias("residue")).distinct()), residue == F.col("residue"), "left_semi")
    return lines.join(ids, "id", "left_semi")


def _counts_here(x: str, y: str, key: int, keys: list[int], frequent: set[int], edits: int) -> bool:
    """Whether a pair is counted at this segment: the first of those that it meets in, where all of them are frequent ones. keys: of y's segments."""
    first, most = None, allowed(len(y), edits)
    cut = segments(len(y), most)
    for i, at, w in places(len(y), len(x), most):
        own, w = cut[i]
        if x.startswith(y[own : own + w], at):
            if keys[i] not in frequent:
                return False
            first = keys[i] if first is None else first
    return first == key


def _in_blocks(rows: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """id and n, its links counted here; or a and b, links that join. rows: key, side, x, letters of frequent segments."""
    own = rows.filter("side = 0").groupBy("x").agg(F.collect_set("key").alias("frequent"))  # one for each segment at most
    known = rows.join(lines.select(F.col("id").alias("x"), "line"), "x").join(own, "x", "left")
    size = known.groupBy("key", "side").agg(F.greatest(F.ceil(F.count("*") / F.greatest(F.lit(BLOCK), F.sqrt(F.count("*")) * (BLOCK / 48))), F.ceil(F.sum(F.length("line")) / BLOCK_CHARS)).cast("int").alias("blocks"))
    size = size.groupBy("key").agg(*(F.max(F.when(F.col("side") == s, F.col("blocks"))).alias(f"blocks{s}") for s in (0, 1)))
    placed = known.join(size, "key")
    block = lambda s: F.pmod(F.xxhash64("x"), F.col(f"blocks{s}")).cast("int")
    every = lambda s: F.sequence(F.lit(0), F.col(f"blocks{s}") - 1)
    have, probe = placed.filter("side = 0"), placed.filter("side = 1")
    columns = ("key", "i", "j", "side", "x", "letters", "line", "frequent")
    met = have.withColumns({"i": block(0), "j": F.explode(every(1))}).select(*columns).union(probe.withColumns({"j": block(1), "i": F.explode(every(0))}).select(*columns))

    def joined(group: tuple, t: pa.Table) -> pa.Table:
        key, side = group[0].as_py(), t.column("side").to_numpy()
        ids, letters, lines_ = t.column("x").to_numpy(), t.column("letters").to_numpy(), t.column("line").to_pylist()
        size = np.fromiter(map(len, lines_), np.int64, len(lines_))
        y, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found_x, found_y = [], []
        for at in range(0, len(x), 64):
            part = x[at : at + 64]
            ok = (np.bitwise_count(letters[part][:, None] ^ letters[y][None, :]) <= 2 * edits) & ((size[part][:, None] > size[y][None, :]) | (ids[part][:, None] > ids[y][None, :]))
            i, j = np.nonzero(ok)
            i, j = part[i], y[j]
            most = np.minimum(edits, size[j] // EACH)
            near = within_many([lines_[k] for k in i], [lines_[k] for k in j], most, edits)
            found_x.append(i[near])
            found_y.append(j[near])
        i, j = (np.concatenate([*f, np.empty(0, np.int64)]) for f in (found_x, found_y))
        frequent = {k: set(t.column("frequent")[k].as_py()) for k in set(j.tolist())}
        keys = dict(zip(frequent, _segment_keys([lines_[k] for k in frequent], edits), strict=True))
        own = np.fromiter((_counts_here(lines_[a], lines_[b], key, keys[b], frequent[b], edits) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        i, j = i[own], j[own]
        n = np.bincount(np.concatenate([i, j]), minlength=len(ids))
        kept, counted = forest(ids[i], ids[j]), np.flatnonzero(n)
        a, b = ids[i[kept]], ids[j[kept]]
        none = lambda m: pa.nulls(m, pa.int64())
        whole = [(pa.array(ids[counted]), none(len(a))), (pa.array(n[counted].astype(np.int64)), none(len(a))), (none(len(counted)), pa.array(a)), (none(len(counted)), pa.array(b))]
        return pa.table([pa.concat_arrays(c) for c in whole], names=["id", "n", "a", "b"])

    return met.groupBy("key", "i", "j").applyInArrow(joined, "id long, n long, a long, b long")


def near_lines(df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """key, line_no int, class_id long, n_links long, kept boolean for every line of every row.

    Lines are what stands between line feeds. Equal lines are one; different lines are linked when the insertions,
    deletions and replacements between them are at most `edits`, and at most one for each EACH characters of the shorter
    line. A class is what links connect, class_id the smallest id of its lines, and n_links the number of different
    lines that a line is linked with. Of a class the line of the smallest key, then the smallest number, is kept.

    Null text counts as one empty line. Rows with null keys take part, sorted last. Rows repeated with one key keep one
    line each for equal numbers. An empty table gives no rows; columns not named are not read.
    """
    docs = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    clashes = _clashes(docs)
    every = _lines(docs, clashes)
    met = stored(_met(_keys(every, edits), edits), "line-meetings")
    pairs = stored(met.filter("key IS NULL").select("x", "y").distinct(), "line-pairs")
    frequent = stored(met.filter("key IS NOT NULL").select("key", "side", "x", "letters").distinct(), "frequent")  # a line comes once from each task that has it
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).union(frequent.select("x")).distinct()
    lines = stored(_of_ids(every.select("id", "line"), ids).dropDuplicates(["id"]), "met-lines")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.tolist(), b.tolist()
        return pd.Series(within_many(a, b, np.array([allowed(min(len(x), len(y)), edits) for x, y in zip(a, b, strict=True)], np.int64), edits))

    side = lambda c: lines.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"))
    known = pairs.join(side("x"), "x").join(side("y"), "y").filter((F.length("line_x") > F.length("line_y")) | (F.col("x") > F.col("y")))
    links = stored(known.filter(linked("line_x", "line_y")).select(F.col("x").alias("a"), F.col("y").alias("b")), "line-links")
    counted = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n"))
    if not frequent.isEmpty():
        blocks = stored(_in_blocks(frequent, lines, edits), "line-blocks")
        links = links.union(blocks.filter("a IS NOT NULL").select("a", "b"))
        counted = counted.union(blocks.filter("id IS NOT NULL").select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(links)
    classes = roots.select(F.col("node").alias("id"), F.col("root").alias("class_id")).join(counted.withColumnRenamed("n", "n_links"), "id")

    own = every.select("__key", "line_no", "id").join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    place: Column = F.struct(F.col("__key").isNull().alias("last"), F.col("__key"), F.col("line_no"))
    firsts = own.groupBy("class_id").agg(F.min(place).alias("first"))
    out = own.join(firsts, "class_id")
    return out.select(F.col("__key").alias(key), "line_no", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (place == F.col("first")).alias("kept"))
