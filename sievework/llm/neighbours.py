"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors of length 1 are rounded to 8-bit integers. The product of two blocks of them gives every cosine of the tile
up to an error that follows from the lengths of what rounding has cut off. Pairs whose upper bound reaches the k-th
best lower bound of their query are computed again in double precision; tiles and tasks are merged by heaps, which
a task holds for one block of queries at a time. The bounds are exact, so the result is that of brute force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries.
CANDIDATE_ROWS, QUERY_ROWS = 4096, 2048


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v: vectors that are neither null nor zero and have finite components only."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def _blocks(rows: DataFrame, n: int, name: str, copies: int | None = None) -> DataFrame:
    """dim, the block's number and its rows packed: ids as int64, vectors as float64, in one binary each.

    copies: of equal vectors in a block, only those with so many smallest ids are kept; with one more than the
    neighbours asked for, the others can't be among them.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, v = pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.float64)
        if copies:
            frame = pd.DataFrame({"id": ids, "v": [r.tobytes() for r in v]}).drop_duplicates()
            kept = frame.index[frame.groupby("v").cumcount() < copies].to_numpy()
            ids, v = ids[kept], v[kept]
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], name: [pdf[name].iloc[0]], f"{name}_ids": [ids.tobytes()], f"{name}_rows": [v.tobytes()]})

    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias(name))
    return dealt.groupBy("dim", name).applyInPandas(pack, f"dim int, {name} int, {name}_ids binary, {name}_rows binary")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows divided by their length; first by their largest component, so that nothing overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding has cut off."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(1))


def tile(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines of all pairs, and a bound of their error; at most 1,024 products are summed in float32."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    dots = np.zeros((len(qa), len(qb)))
    for at in range(0, qa.shape[1], 1024):
        dots += qa[:, at : at + 1024].astype(np.float32) @ qb[:, at : at + 1024].astype(np.float32).T
    dots *= sa[:, None] * sb[None, :]
    return dots, ra[:, None] * (1 + rb[None, :]) + rb[None, :] * (1 + ra[:, None]) + 1e-9


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of matching rows, summed from the first component to the last: equal vectors give equal sums."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return folded(a, b) / (np.sqrt(folded(a, a)) * np.sqrt(folded(b, b)))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest cosine for each query, its own id left out.

    Nearest first, ties to the smaller id; all candidates where there are fewer than k. Only vectors of a query's own
    dimension are its candidates. Null, zero and non-finite vectors and null ids take no part; rows repeated with one
    id count once for each distinct score; an empty table gives no rows; other columns are not read.
    """
    q, c = _clean(queries, key, vector), _clean(candidates, key, vector)
    n_q, n_c = q.count(), c.count()
    blocks_q, blocks_c = -(-max(n_q, 1) // QUERY_ROWS), -(-max(n_c, 1) // CANDIDATE_ROWS)
    left = _blocks(q, blocks_q, "qb").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks_c - 1))))
    right = _blocks(c, blocks_c, "cb", copies=k + 1).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))
    tiles = left.hint("merge").join(right, ["dim", "qb", "cb"])  # sorted, so that the tiles of a query block follow each other

    def search(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = {}
        block = None
        for frame in frames:
            for r in frame.itertuples(index=False):
                if (r.dim, r.qb) != block:
                    if best:
                        yield listed(best)
                    best, block = {}, (r.dim, r.qb)
                ids_q, ids_c = np.frombuffer(r.qb_ids, np.int64), np.frombuffer(r.cb_ids, np.int64)
                v_q = np.frombuffer(r.qb_rows).reshape(len(ids_q), -1)
                v_c = np.frombuffer(r.cb_rows).reshape(len(ids_c), -1)
                quantised = quantise(unit(v_c))
                for at in range(0, len(ids_q), 256):
                    near, bound = tile(quantise(unit(v_q[at : at + 256])), quantised)
                    near[ids_q[at : at + 256, None] == ids_c[None, :]] = -np.inf
                    low = near - bound
                    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
                    heaps = [best.setdefault(i, []) for i in ids_q[at : at + 256].tolist()]
                    known = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                    i, j = np.nonzero((near + bound >= np.maximum(kth, known - 1e-9)[:, None]) & (near > -np.inf))
                    for p in range(0, len(i), 1 << 15):
                        a, b = i[p : p + (1 << 15)], j[p : p + (1 << 15)]
                        for x, y, s in zip(a.tolist(), ids_c[b].tolist(), cosines(v_q[at + a], v_c[b]).tolist(), strict=True):
                            push(heaps[x], k, s, y)
        yield listed(best)

    def merge(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = {}
        for frame in frames:  # sorted by query: all but the last one of a frame are done
            for q_id, v_id, s in zip(frame["query_id"].tolist(), frame["vec_id"].tolist(), frame["score"].tolist(), strict=True):
                push(best.setdefault(q_id, []), k, s, v_id)
            if len(best) > 1:
                last, heap = best.popitem()
                yield listed(best)
                best = {last: heap}
        yield listed(best)

    schema = "query_id long, rank int, vec_id long, score double"
    found = tiles.select("dim", "qb", "qb_ids", "qb_rows", "cb_ids", "cb_rows").mapInPandas(search, schema)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(merge, schema)


def push(heap: list[tuple[float, int]], k: int, score: float, own: int) -> None:
    """The k largest, of equal scores the smaller ids; the least of them is first."""
    item = (score, -own)
    if item in heap:
        return
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def listed(best: dict[int, list[tuple[float, int]]]) -> pd.DataFrame:
    rows = [(q, n, -own, score) for q, heap in best.items() for n, (score, own) in enumerate(sorted(heap, reverse=True), 1)]
    frame = pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
    return frame.astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})
