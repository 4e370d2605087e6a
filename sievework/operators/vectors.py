"""Nearest vectors by products of blocks: ranges of queries and groups of rows meet in tasks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keyed

#: Queries and rows of a task, and queries of one product.
QUERIES, ROWS, STEP = 1 << 14, 1 << 15, 512


def finite(vector: Column) -> Column:
    """As doubles; null where a vector is null or empty or holds null, NaN or infinite entries."""
    v = vector.cast("array<double>")
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _in_order(products: np.ndarray) -> np.ndarray:
    """Sums from the first to the last, as a fold over a list gives them."""
    return np.cumsum(products, axis=1)[:, -1]


def cosine_tile(k: int, itself: bool):
    """Of a task's queries and rows, the k rows nearest to each query: query, row, score, bias, tie."""

    def tile(queries: pa.Table, rows: pa.Table) -> pa.Table:
        query, row, score = [], [], []  # row: places in rows
        if len(queries) and len(rows):
            ids, own = rows.column("__id").to_numpy(), queries.column("__id").to_numpy()
            c, q = _matrix(rows.column("__v")), _matrix(queries.column("__v"))
            bias, ties = rows.column("__bias").to_numpy(), rows.column("__tie").to_numpy()
            c_size, q_size = np.sqrt(_in_order(c * c)), np.sqrt(_in_order(q * q))
            for at in range(0, len(q), STEP):
                part = q[at : at + STEP]
                sizes = q_size[at : at + STEP, None] * c_size[None, :]
                near = np.divide(part @ c.T, sizes, out=np.zeros(sizes.shape), where=sizes != 0) + bias[None, :]
                if not itself:
                    near[own[at : at + STEP, None] == ids[None, :]] = -np.inf
                n = min(k, len(c))
                least = np.partition(near, len(c) - n, axis=1)[:, len(c) - n]
                i, j = np.nonzero(near >= np.maximum(least - 1e-9, -1e300)[:, None])  # ties, and what rounding may have parted
                exact = np.divide(_in_order(part[i] * c[j]), sizes[i, j], out=np.zeros(len(i)), where=sizes[i, j] != 0)
                order = np.lexsort((ids[j], ties[j], -(exact + bias[j]), i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                query.append(own[at + i[first]])
                row.append(j[first])
                score.append(exact[first])
        place = np.concatenate([*row, np.empty(0, np.int64)]).astype(np.int64)
        found = rows.select(["__id", "__bias", "__tie"]).take(pa.array(place))
        flat = lambda parts, kind: pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind))
        return pa.table([flat(query, np.int64), found.column(0), flat(score, np.float64), found.column(1), found.column(2)], names=["query", "row", "score", "bias", "tie"])

    return tile


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, bias: Column | None = None, tie: Column | None = None, itself: bool = False) -> DataFrame:
    """query, row, score, place: for each query the k rows of largest cosine; itself: whether a row meets the query of its own key.

    key is a whole number; rows with a null key or a vector that finite() makes null take no part, and only vectors of
    one length meet. A vector of zeros has a cosine of 0. score is the cosine, summed in order of the entries. bias and
    tie are expressions of rows: order follows cosine plus bias, then the smaller tie, then the smaller key. Each range of
    queries meets each group of rows in one task, which gives k rows for each query, so the shuffle of rows grows with
    ranges of QUERIES queries. An empty side gives no rows.
    """
    expression = lambda x, kind: (F.lit(0) if x is None else x).cast(kind)
    rows = rows.select(F.col(key).cast("long").alias("__id"), finite(F.col(vector)).alias("__v"), expression(bias, "double").alias("__bias"), expression(tie, "long").alias("__tie")).filter("__id IS NOT NULL AND __v IS NOT NULL")
    queries = queries.select(F.col(key).cast("long").alias("__id"), finite(F.col(vector)).alias("__v")).filter("__id IS NOT NULL AND __v IS NOT NULL")
    ranges, groups = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERIES), (rows, ROWS)))
    place = lambda n: F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("*", F.size("__v").alias("__d"), place(ranges).alias("__range"), every(groups).alias("__group"))
    met = rows.select("*", F.size("__v").alias("__d"), every(ranges).alias("__range"), place(groups).alias("__group"))
    at = ["__d", "__range", "__group"]
    schema = T.StructType([T.StructField(c, t) for c, t in (("query", T.LongType()), ("row", T.LongType()), ("score", T.DoubleType()), ("bias", T.DoubleType()), ("tie", T.LongType()))])
    found = asked.groupBy(*at).cogroup(met.groupBy(*at)).applyInArrow(cosine_tile(k, itself), schema)
    order = [F.desc(F.col("score") + F.col("bias")), F.asc("tie"), F.asc("row")]
    return keyed.best_rows(found, ["query"], order, k, "place").select("query", "row", "score", "place")
