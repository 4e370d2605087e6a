"""Whitening of embeddings by their leading principal components, found by spectrum slicing.

The number of eigenvalues above a shift is the number of positive pivots of an LDL^T factorisation of the shifted
covariance (Sylvester's law of inertia). Bisection with such counts isolates each leading eigenvalue, Rayleigh quotient
iteration from inside its interval converges cubically, and two more counts around the result certify its number.

Vectors are whole numbers, floor(scale * entry), so sums are exact; the covariance is over each distinct vector once,
centred before multiplying, in one row of partial sums for each partition. Only a covariance of d x d numbers reaches the
driver, for each length d of vectors that occurs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Eigenvalues below this share of the trace, for each dimension, are zero for double precision.
NOTHING = 8 * np.finfo(float).eps
#: Widest interval, as a share of the norm, whose eigenvalues count as one of higher multiplicity.
CLOSE = 64 * np.finfo(float).eps


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of v above shift: positive pivots of v - shift I, with complete diagonal pivoting."""
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).tiny
    positive = 0
    bound = (1 + 17**0.5) / 8
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        q, r = divmod(int(off.argmax()), n)
        if diagonal[p] >= bound * off[q, r]:
            pivot = a[p, p]
            positive += pivot > 0
            rest = np.arange(n) != p
            column = a[rest, p]
            a = a[np.ix_(rest, rest)]
            if abs(pivot) > tiny:
                a = a - np.outer(column, column / pivot)
        else:  # a block of two, whose determinant is negative: one positive eigenvalue
            positive += 1
            pair, rest = [q, r], np.setdiff1d(np.arange(n), [q, r])
            columns = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
        a = (a + a.T) / 2
    return positive


def _solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    """A step of inverse iteration; a shift that is an eigenvalue to the last digit is moved by one."""
    move = np.finfo(float).eps * np.abs(v).max()
    for k in range(8):
        try:
            y = np.linalg.solve(v - (shift + (2**k - 1) * move) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and y.any():
            return y / np.linalg.norm(y)
    return x


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that aren't 0 to double precision, at most `most`, falling, and their unit vectors as columns.

    An eigenvalue of higher multiplicity is given as often as it occurs, with orthogonal vectors.
    """
    v = (v + v.T) / 2
    size, trace = len(v), float(np.trace(v)) if len(v) else 0.0
    norm = float(np.abs(v).sum(0).max()) if size else 0.0
    values: list[float] = []
    vectors = np.empty((size, 0))
    least = NOTHING * size * trace
    wanted = min(most, above(v, least) if norm > 0 and trace > 0 else 0)
    count = functools.lru_cache(None)(lambda shift: above(v, shift))
    while len(values) < wanted:
        k = len(values) + 1
        low, high = least, norm * (1 + 1e-9)  # more than k - 1 above low, fewer than k above high
        while not (count(low) == k and count(high) == k - 1) and high - low > CLOSE * norm:
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)
        value, vector = _refined(v, low, high, vectors, count, k)
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _refined(v: np.ndarray, low: float, high: float, found: np.ndarray, count, k: int) -> tuple[float, np.ndarray]:
    """Eigenvalue k, known to lie from low to high, and its vector, orthogonal to those found."""
    norm = float(np.abs(v).sum(0).max())
    away = lambda x: (y := x - found @ (found.T @ x)) / np.linalg.norm(y)
    x = away(np.random.default_rng(k).standard_normal(len(v)))
    while True:
        value = (low + high) / 2
        for _ in range(3):  # into the interval
            x = away(_solve(v, value, x))
        for _ in range(12):
            value = float(x @ v @ x)
            residual = np.linalg.norm(v @ x - value * x)
            if not low - CLOSE * norm <= value <= high + CLOSE * norm or residual <= 4 * np.finfo(float).eps * norm:
                break
            x = away(_solve(v, value, x))
        edge = CLOSE * norm
        certified = count(value - edge) >= k and count(value + edge) < k
        if certified and residual <= 64 * np.finfo(float).eps * norm or high - low <= edge:
            return value, x
        middle = (low + high) / 2
        low, high = (middle, high) if count(middle) >= k else (low, middle)


@dataclass
class Basis:
    """For vectors of one length: n and sums of the fit, eigenvalues and unit vectors, trace of the covariance."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    @property
    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * entry) of each entry, as a long; null for vectors that are null, empty or hold null, NaN or infinite entries."""
    values = vector.cast("array<double>")
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(values) > 0) & ~bad, F.transform(values, lambda c: F.floor(c * F.lit(float(scale)))))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), size)


def _by_size(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each batch by the length of their vectors, which stand last."""
    for batch in batches:
        sizes = np.diff(batch.column(batch.num_columns - 1).offsets.to_numpy())
        for size in np.unique(sizes).tolist():
            part = batch if len(batch) == (sizes == size).sum() else batch.filter(pa.array(sizes == size))
            yield size, part, _matrix(part.column(part.num_columns - 1), size)


def _centred_products(fit: DataFrame, means: dict[int, np.ndarray], turned) -> dict[int, np.ndarray]:
    """For each length of vectors, the sum of y^T y over all rows; y = turned(size, x)."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for size, _, x in _by_size(batches):
            y = turned(size, x)
            total[size] = total.get(size, 0) + y.T @ y
        for size, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j], pa.float64())], names=["size", "i", "j", "part"])

    summed = fit.select("x").mapInArrow(partial, "size int, i int, j int, part double").groupBy("size", "i", "j").agg(F.sum("part").alias("part"))
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():
        m = out.setdefault(r.size, np.zeros(turned(r.size, means[r.size][None, :]).shape[1:] * 2))
        m[r.i, r.j] = m[r.j, r.i] = r.part
    return out


def fit(x: DataFrame, components: int) -> tuple[dict[int, Basis], float]:
    """The basis of each length of vectors, and the largest absolute entry of whitened covariances less the identity. x: distinct vectors, column x."""
    sums = x.select(F.size("x").alias("size"), F.posexplode("x").alias("i", "c")).groupBy("size", "i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    found: dict[int, Basis] = {}
    for r in sums.collect():
        own = found.setdefault(r.size, Basis(r.n, np.zeros(r.size, object), 0.0))
        own.sums[r.i] = int(r.s)
    means = {size: b.mean for size, b in found.items()}
    products = _centred_products(x, means, lambda size, v: v - means[size])
    for size, own in found.items():
        v = products[size] / own.n
        own.trace = float(np.trace(v))
        own.values, own.vectors = leading(v, components)
    bases = dict(found)
    errors = [float(np.abs(m / bases[size].n - np.eye(len(m))).max()) for size, m in _centred_products(x, means, lambda size, v: bases[size].whitened(v)).items() if len(m)]
    return found, max(errors, default=0.0)


def _deviation(x: np.ndarray, own: Basis) -> list[int | None]:
    """Exact; null beyond 2^63 - 1."""
    largest = max(int(np.abs(x).max()), 1)
    bound = (own.n * largest + max(map(abs, own.sums.tolist()))) ** 2 * x.shape[1]
    if bound < 1 << 63:
        d = own.n * x - own.sums.astype(np.int64)
        return (d * d).sum(1).tolist()
    exact = (((own.n * x.astype(object)) - own.sums) ** 2).sum(1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """key, component int, n long, deviation long, whitened, explained, identity_error double: `components` rows for each vector.

    Each entry c becomes x = floor(scale * c); entries beyond a long are not supported (they take the largest long). Null
    and empty vectors and those with null or non-finite entries take no part. The fit is over each distinct x once: n of
    them with sums S; covariance V centred by S / n, with divisor n. Components are unit eigenvectors of V by falling
    eigenvalue e, of one sign for all rows. deviation: sum of (n x - S)^2, exact, null beyond a long. whitened: x - S / n
    on the component over sqrt(e). explained: e / trace(V). identity_error: one value, the largest absolute entry of the
    covariance of whitened less the identity.

    Vectors of different lengths are fitted apart. Fewer components come where a fit has fewer eigenvalues above 0 (none
    for a single distinct vector). Repeated rows and null keys stay; an empty table gives no rows; other columns are not
    read.
    """
    kept = df.select(F.col(key), whole_numbers(F.col(vector), scale).alias("x")).filter("x IS NOT NULL")
    bases, error = fit(stored(kept.select("x").distinct(), "whitening-fit"), components)
    schema = T.StructType(
        [df.schema[key], T.StructField("component", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", "deviation")), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))]
    )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part, x in _by_size(batches):
            own = bases[size]
            k, n = len(own.values), len(x)
            if not k:
                continue
            which = pa.array(np.repeat(np.arange(n), k))
            columns = [
                part.column(0).take(which), np.tile(np.arange(1, k + 1, dtype=np.int32), n), np.full(n * k, own.n, np.int64), pa.array(_deviation(x, own), pa.int64()).take(which),
                own.whitened(x).ravel(), np.tile(own.values / own.trace, n), np.full(n * k, error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return kept.mapInArrow(rows, schema)


