"""Near-duplicate documents by SetSketch registers.

A document is its set of hashed word shingles. Each register of its sketch is the truncated logarithm of the smallest of
exponentially distributed hash values of the set, so that sketches of parts merge by taking the larger register, and the
chance that two registers agree follows the sets' similarity. Bands of registers bring documents together; the joint
likelihood of all registers of a pair, with both sizes known, leaves out pairs that are clearly apart; all others are
confirmed on their full sets.

Documents with one set are one node. The nodes of a band's bucket are never paired with each other at once: in each
round every node meets a few nodes of its bucket, drawn anew, and what is found to be linked is joined. After the rounds
only buckets whose nodes are still in different groups are open. Those of a few nodes are paired. Larger
ones are cut into blocks, and each two blocks are compared by a product of their incidence matrices, from which only the
links that join groups come out: rows stand for a node in a block, never for a pair. Buckets that have nodes in common
are compared as one where this moves less. So a large group of copies costs few rows, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, lean, stored, texts
from .graph import components, forest

#: Registers and their parameters: base, rate, largest value.
REGISTERS, BASE, RATE, TOP = 128, 1.001, 20.0, 65535
#: Registers in a band. At a similarity of 0.75 a pair misses all 32 bands of 4 once in about 190,000 times.
BAND = 4
#: Rounds of meetings before the remaining pairs are confirmed, and nodes of its bucket that a node meets in each.
ROUNDS, CENTRES = 1, 3
#: Nodes of an open bucket that are paired; more are compared in blocks.
FEW = 16
#: Nodes of a block (growing with the root of their number, so that rows grow by a power of 1.5), hashes of a block, columns of a matrix.
BLOCK, LARGEST_BLOCK, BLOCK_HASHES, COLUMNS = 128, 2048, 2_000_000, 4096
#: Most nodes that have met whose keys are broadcast, so that no text is shuffled for their sets; more are joined by a shuffle.
MOST_SENT = 500_000
#: Words whose hashes a worker keeps; more cost memory and save no time.
WORDS_KEPT = 50_000
#: A pair is left out when its likelihood speaks against the threshold by so many standard deviations.
DEVIATIONS = 6.0

_ODD = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles: A-Z lower-cased, words between ASCII white space.

    A text of fewer words is one shingle; one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set: floor(1 - log_BASE of the smallest exponential value), held to 0 to TOP."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * _ODD[None, :]).min(0))
    uniform = (least.astype(np.float64) + 1) * 2.0**-64
    value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of similarities j, when of REGISTERS so many of the first set's are larger and so many smaller."""
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    u, v = na / (na + nb), nb / (na + nb)
    up, down = p(u - v * j), p(v - u * j)
    return above * np.log(up) + below * np.log(down) + (REGISTERS - above - below) * np.log(np.maximum(1 - up - down, 1e-12))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches may have at least this similarity, by size and by joint likelihood."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    at = np.minimum(percent / 100, most)
    best = np.full(len(a), -np.inf)
    where = np.zeros(len(a))
    for step in np.linspace(0, 1, 101):
        j = step * most
        value = log_likelihood(j, above, below, na, nb)
        where = np.where(value > best, j, where)
        best = np.maximum(best, value)
    against = 2 * (best - log_likelihood(at, above, below, na, nb)) > DEVIATIONS**2
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ~(against & (where < at))


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (shingles), node (a 128-bit digest of the set, null if empty), registers, for every row."""
    schema = T.StructType([df.schema[key], T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("registers", T.BinaryType())])

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for start, stop in byte_slices(batch.column(1)):
                sets = [shingles(t) for t in texts(batch.column(1), start, stop)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=schema.names,
                )

    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(signed, schema)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes: the full sets of these nodes, made from the text of one document each."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            wanted = batch.column(0).to_pylist()
            for start, stop in byte_slices(batch.column(1)):
                sets = [shingles(t) for t in texts(batch.column(1), start, stop)]
                mine = [(w, s.view(np.int64)) for w, s in zip(wanted[start:stop], sets, strict=True) if xxhash.xxh3_128_digest(s.tobytes()) == w]
                if mine:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in mine], pa.binary()), pa.array([s for _, s in mine], pa.list_(pa.int64()))], names=["node", "hashes"])

    wanted = nodes.select(F.col("first").alias("__key"), "node")
    few = wanted.limit(MOST_SENT + 1).count() <= MOST_SENT
    rows = docs.join(F.broadcast(wanted) if few else wanted, "__key").select("node", "__text")
    return rows.mapInArrow(made, "node binary, hashes array<bigint>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (smallest keys of the two nodes) of the pairs (x, y) that are as similar as asked for."""
    side = lambda x, i: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{i}"), F.col("registers").alias(f"r{i}"), F.col("first").alias(i))
    known = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y")

    def likely(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                r = [np.frombuffer(b"".join(f[c]), "<u2").reshape(len(f), -1) for c in ("ra", "rb")]
                f = f[plausible(*r, f["na"].to_numpy(float), f["nb"].to_numpy(float), percent)]
            yield f[["x", "y", "na", "nb", "a", "b"]]

    kept = known.select("x", "y", "na", "nb", "a", "b", "ra", "rb").mapInPandas(likely, "x binary, y binary, na long, nb long, a long, b long")
    full = kept.join(sets.select(F.col("node").alias("x"), F.col("hashes").alias("hx")), "x").join(sets.select(F.col("node").alias("y"), F.col("hashes").alias("hy")), "y")
    both = full.select("a", "b", "na", "nb", F.size(F.array_intersect("hx", "hy")).cast("long").alias("i"))
    return both.filter(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _joined_groups(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after further links (a, b): only the groups that these join are walked again."""
    group = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(group("a"), "a", "left").join(group("b"), "b", "left")
    step = components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(moved.union(step.join(roots, "node", "left_anti").select("node", "root")), "groups")


def shared_counts(hashes: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes each row of `left` has in common with each of `right`; hash i is in row row[i], once."""
    _, code, count = np.unique(hashes, return_inverse=True, return_counts=True)
    many = count[code] > 1
    row, code = row[many], (np.cumsum(count > 1) - 1)[code[many]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(left), len(right)))
    n = int(max(left.max(), right.max())) + 1
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        low, high = np.searchsorted(code, (at, at + COLUMNS))
        has = np.zeros((n, COLUMNS), np.float32)
        has[row[low:high], code[low:high] - at] = 1
        out += has[left] @ has[right].T
    return out


def _block_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join the groups of nodes with a bucket in common. open_: bucket, node, first, n, group."""
    in_bucket = stored(open_, "open")
    own = in_bucket.groupBy("node").agg(F.min("bucket").alias("one"))
    roots = components(in_bucket.join(own, "node").select("one", "bucket"), "one", "bucket")
    rooted = in_bucket.join(roots.select(F.col("node").alias("bucket"), "root"), "bucket", "left").withColumn("root", F.coalesce("root", "bucket"))
    in_bucket = stored(rooted, "rooted")  # read four times below

    m = F.count("*")
    nodes_each = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), F.sqrt(m) * (BLOCK / 48)))
    blocks = F.greatest(F.ceil(m / nodes_each), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    by_bucket = in_bucket.groupBy("root", "bucket").agg(blocks.alias("blocks"), m.alias("m"))
    apart = by_bucket.groupBy("root").agg(F.sum(F.col("m") * F.col("blocks")).alias("rows_apart"))
    once = in_bucket.dropDuplicates(["root", "node"])
    by_root = once.groupBy("root").agg(blocks.alias("blocks"), m.alias("m")).join(apart, "root").withColumn("joint", F.col("m") * F.col("blocks") <= F.col("rows_apart"))
    joint = once.join(by_root.filter("joint").select("root", "blocks"), "root").withColumn("unit", F.col("root"))
    single = in_bucket.join(by_bucket.join(by_root.filter("NOT joint").select("root"), "root", "left_semi").select("bucket", "blocks"), "bucket").withColumn("unit", F.col("bucket"))
    columns = ("unit", "node", "first", "n", "group", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")
    placed = joint.select(*columns).union(single.select(*columns)).join(sets, "node")
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "first", "n", "group", "hashes")

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        first, n, group, block = (rows.column(c).to_numpy() for c in ("first", "n", "group", "block"))
        left, right = (np.flatnonzero(block == k.as_py()) for k in key[1:])
        a = b = np.empty(0, np.int64)
        if len(left) and len(right) and (group != group[0]).any():
            lists = rows.column("hashes").combine_chunks()
            shared = shared_counts(lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), left, right)
            x, y = np.nonzero((100 * shared >= percent * (n[left][:, None] + n[right][None, :] - shared)) & (group[left][:, None] != group[right][None, :]))
            x, y = left[x], right[y]
            kept = forest(group[x], group[y])
            a, b = first[x[kept]], first[y[kept]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("unit", "i", "j").applyInArrow(joined, "a long, b long")


def _links_of_keys(signed: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """a, b: links between the nodes that have a key in common, each by its smallest key."""
    held = signed.filter("node IS NOT NULL").join(repeated, "__key", "left_semi").select("__key", "node").distinct()
    firsts = stored(held.join(nodes.select("node", "first"), "node").select("__key", "first").distinct(), "firsts")
    return firsts.join(firsts.groupBy("__key").agg(F.min("first").alias("a")), "__key").select("a", F.col("first").alias("b"))


def group_similar(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """key, n_shingles long, component_id, kept boolean for every row.

    Rows are linked when 100 * shared shingles >= percent * all shingles of the two; component_id is the smallest key
    that a row reaches by links, its own included, and the row that has it is kept.

    Null or wordless text has no shingles and is linked with nothing. Rows with one key are one document: each keeps
    its own n_shingles, and the links of any are links of all. Rows with a null key take no part and have a null
    component_id; their kept is false. An empty table gives no rows; columns not named are not read.
    """
    docs = df.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text"))
    signed = stored(signatures(docs, "__key", "__text"), "signatures")
    nodes = stored(signed.filter("node IS NOT NULL AND __key IS NOT NULL").groupBy("node", "n", "registers").agg(F.min("__key").alias("first")), "nodes")

    bands = [F.xxhash64(F.substring("registers", 1 + 2 * BAND * i, 2 * BAND), F.lit(i)) for i in range(REGISTERS // BAND)]
    banded = nodes.select("node", "first", "n", F.explode(F.array(*bands)).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    members = stored(banded.join(shared, "bucket"), "members")
    met = stored(nodes.join(members.select("node").distinct(), "node", "left_semi"), "met")
    sets = stored(_sets(docs, met), "sets")

    repeated = stored(signed.filter("__key IS NOT NULL").groupBy("__key").agg(F.count("*").alias("size")).filter("size > 1").select("__key"), "repeated-keys")
    roots = None if repeated.isEmpty() else components(_links_of_keys(signed, nodes, repeated))
    tested = None
    for turn in range(ROUNDS + 1):
        now = members if roots is None else members.join(roots.withColumnRenamed("node", "first"), "first", "left")
        now = now.select("bucket", "node", "first", "n", F.col("first").alias("group") if roots is None else F.coalesce("root", "first").alias("group"))
        span = [F.count("*").alias("size"), F.min("group").alias("g0"), F.max("group").alias("g1")]
        in_blocks = None
        if turn < ROUNDS:
            drawn = [F.min(F.struct(F.xxhash64("node", F.lit(turn * CENTRES + i)), "node", "group")).alias(f"c{i}") for i in range(CENTRES)]
            centres = now.groupBy("bucket").agg(*span, *drawn).filter("g0 <> g1").select("bucket", F.array_distinct(F.array(*(F.struct(F.col(f"c{i}.node"), F.col(f"c{i}.group")) for i in range(CENTRES)))).alias("centres"))
            met_by = now.join(centres, "bucket").select("node", "group", F.explode("centres").alias("c")).filter(F.col("group") != F.col("c.group")).select("node", F.col("c.node").alias("other"))
        else:  # what is left: all pairs of a bucket that are in different groups
            open_ = stored(now.groupBy("bucket").agg(*span).filter("g0 <> g1").select("bucket", "size"), "open-buckets")
            few = now.join(open_.filter(F.col("size") <= FEW).select("bucket"), "bucket", "left_semi")
            its = few.select("bucket", F.col("node").alias("other"), F.col("n").alias("its_n"), F.col("group").alias("its"))
            fits = 100 * F.least("n", "its_n") >= percent * F.greatest("n", "its_n")
            met_by = few.alias("o").join(its.alias("i"), (F.col("o.bucket") == F.col("i.bucket")) & (F.col("group") < F.col("its")) & fits)
            many = open_.filter(F.col("size") > FEW).select("bucket")
            if not many.isEmpty():
                in_blocks = _block_links(now.join(many, "bucket", "left_semi"), sets, percent)
        pairs = met_by.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"), "pairs")
        found = _confirmed(pairs, met, sets, percent)
        found = stored(found if in_blocks is None else found.union(in_blocks), "links")
        tested = pairs if tested is None else tested.union(pairs)
        roots = components(found) if roots is None else _joined_groups(roots, found)

    grouped = nodes.join(roots.withColumnRenamed("node", "first"), "first", "left").select("node", F.coalesce("root", "first").alias("component_id"))
    rows = signed.join(grouped, "node", "left")  # a hot node's rows are split among tasks as a skewed join
    component = F.when(F.col("__key").isNotNull(), F.coalesce("component_id", "__key"))
    if not repeated.isEmpty():  # a row without shingles follows the other rows of its key
        by_key = rows.join(repeated, "__key", "left_semi").groupBy("__key").agg(F.min("component_id").alias("of_key"))
        rows = rows.join(by_key, "__key", "left")
        component = F.when(F.col("__key").isNotNull(), F.coalesce("component_id", "of_key", "__key"))
    return rows.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
