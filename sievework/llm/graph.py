"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node each node of `edges` reaches.

    Each round a node takes the smallest label around it and then that label's own label, so stars and chains shrink
    by powers. Labels move as minima that are merged before the shuffle; nothing is gathered by node. Links with a null
    end and links of a node with itself count for nothing; repeated links count once; without links there are no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stored(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jumped = nearer.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        new = jumped.select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        moved = Observation()  # counted while the labels are written
        written = stored(new.observe(moved, F.count_if(F.col("old") != F.col("root")).alias("n")).select("node", "root"), "labels")
        discard(labels)
        labels = written
        if not moved.get["n"]:
            discard(both)
            return labels


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the links (a[i], b[i]) that join what those before have not joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (to := up.get(x, x)) != x:
            up[x] = up.get(to, to)
            x = to
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            up[x] = y
            out.append(i)
    return out
