"""Connected components of a distributed edge list by alternating large and small stars.

Each step is one aggregation and one join on a node.  A node with many edges is aggregated by its minimum, map-side
first; for the join its edges are dealt over SALTS parts, each of which gets the minimum, so that the centre of a large
star is not one task's.  Edges that fit in one task, as small tables have them, are solved there without any shuffle:
each step has some 8 exchanges, and what the driver keeps of their jobs and tasks is no less for few edges.  No edge
list reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import durable, lean


#: Edges that one task solves, at most; they take 4 MB.
ALONE = 1 << 18
#: Parts that the edges of each node are dealt over.
SALTS = 16


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).filter("most > u").select("u", F.least("u", "m").alias("m"))
    dealt = both.filter("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    everywhere = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(everywhere, ["u", "salt"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> each node with the smallest one of its component."""
    edges = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not edges:
        return
    nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge, its root included; root is the component's smallest node.

    edges: columns u and v, 64-bit, in any direction; loops and repeats do no harm.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    if now.count() <= ALONE:
        return now.coalesce(1).mapInArrow(lean(_alone), "node long, root long")
    seen = None
    for _ in range(most_rounds):
        now = durable(_small(_large(now)).distinct())
        sign = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
