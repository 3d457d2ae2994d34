"""Connected components of an edge table, by alternating large and small stars; up to WHOLE edges by one task.

Both steps are group minima, which combine before the shuffle, and joins with them, in which nodes with very many
edges are looked up by broadcast: no task gets all the edges of a node.  The edge table never grows.  Each round is
cut off in the shared folder, and what it has written there is deleted by the next.

A round is some twenty jobs, and each job, stage and broadcast takes memory of the driver, however few rows it has.  So edges that fit
into one task are not dealt out: it joins them all, in some megabytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import discard, lookup, save, tidy

#: Edges, of 16 bytes, that one task takes.
WHOLE = 1 << 19


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a[k] - b[k], ascending, and of each the least node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(p):
        low, high = np.minimum(up[p], up[q]), np.maximum(up[p], up[q])
        np.minimum.at(up, high, low)  # of two roots that meet, the larger goes below the least that it meets
        while (up[up] != up).any():
            up = up[up]
        apart = up[p] != up[q]
        p, q = p[apart], q[apart]
    return nodes, nodes[up]


def _joined(batches):
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*map(np.concatenate, zip(*held)))], ["node", "root"])


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges: n rows (u, v) with u > v.  Large: link every larger neighbour to the least node around; small: every smaller one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    met = lookup(both.where("v > u") if large else edges, least, "u", "n", 2 * n if large else n)
    linked = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    out = save(linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large" if large else "small")
    discard(least, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs, root being the least node that it reaches; loops and repeats are allowed."""
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if got["n"] <= WHOLE:
            return now.coalesce(1).mapInArrow(tidy(_joined), "node long, root long")
        if (got["n"], got["s"]) == mark:
            break
        mark = (got["n"], got["s"])
        now = _star(_star(now, True, got["n"]), False, got["n"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
