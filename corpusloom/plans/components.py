"""Connected components: a short edge table in one step, a longer one by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import drop_scratch, materialize, sized


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges: distinct (a, b) with a > b.

    The minimum per node is a map-side combined aggregate, written before it is joined back: to be broadcast while it is
    short, and else so that the join is one of two plain exchanges, whose hot nodes adaptive execution can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m0")).select("a", F.least("a", "m0").alias("m"))
        least = sized(materialize(least, "least"))
        out = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = sized(materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least"))
        out = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


#: Edges that one task joins; of longer tables no task sees more than its part.
JOINED = 1_000_000


def least_nodes(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node of each node's group, of n nodes and the edges x, y."""
    up = np.arange(n)
    while len(x):
        while (up[up] != up).any():
            up = up[up]
        p, q = up[x], up[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
    return up


def _joined(batches):
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    both = pa.chunked_array([*table["a"].chunks, *table["b"].chunks])
    nodes = pc.unique(both)
    nodes = nodes.take(pc.sort_indices(nodes))
    x, y = (pc.index_in(table[c], nodes).to_numpy().astype(np.int64) for c in ("a", "b"))
    up = least_nodes(len(nodes), x, y)
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(up))], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, most: int = JOINED) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node of its group.

    A written table of `most` edges or fewer is joined by one task; longer ones take rounds. Each round is written to the
    shared folder, so plans stay short and lost executors cost one round at most.
    Self loops and null ends are ignored. Raises if max_rounds do not suffice.
    """
    x, y = F.col(a), F.col(b)
    now = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now = materialize(now, "edges")
    if now.count() <= most:
        kind = now.schema["a"].dataType.simpleString()
        return materialize(now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"), "components")
    seen = None
    for _ in range(max_rounds):
        half = materialize(_star(now, large=True), "edges")
        step = materialize(_star(half, large=False), "edges")
        sign = step.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_scratch(now)
        drop_scratch(half)
        now = step
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
