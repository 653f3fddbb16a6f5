"""Connected components of a distributed edge list, by alternating stars.

Every step is a partial aggregation and a join on node ids, so a node with a
third of all edges is combined on the map side. The least neighbours are
written before they are joined, so both sides of each join are exchanges and
adaptive execution can split such a node. Nothing but two numbers per round reaches the driver.

A round is a dozen of exchanges, each with a file and a record for every task, however few
the edges are. So a list of at most FEW_EDGES is linked by one task instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .gray_index import Labels

#: 4 MB of edges.
FEW_EDGES = 1 << 18


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src long, dst long) -> (node, component): the smallest node reachable.

    Only nodes with an edge to another node are returned. Null ends and loops
    are ignored. An empty edge list gives no rows.
    """
    pairs = cut(_larger_first(edges))
    seen = _signature(pairs)
    if seen[0] <= FEW_EDGES:
        return cut(pairs.coalesce(1).mapInArrow(_linked, "node long, component long"))
    for _ in range(max_rounds):
        pairs = cut(_small_star(_large_star(pairs)))
        now = _signature(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = pairs.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = pairs.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return members.union(roots).distinct()


def _linked(batches):
    """All edges -> (node, component)."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    src, dst = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    labels = Labels(len(nodes))
    labels.link(at[: len(src)], at[len(src) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[labels.of], pa.int64())], names=["node", "component"])


def _larger_first(edges: DataFrame) -> DataFrame:
    return (
        edges.where("src != dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _signature(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h"),
    ).first()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")))
    return _larger_first(both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")))


def _small_star(pairs: DataFrame) -> DataFrame:
    least = cut(pairs.groupBy("src").agg(F.min("dst").alias("m")))
    others = pairs.join(least, "src").where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return _larger_first(others.union(least.select("src", F.col("m").alias("dst"))))
