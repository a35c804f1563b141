"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import release, saved

Star = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _star(*, small: bool) -> Star:
    """One star step over rows (u, v) sorted by both: v and, in the small step, u are tied to the least of u and its neighbours.

    The first row of a node has its least neighbour, so rows stream through and no neighbourhood is
    held, however large. Repeated edges are dropped on the way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = least = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            first = np.empty(len(u), bool)
            first[0], first[1:] = node is None or u[0] != node, u[1:] != u[:-1]
            fresh = first.copy()
            fresh[1:] |= v[1:] != v[:-1]
            fresh[0] |= last is not None and v[0] != last
            place = np.maximum.accumulate(np.where(first, np.arange(len(u)), -1))
            m = np.where(place >= 0, np.minimum(u, v)[np.maximum(place, 0)], u[0] if least is None else least)
            keep = fresh & (v != m) if small else fresh & (v > u) & (v != m)
            a, b = [m[keep]], [v[keep]]
            if small:
                a.append(m[first])
                b.append(u[first])
            node, least, last = u[-1], m[-1], v[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _step(edges: DataFrame, *, small: bool) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    rows = down if small else down.union(edges.select("a", "b"))
    return rows.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_star(small=small), "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b): the least node that each one reaches.

    Large and small stars alternate until every component is one star; the number of rounds grows
    with the logarithm of the longest path. Each round is checkpointed, so a lost executor costs
    one round at most. An empty table gives no rows.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = saved(_step(_step(edges, small=False), small=True))
        release(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    least = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return least.union(edges.select("a", "a").distinct())
