"""Connected components: of a bounded number of edges by one task, of more by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, tidy

#: Up to so many edges (16 bytes each) go to one task, whose memory they bound; more take steps of joins.
ONE_TASK_EDGES = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        rx, ry = label[x], label[y]  # roots, as paths are of one step here
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[label]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(label, np.maximum(rx, ry), np.minimum(rx, ry))
        while (label != (further := label[label])).any():
            label = further


def _one_task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(it)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x.column(c).to_numpy() for x in batches)]) for c in ("a", "b"))
    nodes, least = least_reachable(a, b)
    for i in range(0, len(nodes), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 17)]), pa.array(least[i : i + (1 << 17)])], ["node", "component"])


def connected_components(edges: DataFrame, work: Workspace, name: str, most: int = 60) -> DataFrame:
    """edges (a long, b long; columns of a written table) -> (node long, component long), component the least node reachable.

    Nodes without an edge do not occur. Each step of joins is nine stages, whose tasks and plans the driver
    keeps record of, so at most ONE_TASK_EDGES edges go to one task instead. Of more, no task holds a whole
    component: every step is a min-aggregate (with map-side combine) joined back on the node, and each
    round's edges are written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u")
        out = joined.where("v > u").select("v", "m") if large else joined.select("v", "m").union(least)
        return out.toDF("a", "b").where("a <> b").distinct()

    edges = edges.select("a", "b").where("a <> b")
    if edges.count() <= ONE_TASK_EDGES:
        return work.write(edges.coalesce(1).mapInArrow(tidy(_one_task), "node long, component long"), name)
    now, seen = work.write(edges.distinct(), f"{name}-0"), None
    for k in range(1, most + 1):
        now = work.write(star(star(now, True), False), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    # every edge now is (node, least node of its component)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
