"""Connected components: contraction within tasks, then alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import cut, release

LOCAL_EDGES = 1_000_000  # 16 MB in a task


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of an edge list, without the smallest nodes themselves."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[x], low[y])
        np.minimum.at(new, low[y], low[x])
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    keep = low != np.arange(len(nodes))
    return nodes[keep], nodes[low[keep]]


def _contracted(e: DataFrame, tasks: int) -> DataFrame:
    """Each task's edges as a forest of stars."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        a, b = [], []
        for x in batches:
            a.append(x.column("u").to_numpy())
            b.append(x.column("v").to_numpy())
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in contract(np.concatenate(a), np.concatenate(b))], schema=schema)

    return e.coalesce(tasks).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label): the smallest node of each node's component, for all nodes but those smallest ones.

    ``edges`` has two long columns; loops and repeats do no harm.  Tasks of ``local_edges`` edges first
    contract what they hold.  One such task is the whole job; several are joined by large-star and
    small-star rounds, where minima are combined before they are shuffled and joins on a hot node have
    rows of that node on one side only.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    tasks = max(1, -(-e.count() // local_edges))
    e = cut(_contracted(e, tasks))
    mark = None
    while tasks > 1:
        e = cut(_small(_large(e)))
        release(e.sparkSession)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
