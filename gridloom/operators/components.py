"""Connected components on grids, cluster tables, peaks, partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators.order import cut as _cut
from gridloom.operators.order import ranked, running, stored
from gridloom.operators.stencil import neighbour_offsets, taps
from gridloom.rng import mulberry32

TILE, LOCAL_EDGES = 32, 1_000_000


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for nodes 0 to n - 1 and edges (x, y)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, low[x], low[y])
        np.minimum.at(new, low[y], low[x])
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


def _contract(frames):
    """(node, root) of the nodes of an edge list (a, b)."""
    parts = [f for f in frames if len(f)]
    if parts:
        e = pd.concat(parts)
        nodes, at = np.unique(np.r_[e["a"], e["b"]], return_inverse=True)
        yield pd.DataFrame({"node": nodes, "root": nodes[_least(len(nodes), at[: len(e)], at[len(e) :])]})


def _in_tile(pdf: pd.DataFrame, half: list[tuple[int, int, int]], same: str | None, tile: int) -> pd.DataFrame:
    """The cells of one tile with the least cell of their component inside it, and whether they lie at its border."""
    pdf = pdf.sort_values("idx")
    c = pdf[["i", "j", "k"]].to_numpy() % tile
    place = np.full((tile,) * 3, -1)
    place[tuple(c.T)] = np.arange(len(pdf))
    group = pdf[same].to_numpy() if same else np.zeros(len(pdf))
    xs, ys = [], []
    for o in half:
        here = place[tuple(slice(max(0, -d), tile - max(0, d)) for d in o)].ravel()
        there = place[tuple(slice(max(0, d), tile - max(0, -d)) for d in o)].ravel()
        on = (here >= 0) & (there >= 0)
        on[on] = group[here[on]] == group[there[on]]
        xs.append(here[on])
        ys.append(there[on])
    idx = pdf["idx"].to_numpy()
    pdf["local"] = idx[_least(len(pdf), np.concatenate(xs), np.concatenate(ys))]
    pdf["border"] = ((c == 0) | (c == tile - 1)).any(axis=1)
    return pdf


def roots(cells: DataFrame, grid: Grid, connectivity: int = 26, same: str | None = None, local_edges: int = LOCAL_EDGES, tile: int = TILE) -> DataFrame:
    """(idx, root): the least cell of each component of ``cells``; with ``same``, neighbours must agree in that column.

    Cells meet in tiles of ``tile`` an edge, where components are found in arrays; only links over the borders of tiles leave them, as
    pairs of the tiles' components.  Up to ``LOCAL_EDGES`` such pairs are one task's array work; more take
    rounds of minimum over neighbours with pointer jumping.
    """
    half = [o for o in neighbour_offsets(connectivity) if o > (0, 0, 0)]
    dims = [int(n) for n in grid.dim[:3]]
    axes = dict(zip("ijk", grid.axes_of("idx"), strict=False))
    d = cells.select(F.col("idx").cast("long").alias("idx"), *([same] if same else [])).withColumns(axes)
    kind = f", {same} {d.schema[same].dataType.simpleString()}" if same else ""
    block = [F.floor(F.col(c) / tile) for c in "ijk"]
    inside = d.groupBy(*[t.alias(f"t{c}") for t, c in zip(block, "ijk", strict=True)]).applyInPandas(lambda pdf: _in_tile(pdf[["idx", *([same] if same else []), "i", "j", "k"]], half, same, tile), f"idx long{kind}, i int, j int, k int, local long, border boolean")
    inside = _cut(inside)
    rim = inside.filter("border")
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(o, "abc", strict=True)]) for o in half]))
    at = [F.col(c) + F.col(f"o.{n}") for c, n in zip("ijk", "abc", strict=True)]
    reach = rim.select("local", *([F.col(same).alias("__mine")] if same else []), "i", "j", "k", step.alias("o"))
    within = [(c >= 0) & (c < n) for c, n in zip(at, dims, strict=True)]
    other = [F.floor(c / tile) != F.floor(F.col(n) / tile) for c, n in zip(at, "ijk", strict=True)]
    reach = reach.filter(within[0] & within[1] & within[2] & (other[0] | other[1] | other[2]))
    reach = reach.select("local", *(["__mine"] if same else []), (at[0].cast("long") + at[1] * dims[0] + at[2].cast("long") * dims[0] * dims[1]).alias("idx"))
    links = reach.join(rim.select("idx", F.col("local").alias("b"), *([same] if same else [])), "idx")
    links = _cut((links.filter(F.col(same) == F.col("__mine")) if same else links).select(F.col("local").alias("a"), "b").distinct())
    root = _contracted(links, local_edges)
    return inside.select("idx", "local").join(root, F.col("local") == F.col("node"), "left").select("idx", F.coalesce("root", "local").alias("root"))


def _contracted(links: DataFrame, local_edges: int) -> DataFrame:
    """(node, root) of the nodes of a graph of links (a, b): the least node of each component."""
    if links.count() <= local_edges:
        return links.coalesce(1).mapInPandas(_contract, "node long, root long")
    edges = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lab = _cut(edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        low = edges.join(lab.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        new = lab.join(low.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = stored(new.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        lab = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            return lab


def label_components(vol: DataFrame, grid: Grid, threshold: float, connectivity: int = 26, signed: bool = False) -> DataFrame:
    """(idx, value, label, size): components of cells at or above the threshold (``signed``: of |value|, one sign each).

    Labels rank by size, equal sizes by their first cell; missing cells belong to none.
    """
    v = vol.filter(~F.isnan("value"))
    on = v.filter(F.abs("value") >= threshold) if signed else v.filter(F.col("value") >= threshold)
    on = on.select("idx", "value", F.signum("value").alias("sign"))
    r = roots(on, grid, connectivity, "sign" if signed else None)
    size = r.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    rank = ranked(size, [F.desc("size"), F.col("root")], "nth").withColumn("label", (F.col("nth") + 1).cast("int")).drop("nth")
    return on.join(r, "idx").join(rank, "root").select("idx", "value", "label", "size")


def component_at(vol: DataFrame, grid: Grid, cell: int, threshold: float, connectivity: int = 26) -> DataFrame:
    """The same-sign component that holds a cell."""
    c = label_components(vol, grid, threshold, connectivity, signed=True)
    return c.join(c.filter(F.col("idx") == cell).select("label"), "label", "left_semi")


def extent_filter(vol: DataFrame, grid: Grid, threshold: float, least: int, connectivity: int = 26) -> DataFrame:
    """Supra-threshold cells in components below ``least`` cells become 0; nothing changes for least <= 1."""
    if least <= 1:
        return vol
    c = label_components(vol, grid, threshold, connectivity, signed=True).filter(F.col("size") < least).select("idx", F.lit(True).alias("small"))
    return vol.join(c, "idx", "left").select("idx", F.when(F.col("small"), 0.0).otherwise(F.col("value")).alias("value"))


def cluster_table(clusters: DataFrame, grid: Grid) -> DataFrame:
    """Per label: size, centre (grid and world), peak value and its first cell, mean."""
    c = grid.with_axes(clusters)
    peak = F.min_by(F.struct("idx", "value"), F.struct((-F.col("value")).alias("v"), "idx"))
    d = c.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("i").alias("ci"), F.avg("j").alias("cj"), F.avg("k").alias("ck"), F.avg("value").alias("mean"), peak.alias("p"))
    w = grid.to_world("ci", "cj", "ck")
    return d.select("label", "size", "ci", "cj", "ck", w[0].alias("cx"), w[1].alias("cy"), w[2].alias("cz"), F.col("p.value").alias("peak"), F.col("p.idx").alias("peak_idx"), "mean")


def local_maxima(clusters: DataFrame, grid: Grid, min_distance: float | None = None) -> DataFrame:
    """Cells above all same-cluster 26-neighbours; with a distance (mm), greedily thinned from the highest per cluster."""
    near = taps(clusters.select("idx", F.col("value").alias("x"), F.col("label").alias("l")), grid, neighbour_offsets(26), ("x", "l"))
    beaten = near.join(clusters.select("idx", "label", "value"), "idx").filter("l = label and x >= value").select("idx").distinct()
    peaks = clusters.join(beaten, "idx", "left_anti").select("idx", "label", "value")
    if min_distance is None:
        return peaks
    w = grid.world_of_index("idx")
    peaks = _cut(peaks.select("idx", "label", "value", *[c.alias(n) for c, n in zip(w, "xyz", strict=True)]))
    return thinned(peaks, min_distance)


def thinned(peaks: DataFrame, distance: float) -> DataFrame:
    """(idx, label, value) of the peaks (with places x, y, z) that a pick from the highest down keeps, none nearer than ``distance`` to a kept one of its label.

    Peaks meet in boxes of that size.  In each round those above all rivals that are left stay and their rivals go, which is
    the pick's result without its order; equal values go by idx.
    """
    box = lambda: [F.floor(F.col(c) / distance).cast("long") for c in "xyz"]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "abc", strict=True)]) for o in [(0, 0, 0), *neighbour_offsets(26)]]))
    near = peaks.select(F.col("idx").alias("low"), "label", F.col("value").alias("v"), *[F.col(c).alias(f"{c}1") for c in "xyz"], *[b.alias(f"b{c}") for b, c in zip(box(), "xyz", strict=True)], step.alias("o"))
    near = near.withColumns({f"b{c}": F.col(f"b{c}") + F.col(f"o.{n}") for c, n in zip("xyz", "abc", strict=True)}).drop("o")
    other = peaks.select("label", F.col("idx").alias("high"), F.col("value").alias("w"), "x", "y", "z", *[b.alias(f"b{c}") for b, c in zip(box(), "xyz", strict=True)])
    apart = sum(((F.col(c) - F.col(f"{c}1")) * (F.col(c) - F.col(f"{c}1")) for c in "xyz"), F.lit(0.0))
    above = (F.col("w") > F.col("v")) | ((F.col("w") == F.col("v")) & (F.col("high") < F.col("low")))
    rivals = _cut(near.join(other, ["label", "bx", "by", "bz"]).filter(above & (apart < distance * distance)).select("low", "high"))
    left, kept = peaks.select("idx"), None
    while not rivals.isEmpty():
        # peaks without a rival above them stay, and take those below them away
        stay = left.join(rivals.select(F.col("low").alias("idx")).distinct(), "idx", "left_anti")
        gone = rivals.join(stay.select(F.col("idx").alias("high")), "high", "left_semi").select(F.col("low").alias("idx")).distinct()
        stay = stored(stay)
        gone = stored(gone)
        kept = stay if kept is None else kept.unionByName(stay)
        left = stored(left.join(stay, "idx", "left_anti").join(gone, "idx", "left_anti"))
        rivals = stored(rivals.join(left.select(F.col("idx").alias("low")), "low", "left_semi").join(left.select(F.col("idx").alias("high")), "high", "left_semi"))
    kept = left if kept is None else kept.unionByName(left)
    return peaks.join(kept, "idx", "left_semi").select("idx", F.col("label").cast("long").alias("label"), "value")


def kmeans_1d(vol: DataFrame, k: int, seed: int = 1, iterations: int = 100) -> DataFrame:
    """(idx, value, label): seeded k-means on values, labels 1..k.

    Rounds run on distinct values with counts; only centres and one drawn value at a time reach the driver.
    """
    draw = mulberry32(seed)
    d = _cut(vol.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    run = running(d, [F.col("value")], {"before": F.col("n")}).withColumn("cum", F.col("before") + F.col("n"))
    total = d.agg(F.sum("n")).first()[0]
    centres = [run.filter(F.col("cum") > int(draw() * total)).agg(F.min("value")).first()[0]]
    near = lambda c: F.least(*[F.abs(F.col("value") - x) for x in c]) if len(c) > 1 else F.abs(F.col("value") - c[0])
    while len(centres) < k:
        w = d.withColumn("w", near(centres) * near(centres) * F.col("n"))
        s = w.agg(F.sum("w")).first()[0]
        nxt = running(w, [F.col("value")], {"before": F.col("w")}).withColumn("cum", F.col("before") + F.col("w")).filter((F.col("cum") > draw() * s) & (F.col("w") > 0)).agg(F.min("value")).first()[0] if s else None
        if nxt is None:
            break
        centres.append(nxt)
    which = lambda c: F.array_position(F.transform(F.array(*[F.lit(x) for x in c]), lambda m: F.abs(m - F.col("value"))), near(c)).cast("int")
    for _ in range(iterations):
        got = dict(d.groupBy(which(centres).alias("c")).agg(F.sum(F.col("value") * F.col("n")) / F.sum("n")).collect())
        new = [got.get(i + 1, c) for i, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return vol.select("idx", "value", which(centres).alias("label"))


def block_partition(cells: DataFrame, grid: Grid, block_mm: float) -> DataFrame:
    """(idx, block): grid-aligned cuboids of about ``block_mm``, numbered densely in grid order."""
    n = [max(1, int(math.floor(block_mm / s + 0.5))) for s in grid.spacing[:3]]
    b = [F.floor(c / m) for c, m in zip(grid.axes_of("idx"), n, strict=True)]
    d = cells.select("idx", *[x.alias(c) for x, c in zip(b, "abc", strict=True)])
    ids = ranked(d.select("c", "b", "a").distinct(), [F.col(x) for x in "cba"], "block").withColumn("block", F.col("block").cast("int"))
    return d.join(ids, ["a", "b", "c"]).select("idx", "block")
