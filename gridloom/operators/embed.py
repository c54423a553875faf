"""Embeddings and trees of k members: numpy on k x k matrices, whose size is the number of maps, not of cells.

Independent starts, replicates and covariates run as groups of ``applyInPandas``; the matrix is their input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.num import is_finite
from gridloom.operators.order import cut, running
from gridloom.rng import draws, mulberry32

MAX_MEMBERS = 4096


def matrix(dist: DataFrame, missing: float = np.nan) -> tuple[np.ndarray, list]:
    """A symmetric matrix of (i, j, d) pairs and the ids in order; at most MAX_MEMBERS members, whose pairs come in one job."""
    most = MAX_MEMBERS * (MAX_MEMBERS - 1) // 2
    t = dist.select("i", "j", F.col("d").cast("double")).limit(most + 1).toArrow()
    i, j = (np.array(t.column(c).to_pylist()) for c in ("i", "j"))
    ids = np.unique(np.concatenate([i, j])) if len(i) else np.zeros(0, int)
    if t.num_rows > most or len(ids) > MAX_MEMBERS:
        raise ValueError("too many members for a dense matrix")
    out = np.full((len(ids), len(ids)), missing)
    np.fill_diagonal(out, 0.0)
    d = t.column("d").to_numpy()
    d = np.where(np.isnan(d), missing, d)
    i, j = np.searchsorted(ids, i), np.searchsorted(ids, j)
    out[i, j] = out[j, i] = d
    return out, ids.tolist()


# ------------------------------------------------------------------ trees
@dataclass
class Tree:
    """Merges (left, right, height); leaves are 0..k-1, merge m makes node k + m."""

    k: int
    merges: list[tuple[int, int, float]]

    def leaves(self, node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            if n < self.k:
                out.append(n)
            else:
                a, b, _ = self.merges[n - self.k]
                todo += [b, a]
        return out


def average_linkage(d: np.ndarray) -> Tree:
    """UPGMA; non-finite distances count as 2."""
    k = len(d)
    x = np.where(np.isfinite(d), d, 2.0).astype(float)
    np.fill_diagonal(x, np.inf)
    node, size, alive, merges = list(range(k)), np.ones(k), np.ones(k, bool), []
    for m in range(k - 1):
        flat = np.where(alive[:, None] & alive[None, :], x, np.inf)
        i, j = divmod(int(flat.argmin()), k)
        i, j = min(i, j), max(i, j)
        merges.append((node[i], node[j], float(x[i, j])))
        x[i] = (size[i] * x[i] + size[j] * x[j]) / (size[i] + size[j])
        x[:, i], x[i, i] = x[i], np.inf
        size[i], alive[j], node[i] = size[i] + size[j], False, k + m
    return Tree(k, merges)


def cut_tree(tree: Tree, groups: int) -> list[int]:
    """Labels 0.. by leaf order after splitting the highest merges."""
    top = [tree.k + len(tree.merges) - 1] if tree.merges else [0]
    while len(top) < min(groups, tree.k):
        n = max((t for t in top if t >= tree.k), key=lambda t: tree.merges[t - tree.k][2])
        at = top.index(n)
        top[at : at + 1] = tree.merges[n - tree.k][:2]
    out = [0] * tree.k
    for label, n in enumerate(top):
        for leaf in tree.leaves(n):
            out[leaf] = label
    return out


def optimal_leaf_order(tree: Tree, d: np.ndarray) -> list[int]:
    """Leaf order of least adjacent distance among all flips of the tree, by dynamic programming over end pairs."""
    if tree.k == 1:
        return [0]
    best: dict[int, dict[tuple[int, int], tuple[float, tuple]]] = {i: {(i, i): (0.0, ())} for i in range(tree.k)}
    for m, (a, b, _) in enumerate(tree.merges):
        table: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (u, p), (ca, _) in best[a].items():
            for (q, w), (cb, _) in best[b].items():
                c = ca + cb + d[p, q]
                for key, how in (((u, w), (a, u, p, b, q, w)), ((w, u), (b, w, q, a, p, u))):
                    if key not in table or c < table[key][0] - 1e-15:
                        table[key] = (c, how)
        best[tree.k + m] = table

    def order(n, u, w):
        if n < tree.k:
            return [n]
        a, au, ap, b, bq, bw = best[n][u, w][1]
        return order(a, au, ap) + order(b, bq, bw)

    root = tree.k + len(tree.merges) - 1
    u, w = min(best[root], key=lambda e: (best[root][e][0], e))
    return order(root, u, w)


def path_length(order: list[int], d: np.ndarray) -> float:
    return float(sum(d[a, b] for a, b in zip(order, order[1:], strict=False)))


def seriate(similarity: np.ndarray) -> tuple[list[int], Tree]:
    """The best order of the leaves, and the tree with its branches turned to that order."""
    d = 1 - similarity
    t = average_linkage(d)
    order = optimal_leaf_order(t, np.where(np.isfinite(d), d, 2.0))
    at = {leaf: i for i, leaf in enumerate(order)}
    first = [at[i] for i in range(t.k)]  # of every node's leaves
    merges = []
    for a, b, height in t.merges:
        merges.append((a, b, height) if first[a] < first[b] else (b, a, height))
        first.append(min(first[a], first[b]))
    return order, Tree(t.k, merges)


def branches(spark: SparkSession, tree: Tree) -> DataFrame:
    """node, leaves, place (of its first leaf in the tree's order), since, until, height: a node is a branch of every cut into
    ``since`` to ``until`` groups (no end for a leaf).

    Cutting into k groups undoes the k - 1 highest merges, so a node appears when its parent's rank by height is undone
    and goes with its own.
    """
    ranks = {n: i + 1 for i, n in enumerate(sorted(range(len(tree.merges)), key=lambda m: (-tree.merges[m][2], -m)))}
    rows = [(tree.k + m, tree.leaves(tree.k + m), ranks[m], h) for m, (_, _, h) in enumerate(tree.merges)] + [(n, [n], None, None) for n in range(tree.k)]
    up = {child: ranks[m] for m, (a, b, _) in enumerate(tree.merges) for child in (a, b)}
    place = {leaf: i for i, leaf in enumerate(tree.leaves(tree.k + len(tree.merges) - 1))}
    return spark.createDataFrame([(n, leaves, place[leaves[0]], up.get(n, 0) + 1, until, h) for n, leaves, until, h in rows], "node int, leaves array<int>, place int, since int, until int, height double")


def suggest_groups(tree_branches: DataFrame, most: int = 6, gap: float = 0.02, least: int | None = None) -> DataFrame:
    """cut, gap, groups, chosen, widest, member, grp: every candidate cut of a tree's :func:`branches`, one row a leaf.

    The gap of a cut is the difference of the merge heights that it separates.  Branches of ``least`` leaves or more (a tenth of
    all, two at least) are groups, numbered in the tree's order; leaves of others have none (grp null).  The
    chosen cut is the one with the widest gap above ``gap`` that has two to ``most`` groups, if any; cuts into up to three branches more are candidates.
    ``widest``: the cut of the widest gap of all.
    """
    d, size = tree_branches, F.size("leaves")
    n = d.agg(F.max(size)).scalar()
    least = F.greatest(F.lit(2), F.ceil(n / 10)) if least is None else F.lit(least)
    heights = d.filter("height is not null").select("until", "height")
    steps = heights.alias("h").join(heights.alias("l"), F.col("l.until") == F.col("h.until") + 1).select((F.col("h.until") + 1).alias("cut"), (F.col("h.height") - F.col("l.height")).alias("gap"))
    spans = F.sequence(F.greatest("since", F.lit(2)), F.least(F.coalesce("until", F.lit(most + 3)), F.lit(most + 3)))
    at = d.filter(F.greatest("since", F.lit(2)) <= F.least(F.coalesce("until", F.lit(most + 3)), F.lit(most + 3))).select(F.explode(spans).alias("cut"), "node", "leaves", "place", (size >= least).alias("large"))
    counts = at.groupBy("cut").agg(F.count_if("large").alias("groups"))
    fits = F.col("groups").between(2, most) & (F.col("gap") > gap)
    cuts = steps.filter(F.col("cut") <= most + 3).join(counts, "cut")
    best = cuts.agg(F.max_by("cut", F.struct(fits.cast("int").alias("fits"), "gap", -F.col("cut"))).alias("best"), F.max_by("cut", F.struct("gap", -F.col("cut"))).alias("wide"), F.bool_or(fits).alias("some"))
    cuts = cuts.crossJoin(F.broadcast(best)).select("cut", "gap", "groups", (F.col("some") & (F.col("cut") == F.col("best"))).alias("chosen"), (F.col("cut") == F.col("wide")).alias("widest"))
    by = W.partitionBy("cut").orderBy("place")  # at most ``most`` + 3 branches
    named = at.filter("large").withColumn("grp", F.row_number().over(by) - 1).select("cut", "node", "grp")
    return at.join(named, ["cut", "node"], "left").join(cuts, "cut").select("cut", "gap", "groups", "chosen", "widest", F.explode("leaves").alias("member"), "grp")


def cluster_count(tree_branches: DataFrame, most: int = 6, gap: float = 0.02, least: int | None = None) -> int:
    """The number of suggested groups, 1 where none is suggested."""
    row = suggest_groups(tree_branches, most, gap, least).filter("chosen").select("groups").first()
    return row[0] if row else 1


# ------------------------------------------------------------------ scaling
def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    w = np.ones(len(y)) if w is None else w
    blocks: list[list[float]] = []
    for v, u in zip(y, w, strict=True):
        blocks.append([v, u, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, u2, n2 = blocks.pop()
            v1, u1, n1 = blocks.pop()
            blocks.append([(v1 * u1 + v2 * u2) / (u1 + u2), u1 + u2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def disparities(delta: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Monotone disparities, ties free (primary approach)."""
    order = np.lexsort((d, delta))
    out = np.empty(len(d))
    out[order] = isotonic(d[order])
    return out


def stress1(d: np.ndarray, dhat: np.ndarray) -> float:
    s = float((d * d).sum())
    return math.sqrt(float(((d - dhat) ** 2).sum()) / s) if s > 0 else 0.0


def _pair_distances(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(x), 1)
    return np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))


def classical(delta: np.ndarray, dims: int = 2) -> np.ndarray:
    k = len(delta)
    j = np.eye(k) - 1.0 / k
    val, vec = np.linalg.eigh(-0.5 * j @ (delta**2) @ j)
    top = np.argsort(val)[::-1][:dims]
    x = vec[:, top] * np.sqrt(np.maximum(val[top], 0))
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return x * np.where(sign == 0, 1, sign)


def smacof(delta: np.ndarray, x: np.ndarray, metric: bool = False, iterations: int = 300, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Majorisation from a start: ratio scaling (metric) or monotone disparities (nonmetric)."""
    k = len(delta)
    i, j = np.triu_indices(k, 1)
    flat, last = delta[i, j], math.inf
    for _ in range(iterations):
        d = _pair_distances(x)
        if d.max() < 1e-12:
            break
        hat = flat * (flat @ d) / max(flat @ flat, 1e-300) if metric else disparities(flat, d)
        norm = math.sqrt((d @ d) / max(hat @ hat, 1e-300))
        hat = hat * norm
        s = stress1(d, hat)
        if last - s < tol:
            break
        last = s
        b = np.zeros((k, k))
        b[i, j] = b[j, i] = -np.where(d > 1e-12, hat / np.maximum(d, 1e-12), 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        x = b @ x / k
    d = _pair_distances(x)
    hat = flat * (flat @ d) / max(flat @ flat, 1e-300) if metric else disparities(flat, d)
    return x, stress1(d, hat)


def _start(delta: np.ndarray, n: int, seed: int) -> np.ndarray:
    if n == 0:
        return classical(delta)
    draw = mulberry32(seed + n)
    return np.array([[draw() - 0.5, draw() - 0.5] for _ in range(len(delta))]) * float(delta.max() or 1.0)


def nmds(spark: SparkSession, delta: np.ndarray, seed: int = 1, starts: int = 8) -> tuple[np.ndarray, float, str]:
    """Nonmetric scaling to two dimensions: one classical and ``starts`` seeded starts, each a task; best stress wins.

    Falls back to metric scaling where the nonmetric solution is degenerate (points pile up on few places).
    """

    def run(frames):
        for pdf in frames:
            found = [smacof(delta, _start(delta, int(n), seed)) for n in pdf["id"]]
            yield pd.DataFrame({"start": pdf["id"], "stress": [s for _, s in found], "x": [x.ravel().tolist() for x, _ in found]})

    tasks = min(starts + 1, spark.sparkContext.defaultParallelism)
    rows = spark.range(0, starts + 1, 1, tasks).mapInPandas(run, "start long, stress double, x array<double>").collect()
    best = min(rows, key=lambda r: (r["stress"], r["start"]))
    x = np.array(best["x"]).reshape(-1, 2)
    spread = np.unique(np.round(x / max(np.abs(x).max(), 1e-12), 3), axis=0)
    if len(delta) > 3 and len(spread) <= max(3, len(delta) // 4):
        x, s = smacof(delta, classical(delta), metric=True)
        return x, s, "metric"
    return x, float(best["stress"]), "nonmetric"


def align(x: np.ndarray, to: np.ndarray, scale: bool = False) -> np.ndarray:
    """Rotation, reflection, translation (and scale) of ``x`` onto ``to``."""
    a, b = x - x.mean(axis=0), to - to.mean(axis=0)
    u, s, v = np.linalg.svd(a.T @ b)
    k = s.sum() / max((a * a).sum(), 1e-300) if scale else 1.0
    return a @ (u @ v) * k + to.mean(axis=0)


def stability(distances: DataFrame, reference: np.ndarray, ids: list, fit=None) -> DataFrame:
    """(rep, member, x, y): every bootstrap replicate's distances (rep, a, b, distance) refitted and aligned, one task each."""
    fit = fit or (lambda d: smacof(d, classical(d))[0])
    at = {m: n for n, m in enumerate(ids)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros((len(ids), len(ids)))
        for a, b, v in zip(pdf["a"], pdf["b"], pdf["distance"], strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = 1.0 if v is None or not np.isfinite(v) else v
        x = align(fit(d), reference)
        return pd.DataFrame({"rep": int(pdf["rep"].iloc[0]), "member": ids, "x": x[:, 0], "y": x[:, 1]})

    return distances.groupBy("rep").applyInPandas(run, "rep int, member long, x double, y double")


# ------------------------------------------------------------------ covariates on a layout
#: places that a task puts in order at a time
PLACES = 4096


def permuted(values: DataFrame, permutations: int, seed: int = 1) -> DataFrame:
    """rep and the columns of ``values`` (name, member, value, ...): the values of each name dealt anew among its members.

    Replicate 0 is what is observed; in replicate r the place of a member (from 0, in order) draws the number of that place from the generator seeded with
    ``seed`` + r, and the place with the n-th least number gets the n-th member's value; other columns stay with the member.  Replicates are rows, so they spread over
    tasks.  Draws are even, so ranges of them hold about ``PLACES`` places each: a range is put in order by itself and the ranges' counts are summed up, so that no task holds a name.
    """
    stay = [c for c in values.columns if c != "value"]
    own = values.select(F.lit(0).alias("rep"), *stay, "value")
    if not permutations:
        return own
    r = running(values, [F.col("name"), F.col("member")], {}, "__row")
    names = r.groupBy("name").agg(F.min("__row").alias("__base"), F.count(F.lit(1)).alias("n"))  # a row a covariate
    v = cut(r.join(F.broadcast(names), "name").withColumn("i", F.col("__row") - F.col("__base")).select(*stay, "value", "i", "n").repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "i"))
    drawn = v.select(*stay, "i", "n", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("rep"))
    # as an expression beside other columns the draw is too long to be compiled
    drawn = drawn.withColumn("u", F.pandas_udf(draws, "double")(F.lit(seed) + F.col("rep"), F.col("i")))
    drawn = drawn.withColumn("part", F.floor(F.col("u") * F.ceil(F.col("n") / PLACES)))
    keys = ["name", "rep", "part"]
    before = W.partitionBy("name", "rep").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    base = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).select(*keys, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = drawn.withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy("u", "i")) - 1).drop("i", "n", "u")
    dealt = inside.join(base, keys).select("rep", *stay, (F.col("base") + F.col("at")).alias("i"))
    # values meet their places by a shuffle: what Spark takes for a small table by its compressed size is large on the driver
    dealt = dealt.join(v.select("name", "i", "value").hint("merge"), ["name", "i"])
    return dealt.select("rep", *stay, "value").unionByName(v.select(F.lit(0).alias("rep"), *stay, "value"))


def envfit(layout: DataFrame, covariates: DataFrame, kind: str = "vector", permutations: int = 999, seed: int = 1) -> DataFrame:
    """(name, r2, p, dx, dy): R^2 of a linear (vector) or centroid (factor) fit of covariates (name, member, value) on a layout
    (member, x, y), the share of permutations that fit as well, and the direction of a vector.

    All replicates come from one aggregate of sums; members are only joined by shuffles.  Members without a finite value or place are left out; fewer than four, a layout on
    a line or a constant covariate give null.
    """
    here = layout.filter(is_finite("x") & is_finite("y")).select("member", "x", "y")
    v = covariates.filter(is_finite("value") if kind == "vector" else F.col("value").isNotNull()).select("name", "member", "value").join(here.hint("merge"), "member")
    x, y = F.col("x"), F.col("y")
    if kind == "vector":
        e = permuted(v, permutations, seed)
        w, n = F.col("value").cast("double"), F.count(F.lit(1)).cast("double")
        c = {"a": F.covar_pop(x, w) * n, "b": F.covar_pop(y, w) * n, "xx": F.var_pop(x) * n, "yy": F.var_pop(y) * n, "xy": F.covar_pop(x, y) * n, "t": F.var_pop(w) * n, "n": n}
        g = e.groupBy("name", "rep").agg(*[f.alias(k) for k, f in c.items()])
        det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
        ok = (F.col("n") >= 4) & (det > 1e-12 * F.greatest(F.col("xx") * F.col("yy"), F.lit(1e-300))) & (F.col("t") > 0)
        g = g.withColumns({"bx": F.when(ok, (F.col("a") * F.col("yy") - F.col("b") * F.col("xy")) / det), "by": F.when(ok, (F.col("b") * F.col("xx") - F.col("a") * F.col("xy")) / det)})
        g = g.withColumn("r2", (F.col("bx") * F.col("a") + F.col("by") * F.col("b")) / F.when(ok, F.col("t")))
        long = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by"))
        g = g.select("name", "rep", "r2", F.when(long > 0, F.col("bx") / F.when(long > 0, long)).otherwise(F.col("bx")).alias("dx"), F.when(long > 0, F.col("by") / F.when(long > 0, long)).otherwise(F.col("by")).alias("dy"))
    else:
        # sums about the members' centre, which permutations leave where it is
        mid = v.groupBy("name").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))  # a row a covariate
        v = v.join(F.broadcast(mid), "name").select("name", "member", "value", (x - F.col("cx")).alias("x"), (y - F.col("cy")).alias("y"))
        e = permuted(v, permutations, seed)
        g = e.groupBy("name", "rep", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * x + y * y).alias("q"))
        between = F.sum((F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / F.col("n"))
        g = g.groupBy("name", "rep").agg(between.alias("b"), F.sum("q").alias("q"))
        none = F.lit(None).cast("double")
        g = g.select("name", "rep", F.when(F.col("q") > 0, F.col("b") / F.when(F.col("q") > 0, F.col("q"))).alias("r2"), none.alias("dx"), none.alias("dy"))
    g = cut(g)  # a row a covariate and replicate
    seen = g.filter("rep = 0").select("name", F.col("r2").alias("own"), "dx", "dy")
    hits = g.filter("rep > 0").join(seen.select("name", "own"), "name").groupBy("name").agg(F.count_if(F.col("r2") >= F.col("own") - 1e-12 * F.greatest(F.lit(1.0), F.col("own"))).alias("hits"))
    p = (F.coalesce("hits", F.lit(0)) + 1) / F.lit(permutations + 1.0)
    return seen.join(hits, "name", "left").select("name", F.col("own").alias("r2"), F.when(F.col("own").isNotNull(), p).alias("p"), "dx", "dy")


# ------------------------------------------------------------------ display helpers
def _lens(x: Column, y: Column, cx: float, cy: float, radius: float, distortion: float) -> tuple[Column, Column, float]:
    """(offset from the focus in radii, whether the lens moves it, distortion)."""
    d = float(distortion) if math.isfinite(distortion) and distortion > 0 else 0.0
    q = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (radius if radius > 0 else 1.0)
    return q, F.lit(radius > 0 and d > 0) & (q < 1), d


def lens(x: Column, y: Column, cx: float, cy: float, radius: float, distortion: float = 2.0) -> Column:
    """A struct (x, y, scale): points within ``radius`` of a focus move outwards, by ``distortion + 1`` near it; others stay."""
    q, on, d = _lens(x, y, cx, cy, radius, distortion)
    k = F.when(on, (d + 1) / (q * d + 1)).otherwise(1.0)
    scale = F.when(on, (d + 1) / ((q * d + 1) * (q * d + 1))).otherwise(1.0)
    return F.struct((cx + (x - cx) * k).alias("x"), (cy + (y - cy) * k).alias("y"), scale.alias("scale"))


def inverse_lens(x: Column, y: Column, cx: float, cy: float, radius: float, distortion: float = 2.0) -> Column:
    """A struct (x, y): where a point seen through :func:`lens` lies."""
    q, on, d = _lens(x, y, cx, cy, radius, distortion)
    k = F.when(on, 1 / (d + 1 - q * d)).otherwise(1.0)
    return F.struct((cx + (x - cx) * k).alias("x"), (cy + (y - cy) * k).alias("y"))
