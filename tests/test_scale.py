"""Work that must not meet in one task: order, ranks, quantiles, Gram matrices; trees, lines and lenses by definition."""

import gzip
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.grid import Grid
from gridloom.operators import components, design, embed, isolines, joins, order, reduce, roi, setstats, stencil, supervoxels
from gridloom.rng import mulberry32
from gridloom.sources import nifti
from gridloom.streaming import moments


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(50), rng.random()) for k in range(500)]
    d = spark.createDataFrame(rows, "k int, v int, w double").repartition(7)
    got = {r["k"]: (r["s"], r["n"], r["t"]) for r in order.running(d, [F.col("v").desc(), F.col("k")], {"s": F.col("v"), "t": F.col("w")}, "n").collect()}
    s = t = 0
    for n, (k, v, w) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        assert got[k][:2] == (s, n) and abs(got[k][2] - t) < 1e-9
        s, t = s + v, t + w
    assert order.ranked(d.limit(0), [F.col("k")], "n").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
def test_quantiles(spark, q):
    x = [1.0, 1.0, 1.0, 2.5, 7.0, 7.0, 9.0, -3.0, 4.0, 4.5]
    d = spark.createDataFrame([(v,) for v in [*x, None]], "value double")
    assert abs(order.quantiles(d, "value", [q])[0] - np.quantile(x, q)) < 1e-12
    assert order.quantiles(d.limit(0), "value", [q]) == [None]


def test_ranks_average_ties(spark):
    rows = [("a", 3), ("a", 1), ("a", 3), ("a", None), ("b", 5), ("b", 5), ("b", 2)]
    d = spark.createDataFrame(rows, "g string, v int")
    assert sorted(r["rank"] for r in stats.ranks(d, "v").collect()) == [1, 2, 3, 4.5, 4.5, 6.5, 6.5]
    assert sorted((r["g"], r["rank"]) for r in stats.ranks(d, "v", "g").collect()) == [("a", 1), ("a", 2), ("a", 3.5), ("a", 3.5), ("b", 1), ("b", 2.5), ("b", 2.5)]


def test_robust_z_and_outliers_over_all_rows(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    d = spark.createDataFrame([(v,) for v in x], "value double")
    mad = np.median(np.abs(np.array(x) - 3.5))
    assert np.allclose(sorted(r[0] for r in setstats.robust_z(d).collect()), sorted((np.array(x) - 3.5) / (1.4826 * mad)))
    assert [r["value"] for r in reduce.tukey_outliers(d).collect()] == [100.0]


def test_no_single_task_orders(spark):
    """The plans of global orders have no window or exchange into one partition over the rows."""
    d = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("value"))
    cells = spark.range(40).select(F.col("id").alias("idx"), F.lit(1.0).alias("value"))
    grid = Grid((4, 5, 2))
    for out in (stats.ranks(d, "value"), components.block_partition(cells, grid, 2.0), joins.first_seen_levels(d.select("id", "value"), "value", "id"), roi.bootstrap_searchlights(cells.select("idx"), grid, 1.0, 5)):
        plan = out._jdf.queryExecution().toString()
        windows = [x for x in plan.splitlines() if "WindowExec" in x or x.strip().startswith(("+- Window", "Window "))]
        assert not [x for x in windows if "[__range" not in x and "__v0b" not in x and "windowspecdefinition(__range" not in x], plan


@pytest.mark.parametrize(("block", "piece"), [(256, 2048), (2, 7), (1, 50)])
def test_gram_equals_pairs(spark, block, piece):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 200)) + 1000
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5] = 3.25
    x[5, ::3] = np.nan
    d = spark.createDataFrame([(m, p, float(x[m, p])) for m in range(6) for p in range(200)], "member int, pos int, value double")
    old, setstats.SLICE = setstats.SLICE, piece
    try:
        got = {(r["a"], r["b"]): r["r"] for r in setstats.correlation_matrix(d, block=block).collect()}
    finally:
        setstats.SLICE = old
    assert set(got) == set(itertools.combinations(range(6), 2))
    for (a, b), r in got.items():
        ok = np.isfinite(x[a]) & np.isfinite(x[b])
        assert r is None if 5 in (a, b) else abs(r - np.corrcoef(x[a, ok], x[b, ok])[0, 1]) < 1e-9
    lab = spark.range(200).select(F.col("id").cast("int").alias("pos"), (F.col("id") % 3).cast("int").alias("label"))
    m = {(r["label"], r["a"], r["b"]): r for r in setstats.parcel_moments(d, lab).collect()}
    ok = np.isfinite(x[0]) & np.isfinite(x[1]) & (np.arange(200) % 3 == 1)
    assert m[1, 0, 1]["n"] == ok.sum() and abs(m[1, 0, 1]["sxy"] - (x[0, ok] * x[1, ok]).sum()) < 1e-3
    assert setstats.gram(d.limit(0)).count() == 0


def test_quantiles_of_many_keys(spark):
    rng = np.random.default_rng(12)
    rows = [(int(k), float(v), float(v) ** 2) for k in range(6) for v in rng.integers(0, 9, 1 + 40 * k)] + [(7, None, None), (None, 3.0, 1.0), (None, 5.0, None), (8, 2.5, None)]
    d = spark.createDataFrame(rows, "k int, v double, w double").repartition(5)
    p = [0.0, 0.25, 0.5, 0.9, 1.0]
    for held in (order.HELD, 0):
        got = {(r["k"], r["name"]): (r["n"], r["q"]) for r in order.quantiles_by(d, "k", ["v", "w"], p, held).collect()}
        for k in {r[0] for r in rows}:
            for i, name in ((1, "v"), (2, "w")):
                x = [r[i] for r in rows if r[0] == k and r[i] is not None]
                n, q = got[k, name]
                assert n == len(x) and (q == [None] * 5 if not x else np.allclose(q, np.quantile(x, p)))
        assert len(got) == 18 and order.quantiles_by(d.limit(0), "k", ["v"], p, held).count() == 0
    plan = order.quantiles_by(d, "k", ["v"], p, 0)._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_levels_have_no_cap(spark):
    d = spark.range(12000).select(F.concat(F.lit("l"), "id").alias("f"), F.col("id").alias("x"))
    f = next(c for c in design.infer_columns(d, order="x") if c["name"] == "f")
    assert f["kind"] == "factor" and f["levels"].count() == 12000 and f["levels"].filter("level = 'l7'").first()["ord"] == 7


def test_beta_of_arrays():
    rng = np.random.default_rng(6)
    x, a, b = rng.random(300), rng.uniform(0.3, 40, 300), rng.uniform(0.3, 40, 300)
    x[:4] = 0, 1, np.nan, -1
    assert np.allclose(stats.beta_inc_array(x, a, b), [stats.beta_inc(*z) for z in zip(x, a, b, strict=True)], equal_nan=True, rtol=1e-10)
    assert stats.beta_inc_array(np.zeros(0), 1.0, 1.0).shape == (0,)


# ------------------------------------------------------------------ trees
def test_seriation_numbers_clusters_in_leaf_order():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.1, 5), rng.normal(4, 0.1, 4), rng.normal(9, 0.1, 6)]
    d = np.abs(x[:, None] - x[None, :])
    order_, tree = embed.seriate(1 - d)
    assert tree.leaves(tree.k + len(tree.merges) - 1) == order_
    labels = embed.cut_tree(tree, 3)
    seen = list(dict.fromkeys(labels[i] for i in order_))
    assert seen == [0, 1, 2] and sorted(labels.count(k) for k in range(3)) == [4, 5, 6]
    best = min(embed.path_length(p, d[:5, :5]) for p in map(list, itertools.permutations(range(5))))
    small, _ = embed.seriate(1 - d[:5, :5])
    assert embed.path_length(small, d[:5, :5]) >= best - 1e-12


def test_cluster_suggestion(spark):
    x = np.r_[np.zeros(8), np.full(7, 5.0), [30.0]] + np.linspace(0, 0.1, 16)
    t = embed.branches(spark, embed.seriate(1 - np.abs(x[:, None] - x[None, :]))[1])
    s = embed.suggest_groups(t).collect()
    chosen = {r["member"]: r["grp"] for r in s if r["chosen"]}
    assert {r["cut"] for r in s if r["chosen"]} == {3} and {r["groups"] for r in s if r["chosen"]} == {2}
    assert chosen[15] is None and sorted(list(chosen.values()).count(g) for g in (0, 1)) == [7, 8]
    assert len({chosen[i] for i in range(8)}) == 1 and chosen[0] != chosen[8]
    assert {r["cut"] for r in s if r["widest"]} == {2} and embed.cluster_count(t) == 2
    assert not embed.suggest_groups(t, gap=100.0).filter("chosen").count() and embed.cluster_count(t, gap=100.0) == 1
    assert embed.cluster_count(t, least=8) == 1
    one = embed.branches(spark, embed.Tree(1, []))
    assert embed.suggest_groups(one).count() == 0 and embed.cluster_count(one) == 1


# ------------------------------------------------------------------ lines and lenses
def lines_of(spark, grid, level):
    h, w = grid.shape
    nodes = spark.createDataFrame([(0, x, y, float(grid[y, x])) for y in range(h) for x in range(w)], "plane int, x int, y int, value double")
    out = {}
    for r in isolines.iso_lines(nodes, [level]).orderBy("line", "nth").collect():
        out.setdefault(r["line"], []).append((r["x"], r["y"]))
    return list(out.values())


def test_lines_are_rings_and_open_lines(spark):
    y, x = np.mgrid[0:21, 0:31]
    hill = 100.0 - (x - 12) ** 2 - (y - 9) ** 2
    (ring,) = lines_of(spark, hill, 50.0)
    assert ring[0] == ring[-1] and all(abs(np.hypot(a - 12, b - 9) - np.sqrt(50)) < 0.1 for a, b in ring)
    area = sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:], strict=False)) / 2
    assert 140 < area < 158  # the inside is on the left
    assert max(np.hypot(a - c, b - d) for (a, b), (c, d) in zip(ring, ring[1:], strict=False)) < 1.5
    (line,) = lines_of(spark, x.astype(float), 7.25)
    assert len(line) == 21 and all(abs(a - 7.25) < 1e-12 for a, _ in line) and [b for _, b in line] == sorted((b for _, b in line), reverse=line[0][1] > 0)
    assert lines_of(spark, np.ones((4, 4)), 1.0) == []  # equal to the level is outside
    saddle = np.array([[1.0, 0.0], [0.0, 1.0]])
    near = lambda lines: sorted(sorted((round(a), round(b)) for a, b in z) for z in lines)
    joined, apart = lines_of(spark, saddle, 0.4), lines_of(spark, saddle, 0.6)
    assert len(joined) == 2 and len(apart) == 2 and near(joined) != near(apart)
    hole = hill.copy()
    hole[9, 12] = np.nan
    assert len(lines_of(spark, hole, 50.0)) == 2 and lines_of(spark, hill[:1], 3.0) == [] and lines_of(spark, hill, float("nan")) == []


def test_lens_and_its_inverse(spark):
    rng = np.random.default_rng(4)
    p = [(float(a), float(b)) for a, b in rng.uniform(-5, 5, (50, 2))] + [(1.0, 2.0), (4.0, 2.0)]
    d = spark.createDataFrame(p, "x double, y double").withColumn("l", embed.lens(F.col("x"), F.col("y"), 1.0, 2.0, 3.0, 4.0))
    d = d.withColumn("b", embed.inverse_lens(F.col("l.x"), F.col("l.y"), 1.0, 2.0, 3.0, 4.0))
    for r in d.collect():
        q = np.hypot(r["x"] - 1, r["y"] - 2) / 3
        assert abs(r["b"]["x"] - r["x"]) + abs(r["b"]["y"] - r["y"]) < 1e-9
        k = 5 / (4 * q + 1) if q < 1 else 1.0
        assert abs(r["l"]["x"] - 1 - (r["x"] - 1) * k) < 1e-9 and abs(r["l"]["scale"] - (5 / (4 * q + 1) ** 2 if q < 1 else 1)) < 1e-9
    still = d.select(embed.lens(F.col("x"), F.col("y"), 0.0, 0.0, 3.0, -1.0).alias("l"), "x").filter("l.x <> x or l.scale <> 1")
    assert still.count() == 0


# ------------------------------------------------------------------ tiles
FILTERS = {
    "kernel": lambda v, g: stencil.filter_kernel(v, g, stencil.gaussian_kernel(1.0, 2)),
    "blur": lambda v, g: stencil.gaussian_blur(v, g, (0.7, 0.0, 1.0)),
    "box": lambda v, g: stencil.box_mean(v, g, 2),
    "masked": lambda v, g: stencil.masked_box_mean(v, g, 2),
    "guided": lambda v, g: stencil.guided_smooth(v, g, v.select("idx", (F.col("idx") % 17).cast("double").alias("value")), 1),
    "median": lambda v, g: stencil.median_filter(v, g, 1),
    "opening": lambda v, g: stencil.opening(v, g, 2),
    "bilateral": lambda v, g: stencil.bilateral(v, g, 1.0, 5.0, 3),
    "diffusion": lambda v, g: stencil.diffuse(v, g, 9),
    "sobel": lambda v, g: stencil.edges(v, g),
}


def _holey(spark):
    rng = np.random.default_rng(5)
    g = Grid((13, 11, 9))
    x = rng.normal(size=g.size) * 10
    x[rng.random(g.size) < 0.02] = np.nan
    keep = np.flatnonzero(rng.random(g.size) < 0.8)
    return spark.createDataFrame([(int(i), float(x[i])) for i in keep], "idx long, value double"), g, x, keep


@pytest.mark.parametrize("name", FILTERS)
def test_tiles_do_not_show(spark, name):
    """Filters give the same on one tile and on many."""
    v, g, _, _ = _holey(spark)
    got = []
    for size in (1000, 4):
        old, stencil.TILE = stencil.TILE, size
        try:
            got.append({r["idx"]: r["value"] for r in FILTERS[name](v, g).collect()})
        finally:
            stencil.TILE = old
    assert set(got[0]) == set(got[1]) and len(got[0]) >= v.count()
    assert np.allclose(*[[d[k] for k in sorted(d)] for d in got], rtol=1e-9, atol=1e-9, equal_nan=True)


def test_median_and_kernel_equal_brute_force(spark):
    v, g, x, keep = _holey(spark)
    have = {(i % 13, i // 13 % 11, i // 143): x[i] for i in keep.tolist()}
    median = {r["idx"]: r["value"] for r in stencil.median_filter(v, g, 1).collect()}
    kernel = stencil.gaussian_kernel(1.0, 1)
    smooth = {r["idx"]: r["value"] for r in stencil.filter_kernel(v, g, kernel).collect()}
    for i in range(g.size):
        c = (i % 13, i // 13 % 11, i // 143)
        near = [have[p] for a, b, k, _ in kernel if (p := (c[0] + a, c[1] + b, c[2] + k)) in have]
        if not near:
            assert i not in median
            continue
        s = sorted(near, key=lambda y: (np.isnan(y), y))
        assert np.isclose(median[i], (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2, equal_nan=True)
        terms = [(have[p], w) for a, b, k, w in kernel if (p := (c[0] + a, c[1] + b, c[2] + k)) in have]
        assert np.isclose(smooth[i], sum(y * w for y, w in terms) / sum(w for _, w in terms), equal_nan=True)


def test_chunks_by_parts_of_cells(spark):
    s = spark.createDataFrame([(i, t, float(i * t)) for i in range(20) for t in range(25)], "idx int, t int, value double")

    def f(pdf):
        return pdf.groupby("idx", as_index=False).agg(total=("value", "sum"), n=("t", "count"))

    whole, parts = ([tuple(r) for r in moments.process_chunks(s, f, "idx int, total double, n long", 10, cell_parts=k).collect()] for k in (1, 7))
    assert sorted(whole) == sorted(parts) and len(whole) == 60


def test_head_of_compressed_images():
    g = Grid((20, 20, 20), (1.0, 2.0, 3.0))
    raw = nifti.encode(np.random.default_rng(7).random((1, 8000)), g)
    assert nifti.head(gzip.compress(raw)) == raw[:1024] == nifti.head(raw)
    assert nifti.parse_header(nifti.head(gzip.compress(raw)))["dim"] == [20, 20, 20]


def test_seeded_k_means_equals_a_plain_loop(spark):
    rng = random.Random(8)
    x = [round(rng.gauss(m, 1.0), 1) for m in (0, 10, 25) for _ in range(60)]
    got = {r["idx"]: r["label"] for r in components.kmeans_1d(spark.createDataFrame(list(enumerate(x)), "idx int, value double"), 3, seed=4).collect()}
    draw, values = mulberry32(4), sorted(x)
    centres = [values[int(draw() * len(values))]]
    while len(centres) < 3:
        w = [min((v - c) ** 2 for c in centres) for v in values]
        u, acc = draw() * sum(w), 0.0
        for v, p in zip(values, w, strict=True):
            acc += p
            if acc > u and p > 0:
                centres.append(v)
                break
    for _ in range(100):
        label = [min(range(3), key=lambda k: (abs(v - centres[k]), k)) for v in x]
        new = [sum(v for v, k in zip(x, label, strict=True) if k == c) / label.count(c) for c in range(3)]
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    assert [got[i] for i in range(len(x))] == [k + 1 for k in label] and len(set(label)) == 3


def test_peaks_are_thinned_from_the_highest(spark):
    g = Grid((15, 15, 1), (2.0, 1.0, 1.0))
    rng = random.Random(9)
    value = {(i, j): rng.random() + 1 for i in range(15) for j in range(15)}
    c = spark.createDataFrame([(i + 15 * j, 1 + (i >= 8), v) for (i, j), v in value.items()], "idx long, label long, value double")
    got = {(r["label"], r["idx"]) for r in components.local_maxima(c, g, 6.0).collect()}
    want = set()
    for label in (1, 2):
        own = {p: v for p, v in value.items() if 1 + (p[0] >= 8) == label}
        peaks = [p for p, v in own.items() if all(own.get((p[0] + a, p[1] + b), 0) < v for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)]
        kept = []
        for p in sorted(peaks, key=lambda p: -own[p]):
            if all((2 * (p[0] - q[0])) ** 2 + (p[1] - q[1]) ** 2 >= 36 for q in kept):
                kept.append(p)
        want |= {(label, i + 15 * j) for i, j in kept}
    assert got == want and len(want) > 3


def queue_supervoxels(series, grid, k, compactness):
    """The nearest waiting cell at a time, from one queue; means are those of members, the seed counted twice."""
    idx = sorted(series)
    x = np.array([series[i] for i in idx])
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    g = np.array([[i % grid.dim[0], i // grid.dim[0] % grid.dim[1], i // (grid.dim[0] * grid.dim[1])] for i in idx])
    p = g / np.array(grid.spacing)
    at = {tuple(map(int, q)): n for n, q in enumerate(g)}
    step = max(1, len(idx) // k)
    first = list(range(0, step * k, step))[: len(idx)]
    reach, label = np.sqrt(len(idx) / k), np.zeros(len(idx), int)
    member = {c + 1: [f] for c, f in enumerate(first)}
    heap = [(0.0, c + 1, f) for c, f in enumerate(first)]
    while heap:
        heap.sort()
        _, c, v = heap.pop(0)
        if label[v]:
            continue
        label[v] = c
        member[c].append(v)
        mx, mp = x[member[c]].mean(axis=0), p[member[c]].mean(axis=0)
        for o in stencil.neighbour_offsets(26):
            u = at.get(tuple(int(a + b) for a, b in zip(g[v], o, strict=True)))
            if u is not None and not label[u]:
                heap.append((float(((p[u] - mp) ** 2).sum() / reach + ((x[u] - mx) ** 2).sum() / compactness), c, u))
    return dict(zip(idx, label.tolist(), strict=True))


def test_supervoxels_equal_the_queue(spark):
    rng = np.random.default_rng(10)
    g = Grid((4, 3, 2), (2.0, 2.5, 3.0))
    series = {i: rng.normal(0, 1, 2).tolist() for i in range(g.size) if i % 7}
    d = spark.createDataFrame(list(series.items()), "idx long, series array<double>")
    got = {r["idx"]: r["label"] for r in supervoxels.supervoxels(d, g, 3, width=0.0).collect()}
    assert got == queue_supervoxels(series, g, 3, 5.0)


def test_supervoxels_cover_the_mask(spark):
    g = Grid((8, 6, 2))
    rng = np.random.default_rng(10)
    idx = [i for i in range(g.size) if i % 11]
    d = spark.createDataFrame([(i, [float(i % 8 >= 4), float(rng.normal(0, 0.01))]) for i in idx], "idx long, series array<double>")
    got = {r["idx"]: r["label"] for r in supervoxels.supervoxels(d, g, 8).collect()}
    assert set(got) == set(idx) and set(got.values()) == set(range(1, 9))
    apart = d.filter("idx % 8 < 2 or idx % 8 > 5")  # two slabs, one seed
    assert sorted({r["label"] for r in supervoxels.supervoxels(apart, g, 1).collect()}) == [0, 1]
    assert supervoxels.supervoxels(d.limit(0), g, 3).count() == 0
    assert {r["label"] for r in supervoxels.supervoxels(d.filter("idx < 4"), g, 9).collect()} == {1, 2, 3}


def test_fingerprints_are_folds_of_float_bits(spark):
    rng = np.random.default_rng(13)
    maps = {0: rng.normal(0, 1, 50), 1: np.r_[0.0, -0.0, np.nan, np.inf, -np.inf, 1e-45, -3e-40, 3.4e38, 1.0, 2.0, 0.5, np.float32(1) + 2**-23], 2: rng.normal(0, 1e-3, 9001), 3: np.zeros(0)}
    d = spark.createDataFrame([(m, i, float(v)) for m, x in maps.items() for i, v in enumerate(x)], "member int, pos int, value double").repartition(4)

    def fold(m, x):
        words, step = x.astype(np.float32), max(1, len(x) // 4096)
        h = 0x811C9DC5
        for w in [len(x), *words[m % step :: step].view(np.uint32).tolist()]:
            h = ((h ^ w) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    assert {r["member"]: r["key"] for r in setstats.fingerprint(d).collect()} == {m: fold(m, x) for m, x in maps.items() if len(x)}
