"""Work that grew faster than its input: one test for each finding of the third round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import embed, resample, roi, setstats, supervoxels
from gridloom.rng import mulberry32
from gridloom.sources import images, manifest
from gridloom.streaming import moments


def test_permutations_by_ranges(spark, monkeypatch):
    """Each replicate is the draw's order, with no window over all places of a name (F1)."""
    monkeypatch.setattr(embed, "PLACES", 7)
    sizes = {"a": 40, "b": 25}
    rows = [(name, 3 * k + 1, k * 10 + len(name), float(k)) for name, n in sizes.items() for k in range(n)]
    d = spark.createDataFrame(rows, "name string, member long, value long, x double").repartition(5)
    out = embed.permuted(d, 3, seed=5)
    got = {(r["rep"], r["name"], r["member"]): (r["value"], r["x"]) for r in out.collect()}
    assert len(got) == 4 * sum(sizes.values())
    for name, n in sizes.items():
        for rep in range(4):
            draw = mulberry32(5 + rep)
            u = [draw() for _ in range(n)]
            order = sorted(range(n), key=lambda i: (u[i], i)) if rep else list(range(n))
            for j, i in enumerate(order):
                assert got[rep, name, 3 * i + 1] == (j * 10 + 1, float(i))
    plan = out._jdf.queryExecution().executedPlan().toString()
    over = [w.split(" ASC")[0] for w in plan.split("windowspecdefinition(")[1:]]
    assert over and all("rep#" in w for w in over)


def test_pairs_of_one_run_are_not_shuffled(spark, monkeypatch):
    """Pairs leave the tasks that make them, and a map is shipped as a few rows, not as one a cell (F2)."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 40))
    d = spark.createDataFrame([(m, p, float(x[m, p])) for m in range(30) for p in range(40)], "member int, pos int, value double")
    want = np.corrcoef(x)
    for pack, stripe in ((256, 64), (16, 3)):
        monkeypatch.setattr(setstats, "PACK", pack)
        monkeypatch.setattr(setstats, "STRIPE", stripe)
        r = setstats.correlation_matrix(d, block=8)
        got = {(q["a"], q["b"]): q["r"] for q in r.collect()}
        assert len(got) == 30 * 29 // 2 and all(abs(v - want[k]) < 1e-12 for k, v in got.items())
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(i#" in plan


def test_rows_meet_cells_after_the_mask(spark, monkeypatch):
    """Rows of a shared file meet its cells in blocks, and the mask comes from the files alone (F3)."""
    monkeypatch.setattr(manifest, "ROWS", 3)
    monkeypatch.setattr(manifest, "CELLS", 4)
    cells = spark.createDataFrame([(f"/d/{f}", t, i, 0.0 if i == 5 else i + 100.0 * t + (7 if f == "b" else 0)) for f in "ab" for t in range(2) for i in range(11)], "file string, t int, idx long, value double")
    monkeypatch.setattr(manifest, "read_cells", lambda spark, files: cells)
    rows = spark.createDataFrame([(f"r{n}", "a" if n < 8 else "b") for n in range(10)] + [("none", None)], "row string, locator string")

    class Held(manifest.Dataset):
        def resolve(self, feature):
            return rows

    out = Held(spark, "/d", {"row_id": "row"}, rows, None).backing("map")
    want = sorted((f"r{n}", i, t, i + 100.0 * t + (7 if n > 7 else 0)) for n in range(10) for t in range(2) for i in range(11) if i != 5)
    got = sorted((r["row"], r["pos"], r["axis"], r["value"]) for r in out.collect())
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(rows") < plan.index("Aggregate")  # nothing is aggregated over the product


@pytest.mark.parametrize("kind", ["cubic", "lanczos"])
def test_windows_over_tiles(spark, kind):
    """Taps come from tiles: no row a tap is shipped, and borders, tiles' edges, missing and absent cells are as by definition (F4, F6)."""
    rng = np.random.default_rng(3)
    g, n = Grid((37, 3, 1)), (37, 3, 1)
    value = {i: float(v) for i, v in enumerate(rng.normal(size=111)) if i % 13}
    value[40], value[77] = float("nan"), None
    at = [(float(x), float(y), 0.0) for x, y in zip(rng.uniform(0, 36, 60), rng.uniform(0, 2, 60), strict=True)] + [(31.0, 1.0, 0.0), (31.5, 0.5, 0.0), (36.0, 2.0, 0.0), (36.1, 0.0, 0.0), (-0.1, 1.0, 0.0)]
    vol = spark.createDataFrame(list(value.items()), "idx long, value double")
    pts = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "idx long, x double, y double, z double")
    reach = 2 if kind == "cubic" else 3

    def weight(d):
        a = abs(d)
        if kind == "cubic":
            return 1.5 * a**3 - 2.5 * a * a + 1 if a < 1 else -0.5 * a**3 + 2.5 * a * a - 4 * a + 2 if a < 2 else 0.0
        return 1.0 if a < 1e-9 else 3 * np.sin(np.pi * d) * np.sin(np.pi * d / 3) / (np.pi * d) ** 2 if a < 3 else 0.0

    def axis(x, m):
        out = {}
        for c in range(int(np.floor(x)) + 1 - reach, int(np.floor(x)) + reach + 1):
            w = weight(x - c)
            far, end, step = (-c, 0, 1) if c < 0 else (c - m + 1, m - 1, -1)
            for k, u in [(0, w)] if m == 1 else [(c, w)] if 0 <= c < m else [(end, w * (1 + far)), (end + step, -w * far)]:
                out[k] = out.get(k, 0.0) + u
        return out

    out = resample.windowed(vol, g, pts, kind, -9.0)
    got = {r["idx"]: r["value"] for r in out.collect()}
    assert len(got) == len(at)
    for k, p in enumerate(at):
        if not all(0 <= c <= m - 1 for c, m in zip(p, n, strict=True)):
            assert got[k] == -9.0
            continue
        i, j, z = (axis(c, m) for c, m in zip(p, n, strict=True))
        taps = [(a + b * 37, u * v * w) for a, u in i.items() for b, v in j.items() for _, w in z.items() if a + b * 37 in value and u * v * w]
        want = sum((value[c] or 0.0) * w for c, w in taps) / sum(w for _, w in taps)
        assert np.isclose(got[k], want, rtol=1e-9, equal_nan=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and "Aggregate" not in plan and plan.count("Generate explode") == 1


def test_random_cover_over_tiles(spark, monkeypatch):
    """Rounds equal their definition across tiles' borders, and no row a cell of a sphere is shipped (F7)."""
    g = Grid((35, 4, 3), (2.0, 2.5, 3.0))
    cells = [i for i in range(420) if i % 11]
    monkeypatch.setattr(roi, "searchlight_cells", None)  # spheres are not rows
    got = {r["idx"]: r["center"] for r in roi.random_searchlights(spark.createDataFrame([(i,) for i in cells], "idx long"), g, 4.0, seed=3).collect()}

    def priority(i):
        return mulberry32(3 + i * 0x6D2B79F5)(), i

    place = {i: np.array([i % 35 * 2.0, i // 35 % 4 * 2.5, i // 140 * 3.0]) for i in cells}
    near = lambda i, r, of: [k for k in of if ((place[i] - place[k]) ** 2).sum() <= r * r + 1e-9]
    left, want = set(cells), {}
    while left:
        first = [i for i in left if min(near(i, 8.0, left), key=priority) == i]
        for c in sorted(first):
            for k in near(c, 4.0, left):
                want.setdefault(k, c)
        left -= set(want)
    assert got == want


def test_stream_result_is_written_by_tasks(spark, tmp_path):
    """The complete result of a stream comes from files that tasks wrote, after several batches too (F8)."""
    src = f"{tmp_path}/src"
    for n in range(3):
        spark.createDataFrame([(f"2024-01-0{1 + n % 2} 10:00:00", u, float(n + u)) for u in range(4)], "ts string, u long, v double").selectExpr("cast(ts as timestamp) ts", "u", "v").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, u long, v double").option("maxFilesPerTrigger", 1).parquet(src)
    out = moments.completed(moments.streaming_moments(stream, "ts", "u", "v"), f"{tmp_path}/out")
    assert sorted((r["start"].day, r["u"], r["count"], r["mean"]) for r in out.collect()) == sorted([(1, u, 2, 1.0 + u) for u in range(4)] + [(2, u, 1, 1.0 + u) for u in range(4)])
    assert all(f.startswith("file:") for f in out.inputFiles())


@pytest.mark.parametrize("name", ["a.nii", "a.nii.gz"])
def test_small_slabs_share_tasks(spark, tmp_path, monkeypatch, name):
    """Tasks do not grow with the number of small slabs, when written and when read (F9)."""
    monkeypatch.setattr(images, "TASKS", 3)
    monkeypatch.setattr(images, "_BATCH", 1 << 18)
    g, path = Grid((10, 10, 6)), f"{tmp_path}/{name}"
    d = spark.range(600).select(F.col("id").alias("idx"), (F.col("id") * 2.0).alias("value"))
    images.write_image(d, g, path, slab_cells=16)
    got = images.read_images(spark, path, slab_mb=64 / (1 << 20))
    assert sorted((r["idx"], r["value"]) for r in got.collect()) == [(i, i * 2.0) for i in range(600)]
    reader = images.ImageReader({"path": path, "slab_mb": str(64 / (1 << 20))})
    assert len(reader.partitions()) <= 3


def test_supervoxels_rounds_are_no_jobs(spark, monkeypatch):
    """Jobs do not grow with the depth of the grid, and ranges of cells in several tasks give what one task gives (F5)."""
    rng = np.random.default_rng(5)
    sc, jobs, got = spark.sparkContext, {}, {}
    for cells, depth in ((1 << 14, 6), (1 << 14, 40), (60, 40)):
        monkeypatch.setattr(supervoxels, "CELLS", cells)
        g = Grid((3, 3, depth))
        noise = np.random.default_rng(depth).normal(0, 1, (g.size, 2))
        d = spark.createDataFrame([(i, noise[i].tolist()) for i in range(g.size) if i % 13], "idx long, series array<double>")
        group = f"supervoxels-{cells}-{depth}"
        sc.setJobGroup(group, group)
        try:
            got[cells, depth] = {r["idx"]: r["label"] for r in supervoxels.supervoxels(d, g, 3, width=0.5).collect()}
        finally:
            sc._jsc.clearJobGroup()
        jobs[cells, depth] = len(sc.statusTracker().getJobIdsForGroup(group))
    assert 0 < jobs[1 << 14, 40] <= jobs[1 << 14, 6] + 3  # adaptive plans differ by a job or so
    assert got[60, 40] == got[1 << 14, 40] and set(got[60, 40].values()) == {1, 2, 3}
    missing = spark.createDataFrame([(i, [float("nan") if i == 3 else float(x)]) for i, x in enumerate(rng.normal(0, 1, 27))], "idx long, series array<double>")
    assert {r["label"] for r in supervoxels.supervoxels(missing, Grid((3, 3, 3)), 2, width=1.0).collect()} == {1, 2}  # all distances are NaN
