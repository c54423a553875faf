"""Resampling: target cells -> source coordinates -> weighted taps, by one equi-join and one aggregation (nearest, linear) or within tiles (wider windows)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.num import js_round
from gridloom.operators.stencil import Tiles, gaussian_blur, mm_sphere_offsets

XYZ = ("x", "y", "z")


def sample_coordinates(target: Grid, source: Grid, spark, matrix: np.ndarray | None = None) -> DataFrame:
    """(idx, x, y, z): every target cell with its coordinates in the source grid, as linear expressions."""
    m = target.matrix_to(source) if matrix is None else matrix
    g = target.axes_of("idx")
    c = [sum((g[b] * float(m[a, b]) for b in range(3)), F.lit(float(m[a, 3]))) for a in range(3)]
    # values next to a whole number are that number, so that equal grids meet exactly
    c = [F.when(F.abs(x - js_round(x)) < 1e-9, js_round(x).cast("double")).otherwise(x) for x in c]
    return target.cells(spark).select("idx", *[x.alias(n) for x, n in zip(c, XYZ, strict=True)])


def nearest(vol: DataFrame, source: Grid, points: DataFrame, background: float = 0.0) -> DataFrame:
    """Nearest cell, halves rounded up; ``background`` outside."""
    g = [js_round(F.col(c)) for c in XYZ]
    p = points.select("idx", F.when(source.inside(*g), source.index_of(*g)).cast("long").alias("src"))
    return p.join(vol.select(F.col("idx").alias("src"), "value"), "src", "left").select("idx", F.coalesce("value", F.lit(background)).alias("value"))


def linear(vol: DataFrame, source: Grid, points: DataFrame, background: float = 0.0) -> DataFrame:
    """Eight taps; taps outside the grid count as ``background``."""
    f = [F.floor(F.col(c)) for c in XYZ]
    r = [F.col(c) - F.floor(F.col(c)) for c in XYZ]
    corner = []
    for n in range(8):
        b = [(n >> a) & 1 for a in range(3)]
        at = [f[a] + b[a] for a in range(3)]
        w = [r[a] if b[a] else 1 - r[a] for a in range(3)]
        corner.append(F.struct(F.when(source.inside(*at), source.index_of(*at)).cast("long").alias("src"), (w[0] * w[1] * w[2]).alias("w")))
    t = points.select("idx", F.explode(F.array(*corner)).alias("t")).select("idx", "t.src", "t.w").filter("w <> 0")
    d = t.join(vol.select(F.col("idx").alias("src"), "value"), "src", "left")
    return d.groupBy("idx").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(background))).alias("value"))


def _weight(kind: str, d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    if kind == "cubic":  # Catmull-Rom
        return np.where(a < 1, 1.5 * a * a * a - 2.5 * a * a + 1, np.where(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2, 0.0))
    p = np.pi * np.where(a < 1e-9, 1.0, d)
    return np.where(a < 1e-9, 1.0, np.where(a < 3, 3 * np.sin(p) * np.sin(p / 3) / (p * p), 0.0))


def _axis_taps(kind: str, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, weights) of the taps of each point along an axis of ``n`` cells; a tap beyond the border is extrapolated linearly from the two outermost cells."""
    reach, last = 2 if kind == "cubic" else 3, n - 1
    at = np.floor(x).astype(np.int64)[:, None] + np.arange(1 - reach, reach + 1)
    w = _weight(kind, x[:, None] - at)
    if not last:
        return np.zeros_like(at), w
    far = np.maximum(np.maximum(-at, at - last), 0)  # how far outside
    out = np.where(far > 0, 0.0, w)
    for k in range(2 * reach):
        p = np.flatnonzero(far[:, k])
        end, step = np.where(at[p, k] < 0, 0, last), np.where(at[p, k] < 0, 1, -1)
        out[p, end - at[p, 0]] += w[p, k] * (1 + far[p, k])
        out[p, end + step - at[p, 0]] -= w[p, k] * far[p, k]
    return at, out


CHUNK = 4096  # points whose taps a task holds


def windowed(vol: DataFrame, source: Grid, points: DataFrame, kind: str = "cubic", background: float = 0.0) -> DataFrame:
    """Cubic (4^3) or Lanczos-3 (6^3) taps divided by their weight; points outside the grid are ``background``.

    Points meet tiles of the source: each cell and each point is shipped about once, and taps are taken from the tile's dense array.
    """
    reach = 2 if kind == "cubic" else 3
    tile, ok = Tiles(source, (reach,) * 3), F.lit(True)
    for c, n in zip(XYZ, tile.n, strict=True):
        ok = ok & (F.col(c) >= 0) & (F.col(c) <= n - 1)
    p = points.filter(ok).select(F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in XYZ])
    p = p.withColumn("__tile", tile.number(*[F.floor(F.floor(F.col(c)) / t) for c, t in zip(XYZ, tile.edge, strict=True)]))
    v = vol.select(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")).withColumn("__tile", F.explode(tile.near))

    def run(cells: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"idx": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        tile.open(asked.column("__tile")[0].as_py())
        there, known, value = np.zeros(tile.shape, bool), np.zeros(tile.shape, bool), np.zeros(tile.shape)
        if cells.num_rows:
            at = tile.places(cells.column("idx").to_numpy())
            there[at] = True
            known[at] = cells.column("value").is_valid().to_numpy()
            value[at] = cells.column("value").fill_null(0.0).to_numpy()
        there, known, value = there.ravel(), known.ravel(), value.ravel()
        xyz, out = [asked.column(c).to_numpy() for c in XYZ], np.full(asked.num_rows, float(background))
        for a in range(0, asked.num_rows, CHUNK):
            taps = [_axis_taps(kind, x[a : a + CHUNK], n) for x, n in zip(xyz, tile.n, strict=True)]
            (i, wi), (j, wj), (k, wk) = ((np.clip(at - low, 0, m - 1), w) for (at, w), low, m in zip(taps, tile.low, tile.shape[::-1], strict=True))
            w = (wi[:, None, None, :] * wj[:, None, :, None] * wk[:, :, None, None]).reshape(len(i), -1)
            at = ((k[:, :, None, None] * tile.shape[1] + j[:, None, :, None]) * tile.shape[2] + i[:, None, None, :]).reshape(len(i), -1)
            w[~there[at]] = 0  # a missing value outside the window's weights must not count, even NaN
            on = w != 0
            with np.errstate(invalid="ignore"):
                total, weight = np.where(on, w * value[at], 0.0).sum(axis=1), w.sum(axis=1)
            some = (on & known[at]).any(axis=1) & (weight != 0)
            out[a : a + CHUNK][some] = total[some] / weight[some]
        return pa.table({"idx": asked.column("idx"), "value": out})

    inside = v.groupBy("__tile").cogroup(p.groupBy("__tile")).applyInArrow(run, "idx long, value double")
    return inside.unionByName(points.filter(~F.coalesce(ok, F.lit(False))).select(F.col("idx").cast("long").alias("idx"), F.lit(float(background)).alias("value")))


def interpolate(vol: DataFrame, source: Grid, points: DataFrame, method: str = "linear", background: float = 0.0) -> DataFrame:
    """Values at source coordinates: points (idx, x, y, z)."""
    if method == "nearest":
        return nearest(vol, source, points, background)
    if method == "linear":
        return linear(vol, source, points, background)
    return windowed(vol, source, points, method, background)


def resample(vol: DataFrame, source: Grid, target: Grid, method: str = "linear", anti_alias: bool = True, background: float = 0.0) -> DataFrame:
    """The volume on another grid; smoothed first where an axis shrinks by more than 1.5."""
    ratio = [a / b for a, b in zip(source.dim, target.dim, strict=True)]
    if anti_alias and method != "nearest" and max(ratio) > 1.5:
        vol = gaussian_blur(vol, source, tuple(r / 2 if r > 1.5 else 0.0 for r in ratio))
    return interpolate(vol, source, sample_coordinates(target, source, vol.sparkSession), method, background)


def to_dimensions(vol: DataFrame, source: Grid, dim, **how) -> tuple[DataFrame, Grid]:
    g = source.with_dim(dim)
    return resample(vol, source, g, **how), g


def to_voxel_size(vol: DataFrame, source: Grid, spacing, **how) -> tuple[DataFrame, Grid]:
    g = source.with_spacing(spacing)
    return resample(vol, source, g, **how), g


def downsample(vol: DataFrame, source: Grid, factor: int, **how) -> tuple[DataFrame, Grid]:
    return to_dimensions(vol, source, [max(1, n // factor) for n in source.dim], **how)


def upsample(vol: DataFrame, source: Grid, factor: int, **how) -> tuple[DataFrame, Grid]:
    return to_dimensions(vol, source, [n * factor for n in source.dim], **how)


def rigid_matrix(translation=(0, 0, 0), rotation=(0, 0, 0), scale=(1, 1, 1), center=(0, 0, 0)) -> np.ndarray:
    """Voxel-space affine: scale, then rotate about x, y, z (radians) around a centre, then translate."""
    m = np.eye(4)
    m[:3, :3] = np.diag(scale)
    for axis, a in enumerate(rotation):
        r, (u, v) = np.eye(4), [x for x in range(3) if x != axis]
        s = -1 if axis == 1 else 1
        r[u, u] = r[v, v] = math.cos(a)
        r[u, v], r[v, u] = -s * math.sin(a), s * math.sin(a)
        m = r @ m
    to, back = np.eye(4), np.eye(4)
    to[:3, 3], back[:3, 3] = -np.asarray(center, float), np.asarray(center, float) + np.asarray(translation, float)
    return back @ m @ to


def transform(vol: DataFrame, grid: Grid, matrix: np.ndarray, method: str = "linear", background: float = 0.0) -> DataFrame:
    """The volume moved by a voxel-space affine, sampled through its inverse."""
    return interpolate(vol, grid, sample_coordinates(grid, grid, vol.sparkSession, np.linalg.inv(matrix)), method, background)


def resample_labels(labels: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Labels by nearest cell; only labelled cells stay."""
    v = labels.select("idx", F.col("label").cast("double").alias("value"))
    out = nearest(v, source, sample_coordinates(target, source, labels.sparkSession))
    return out.filter("value <> 0").select("idx", F.col("value").cast("int").alias("label"))


def upsample_plane(plane: DataFrame, w: int, h: int, factor: int, clamped_cubic: bool = False) -> DataFrame:
    """A plane (row, col, value) enlarged bilinearly, or by cubic taps clamped to the four nearest values; missing values by the nearest cell."""
    src, dst = Grid((w, h, 1)), Grid((w * factor, h * factor, 1), (1 / factor, 1 / factor, 1.0))
    v = plane.select((F.col("col") + F.col("row") * w).cast("long").alias("idx"), "value")
    pts = sample_coordinates(dst, src, plane.sparkSession)
    pts = pts.withColumns({"x": F.least(F.col("x"), F.lit(float(w - 1))), "y": F.least(F.col("y"), F.lit(float(h - 1))), "z": F.lit(0.0)})
    out = windowed(v, src, pts, "cubic") if clamped_cubic else linear(v, src, pts)
    near = nearest(v, src, pts).withColumnRenamed("value", "near")
    out = out.join(near, "idx").withColumn("value", F.when(F.isnan("value"), F.col("near")).otherwise(F.col("value")))
    if clamped_cubic:
        lo = v.agg(F.min("value").alias("a")).select("a").scalar()
        hi = v.agg(F.max("value").alias("b")).select("b").scalar()
        out = out.withColumn("value", F.least(F.greatest("value", lo), hi))
    i, j, _ = dst.axes_of("idx")
    return out.select(j.alias("row"), i.alias("col"), "value")


def scatter_field(points: DataFrame, grid: Grid, sigma: float, cutoff: float | None = None, combine: str = "max", kernel=None) -> DataFrame:
    """Weighted world points (x, y, z, weight) splatted onto the grid: Gaussian within 3 sigma mm, combined by max or sum."""
    cutoff = 3 * sigma if cutoff is None else cutoff
    kernel = kernel or (lambda d2: F.exp(-d2 / (2 * sigma * sigma)))
    g = [js_round(c) for c in grid.to_grid("x", "y", "z")]
    off = mm_sphere_offsets(grid, cutoff + max(grid.spacing))
    table = F.array(*[F.array(*[F.lit(int(x)) for x in o]) for o in off])
    p = points.select("x", "y", "z", "weight", *[c.alias(n) for c, n in zip(g, ("gi", "gj", "gk"), strict=True)]).filter(grid.inside("gi", "gj", "gk"))
    p = p.withColumn("o", F.explode(table))
    at = [F.col(n) + F.col("o")[a] for a, n in enumerate(("gi", "gj", "gk"))]
    p = p.filter(grid.inside(*at))
    w = grid.to_world(*at)
    d2 = sum(((c - F.col(n)) * (c - F.col(n)) for c, n in zip(w, XYZ, strict=True)), F.lit(0.0))
    f = F.max if combine == "max" else F.sum
    return p.select(grid.index_of(*at).cast("long").alias("idx"), d2.alias("d2"), "weight").filter(F.col("d2") <= cutoff * cutoff).groupBy("idx").agg(f(F.col("weight") * kernel(F.col("d2"))).alias("value"))
