"""Queries on grid geometry, regions, labels, number formats and stored files."""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from gridloom import layout as L
from gridloom.functions import stats as ST
from gridloom.functions import text as TX
from gridloom.grid import Grid, axis_vectors, safe_center
from gridloom.num import rounded
from gridloom.operators import embed as E
from gridloom.operators import reduce as R
from gridloom.operators import roi
from gridloom.operators import setstats as SS
from gridloom.operators import temporal as T
from gridloom.operators import volume as V
from gridloom.operators.order import ensure_checkpoint_dir
from gridloom.plans.registry import draws, query, r, show
from gridloom.plans.sets import group_maps, stack
from gridloom.plans.spec import PlotSpec, summary_scene
from gridloom.plans.volumes import _G, _PT, _points, vol
from gridloom.rng import mulberry32, random_index
from gridloom.sources import atlas, delimited, manifest, nifti, summary


def scratch(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def rows(spark, records: list[tuple], schema: str):
    return spark.createDataFrame(records, schema)


# ------------------------------------------------------------------ geometry
_XYZ = "-9 + 2.0 * i AS x, -11.25 + 2.5 * j AS y, -20 + 3.0 * k AS z"


@query("grid_bounds", f"+{_G}, w AS (SELECT {_XYZ} FROM g) SELECT unnest(['x', 'y', 'z']) AS axis, unnest([min(x), min(y), min(z)])::DOUBLE AS lo, unnest([max(x), max(y), max(z)])::DOUBLE AS hi, unnest([(min(x) + max(x)) / 2, (min(y) + max(y)) / 2, (min(z) + max(z)) / 2])::DOUBLE AS center FROM w", "vol")
def _(spark, d):
    g = vol(spark, d)[1]
    return rows(spark, [(a, float(lo), float(hi), float(c)) for a, lo, hi, c in zip("xyz", *g.bounds(), g.centroid(), strict=True)], "axis string, lo double, hi double, center double")


_PERM = "p AS (SELECT * FROM (VALUES (0, [0, 1, 2]), (1, [0, 2, 1]), (2, [1, 0, 2]), (3, [1, 2, 0]), (4, [2, 0, 1]), (5, [2, 1, 0])) t(p, o))"


@query("grid_orientations", f"WITH {_PERM}, f AS (SELECT range AS f FROM range(8)), e AS (SELECT p, f, unnest(range(3)) AS a, o FROM p, f) SELECT CAST(p AS INTEGER) AS p, CAST(f AS INTEGER) AS f, CAST(a AS INTEGER) AS a, CASE WHEN f >> a & 1 = 1 THEN ['left', 'posterior', 'inferior'][o[a + 1] + 1] ELSE ['right', 'anterior', 'superior'][o[a + 1] + 1] END AS axis FROM e")
def _(spark, d):
    from itertools import permutations

    g = vol(spark, d)[1]
    out = [(p, f, a, name) for p, o in enumerate(permutations(range(3))) for f in range(8) for a, name in enumerate(g.reorient(o, tuple(bool(f >> x & 1) for x in range(3))).orientation())]
    return rows(spark, out, "p int, f int, a int, axis string")


@query("slice_pixels", f"+{_G}, m AS (SELECT max(k) AS nk FROM g), e AS (SELECT idx, 0 AS axis, nk - k AS row, j AS col FROM g, m UNION ALL SELECT idx, 1, nk - k, i FROM g, m UNION ALL SELECT idx, 2, 9 - j, i FROM g) SELECT CAST(axis AS INTEGER) AS axis, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, idx FROM e", "vol")
def _(spark, d):
    """Every cell's pixel in the slices through it, and the cell found again under that pixel."""
    v, g = vol(spark, d)
    cell, out = g.axes_of("idx"), None
    for axis in range(3):
        row, col = V.cell_to_slice_pixel(g, axis, cell)
        back = V.slice_pixel_to_cell(g, axis, cell[axis], row, col)
        part = v.select(F.lit(axis).alias("axis"), row.cast("int").alias("row"), col.cast("int").alias("col"), (back[0] + 10 * back[1] + 100 * back[2]).cast("long").alias("idx"))
        out = part if out is None else out.union(part)
    return out


_N = "n AS (SELECT unnest([0, 1, 2]) AS axis, unnest([nx, ny, nz]) AS dim, unnest([2.0, 2.5, 3.0]) AS spacing, unnest([-9.0, -11.25, -20.0]) AS origin FROM gdim)"


@query("derived_grids", f"+{_N} SELECT 'double' AS grid, CAST(axis AS INTEGER) AS axis, dim * 2 AS dim, CAST(spacing / 2 AS DOUBLE) AS spacing, CAST(origin AS DOUBLE) AS origin FROM n UNION ALL SELECT 'coarse', axis, CAST(greatest(1, floor(dim * spacing / 4 + 0.5)) AS BIGINT), 4.0, origin FROM n UNION ALL SELECT 'plane', axis, dim, spacing, origin FROM n WHERE axis < 2 UNION ALL SELECT 'series', axis, dim, spacing, origin FROM n UNION ALL SELECT 'series', 3, 30, 1.5, 0.0", "gdim")
def _(spark, d):
    g = vol(spark, d)[1]
    made = {"double": g.with_dim([n * 2 for n in g.dim]), "coarse": g.with_spacing((4.0, 4.0, 4.0)), "plane": g.drop_axis(2), "series": g.add_axis(30, 1.5)}
    return rows(spark, [(n, a, int(x.dim[a]), float(x.spacing[a]), float(x.origin[a])) for n, x in made.items() for a in range(len(x.dim))], "grid string, axis int, dim long, spacing double, origin double")


def _finer(g: Grid) -> Grid:
    return Grid(tuple(2 * n for n in g.dim), tuple(s / 2 for s in g.spacing), tuple(o - s / 4 for o, s in zip(g.origin, g.spacing, strict=True)))


@query("grid_to_grid", f"+{_N}, a AS (SELECT axis AS row, range AS col FROM n, range(4)) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CASE WHEN row = col THEN 2.0 WHEN col = 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS value FROM a", "gdim")
def _(spark, d):
    g = vol(spark, d)[1]
    m = g.matrix_to(_finer(g))
    return show(rows(spark, [(i, j, float(m[i, j])) for i in range(3) for j in range(4)], "row int, col int, value double"), "row", "col", value="value")


@query("grid_registration", f"+{_N} SELECT CAST(axis AS INTEGER) AS axis, {r('spacing / (spacing / 2)')} AS scale, {r('(origin - (origin - spacing / 4)) / (spacing / 2)')} AS shift, false AS turned FROM n UNION ALL SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), true", "gdim")
def _(spark, d):
    g = vol(spark, d)[1]
    turned = g.registers_to(g.reorient((1, 0, 2), (False,) * 3))
    out = [(a, *x, False) for a, x in enumerate(g.registers_to(_finer(g)))] + ([(0, 0.0, 0.0, True)] if turned is None else [])
    return show(rows(spark, out, "axis int, scale double, shift double, turned boolean"), "axis", "turned", scale="scale", shift="shift")


@query("axis_directions", f"WITH {_PERM} SELECT CAST(p AS INTEGER) AS p, CAST(a AS INTEGER) AS a, CAST(o[a + 1] AS INTEGER) AS world, CASE WHEN (p + a) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS value FROM (SELECT p, o, unnest(range(3)) AS a FROM p)")
def _(spark, d):
    from itertools import permutations

    up, down, out = ("right", "anterior", "superior"), ("left", "posterior", "inferior"), []
    for p, o in enumerate(permutations(range(3))):
        m = axis_vectors(tuple((up if (p + a) % 2 == 0 else down)[o[a]] for a in range(3)))
        out += [(p, a, w, float(m[w, a])) for a in range(3) for w in range(3) if m[w, a]]
    return rows(spark, out, "p int, a int, world int, value double")


@query("grid_steps", f"+{_N} SELECT CAST(axis AS INTEGER) AS axis, 'step' AS what, s AS i, CAST(origin + spacing * s AS DOUBLE) AS value FROM (SELECT axis, origin, spacing, unnest(range(0, dim, 3)) AS s FROM n) UNION ALL SELECT axis, 'last', dim - 1, origin + spacing * (dim - 1) FROM n UNION ALL SELECT axis, 'center', dim // 2, origin + spacing * (dim // 2) FROM n UNION ALL SELECT axis, 'shared', (dim + 1) // 2 // 2, origin + spacing * ((dim + 1) // 2 // 2) FROM n", "gdim")
def _(spark, d):
    g = vol(spark, d)[1]
    half, out = Grid(tuple((n + 1) // 2 for n in g.dim), tuple(2 * s for s in g.spacing), g.origin), []
    at = lambda a, i: float(g.origin[a] + g.spacing[a] * i)
    for a in range(3):
        out += [(a, "step", i, w) for i, w in zip(g.along(a, 3), map(float, g.world_along(a, 3)), strict=True)]
        out += [(a, n, i, at(a, i)) for n, i in (("last", g.last_slice(a)), ("center", g.center_slice(a)), ("shared", safe_center(g, half, axis=a))) if g.valid_slice(a, int(i))]
    return rows(spark, [(a, n, int(i), v) for a, n, i, v in out], "axis int, what string, i long, value double")


@query("slice_world_bounds", f"+{_G}, s AS (SELECT axis, n, x, y, z FROM (SELECT 0 AS axis, i AS n, {_XYZ} FROM g UNION ALL SELECT 1, j, {_XYZ} FROM g UNION ALL SELECT 2, k, {_XYZ} FROM g)) SELECT CAST(axis AS INTEGER) AS axis, n, {', '.join(f'CAST({f}({c}) AS DOUBLE) AS {f}_{c}' for f in ('min', 'max') for c in 'xyz')} FROM s GROUP BY axis, n", "vol")
def _(spark, d):
    g = vol(spark, d)[1]
    out = [(a, i, *map(float, (*g.slice_bounds(a, i)[0], *g.slice_bounds(a, i)[1]))) for a in range(3) for i in range(g.dim[a])]
    return rows(spark, out, "axis int, n long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")


@query("points_inside", f"+p AS (SELECT {_PT} FROM customer) SELECT c_custkey, ((x + 9) / 2 >= 0 AND (x + 9) / 2 < nx AND (y + 11.25) / 2.5 >= 0 AND (y + 11.25) / 2.5 < ny AND (z + 20) / 3 >= 0 AND (z + 20) / 3 < nz) AS inside FROM p, gdim", "gdim")
def _(spark, d):
    g = vol(spark, d)[1]
    return _points(spark, d).select("c_custkey", g.inside(*g.to_grid("x", "y", "z")).alias("inside"))


@query("grids_agree", "SELECT CAST(range AS INTEGER) AS n, (power(10, -range) <= 1e-6) AS same, (power(10, -range) <= 1e-4 * 20) AS compatible FROM range(1, 10)")
def _(spark, d):
    g = vol(spark, d)[1]
    moved = [(n, Grid(g.dim, g.spacing, (*g.origin[:2], g.origin[2] + 0.999999 * 10.0**-n))) for n in range(1, 10)]
    return rows(spark, [(n, g.same_geometry(m), m.compatible(g)) for n, m in moved], "n int, same boolean, compatible boolean")


# ------------------------------------------------------------------ regions and labels
@query("roi_cuboid", f"+{_G} SELECT idx, value FROM g WHERE abs(i - 4) <= 2 AND abs(j - 1) <= 3 AND abs(k - 1) <= 1", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.cuboid(v, g, (4, 1, 1), (2, 3, 1)).select("idx", "value")


@query("roi_from_cells", f"+{_G}, c AS (SELECT DISTINCT c_custkey % 9 + c_custkey % 7 * 10 + 100 AS idx FROM customer) SELECT 'mask' AS how, idx, value FROM vol WHERE label > 40 UNION ALL SELECT 'indices', idx, value FROM vol WHERE idx IN (3, 7, 50) UNION ALL SELECT 'coordinates', vol.idx, value FROM vol JOIN c ON c.idx = vol.idx UNION ALL SELECT 'subset', idx, value FROM vol WHERE label > 40 AND idx IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) UNION ALL SELECT 'condition', idx, value FROM vol WHERE label > 40 AND value > 1000", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    c = F.col("c_custkey")
    cells = L.table(spark, d, "customer").select((c % 9).alias("i"), (c % 7).alias("j"), F.lit(1).alias("k")).distinct()
    mask = roi.from_mask(v, v.filter("label > 40"))
    parts = {"mask": mask, "indices": roi.from_indices(v, [3, 7, 50]), "coordinates": roi.from_mask(v, roi.from_coordinates(cells, g)), "subset": roi.subset(mask, list(range(1, 13))), "condition": roi.subset(mask, F.col("value") > 1000)}
    out = None
    for how, part in parts.items():
        part = part.select(F.lit(how).alias("how"), "idx", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("roi_world", f"+{_G} SELECT idx, CAST(-9 + 2.0 * i AS DOUBLE) AS x, CAST(-11.25 + 2.5 * j AS DOUBLE) AS y, CAST(-20 + 3.0 * k AS DOUBLE) AS z FROM g WHERE label = 12", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.world_coordinates(v.filter("label = 12").select("idx"), g)


def _names(v):
    """A name for every label but 13: the least brand of its cells and its number."""
    return v.filter("label <> 13").groupBy("label").agg(F.concat(F.min("brand"), F.lit(" "), F.first("label").cast("string")).alias("name"))


_NAMES = "names AS (SELECT label, min(brand) || ' ' || label AS name FROM vol WHERE label <> 13 GROUP BY label)"


@query("region_by_name", f"+{_NAMES} SELECT 'name' AS how, idx FROM vol WHERE label = 7 UNION ALL SELECT 'number', idx FROM vol WHERE label = 9", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    names = _names(v)
    name = names.filter("label = 7").first()["name"]
    return atlas.region(v, names, key=name).select(F.lit("name").alias("how"), "idx").union(atlas.region(v, names, label=9).select(F.lit("number").alias("how"), "idx"))


@query("labels_with_names", f"+{_NAMES} SELECT idx, v.label, name FROM vol v LEFT JOIN names n ON n.label = v.label", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    return atlas.with_names(v.select("idx", "label"), _names(v)).select("idx", "label", "name")


@query("stat_functions", f"SELECT name, {r('value')} AS value FROM (SELECT unnest(['sum', 'mean', 'min', 'max', 'std', 'median']) AS name, unnest([sum(value), avg(value), min(value), max(value), stddev_samp(value), median(value)]) AS value FROM vol)", "vol")
def _(spark, d):
    v, out = vol(spark, d)[0], None
    for name in ("sum", "mean", "min", "max", "std", "median"):
        part = R.stat(v, name).select(F.lit(name).alias("name"), F.col(name).alias("value"))
        out = part if out is None else out.union(part)
    return show(out, "name", value="value")


@query("valid_stacks", "+c AS (SELECT grp, count(DISTINCT member) AS n FROM members GROUP BY grp) SELECT a.grp AS a, b.grp AS b, a.n = b.n AS ok FROM c a JOIN c b ON b.grp = a.grp + 1 WHERE a.grp < 3", "members")
def _(spark, d):
    s = stack(spark, d)

    def ok(a, b):
        try:
            R.validate_stack({str(x): s.filter(F.col("grp") == x) for x in (a, b)})
        except ValueError:
            return False
        return True

    groups = sorted(x[0] for x in s.select("grp").distinct().collect())
    return rows(spark, [(a, b, ok(a, b)) for a, b in zip(groups[:3], groups[1:], strict=False)], "a int, b int, ok boolean")


@query("pair_similarity", f"+gm AS (SELECT grp AS member, pos, avg(value) AS value FROM members GROUP BY grp, pos) SELECT {r('corr(a.value, b.value)')} AS r FROM gm a JOIN gm b ON a.pos = b.pos WHERE a.member = 2 AND b.member = 5", "members")
def _(spark, d):
    return show(SS.basis_r(SS.basis(group_maps(spark, d))[2], 5, 2), r="r")


# ------------------------------------------------------------------ scalars
_TICK = "b AS (SELECT *, power(10.0, floor(log10((hi - lo) / 5))) AS base FROM a), s AS (SELECT *, list_sort([[abs(m * base - (hi - lo) / 5), m * base] FOR m IN [1, 2, 5, 10]])[1][2] AS step FROM b)"


@query("axis_ticks", f"WITH a AS (SELECT label, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM (SELECT p_size AS label, p_retailprice FROM part) GROUP BY label HAVING min(p_retailprice) < max(p_retailprice)), {_TICK} SELECT label, {r('k * step')} AS tick FROM (SELECT label, step, unnest(range(CAST(ceil(lo / step - 1e-9) AS BIGINT), CAST(floor(hi / step + 1e-9) AS BIGINT) + 1)) AS k FROM s)")
def _(spark, d):
    x = vol(spark, d)[0].groupBy("label").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi").collect()  # one row a label
    return show(rows(spark, [(z["label"], t) for z in x for t in ST.nice_ticks(z["lo"], z["hi"])], "label int, tick double"), "label", tick="tick")


_WORDS = "SELECT n, (CASE WHEN lo >= hi THEN 'all t values shown' WHEN a <= lo AND b >= hi AND lo = -hi THEN '|t| >= ' || printf('%.3g', hi) WHEN a <= lo AND b >= hi THEN 't <= ' || printf('%.3g', lo) || ' or t >= ' || printf('%.3g', hi) WHEN a <= lo THEN 't <= ' || printf('%.3g', lo) WHEN b >= hi THEN 't >= ' || printf('%.3g', hi) ELSE 'no t values shown' END) AS words"


@query("threshold_words", f"WITH c AS (SELECT r_regionkey AS n, r_regionkey * 1.5 - 2.25 AS lo, 2.25 - CASE WHEN r_regionkey = 4 THEN 9 ELSE 0 END AS hi, -3.0 + r_regionkey * 2 AS a, 3.5 AS b FROM region UNION ALL SELECT r_regionkey + 10, -2.25, 2.25 + r_regionkey, -3.0, 3.5 FROM region) {_WORDS} FROM c")
def _(spark, d):
    k = [x[0] for x in L.table(spark, d, "region").select("r_regionkey").collect()]
    c = [(n, n * 1.5 - 2.25, 2.25 - (9 if n == 4 else 0), -3.0 + n * 2, 3.5) for n in k] + [(n + 10, -2.25, 2.25 + n, -3.0, 3.5) for n in k]
    return rows(spark, [(n, TX.describe_threshold(lo, hi, "t", (a, b))) for n, lo, hi, a, b in c], "n int, words string")


@query("probe_labels", "SELECT n_nationkey AS n, 'voxel (' || n_nationkey || ', ' || n_nationkey * 2 || ', 7)' AS voxel, n_nationkey + 1 || ' mm sphere at (' || n_nationkey || ', 2, -' || n_nationkey || ')' AS sphere, n_name AS mask FROM nation WHERE n_nationkey > 0")
def _(spark, d):
    x = L.table(spark, d, "nation").filter("n_nationkey > 0").select("n_nationkey", "n_name").collect()
    out = [(n, TX.probe_label("voxel", ijk=(n, n * 2, 7)), TX.probe_label("sphere", radius=n + 1, center=(n, 2, -n)), TX.probe_label("mask", name=name)) for n, name in x]
    return rows(spark, out, "n int, voxel string, sphere string, mask string")


_DFT = "c AS (SELECT s.idx, b.range AS bin, sum(value * cos(2 * pi() * b.range * t / 30)) AS re, -sum(value * sin(2 * pi() * b.range * t / 30)) AS im FROM series s, range(16) b GROUP BY 1, 2)"


@query("fourier_coefficients", f"+{_DFT} SELECT idx, CAST(bin AS INTEGER) AS bin, {r('bin / (30 * 2.0)')} AS hz, round(re, 3) + 0.0::DOUBLE AS re, round(im, 3) + 0.0::DOUBLE AS im FROM c", "series")
def _(spark, d):
    s = T.spectrum(L.series(spark, d), 2.0)
    return show(s, "idx", "bin", hz="hz", re=F.round("re", 3), im=F.round("im", 3))


@query("seeded_draws", f"WITH {draws(5, 40, 7)} SELECT CAST(rep AS INTEGER) AS rep, CAST(n AS INTEGER) AS n, u, CAST(floor(u * 13) AS INTEGER) AS pick FROM rnd")
def _(spark, d):
    out = []
    for rep in range(5):
        draw, pick = mulberry32(7 + rep), mulberry32(7 + rep)
        out += [(rep, n, draw(), random_index(pick, 13)) for n in range(40)]
    return rows(spark, out, "rep int, n int, u double, pick int")


# ------------------------------------------------------------------ lens and correlation along dimensions
_LENS = "l AS (SELECT c_custkey, x, y, sqrt(power(x - 1, 2) + power(y - 2, 2)) / 6 AS q FROM p)"


@query("lens_points", f"WITH p AS (SELECT {_PT} FROM customer), {_LENS} SELECT c_custkey, {r('CASE WHEN q >= 1 THEN x ELSE 1 + (x - 1) * 4 / (3 * q + 1) END')} AS lx, {r('CASE WHEN q >= 1 THEN y ELSE 2 + (y - 2) * 4 / (3 * q + 1) END')} AS ly, {r('CASE WHEN q >= 1 THEN 1 ELSE 4 / power(3 * q + 1, 2) END')} AS scale, {r('x')} AS back_x, {r('y')} AS back_y FROM l")
def _(spark, d):
    p = _points(spark, d)
    p = p.withColumn("l", E.lens(F.col("x"), F.col("y"), 1.0, 2.0, 6.0, 3.0))
    p = p.withColumn("b", E.inverse_lens(F.col("l.x"), F.col("l.y"), 1.0, 2.0, 6.0, 3.0))
    return show(p, "c_custkey", lx="l.x", ly="l.y", scale="l.scale", back_x="b.x", back_y="b.y")


@query("correlate_dimensions", f"+f AS (SELECT flag, year, avg(value) AS x FROM hyper GROUP BY 1, 2), s AS (SELECT status, year, avg(value) AS y FROM hyper GROUP BY 1, 2) SELECT flag, status, {r('CASE WHEN count(*) >= 3 THEN corr(x, y) END')} AS r FROM f JOIN s ON s.year = f.year GROUP BY 1, 2", "hyper")
def _(spark, d):
    return show(R.correlate_dims(L.hyper(spark, d), "flag", "status"), "flag", "status", r="r")


# ------------------------------------------------------------------ stored files
@query("read_stored_volume", f"SELECT idx, {r('CAST(value AS FLOAT)')} AS value FROM vol", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    path = f"{scratch(spark)}/v.nii.gz"
    nifti.write_volume(v.select("idx", "value"), g, path)
    got, h = nifti.read_volume(spark, path)
    if not h.same_geometry(g, 1e-4):
        raise ValueError("the grid has changed")
    return show(got, "idx", value="value")


@query("read_stored_header", "SELECT CAST(a AS INTEGER) AS axis, CAST([nx, ny, nz][a] AS INTEGER) AS dim, [2.0, 2.5, 3.0][a]::DOUBLE AS spacing, [-9.0, -11.25, -20.0][a]::DOUBLE AS origin, 'i2' AS datatype, 16 AS bitpix, 1 AS sform_code FROM gdim, (SELECT unnest([1, 2, 3]) AS a)", "gdim")
def _(spark, d):
    v, g = vol(spark, d)
    path = f"{scratch(spark)}/h.nii"
    nifti.write_volume(v.select("idx", "value"), g, path, "i2")
    h = nifti.read_headers(spark, path)
    one = h.select(F.posexplode(F.slice("dim", 1, 3)).alias("p", "dim"), F.slice("spacing", 1, 3).alias("spacing"), "origin", "datatype", "bitpix", "sform_code")
    return one.select((F.col("p") + 1).alias("axis"), "dim", F.get("spacing", "p").alias("spacing"), F.get("origin", "p").alias("origin"), "datatype", "bitpix", "sform_code")


def _grid_of_users(s):
    """Users as cells, in planes of 100."""
    top = s.agg(F.max("idx")).first()[0]
    return Grid((10, 10, int(top) // 100 + 1))


@query("read_stored_series", "+f AS (SELECT idx, t, value FROM series) SELECT idx, CAST(0 AS INTEGER) AS t, round(CAST(value AS FLOAT)::DOUBLE, 3) AS value FROM f WHERE t = 9 UNION ALL SELECT idx, 1, round(CAST(value AS FLOAT)::DOUBLE, 3) FROM f WHERE t = 4", "series")
def _(spark, d):
    s = L.series(spark, d)
    path = f"{scratch(spark)}/s.nii"
    nifti.write_volume(s, _grid_of_users(s), path, tr=2.0)
    got = nifti.read_series(spark, path, [9, 4])[0]
    return got.join(s.select("idx").distinct(), "idx").select("idx", "t", F.round("value", 3).alias("value"))


@query("read_several_volumes", f"SELECT CAST(n AS INTEGER) AS n, idx, {r('CAST(value * n AS FLOAT)')} AS value FROM vol, (SELECT unnest([1, 2, 3]) AS n)", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    base = scratch(spark)
    for n in (1, 2, 3):
        nifti.write_volume(v.select("idx", (F.col("value") * n).alias("value")), g, f"{base}/v{n}.nii.gz")
    c = nifti.read_cells(spark, [f"{base}/v{n}.nii.gz" for n in (1, 2, 3)])
    return show(c, F.regexp_extract("file", r"v(\d)\.nii", 1).cast("int").alias("n"), "idx", value="value")


@query("read_image_variants", f"SELECT unnest(['big endian', 'scaled', 'no scaling', 'gzip']) AS how, idx, unnest([floor(value + 0.5), floor(value + 0.5) * 0.5 - 7, floor(value + 0.5), floor(value + 0.5)])::DOUBLE AS value FROM vol", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    files = None
    for how, options in (("big endian", {"order": ">"}), ("scaled", {"slope": 0.5, "inter": -7.0}), ("no scaling", {"slope": 0.0, "inter": 5.0}), ("gzip", {"gz": True})):
        one = nifti.encoded(v.select("idx", "value").withColumn("file", F.lit(how)), g, "file", "i2", **options)
        files = one if files is None else files.union(one)
    return nifti.cells_of(files).select(F.col("file").alias("how"), "idx", "value")


@query("read_label_atlas", f"+{_NAMES} SELECT idx, v.label, name FROM vol v LEFT JOIN names n ON n.label = v.label WHERE v.label <> 0", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    base = scratch(spark)
    nifti.write_volume(v.select("idx", F.col("label").cast("double").alias("value")), g, f"{base}/labels.nii.gz", "i2")
    delimited.write_text(_names(v), f"{base}/names.csv")
    labels, names, _ = atlas.read_atlas(spark, f"{base}/labels.nii.gz", f"{base}/names.csv")
    return atlas.with_names(labels, names).select("idx", F.col("label").cast("int").alias("label"), "name")


@query("read_typed_text", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size > 25 AS big, CASE WHEN p_size <> 7 THEN p_size END AS size FROM part")
def _(spark, d):
    p = L.table(spark, d, "part")
    path = f"{scratch(spark)}/part.csv"
    delimited.write_text(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("big"), F.when(F.col("p_size") != 7, F.col("p_size")).alias("size")), path)
    return delimited.read_typed(spark, path, {"id": "int64", "name": "string", "price": "float64", "big": "bool", "size": "int32"})


@query("parse_small_text", "SELECT n_nationkey AS n, n_name AS name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def _(spark, d):
    x = L.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    text = " n ;name; region\n\n" + "\n".join(f'{a};"{b}";{c if c else ""}' for a, b, c in x) + "\n"
    head, body = delimited.parse(text, ";")
    return rows(spark, body, ", ".join(f"{h} string" for h in head)).withColumn("n", F.col("n").cast("int"))


@query("convert_json_cells", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN props END AS props FROM events")
def _(spark, d):
    e = L.table(spark, d, "events")
    return e.select("event_id", delimited.convert(F.when(F.col("event_id") % 7 > 0, F.col("props")), "json").alias("props"))


@query("read_subject_covariates", "SELECT CAST(c_custkey AS VARCHAR) AS participant_id, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS balance, c_mktsegment AS segment FROM customer")
def _(spark, d):
    c = L.table(spark, d, "customer")
    path = f"{scratch(spark)}/participants.tsv"
    delimited.write_text(c.select(F.concat(F.lit("sub-"), "c_custkey").alias("participant_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("balance"), F.col("c_mktsegment").alias("segment")), path, "\t")
    return delimited.read_covariates(spark, path)


_MANIFEST = {
    "spec_version": "0.1.0", "dataset_id": "parts", "storage_profile": "table-package", "observation_table": {"path": "obs.csv", "format": "csv"}, "row_id": "row", "observation_axes": ["subject", "cond"],
    "observation_columns": {"row": {"dtype": "string", "nullable": False}, "subject": {"dtype": "string", "semantic_role": "subject"}, "cond": {"dtype": "string", "semantic_role": "condition"}, "age": {"dtype": "float64"}, "file": {"dtype": "string"}},
    "features": {"map": {"logical": {"kind": "volume", "axes": ["x", "y", "z"], "support_ref": "grid"}, "encodings": [{"type": "ref", "binding": {"resource_id": {"column": "file"}}}]}},
    "supports": {"grid": {"support_type": "volume", "grid_id": "g"}}, "resources": {"path": "resources.csv", "format": "csv"},
}


def _dataset(spark, d):
    """A dataset on disk: all suppliers in two conditions, one of three images for each row."""
    base = scratch(spark)
    v, g = vol(spark, d)
    for n in range(3):
        nifti.write_volume(v.select("idx", (F.col("value") + n).alias("value")), g, f"{base}/v{n}.nii.gz")
    s = L.table(spark, d, "supplier").crossJoin(spark.range(2).withColumnRenamed("id", "c"))
    delimited.write_text(s.select(F.concat_ws("-", F.lit("r"), "s_suppkey", "c").alias("row"), F.col("s_suppkey").cast("string").alias("subject"), F.when(F.col("c") == 0, "a").otherwise("b").alias("cond"), F.col("s_acctbal").alias("age"), F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string")).alias("file")), f"{base}/obs.csv")
    delimited.write_text(rows(spark, [(f"f{n}", "file", f"v{n}.nii.gz") for n in range(3)], "resource_id string, backend string, locator string"), f"{base}/resources.csv")
    rows(spark, [(json.dumps(_MANIFEST),)], "value string").coalesce(1).write.text(f"{base}/manifest.json")
    return manifest.open_dataset(spark, f"{base}/manifest.json")


_OBS = "obs AS (SELECT 'r-' || s_suppkey || '-' || c AS row, CAST(s_suppkey AS VARCHAR) AS subject, CASE c WHEN 0 THEN 'a' ELSE 'b' END AS cond, s_acctbal AS age, s_suppkey % 3 AS f FROM supplier, (SELECT unnest([0, 1]) AS c))"


@query("dataset_design", f"WITH {_OBS} SELECT subject, cond, age FROM obs")
def _(spark, d):
    return _dataset(spark, d).design()[0]


@query("dataset_resources", f"WITH {_OBS} SELECT row, 'file' AS backend, 'v' || f || '.nii.gz' AS locator FROM obs")
def _(spark, d):
    return _dataset(spark, d).resolve("map").select("row", "backend", "locator")


@query("dataset_maps", f"WITH {_OBS} SELECT row, p_partkey AS pos, {r('CAST(p_retailprice + f AS FLOAT)')} AS value FROM obs, part")
def _(spark, d):
    return _dataset(spark, d).backing("map", each=rounded).select("row", "pos", "value")


@query("checksum_mismatches", "SELECT 'v' || range || '.bin' AS file FROM range(3) WHERE range = 1")
def _(spark, d):
    base = scratch(spark)
    rows(spark, [(f"line {n}", n) for n in range(3)], "value string, n int").write.partitionBy("n").text(f"{base}/t")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{base}/t").select("path", F.regexp_extract("path", r"n=(\d)", 1).cast("int").alias("n"), "content").collect()
    want = [(x["path"].rsplit("/", 1)[-1], "sha256:" + hashlib.sha256(bytes(x["content"])).hexdigest() if x["n"] != 1 else "sha256:0") for x in files]
    bad = nifti.verified(spark, rows(spark, want, "file string, checksum string"), [x["path"] for x in files])
    number = rows(spark, [(x["path"].rsplit("/", 1)[-1], x["n"]) for x in files], "file string, n int")
    return bad.join(number, "file").select(F.concat(F.lit("v"), F.col("n").cast("string"), F.lit(".bin")).alias("file"))


_SUM = "s AS (SELECT p_brand AS brand, count(*) AS n, avg(p_retailprice) AS m, stddev_samp(p_retailprice) / sqrt(count(*)) AS se FROM part GROUP BY 1 HAVING count(*) > 1)"


def _summary(spark, d):
    p = L.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("estimate"), (F.stddev_samp("p_retailprice") / F.sqrt(F.count(F.lit(1)))).alias("se")).filter("n > 1")
    path = f"{scratch(spark)}/summary"
    t = p.select("brand", "estimate", (F.col("estimate") - F.col("se")).alias("lower"), (F.col("estimate") + F.col("se")).alias("upper"), F.lit("se").alias("interval_kind"), "n", "se")
    lines = [x["line"] for x in summary.to_text(t).collect()]  # a summary table: one row a brand
    rows(spark, [("\n".join([",".join(t.columns), *lines]),)], "value string").coalesce(1).write.text(path)
    return summary.read_summary(spark, path)


@query("read_summary_table", f"WITH {_SUM} SELECT brand, {r('m')} AS estimate, {r('m - se')} AS lower, {r('m + se')} AS upper, CAST(n AS DOUBLE) AS n FROM s")
def _(spark, d):
    return show(_summary(spark, d), "brand", estimate="estimate", lower="lower", upper="upper", n=F.col("n").cast("double"))


@query("stored_summary_scene", f"WITH {_SUM} SELECT brand, {r('m')} AS mean, {r('m - se')} AS lo, {r('m + se')} AS hi, CAST(n AS DOUBLE) AS n FROM s")
def _(spark, d):
    return show(summary_scene(_summary(spark, d), PlotSpec(x="brand")), "brand", mean="mean", lo="lo", hi="hi", n=F.col("n").cast("double"))


# ------------------------------------------------------------------ layouts
_GM2 = "gm AS (SELECT grp AS member, pos, avg(value) AS value FROM members GROUP BY grp, pos)"
_LAY = f"{_GM2}, lay AS (SELECT member, max(value) FILTER (pos = 0) AS x, max(value) FILTER (pos = 1) AS y FROM gm GROUP BY member)"
_DEL = f"{_LAY}, pr AS (SELECT a.member AS i, b.member AS j, 1 - corr(a.value, b.value) AS delta FROM gm a JOIN gm b ON b.pos = a.pos AND b.member > a.member GROUP BY 1, 2), pd AS (SELECT i, j, delta, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) AS d FROM pr JOIN lay p ON p.member = i JOIN lay q ON q.member = j)"


def _layout(spark, d):
    g = group_maps(spark, d)
    at = lambda n: F.max(F.when(F.col("pos") == n, F.col("value")))
    return g.groupBy("member").agg(at(0).alias("x"), at(1).alias("y"))


def _delta(spark, d):
    """Dissimilarities of the ten maps, and the places that their first two cells give them."""
    m, ids = E.matrix(SS.correlation_matrix(group_maps(spark, d)).select(F.col("a").alias("i"), F.col("b").alias("j"), (1 - F.col("r")).alias("d")))
    lay = {x["member"]: (x["x"], x["y"]) for x in _layout(spark, d).collect()}  # ten rows
    return m, [lay[i] for i in ids], ids


@query("layout_regression", f"+{_LAY}, c AS (SELECT 'cell' || gm.pos AS name, covar_pop(x, value) AS sxv, covar_pop(y, value) AS syv, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy, var_pop(value) AS svv FROM gm JOIN lay ON lay.member = gm.member WHERE pos BETWEEN 2 AND 6 GROUP BY 1), b AS (SELECT *, (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) AS bx, (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) AS vy FROM c) SELECT name, {r('(bx * sxv + vy * syv) / svv')} AS r2, {r('bx / sqrt(bx * bx + vy * vy)')} AS dx, {r('vy / sqrt(bx * bx + vy * vy)')} AS dy FROM b", "members")
def _(spark, d):
    cov = group_maps(spark, d).filter("pos between 2 and 6").select(F.concat(F.lit("cell"), "pos").alias("name"), "member", "value")
    return show(E.envfit(_layout(spark, d), cov, permutations=0), "name", r2="r2", dx="dx", dy="dy")


@query("layout_groups", f"+{_LAY}, f AS (SELECT member % 3 AS g, x, y FROM lay), w AS (SELECT sum(vx * n) + sum(vy * n) AS within FROM (SELECT var_pop(x) AS vx, var_pop(y) AS vy, count(*) AS n FROM f GROUP BY g)), t AS (SELECT (var_pop(x) + var_pop(y)) * count(*) AS total FROM f) SELECT 'third' AS name, {r('1 - within / total')} AS r2 FROM w, t", "members")
def _(spark, d):
    lay = _layout(spark, d)
    cov = lay.select(F.lit("third").alias("name"), "member", (F.col("member") % 3).cast("double").alias("value"))
    return show(E.envfit(lay, cov, "factor", permutations=0), "name", r2="r2")


@query("path_lengths", f"+{_DEL} SELECT 'forward' AS way, {r('sum(delta)')} AS length FROM pd WHERE j = i + 1 UNION ALL SELECT 'evens', {r('sum(delta)')} FROM pd WHERE j = i + 2 AND i % 2 = 0", "members")
def _(spark, d):
    m, _, ids = _delta(spark, d)
    out = [("forward", E.path_length(list(range(len(ids))), m)), ("evens", E.path_length(list(range(0, len(ids), 2)), m))]
    return show(rows(spark, out, "way string, length double"), "way", length="length")


@query("metric_stress", f"+{_DEL}, k AS (SELECT sum(delta * d) / sum(delta * delta) AS k FROM pd) SELECT {r('sqrt(sum(power(d - k * delta, 2)) / sum(d * d))')} AS stress FROM pd, k", "members")
def _(spark, d):
    m, lay, _ = _delta(spark, d)
    i, j = np.triu_indices(len(m), 1)
    flat, dist = m[i, j], E._pair_distances(np.array(lay))
    return show(rows(spark, [(E.stress1(dist, flat * (flat @ dist) / (flat @ flat)),)], "stress double"), stress="stress")


_ISO = "o AS (SELECT i, j, d, row_number() OVER (ORDER BY delta, d) AS n FROM pd), c AS (SELECT n, sum(d) OVER (ORDER BY n) AS s FROM o UNION ALL SELECT 0, 0.0), m AS (SELECT a.n + 1 AS a, b.n AS b, (b.s - a.s) / (b.n - a.n) AS mean FROM c a JOIN c b ON b.n > a.n), lo AS (SELECT o.n, m.a, min(mean) AS low FROM o JOIN m ON m.a <= o.n AND m.b >= o.n GROUP BY 1, 2), hi AS (SELECT n, max(low) AS fit FROM lo GROUP BY n)"


@query("monotone_disparities", f"+{_DEL}, {_ISO} SELECT i, j, {r('fit')} AS disparity FROM o JOIN hi ON hi.n = o.n", "members")
def _(spark, d):
    """By the max-min formula in SQL, by pooling here."""
    m, lay, ids = _delta(spark, d)
    i, j = np.triu_indices(len(m), 1)
    hat = E.disparities(m[i, j], E._pair_distances(np.array(lay)))
    return show(rows(spark, [(int(ids[a]), int(ids[b]), float(h)) for a, b, h in zip(i, j, hat, strict=True)], "i int, j int, disparity double"), "i", "j", disparity="disparity")


_PRO = (
    "p AS (SELECT c_acctbal AS x, c_custkey % 97 * 10.0 AS y, c_custkey % 97 * 20.0 + 5 + c_custkey % 7 AS u, c_acctbal * CASE WHEN {turn} THEN -2 ELSE 2 END + 1 - c_custkey % 5 AS v FROM customer), "
    "s AS (SELECT covar_pop(x, u) AS xu, covar_pop(x, v) AS xv, covar_pop(y, u) AS yu, covar_pop(y, v) AS yv, var_pop(x) + var_pop(y) AS sx, var_pop(u) + var_pop(v) AS su FROM p), "
    "g AS (SELECT *, sqrt(power(xu + yv, 2) + power(xv - yu, 2)) AS turned, sqrt(power(xu - yv, 2) + power(xv + yu, 2)) AS flipped FROM s)"
)
for _turn in (True, False):

    def _run(spark, d, turn=_turn):
        """Share of the target's spread that the best similarity explains, its scale, and whether it mirrors."""
        c = L.table(spark, d, "customer")
        k = F.col("c_custkey")
        p = c.select(F.col("c_acctbal").alias("x"), (k % 97 * 10.0).alias("y"), (k % 97 * 20.0 + 5 + k % 7).alias("u"), (F.col("c_acctbal") * (-2 if turn else 2) + 1 - k % 5).alias("v"))
        how, out = SS.procrustes(p)
        e = out.agg(F.avg((F.col("x2") - F.col("u")) ** 2 + (F.col("y2") - F.col("v")) ** 2).alias("left"), (F.var_pop("u") + F.var_pop("v")).alias("su"))
        return show(e.withColumns({"scale": F.lit(how["scale"]), "mirrored": F.lit(bool(how["reflected"]))}), "mirrored", fit=1 - F.col("left") / F.col("su"), scale="scale")

    query(f"procrustes_{'turned' if _turn else 'mirrored'}", f"WITH {_PRO.format(turn=str(_turn).lower())} SELECT flipped > turned AS mirrored, {r('power(greatest(turned, flipped), 2) / (sx * su)')} AS fit, {r('greatest(turned, flipped) / sx')} AS scale FROM g")(_run)
