"""Queries on volumes: arithmetic, masks, geometry, reductions, joins, stencils, resampling, components, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import layout as L
from gridloom.grid import Grid
from gridloom.operators import components as C
from gridloom.operators import joins as J
from gridloom.operators import reduce as R
from gridloom.operators import resample as RS
from gridloom.operators import roi
from gridloom.operators import stencil as S
from gridloom.operators import volume as V
from gridloom.plans.registry import draws, query, r, show


def vol(spark, d):
    v, g = L.volume(spark, d)
    return v, g


def other(v):
    return v.select("idx", F.col("label").cast("double").alias("value"))


# ------------------------------------------------------------------ arithmetic and comparison
for _name, _f, _sql in (
    ("vol_add", lambda a, b: V.add(a, b), "value + label"),
    ("vol_subtract", lambda a, b: V.subtract(a, b), "value - label"),
    ("vol_multiply", lambda a, b: V.multiply(a, b), "value * label"),
    ("vol_divide", lambda a, b: V.divide(a, V.subtract(b, 10.0)), "CASE WHEN label = 10 THEN 0.0 ELSE value / (label - 10) END"),
    ("vol_add_scalar", lambda a, b: V.add(a, 2.5), "value + 2.5"),
    ("vol_negate", lambda a, b: V.negate(a).select("idx", "value"), "-value"),
    ("vol_abs", lambda a, b: V.absolute(V.subtract(b, 25.0)), "abs(label - 25.0)"),
    ("vol_sqrt", lambda a, b: V.root(V.subtract(b, 25.0)), "sqrt(greatest(label - 25.0, 0.0))"),
    ("vol_map_udf", lambda a, b: V.apply(a, lambda x: F.floor(x / 7) * 7.0).select("idx", "value"), "floor(value / 7) * 7.0"),
):

    def _run(spark, d, f=_f):
        v, _ = vol(spark, d)
        return show(f(v, other(v)), "idx", value="value")

    query(_name, f"SELECT idx, {r(_sql)} AS value FROM vol", "vol")(_run)

for _name, _f, _sql in (
    ("vol_greater", lambda a, b: V.greater(a, V.multiply(b, 40.0)), "value > label * 40.0"),
    ("vol_less", lambda a, b: V.less(a, V.multiply(b, 40.0)), "value < label * 40.0"),
    ("vol_equal", lambda a, b: V.equal(b, 25.0, 1.5), "abs(label - 25.0) <= 1.5"),
):

    def _run(spark, d, f=_f):
        v, _ = vol(spark, d)
        return f(v, other(v))

    query(_name, f"SELECT idx, {_sql} AS value FROM vol", "vol")(_run)


@query("vol_threshold", "SELECT op, count(*) AS n, CAST(sum(idx) AS BIGINT) AS total FROM (SELECT idx, unnest(CASE WHEN label > 25 THEN ['gt', 'gte', 'neq'] WHEN label < 25 THEN ['lt', 'lte', 'neq'] ELSE ['gte', 'lte', 'eq'] END) AS op FROM vol) GROUP BY op", "vol")
def _(spark, d):
    b = other(vol(spark, d)[0])
    out = None
    for op in ("gt", "lt", "gte", "lte", "eq", "neq"):
        part = V.threshold(b, 25, op).select(F.lit(op).alias("op"), "idx")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total"))


@query("vol_sparse_dense", "SELECT idx, CAST(CASE WHEN abs(label - 25) > 20 THEN label - 25 ELSE 0 END AS DOUBLE) AS value FROM vol", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return V.densify(V.sparse(V.subtract(other(v), 25.0), 20), g).select("idx", "value")


@query("vol_relabel", "SELECT idx, CAST(CASE label WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE label END AS DOUBLE) AS value FROM vol", "vol")
def _(spark, d):
    return V.relabel(other(vol(spark, d)[0]), {1: 100, 2: 200})


@query("vol_integer_labels", "SELECT idx, label FROM vol", "vol")
def _(spark, d):
    return V.integer_labels(V.add(other(vol(spark, d)[0]), 1e-5))


_A, _B = "label > 20", "brand = 'Brand#12'"


def _masks(spark, d):
    v, g = vol(spark, d)
    return v.filter(_A), v.filter(_B), g, v


for _name, _f, _sql in (
    ("mask_and", lambda a, b, g, v: V.mask_and(a, b), f"SELECT idx FROM vol WHERE {_A} AND {_B}"),
    ("mask_or", lambda a, b, g, v: V.mask_or(a, b), f"SELECT idx FROM vol WHERE {_A} OR {_B}"),
    ("mask_xor", lambda a, b, g, v: V.mask_xor(a, b), f"SELECT idx FROM vol WHERE ({_A}) <> ({_B})"),
    ("mask_not", lambda a, b, g, v: V.mask_not(a, g), f"SELECT idx FROM vol WHERE NOT ({_A})"),
    ("mask_semi", lambda a, b, g, v: V.inside_mask(v, b).select("idx", "value"), f"SELECT idx, value FROM vol WHERE {_B}"),
    ("mask_anti", lambda a, b, g, v: V.outside_mask(v, a).select("idx", "value"), f"SELECT idx, value FROM vol WHERE NOT ({_A})"),
):

    def _run(spark, d, f=_f):
        return f(*_masks(spark, d))

    query(_name, _sql, "vol")(_run)

# ------------------------------------------------------------------ geometry
_IJK = "idx % 10 AS i, idx // 10 % 10 AS j, idx // 100 AS k"
_G = f"g AS (SELECT idx, {_IJK}, value, label FROM vol)"


@query("grid_coordinates", f"+{_G} SELECT idx, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, CAST(-9 + 2.0 * i AS DOUBLE) AS x, CAST(-11.25 + 2.5 * j AS DOUBLE) AS y, CAST(-20 + 3.0 * k AS DOUBLE) AS z, idx AS back FROM g", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    w = v.select("idx", *[c.alias(n) for c, n in zip(g.axes_of("idx"), "ijk", strict=True)], *[c.alias(n) for c, n in zip(g.world_of_index("idx"), "xyz", strict=True)])
    return w.withColumn("back", g.nearest_index("x", "y", "z").cast("long"))


@query("vol_slice", f"+{_G} SELECT CAST(j AS INTEGER) AS row, CAST(i AS INTEGER) AS col, value FROM g WHERE k = 1", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return V.slice_of(v, g, 2, 1)


@query("vol_display_slice", f"+{_G}, m AS (SELECT max(k) AS nk FROM g) SELECT CAST(nk - k AS INTEGER) AS row, CAST(j AS INTEGER) AS col, value FROM g, m WHERE i = 4", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return V.display_slice(v, g, 0, 4)


@query("vol_orthogonal_slices", f"+{_G} SELECT plane, count(*) AS n, {r('sum(value)')} AS value FROM (SELECT value, unnest(CASE WHEN k = 1 THEN ['axial'] ELSE [] END || CASE WHEN j = 4 THEN ['coronal'] ELSE [] END || CASE WHEN i = 5 THEN ['sagittal'] ELSE [] END) AS plane FROM g) GROUP BY plane", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    s = V.orthogonal_slices(v, g, g.point((5, 4, 1)))
    return show(s.groupBy("plane").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")), "plane", "n", value="value")


@query("sphere_positions", f"+{_G} SELECT idx FROM g WHERE (i-5)*(i-5) + (j-5)*(j-5) + (k-1)*(k-1) <= 9", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return V.sphere_positions(v, g, (5, 5, 1), 3).select("idx")


@query("sphere_probe", f"+{_G} SELECT idx FROM g WHERE power(-9 + 2.0 * i - 1.2, 2) + power(-11.25 + 2.5 * j, 2) + power(-20 + 3.0 * k + 17, 2) <= 36", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return V.sphere_probe(v, g, (1.2, 0.0, -17.0), 6).select("idx")


@query("vol_box", f"+{_G} SELECT idx FROM g WHERE i BETWEEN 2 AND 5 AND j BETWEEN 0 AND 3 AND k BETWEEN 0 AND 1", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return V.box(v, g, (2, 0, 0), (5, 3, 1)).select("idx")


@query("vol_reorient", f"+{_G}, m AS (SELECT max(k) + 1 AS nk FROM g) SELECT CAST((nk - 1 - k) + i * nk + j * nk * 10 AS BIGINT) AS idx, value FROM g, m", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return V.reorient(v, g, (2, 0, 1), (True, False, False)).select(F.col("idx").cast("long").alias("idx"), "value")


@query("hidden_by_threshold", "SELECT idx, (value > 950 AND value < 1200) AS hidden FROM vol", "vol")
def _(spark, d):
    return vol(spark, d)[0].select("idx", V.hidden(F.col("value"), 950, 1200).alias("hidden"))


# ------------------------------------------------------------------ reductions
@query("volume_stats", f"SELECT {r('sum(value)')} AS sum, {r('avg(value)')} AS mean, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('min(value)')} AS lo, {r('max(value)')} AS hi, count(value) AS n FROM vol", "vol")
def _(spark, d):
    s = R.volume_stats(vol(spark, d)[0])
    return show(s, "n", **{c: c for c in ("sum", "mean", "min", "max", "lo", "hi")})


@query("volume_median_std", f"SELECT {r('median(value)')} AS median, {r('stddev_samp(value)')} AS std FROM vol", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    both = v.agg(R.REDUCERS["median"](F.col("value")).alias("median"), R.REDUCERS["std"](F.col("value")).alias("std"))
    return show(both, median="median", std="std")


@query("parcel_sums", f"SELECT CASE WHEN grouping(l) = 1 THEN 'total' WHEN l = 0 THEN 'outside' ELSE CAST(l AS VARCHAR) END AS parcel, {r('sum(value)')} AS sum, count(value) AS n FROM (SELECT value, label % 8 AS l FROM vol) GROUP BY GROUPING SETS ((l), ())", "vol")
def _(spark, d):
    v = vol(spark, d)[0].withColumn("label", F.col("label") % 8)
    return show(R.parcel_sums(v), "parcel", "n", sum="sum")


@query("histogram", "+h AS (SELECT CAST(least(floor((value - 900) / 1100 * 72), 71) AS INTEGER) AS bin, count(*) AS n FROM vol WHERE value <> 0 AND value BETWEEN 900 AND 2000 GROUP BY 1) SELECT CAST(b.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(72) b LEFT JOIN h ON h.bin = b.range", "vol")
def _(spark, d):
    return R.histogram(vol(spark, d)[0], 900, 2000)


@query("label_sizes_centers", f"+{_G} SELECT label, count(*) AS size, {r('avg(i)')} AS i, {r('avg(j)')} AS j, {r('avg(k)')} AS k FROM g WHERE label <> 0 GROUP BY label", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(R.cluster_info(g.with_axes(v)), "label", "size", i="i", j="j", k="k")


@query("label_median_centers", f"+{_G} SELECT label, count(*) AS size, {r('median(i)')} AS i, {r('median(j)')} AS j, {r('median(k)')} AS k FROM g WHERE label <> 0 GROUP BY label", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(R.cluster_info(g.with_axes(v), "median"), "label", "size", i="i", j="j", k="k")


@query("tukey_outliers", "+q AS (SELECT label, count(*) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM vol GROUP BY label) SELECT idx, vol.label AS label FROM vol JOIN q ON q.label = vol.label WHERE n >= 4 AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))", "vol")
def _(spark, d):
    return R.tukey_outliers(vol(spark, d)[0], "label").select("idx", "label")


# ------------------------------------------------------------------ joins
@query("align_volumes", "SELECT idx, value, CAST(label AS DOUBLE) AS other FROM vol", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    return J.align(v.select("idx", "value"), other(v))


@query("resource_lookup", "SELECT l_orderkey AS row, l_linenumber AS line, p_name AS locator FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    rows = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("ref"))
    reg = L.table(spark, d, "part").select(F.col("p_partkey").alias("resource_id"), F.col("p_name").alias("locator"))
    return J.resources(rows, reg, "ref").filter("ref is not null").select("row", "line", "locator")


@query("covariate_last_row", "SELECT c_custkey AS subject, arg_max(o_totalprice, o_orderkey) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    s = L.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return J.covariate(s, o, "price", "o_orderkey")


@query("align_by_id", "SELECT a.k AS key, a.p AS source_pos, b.p AS target_pos FROM (SELECT o_custkey AS k, min(o_orderkey) AS p FROM orders GROUP BY 1) a JOIN (SELECT c_custkey AS k, min(c_custkey) AS p FROM customer GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    a = L.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"))
    b = L.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("pos"))
    return J.align_by_id(a, b, "key", "pos")


_REG = "CAST(floor((-9 + 2.0 * i + 9) / 4.0 + 0.5) AS BIGINT) AS a, CAST(floor((-11.25 + 2.5 * j + 11.25) / 5.0 + 0.5) AS BIGINT) AS b, CAST(floor(k / 2.0 + 0.5) AS BIGINT) AS c"


@query("regrid", f"+{_G}, m AS (SELECT (max(k) + 2) // 2 AS nk FROM g), t AS (SELECT {_REG}, m.nk FROM g, m) SELECT DISTINCT a + b * 5 + c * 25 AS idx FROM t WHERE a < 5 AND b < 5 AND c < nk", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    t = Grid((5, 5, (g.dim[2] + 1) // 2), (4.0, 5.0, 6.0), g.origin)
    return J.regrid(v, g, t).select(F.col("idx").cast("long").alias("idx"))


@query("overlay_labels", "+a AS (SELECT idx, CASE WHEN label > 30 THEN 0 ELSE label END AS t, CASE WHEN label % 5 = 0 THEN label // 5 ELSE 0 END AS o FROM vol), s AS (SELECT max(t) + 1 AS off FROM a) SELECT idx, CAST(CASE WHEN o <> 0 THEN o + off ELSE t END AS INTEGER) AS label FROM a, s", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    a = v.select("idx", F.when(F.col("label") > 30, 0).otherwise(F.col("label")).alias("label"))
    b = v.select("idx", F.when(F.col("label") % 5 == 0, F.floor(F.col("label") / 5)).otherwise(0).alias("label"))
    return J.overlay_labels(a, b).select("idx", F.col("label").cast("int").alias("label"))


_PT = "c_custkey, c_acctbal AS weight, -8.987 + CAST(c_custkey * 7 % 200 AS DOUBLE) / 10 AS x, -11.237 + CAST(c_custkey * 13 % 250 AS DOUBLE) / 10 AS y, -19.987 + CAST(c_custkey * 17 % 300 AS DOUBLE) / 10 AS z"


def _points(spark, d):
    c = L.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", F.col("c_acctbal").alias("weight"), (-8.987 + (k * 7 % 200) / 10.0).alias("x"), (-11.237 + (k * 13 % 250) / 10.0).alias("y"), (-19.987 + (k * 17 % 300) / 10.0).alias("z"))


@query("sample_points", f"+p AS (SELECT {_PT} FROM customer), q AS (SELECT c_custkey, floor((x + 9) / 2 + 0.5) AS a, floor((y + 11.25) / 2.5 + 0.5) AS b, floor((z + 20) / 3 + 0.5) AS c FROM p) SELECT c_custkey, value FROM q LEFT JOIN gdim ON true LEFT JOIN vol ON a BETWEEN 0 AND 9 AND b BETWEEN 0 AND 9 AND c BETWEEN 0 AND nz - 1 AND vol.idx = a + b * 10 + c * 100", "vol gdim")
def _(spark, d):
    v, g = vol(spark, d)
    return J.sample_points(_points(spark, d), v.select("idx", "value"), g).select("c_custkey", "value")


# ------------------------------------------------------------------ stencils
_O1 = "o AS (SELECT a.range AS a, b.range AS b, c.range AS c FROM range(-1, 2) a, range(-1, 2) b, range(-1, 2) c)"
_NB = f"+{_G}, {_O1}, nb AS (SELECT g.idx, g.value AS center, o.a, o.b, o.c, n.value FROM g CROSS JOIN o JOIN g n ON n.i = g.i + o.a AND n.j = g.j + o.b AND n.k = g.k + o.c)"
_V = ("idx",)

for _name, _f, _sql in (
    ("stencil_box", lambda v, g: S.filter_kernel(v, g, S.box_kernel(1)), "avg(value)"),
    ("stencil_box_separable", lambda v, g: S.box_mean(v, g, 1), "avg(value)"),
    ("stencil_gaussian", lambda v, g: S.filter_kernel(v, g, S.gaussian_kernel(1.0, 1)), "sum(value * exp(-(a*a+b*b+c*c) / 2.0)) / sum(exp(-(a*a+b*b+c*c) / 2.0))"),
    ("stencil_median", lambda v, g: S.median_filter(v, g, 1), "median(value)"),
    ("stencil_bilateral", lambda v, g: S.bilateral(v, g, 1.0, 20.0, 3), "sum(value * exp(-(a*a+b*b+c*c) / 2.0) * exp(-power(value - center, 2) / 800.0)) / sum(exp(-(a*a+b*b+c*c) / 2.0) * exp(-power(value - center, 2) / 800.0))"),
):

    def _run(spark, d, f=_f):
        v, g = vol(spark, d)
        return show(f(v.select("idx", "value"), g), "idx", value="value")

    query(_name, f"{_NB} SELECT idx, {r(_sql)} AS value FROM nb GROUP BY idx", "vol")(_run)

for _name, _f, _agg in (("stencil_erode", S.erode, "min"), ("stencil_dilate", S.dilate, "max")):

    def _run(spark, d, f=_f):
        v, g = vol(spark, d)
        return f(v.select("idx", "value"), g, 1)

    query(_name, f"{_NB} SELECT idx, {_agg}(value) AS value FROM nb WHERE abs(a) + abs(b) + abs(c) <= 1 GROUP BY idx", "vol")(_run)

_SECOND = "e AS (SELECT idx, idx % 10 AS i, idx // 10 % 10 AS j, idx // 100 AS k, value FROM (SELECT idx, {f}(value) AS value FROM nb WHERE abs(a) + abs(b) + abs(c) <= 1 GROUP BY idx))"
for _name, _f, _one, _two in (("stencil_opening", S.opening, "min", "max"), ("stencil_closing", S.closing, "max", "min")):

    def _run(spark, d, f=_f):
        v, g = vol(spark, d)
        return f(v.select("idx", "value"), g, 1)

    query(_name, f"{_NB}, {_SECOND.format(f=_one)} SELECT x.idx, {_two}(n.value) AS value FROM e x CROSS JOIN o JOIN e n ON n.i = x.i + o.a AND n.j = x.j + o.b AND n.k = x.k + o.c WHERE abs(a) + abs(b) + abs(c) <= 1 GROUP BY x.idx", "vol")(_run)


@query("stencil_laplacian", f"{_NB}, s AS (SELECT idx, sum(CASE WHEN a=0 AND b=0 AND c=0 THEN -6.0 ELSE 1.0 END * value) AS s, sum(CASE WHEN a=0 AND b=0 AND c=0 THEN -6.0 ELSE 1.0 END) AS w FROM nb WHERE abs(a) + abs(b) + abs(c) <= 1 GROUP BY idx) SELECT idx, {r('CASE WHEN abs(w) < 1e-8 THEN s ELSE s / w END')} AS value FROM s", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(S.edges(v.select("idx", "value"), g, "laplacian"), "idx", value="value")


_SOB = "sum(value * {x} * (2 - abs({y})) * (2 - abs({z})))"


@query("stencil_sobel", f"{_NB}, s AS (SELECT idx, {_SOB.format(x='a', y='b', z='c')} AS p, {_SOB.format(x='b', y='a', z='c')} AS q, {_SOB.format(x='c', y='a', z='b')} AS t FROM nb GROUP BY idx) SELECT idx, {r('sqrt(p*p + q*q + t*t)')} AS value FROM s", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(S.edges(v.select("idx", "value"), g), "idx", value="value")


_PASS = "p{n} AS (SELECT x.idx, x.i, x.j, x.k, sum(n.value * exp(-o.range * o.range / 2.0)) / sum(exp(-o.range * o.range / 2.0)) AS value FROM {src} x CROSS JOIN range(-3, 4) o JOIN {src} n ON {on} GROUP BY x.idx, x.i, x.j, x.k)"
_ON = {0: "n.i = x.i + o.range AND n.j = x.j AND n.k = x.k", 1: "n.i = x.i AND n.j = x.j + o.range AND n.k = x.k", 2: "n.i = x.i AND n.j = x.j AND n.k = x.k + o.range"}


@query("gaussian_blur", f"+{_G}, {_PASS.format(n=0, src='g', on=_ON[0])}, {_PASS.format(n=1, src='p0', on=_ON[1])}, {_PASS.format(n=2, src='p1', on=_ON[2])} SELECT idx, {r('value')} AS value FROM p2", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(S.gaussian_blur(v.select("idx", "value"), g, 1.0), "idx", value="value")


_DIF = "d{n} AS (SELECT x.idx, x.i, x.j, x.k, x.value + 0.1 * sum(exp(-power((n.value - x.value) / 30.0, 2)) * (n.value - x.value)) AS value FROM {src} x CROSS JOIN o JOIN {src} n ON n.i = x.i + o.a AND n.j = x.j + o.b AND n.k = x.k + o.c WHERE abs(a) + abs(b) + abs(c) = 1 GROUP BY x.idx, x.i, x.j, x.k, x.value)"


@query("anisotropic_diffusion", f"+{_G}, {_O1}, {_DIF.format(n=1, src='g')}, {_DIF.format(n=2, src='d1')} SELECT idx, {r('value')} AS value FROM d2", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(S.diffuse(v.select("idx", "value"), g, 2), "idx", value="value")


_AVG = "avg({c}) OVER (PARTITION BY {p} ORDER BY {o} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {c}"


def _box_cte(name, src, cols):
    out, prev = [], src
    for n, (p, o) in enumerate((("j, k", "i"), ("i, k", "j"), ("i, j", "k"))):
        out.append(f"{name}{n} AS (SELECT idx, i, j, k, {', '.join(_AVG.format(c=c, p=p, o=o) for c in cols)} FROM {prev})")
        prev = f"{name}{n}"
    return ", ".join(out), prev


_M, _MN = _box_cte("m", "m_in", ("gd", "p", "gg", "gp"))
_N, _NN = _box_cte("n", "n_in", ("a", "b"))


@query("guided_filter", f"+{_G}, m_in AS (SELECT idx, i, j, k, CAST(label AS DOUBLE) AS gd, value AS p, CAST(label * label AS DOUBLE) AS gg, label * value AS gp FROM g), {_M}, n_in AS (SELECT idx, i, j, k, (gp - gd * p) / (gg - gd * gd + 0.5) AS a, p - (gp - gd * p) / (gg - gd * gd + 0.5) * gd AS b FROM {_MN}), {_N} SELECT q.idx, {r('a * label + b')} AS value FROM {_NN} q JOIN g ON g.idx = q.idx", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(S.guided_filter(v.select("idx", "value"), g, 1, 0.5, other(v)), "idx", value="value")


_GSM = "f AS (SELECT idx, i, j, k, value AS p, label FROM g WHERE label > 10), st AS (SELECT avg(label) AS m, stddev_pop(label) AS s FROM f), d AS (SELECT idx, i, j, k, p, (label - m) / s AS gd FROM f, st)"
_NEAR = "CROSS JOIN o JOIN {t} n ON n.i = x.i + o.a AND n.j = x.j + o.b AND n.k = x.k + o.c"


@query("guided_smooth_masked", f"+{_G}, {_O1}, {_GSM}, q AS (SELECT x.idx, x.i, x.j, x.k, avg(n.p) AS mp, avg(n.gd) AS mg, avg(n.gd * n.gd) AS gg, avg(n.gd * n.p) AS gp FROM d x {_NEAR.format(t='d')} GROUP BY 1, 2, 3, 4), ab AS (SELECT *, (gp - mg * mp) / (gg - mg * mg + 0.01) AS a FROM q), m AS (SELECT x.idx, x.gd, avg(n.a) AS a, avg(n.mp - n.a * n.mg) AS b FROM d x {_NEAR.format(t='(SELECT i, j, k, a AS a, mp, mg FROM ab)')} GROUP BY 1, 2) SELECT idx, {r('a * gd + b')} AS value FROM m", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(S.guided_smooth(v.filter("label > 10").select("idx", "value"), g, other(v), 1), "idx", value="value")


@query("masked_box_mean", f"{_NB}, f AS (SELECT idx FROM vol WHERE label > 10), mm AS (SELECT g.idx, avg(n.value) AS m FROM g JOIN f ON f.idx = g.idx CROSS JOIN o JOIN g n ON n.i = g.i + o.a AND n.j = g.j + o.b AND n.k = g.k + o.c WHERE n.label > 10 GROUP BY g.idx) SELECT idx, {r('m')} AS value FROM mm", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(S.masked_box_mean(v.filter("label > 10").select("idx", "value"), g, 1), "idx", value="value")


# ------------------------------------------------------------------ resampling
_T = "t AS (SELECT x.range + y.range * 20 + z.range * 400 AS idx, x.range * 9.0 / 19 AS u, y.range * 9.0 / 19 AS v, CAST(z.range AS DOUBLE) AS w FROM gdim, range(20) x, range(20) y, range(nz) z)"


def _fine(g: Grid) -> Grid:
    return Grid((20, 20, g.dim[2]), (g.spacing[0] * 9 / 19, g.spacing[1] * 9 / 19, g.spacing[2]), g.origin)


@query("resample_nearest", f"+{_T} SELECT t.idx, value FROM t JOIN vol ON vol.idx = floor(u + 0.5) + floor(v + 0.5) * 10 + w * 100", "vol gdim")
def _(spark, d):
    v, g = vol(spark, d)
    return RS.resample(v.select("idx", "value"), g, _fine(g), "nearest")


@query("resample_linear", f"+{_T}, c AS (SELECT t.idx, floor(u) + a.range AS i, floor(v) + b.range AS j, w AS k, (CASE a.range WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END) * (CASE b.range WHEN 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END) AS wt FROM t, range(2) a, range(2) b) SELECT c.idx, {r('sum(wt * coalesce(value, 0.0))')} AS value FROM c LEFT JOIN vol ON i <= 9 AND j <= 9 AND vol.idx = i + j * 10 + k * 100 WHERE wt <> 0 GROUP BY c.idx", "vol gdim")
def _(spark, d):
    v, g = vol(spark, d)
    return show(RS.resample(v.select("idx", "value"), g, _fine(g), "linear"), "idx", value="value")


def _axis_sql(points: str, kind: str) -> str:
    """ax(p, cell, w): taps of points (p, u) on an axis of ten cells; what lies beyond the border is spread over the two outermost cells."""
    x = "abs(u - cell)"
    cubic = f"CASE WHEN {x} < 1 THEN 1.5 * {x} * {x} * {x} - 2.5 * {x} * {x} + 1 WHEN {x} < 2 THEN -0.5 * {x} * {x} * {x} + 2.5 * {x} * {x} - 4 * {x} + 2 ELSE 0 END"
    lanczos = f"CASE WHEN {x} < 1e-9 THEN 1 WHEN {x} < 3 THEN 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / (pi() * pi() * {x} * {x}) ELSE 0 END"
    n = 2 if kind == "cubic" else 3
    return (
        f"{points}, ats AS (SELECT p, u, floor(u) + o.range AS cell FROM pts, range({1 - n}, {n + 1}) o), tap AS (SELECT p, cell, {cubic if kind == 'cubic' else lanczos} AS w FROM ats), "
        "ex AS (SELECT p, cell, w FROM tap WHERE cell BETWEEN 0 AND 9 UNION ALL SELECT p, 0, w * (1 - cell) FROM tap WHERE cell < 0 UNION ALL SELECT p, 1, w * cell FROM tap WHERE cell < 0 "
        "UNION ALL SELECT p, 9, w * (cell - 8) FROM tap WHERE cell > 9 UNION ALL SELECT p, 8, -w * (cell - 9) FROM tap WHERE cell > 9), ax AS (SELECT p, cell, sum(w) AS w FROM ex GROUP BY p, cell)"
    )


for _kind in ("cubic", "lanczos"):

    def _run(spark, d, kind=_kind):
        v, g = vol(spark, d)
        return show(RS.resample(v.select("idx", "value"), g, _fine(g), kind), "idx", value="value")

    query(f"resample_{_kind}", f"+{_G}, {_axis_sql('pts AS (SELECT range AS p, range * 9.0 / 19 AS u FROM range(20))', _kind)} SELECT a.p + b.p * 20 + g.k * 400 AS idx, {r('sum(a.w * b.w * g.value) / sum(a.w * b.w)')} AS value FROM ax a, ax b, g WHERE g.i = a.cell AND g.j = b.cell GROUP BY 1", "vol")(_run)


@query("resample_downsample", f"+{_G}, {_PASS.format(n=0, src='g', on=_ON[0])}, {_PASS.format(n=1, src='p0', on=_ON[1])}, {_PASS.format(n=2, src='p1', on=_ON[2])} SELECT i // 2 + j // 2 * 5 + k // 2 * 25 AS idx, {r('value')} AS value FROM p2 WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    out, _ = RS.downsample(v.select("idx", "value"), g, 2)
    return show(out, "idx", value="value")


@query("transform_translate", f"+{_G} SELECT a.idx, coalesce(b.value, 0.0) AS value FROM g a LEFT JOIN g b ON b.i = a.i - 2 AND b.j = a.j + 1 AND b.k = a.k", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return RS.transform(v.select("idx", "value"), g, RS.rigid_matrix(translation=(2, -1, 0)), "linear")


@query("resample_labels", f"+{_T} SELECT t.idx, label FROM t JOIN vol ON vol.idx = floor(u + 0.5) + floor(v + 0.5) * 10 + w * 100 WHERE label <> 0", "vol gdim")
def _(spark, d):
    v, g = vol(spark, d)
    return RS.resample_labels(v, g, _fine(g))


_SC = f"+p AS (SELECT {_PT} FROM customer), h AS (SELECT g.idx, weight * exp(-(power(-9 + 2.0 * i - x, 2) + power(-11.25 + 2.5 * j - y, 2) + power(-20 + 3.0 * k - z, 2)) / 8.0) AS v FROM p JOIN (SELECT idx, {_IJK} FROM range(1) r, (SELECT unnest(range(nx * ny * nz)) AS idx FROM gdim)) g ON abs(-9 + 2.0 * i - x) <= 6 AND abs(-11.25 + 2.5 * j - y) <= 6 AND abs(-20 + 3.0 * k - z) <= 6 CROSS JOIN gdim WHERE floor((x + 9) / 2 + 0.5) BETWEEN 0 AND 9 AND floor((y + 11.25) / 2.5 + 0.5) BETWEEN 0 AND 9 AND floor((z + 20) / 3 + 0.5) BETWEEN 0 AND nz - 1 AND power(-9 + 2.0 * i - x, 2) + power(-11.25 + 2.5 * j - y, 2) + power(-20 + 3.0 * k - z, 2) <= 36)"
for _how in ("max", "sum"):

    def _run(spark, d, how=_how):
        _, g = vol(spark, d)
        return show(RS.scatter_field(_points(spark, d), g, 2.0, combine=how), "idx", value="value")

    query(f"scatter_{_how}", f"{_SC} SELECT idx, {r(f'{_how}(v)')} AS value FROM h GROUP BY idx", "gdim")(_run)

# ------------------------------------------------------------------ components
_ON_ = "q AS (SELECT idx, i, j, k, CAST(label AS DOUBLE) AS value FROM g WHERE label >= 38)"
_CC = f"RECURSIVE vol AS (SELECT p_partkey AS idx, p_retailprice AS value, p_size AS label FROM part), {_G}, {_ON_}, e AS (SELECT a.idx AS a, b.idx AS b FROM q a JOIN q b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1), walk AS (SELECT idx AS root, idx FROM q UNION SELECT walk.root, e.b FROM walk JOIN e ON e.a = walk.idx), c AS (SELECT idx, min(root) AS root FROM walk GROUP BY idx), s AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root) AS label FROM c GROUP BY root), lab AS (SELECT q.idx, q.i, q.j, q.k, q.value, s.label, s.size FROM q JOIN c ON c.idx = q.idx JOIN s ON s.root = c.root)"


def _clusters(spark, d):
    v, g = vol(spark, d)
    return C.label_components(other(v), g, 38, 6), g


@query("connected_components", f"WITH {_CC} SELECT idx, value, label, size FROM lab")
def _(spark, d):
    c, _ = _clusters(spark, d)
    return c.select("idx", "value", F.col("label").cast("long").alias("label"), "size")


@query("cluster_table", f"WITH {_CC} SELECT label, count(*) AS size, {r('avg(i)')} AS ci, {r('avg(j)')} AS cj, {r('avg(k)')} AS ck, {r('-9 + 2.0 * avg(i)')} AS cx, {r('-11.25 + 2.5 * avg(j)')} AS cy, {r('-20 + 3.0 * avg(k)')} AS cz, max(value) AS peak, arg_min(idx, -value * 1000000 + idx) AS peak_idx, {r('avg(value)')} AS mean FROM lab GROUP BY label")
def _(spark, d):
    c, g = _clusters(spark, d)
    t = C.cluster_table(c, g)
    return show(t, F.col("label").cast("long").alias("label"), "size", "peak", "peak_idx", **{n: n for n in ("ci", "cj", "ck", "cx", "cy", "cz", "mean")})


@query("local_maxima", f"WITH {_CC} SELECT idx, label, value FROM lab a WHERE NOT EXISTS (SELECT 1 FROM lab b WHERE b.label = a.label AND b.idx <> a.idx AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND b.value >= a.value)")
def _(spark, d):
    c, g = _clusters(spark, d)
    return C.local_maxima(c, g).select("idx", F.col("label").cast("long").alias("label"), "value")


_PEAK = "pk AS (SELECT idx, label, -9 + 2.0 * i AS x, -11.25 + 2.5 * j AS y, -20 + 3.0 * k AS z, row_number() OVER (PARTITION BY label ORDER BY value DESC, idx) AS n FROM lab a WHERE NOT EXISTS (SELECT 1 FROM lab b WHERE b.label = a.label AND b.idx <> a.idx AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND b.value >= a.value))"
_THIN = "wk AS (SELECT label, n, [{'x': x, 'y': y, 'z': z, 'idx': idx}] AS kept FROM pk WHERE n = 1 UNION ALL SELECT p.label, p.n, CASE WHEN len(list_filter(kept, lambda q: power(q.x - p.x, 2) + power(q.y - p.y, 2) + power(q.z - p.z, 2) < 36)) = 0 THEN list_append(kept, {'x': p.x, 'y': p.y, 'z': p.z, 'idx': p.idx}) ELSE kept END FROM wk JOIN pk p ON p.label = wk.label AND p.n = wk.n + 1), th AS (SELECT unnest(arg_max(kept, n)).idx AS idx FROM wk GROUP BY label)"


@query("local_maxima_thinned", f"WITH {_CC}, {_PEAK}, {_THIN} SELECT lab.idx, lab.label, lab.value FROM th JOIN lab ON lab.idx = th.idx")
def _(spark, d):
    c, g = _clusters(spark, d)
    return C.local_maxima(c, g, 6.0)


@query("cluster_extent_filter", f"WITH {_CC} SELECT g.idx, CASE WHEN lab.size < 3 THEN 0.0 ELSE CAST(g.label AS DOUBLE) END AS value FROM g LEFT JOIN lab ON lab.idx = g.idx")
def _(spark, d):
    v, g = vol(spark, d)
    return C.extent_filter(other(v), g, 38, 3, 6)


#: seeded centres one after the other, then rounds of means until they stay
_KM = f"""vals AS (SELECT value, count(*) AS n, sum(count(*)) OVER (ORDER BY value) AS cum, sum(count(*)) OVER () AS total FROM vol GROUP BY value),
{draws(1, 4)},
init AS (SELECT 1 AS k, [(SELECT min(value) FROM vals WHERE cum > floor((SELECT u FROM rnd WHERE n = 0) * total))] AS c
    UNION ALL
    SELECT k + 1, list_append(c, v) FROM (SELECT k, c, min(value) AS v FROM (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY value) AS run, sum(w) OVER (PARTITION BY k) AS whole FROM
        (SELECT k, c, value, vals.n * power(list_min(list_transform(c, lambda m: abs(value - m))), 2) AS w FROM init, vals WHERE k < 4)) q JOIN rnd ON rnd.n = q.k WHERE run > u * whole AND w > 0 GROUP BY k, c)),
lloyd AS (SELECT 0 AS step, c FROM init WHERE k = 4
    UNION ALL
    SELECT step + 1, next FROM (SELECT step, c, list(coalesce(m, x) ORDER BY i) AS next FROM (SELECT l.step, l.c, i.range AS i, any_value(l.c[i.range]) AS x, sum(a.value * a.n) / sum(a.n) AS m
        FROM lloyd l CROSS JOIN range(1, 5) i LEFT JOIN (SELECT l2.step, v.value, v.n, list_position(list_transform(l2.c, lambda m: abs(m - v.value)), list_min(list_transform(l2.c, lambda m: abs(v.value - m)))) AS at FROM lloyd l2, vals v) a ON a.at = i.range AND a.step = l.step
        GROUP BY l.step, l.c, i.range) GROUP BY step, c) WHERE next <> c AND step < 100),
fin AS (SELECT arg_max(c, step) AS c FROM lloyd)"""


@query("kmeans_partition", f"WITH RECURSIVE vol AS (SELECT p_partkey AS idx, sqrt(p_retailprice) AS value FROM part), {_KM} SELECT idx, value, CAST(list_position(list_transform(c, lambda m: abs(m - value)), list_min(list_transform(c, lambda m: abs(value - m)))) AS INTEGER) AS label FROM vol, fin")
def _(spark, d):
    """Four groups of root prices, which lie unevenly."""
    return C.kmeans_1d(vol(spark, d)[0].select("idx", F.sqrt("value").alias("value")), 4)


@query("block_partition", f"+{_G}, b AS (SELECT idx, i // 3 AS a, j // 2 AS b, k // 2 AS c FROM g), u AS (SELECT a, b, c, CAST(row_number() OVER (ORDER BY c, b, a) - 1 AS INTEGER) AS block FROM (SELECT DISTINCT a, b, c FROM b)) SELECT idx, block FROM b JOIN u USING (a, b, c)", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return C.block_partition(v, g, 6.0)


# ------------------------------------------------------------------ regions
@query("roi_sphere", f"+{_G} SELECT idx, value FROM g WHERE 4.0*(i-5)*(i-5) + 6.25*(j-5)*(j-5) + 9.0*(k-1)*(k-1) <= 25", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.spherical(v, g, (5, 5, 1), 5.0).select("idx", "value")


@query("roi_square", f"+{_G} SELECT idx, value FROM g WHERE abs(i-5) <= 2 AND abs(j-5) <= 2 AND k = 1", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.square(v, g, (5, 5, 1), 2).select("idx", "value")


@query("roi_centroid", f"+{_G} SELECT {r('avg(-9 + 2.0 * i)')} AS x, {r('avg(-11.25 + 2.5 * j)')} AS y, {r('avg(-20 + 3.0 * k)')} AS z FROM g WHERE label > 20", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(roi.centroid(v.filter("label > 20"), g), x="x", y="y", z="z")


_BALL = "ball AS (SELECT a.range AS a, b.range AS b, c.range AS c FROM range(-3, 4) a, range(-3, 4) b, range(-3, 4) c WHERE 4.0*a.range*a.range + 6.25*b.range*b.range + 9.0*c.range*c.range <= 16)"


@query("searchlight_mean", f"+{_G}, {_BALL} SELECT x.idx AS center, count(*) AS n, {r('avg(n.value)')} AS value FROM g x CROSS JOIN ball JOIN g n ON n.i = x.i + a AND n.j = x.j + b AND n.k = x.k + c WHERE x.label > 20 AND n.label > 20 GROUP BY x.idx", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    lights = roi.searchlights(v.filter("label > 20"), g, 4.0)
    return show(roi.searchlight_stat(lights, v.select("idx", "value")), "center", "n", value="value")


@query("searchlight_clustered", f"+{_G}, {_BALL}, c0 AS (SELECT label, floor(avg(i) + 0.5) AS i, floor(avg(j) + 0.5) AS j, floor(avg(k) + 0.5) AS k FROM g WHERE label > 0 GROUP BY label) SELECT c0.label, n.idx FROM c0 CROSS JOIN ball JOIN g n ON n.i = c0.i + a AND n.j = c0.j + b AND n.k = c0.k + c", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.clustered_searchlights(v, g, 4.0)


@query("searchlight_bootstrap", f"+{_G}, {_BALL}, {draws(1, 20)}, c AS (SELECT n AS draw, floor(u * (SELECT count(*) FROM g)) AS idx FROM rnd) SELECT CAST(draw AS INTEGER) AS draw, n.idx FROM c JOIN g x ON x.idx = c.idx CROSS JOIN ball JOIN g n ON n.i = x.i + a AND n.j = x.j + b AND n.k = x.k + c", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.bootstrap_searchlights(v.select("idx"), g, 4.0, 20)


#: rounds over all cells: those of least priority within two radii become centres and cover what is left around them
_RANDOM = f"""{draws(1, 100000).replace("range(100000) n", "(SELECT idx AS range FROM g) n")},
ofs AS (SELECT a.range AS a, b.range AS b, c.range AS c, 4.0 * a.range * a.range + 6.25 * b.range * b.range + 9.0 * c.range * c.range AS d FROM range(-4, 5) a, range(-4, 5) b, range(-4, 5) c),
near AS MATERIALIZED (SELECT x.idx AS a, y.idx AS b, o.d FROM g x CROSS JOIN ofs o JOIN g y ON y.i = x.i + o.a AND y.j = x.j + o.b AND y.k = x.k + o.c WHERE o.d <= 64),
s AS (SELECT 0 AS step, idx, CAST(NULL AS BIGINT) AS center FROM g
    UNION ALL
    SELECT s.step + 1, s.idx, coalesce(s.center, v.center) FROM s LEFT JOIN (
        SELECT n.b AS idx, min(ch.idx) AS center FROM (
            SELECT x.a AS idx FROM near x JOIN s m ON m.idx = x.a AND m.center IS NULL JOIN s l ON l.idx = x.b AND l.center IS NULL JOIN rnd r ON r.n = x.b GROUP BY x.a HAVING min(struct_pack(u := r.u, i := x.b)).i = x.a) ch
        JOIN near n ON n.a = ch.idx AND n.d <= 16 JOIN s f ON f.idx = n.b AND f.center IS NULL GROUP BY n.b) v ON v.idx = s.idx
    WHERE EXISTS (SELECT 1 FROM s WHERE center IS NULL))"""


@query("searchlight_random", f"WITH RECURSIVE {L.SQL['vol']}, {_G}, {_RANDOM} SELECT center, idx FROM s WHERE step = (SELECT max(step) FROM s)")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.random_searchlights(v.select("idx"), g, 4.0)
