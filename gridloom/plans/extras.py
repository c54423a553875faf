"""More queries: scalar helpers, sparse and stacked layouts, point samples, reviews, image bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gridloom import layout as L
from gridloom.functions import stats as ST
from gridloom.num import clamp
from gridloom.operators import components as C
from gridloom.operators import reduce as R
from gridloom.operators import resample as RS
from gridloom.operators import roi
from gridloom.operators import setstats as SS
from gridloom.operators import temporal as T
from gridloom.operators import volume as V
from gridloom.plans.registry import query, r, show
from gridloom.plans.sets import _GM, group_maps, stack
from gridloom.plans.volumes import _CC, _G, _axis_sql, _points, other, vol
from gridloom.sources import nifti


@query("scalar_helpers", f"SELECT idx, {r('least(greatest(value, 950), 1500)')} AS clamped, {r('power(least(greatest((value - 900) / 600, 0), 1), 2) * (3 - 2 * least(greatest((value - 900) / 600, 0), 1))')} AS smooth, {r('value + (label - value) * 0.25')} AS mixed, abs(value - 1000) <= 5 AS near FROM vol", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    x, y = F.col("value"), F.col("label").cast("double")
    e = v.select("idx", clamp(x, 950.0, 1500.0).alias("clamped"), ST.smoothstep(x, 900.0, 1500.0).alias("smooth"), ST.lerp(x, y, F.lit(0.25)).alias("mixed"), ST.nearly_equal(x, F.lit(1000.0), 5.0).alias("near"))
    return show(e, "idx", "near", clamped="clamped", smooth="smooth", mixed="mixed")


@query("color_lookup", "SELECT idx, CAST(floor(least(greatest((value - 900) / 1000, 0), 1) * 3) AS DOUBLE) / 10 AS red FROM vol", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    return v.select("idx", V.color(F.col("value"), [(0.0, 0, 0, 1), (0.1, 0, 0, 1), (0.2, 0, 0, 1), (0.3, 0, 0, 1)], 900.0, 1900.0)[0].alias("red"))


@query("sparsity", f"SELECT count(*) FILTER (label > 40) AS stored, {r('count(*) FILTER (label > 40) / CAST(count(*) AS DOUBLE)')} AS ratio FROM vol", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(R.sparsity(v.filter("label > 40"), g.size), "stored", ratio="ratio")


@query("stack_volumes", "SELECT idx, 0 AS t, value FROM vol UNION ALL SELECT idx, 1, CAST(label AS DOUBLE) FROM vol UNION ALL SELECT idx, 2, -value FROM vol", "vol")
def _(spark, d):
    v = vol(spark, d)[0]
    return T.stack([v, other(v), V.negate(v)])


@query("series_at_cells", "+c AS (SELECT DISTINCT idx FROM series WHERE idx % 2 = 0 UNION ALL SELECT -1) SELECT c.idx, CAST(t.range AS INTEGER) AS t, coalesce(value, 0.0) AS value FROM c CROSS JOIN range(30) t LEFT JOIN series s ON s.idx = c.idx AND s.t = t.range", "series")
def _(spark, d):
    s = L.series(spark, d)
    cells = s.select("idx").distinct().filter("idx % 2 = 0").union(spark.range(1).select(F.lit(-1).cast("long")))
    return T.series_at(s, cells)


for _name, _sql in (("mean", "avg(value)"), ("sd", "stddev_samp(value)"), ("t", "avg(value) / (stddev_samp(value) / sqrt(count(value)))")):

    def _run(spark, d, name=_name):
        return show(R.review(stack(spark, d), name), "pos", value="value")

    query(f"set_review_{_name}", f"SELECT pos, {r(_sql)} AS value FROM members GROUP BY pos", "members")(_run)


@query("set_review_consistency", f"+m AS (SELECT pos, avg(value) AS m, count(*) AS n, count(*) FILTER (value > 0) AS u, count(*) FILTER (value < 0) AS l FROM members GROUP BY pos) SELECT pos, {r('(CASE WHEN m > 0 THEN u WHEN m < 0 THEN l ELSE 0 END) / CAST(n AS DOUBLE)')} AS value FROM m", "members")
def _(spark, d):
    return show(R.review(stack(spark, d), "consistency"), "pos", value="value")


@query("component_at_cell", f"WITH {_CC} SELECT idx, value FROM lab WHERE label = (SELECT label FROM lab WHERE idx = (SELECT min(idx) FROM lab WHERE label = 1))")
def _(spark, d):
    v, g = vol(spark, d)
    c = C.label_components(other(v), g, 38, 6)
    seed = c.filter("label = 1").agg(F.min("idx")).first()[0]
    return C.component_at(other(v), g, seed, 38, 6).select("idx", "value")


@query("roi_features", "SELECT idx, count(*) AS n, round(sum(value), 6) AS total FROM series GROUP BY idx", "series")
def _(spark, d):
    s = L.series(spark, d)
    f = roi.features(s.select("idx").distinct(), s)
    return f.select("idx", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda a, b: a + b).alias("total")).withColumn("total", F.round("total", 6))


@query("searchlight_sizes", f"+{_G}, s AS (SELECT a.range AS a, b.range AS b, c.range AS c FROM range(-1, 2) a, range(-1, 2) b, range(-1, 2) c WHERE 4.0*a.range*a.range + 6.25*b.range*b.range + 9.0*c.range*c.range <= 9) SELECT g.idx AS center, count(*) AS n FROM g CROSS JOIN s JOIN g n ON n.i = g.i + a AND n.j = g.j + b AND n.k = g.k + c GROUP BY g.idx", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return roi.searchlights(v, g, 3.0, nonzero=False).groupBy("center").agg(F.count(F.lit(1)).alias("n"))


_PAIR = "first AS (SELECT member, value FROM gm WHERE pos = 0), pr AS (SELECT a.member AS i, b.member AS j, 1 - corr(a.value, b.value) AS d, any_value(abs(x.value - y.value)) AS e FROM gm a JOIN gm b ON a.pos = b.pos AND a.member <> b.member JOIN first x ON x.member = a.member JOIN first y ON y.member = b.member GROUP BY 1, 2)"


@query("neighbour_preservation", f"+{_GM}, {_PAIR}, n AS (SELECT i, rank() OVER (PARTITION BY i ORDER BY d) AS p, rank() OVER (PARTITION BY i ORDER BY e) AS q FROM pr) SELECT i, {r('count(*) FILTER (q <= 3) / CAST(count(*) AS DOUBLE)')} AS kept FROM n WHERE p <= 3 GROUP BY i", "members")
def _(spark, d):
    """Neighbours by correlation that are neighbours by the difference in one cell."""
    g = group_maps(spark, d)
    p = SS.correlation_matrix(g).select(F.col("a").alias("i"), F.col("b").alias("j"), (1 - F.col("r")).alias("d"))
    one = g.filter("pos = 0").select("member", "value")
    near = p.join(one.select(F.col("member").alias("i"), F.col("value").alias("x")), "i").join(one.select(F.col("member").alias("j"), F.col("value").alias("y")), "j")
    return show(SS.neighbour_preservation(p, near.select("i", "j", F.abs(F.col("x") - F.col("y")).alias("d")), 3), "i", kept="kept")


@query("noise_member_count", "SELECT count(DISTINCT grp) + 1 AS members, (count(DISTINCT grp) + 1) * 64 AS cells FROM members", "members")
def _(spark, d):
    n = SS.noise_member(SS.standardize(group_maps(spark, d)), 3)
    return n.agg(F.count_distinct("member").alias("members"), F.count("value").alias("cells"))


@query("upsample_plane", f"+{_G}, {_axis_sql('pts AS (SELECT range AS p, least(range / 3.0, 9) AS u FROM range(30))', 'cubic')}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM g WHERE k = 1), c AS (SELECT b.p AS row, a.p AS col, sum(a.w * b.w * g.value) / sum(a.w * b.w) AS v FROM ax a, ax b, g WHERE g.i = a.cell AND g.j = b.cell AND g.k = 1 GROUP BY 1, 2) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, {r('least(greatest(v, lo), hi)')} AS value FROM c, m", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    return show(RS.upsample_plane(V.slice_of(v, g, 2, 1), 10, 10, 3, True), "row", "col", value="value")


@query("interpolate_points", f"+{_G}, p AS (SELECT c_custkey AS idx, c_custkey % 9 + 0.25 AS x, c_custkey % 8 + 0.5 AS y, CAST(c_custkey % 2 AS DOUBLE) AS z FROM customer), c AS (SELECT p.idx, floor(x) + a.range AS i, floor(y) + b.range AS j, z AS k, abs(1 - a.range - 0.25) * 0.5 AS w FROM p, range(2) a, range(2) b) SELECT c.idx, {r('sum(w * value)')} AS value FROM c JOIN g ON g.i = c.i AND g.j = c.j AND g.k = c.k GROUP BY c.idx", "vol")
def _(spark, d):
    v, g = vol(spark, d)
    k = F.col("c_custkey")
    pts = _points(spark, d).select(k.alias("idx"), (k % 9 + 0.25).alias("x"), (k % 8 + 0.5).alias("y"), (k % 2).cast("double").alias("z"))
    return show(RS.interpolate(v.select("idx", "value"), g, pts, "linear"), "idx", value="value")


@query("image_round_trip", f"SELECT idx, {r('CAST(value AS FLOAT)')} AS value FROM vol", "vol")
def _(spark, d):
    v, g = vol(spark, d)

    def back(frames):
        for pdf in frames:
            for raw in pdf["content"]:
                data = nifti.decode(raw)[1][0]
                yield pd.DataFrame({"idx": range(len(data)), "value": data.astype(float)})

    files = nifti.encoded(v.select("idx", "value").withColumn("file", F.lit(1)), g, "file", gz=True)
    return show(files.select("content").mapInPandas(back, "idx long, value double"), "idx", value="value")


@query("clamp_to_integers", "SELECT idx, CAST(greatest(-128, least(127, floor(value - 1000 + 0.5))) AS BIGINT) AS value FROM vol", "vol")
def _(spark, d):
    return vol(spark, d)[0].select("idx", nifti.round_clamp_column(F.col("value") - 1000, -128, 127).alias("value"))
