"""Queries on sets of maps, series, named dimensions and designs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom import layout as L
from gridloom.functions import stats as ST
from gridloom.functions import text as TX
from gridloom.operators import design as D
from gridloom.operators import embed as E
from gridloom.operators import joins as J
from gridloom.operators import reduce as R
from gridloom.operators import setstats as SS
from gridloom.operators import temporal as T
from gridloom.plans.registry import draws, query, r, show, t_inside, t_table
from gridloom.plans.spec import PlotSpec, build_scene, infer_spec
from gridloom.sources import summary as SU
from gridloom.streaming import moments as ST_M


def stack(spark, d) -> DataFrame:
    return L.members(spark, d).withColumnRenamed("member", "subject")


# ------------------------------------------------------------------ subject stacks
@query("set_one_sample_t", f"SELECT pos, count(value) AS count, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd, {r('avg(value) / stddev_samp(value)')} AS effect, {r('avg(value) / (stddev_samp(value) / sqrt(count(value)))')} AS t FROM members GROUP BY pos", "members")
def _(spark, d):
    return show(R.group_maps(R.sufficient(stack(spark, d))), "pos", "count", mean="mean", sd="sd", effect="effect", t="t")


@query("set_welch_t", f"+a AS (SELECT pos, count(*) FILTER (grp < 5) AS na, count(*) FILTER (grp >= 5) AS nb, avg(value) FILTER (grp < 5) AS ma, avg(value) FILTER (grp >= 5) AS mb, var_samp(value) FILTER (grp < 5) AS va, var_samp(value) FILTER (grp >= 5) AS vb FROM members GROUP BY pos) SELECT pos, {r('ma - mb')} AS diff, {r('(ma - mb) / sqrt(va / na + vb / nb)')} AS t FROM a", "members")
def _(spark, d):
    return show(R.two_groups(stack(spark, d), F.col("grp") < 5, F.col("grp") >= 5), "pos", diff="diff", t="t")


@query("set_paired_t", f"+p AS (SELECT a.pos AS pos, a.value - b.value AS v FROM members a JOIN members b ON b.pos = a.pos AND b.member = a.member + 1 WHERE a.member % 2 = 0) SELECT pos, count(*) AS count, {r('avg(v)')} AS mean, {r('avg(v) / (stddev_samp(v) / sqrt(count(*)))')} AS t FROM p GROUP BY pos", "members")
def _(spark, d):
    s = stack(spark, d)
    a = s.filter("subject % 2 = 0")
    b = s.filter("subject % 2 = 1").withColumn("subject", F.col("subject") - 1)
    return show(R.group_maps(R.sufficient(R.paired_difference(a, b))), "pos", "count", mean="mean", t="t")


@query("set_consistency", f"+m AS (SELECT pos, avg(value) AS m, count(*) AS n, count(*) FILTER (value > 0.1) AS u, count(*) FILTER (value < -0.1) AS l FROM members GROUP BY pos) SELECT pos, {r('(CASE WHEN m > 0 THEN u WHEN m < 0 THEN l ELSE 0 END) / CAST(n AS DOUBLE)')} AS value FROM m", "members")
def _(spark, d):
    return show(R.consistency(stack(spark, d), 0.1, "proportion"), "pos", value="value")


@query("set_leave_one_out", f"+s AS (SELECT pos, sum(value) AS s, sum(value * value) AS q, count(*) AS n FROM members GROUP BY pos) SELECT member AS subject, m.pos, n - 1 AS loo_count, {r('(s - value) / (n - 1)')} AS loo_mean, {r('(q - value * value) - power(s - value, 2) / (n - 1)')} AS loo_m2 FROM members m JOIN s ON s.pos = m.pos", "members")
def _(spark, d):
    return show(R.leave_one_out(stack(spark, d)), "subject", "pos", "loo_count", loo_mean="loo_mean", loo_m2="loo_m2")


@query("set_prevalence", f"SELECT pos, {r('(count(*) FILTER (value > 0.1) - count(*) FILTER (value < -0.1)) / CAST(count(*) AS DOUBLE)')} AS value FROM members GROUP BY pos", "members")
def _(spark, d):
    return show(R.prevalence(stack(spark, d), 0.1), "pos", value="value")


@query("set_review_subjects", f"SELECT pos, {r('avg(value) / stddev_samp(value)')} AS value FROM members WHERE grp IN (1, 2, 3) GROUP BY pos", "members")
def _(spark, d):
    return show(R.review(stack(spark, d), "effect", [1, 2, 3], "grp"), "pos", value="value")


@query("set_downdate", f"SELECT pos, count(*) AS count, {r('avg(value)')} AS mean, {r('var_pop(value) * count(*)')} AS m2 FROM members WHERE grp <> 3 GROUP BY pos", "members")
def _(spark, d):
    s = stack(spark, d)
    return show(ST_M.merge_moments(R.sufficient(s), R.sufficient(s.filter("grp = 3")), sign=-1), "pos", "count", mean="mean", m2="m2")


@query("set_mask", "SELECT pos FROM members GROUP BY pos HAVING bool_or(value <> 0)", "members")
def _(spark, d):
    return R.mask_of_members(L.members(spark, d))


@query("set_where_levels", "+m AS (SELECT vec_id AS member, label FROM embeddings) SELECT label, min(member) AS first, CAST(row_number() OVER (ORDER BY min(member)) - 1 AS INTEGER) AS ord FROM m GROUP BY label", "members")
def _(spark, d):
    m = L.table(spark, d, "embeddings").select(F.col("vec_id").alias("member"), "label")
    return J.first_seen_levels(m, "label", "member")


# ------------------------------------------------------------------ maps of groups (10 members)
_GM = "gm AS (SELECT grp AS member, pos, avg(value) AS value FROM members GROUP BY grp, pos)"
_Z = "z AS (SELECT member, pos, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM gm WINDOW w AS (PARTITION BY member))"


def group_maps(spark, d) -> DataFrame:
    return L.members(spark, d).groupBy(F.col("grp").alias("member"), "pos").agg(F.avg("value").alias("value"))


def _labels(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("pos"), F.floor(F.col("id") / 16).cast("int").alias("label"))


_LAB = "lab AS (SELECT CAST(range AS INTEGER) AS pos, CAST(range // 16 AS INTEGER) AS label FROM range(64))"


@query("zscore_members", f"SELECT member, pos, {r('(value - avg(value) OVER (PARTITION BY member)) / stddev_samp(value) OVER (PARTITION BY member)')} AS value FROM members", "members")
def _(spark, d):
    return show(SS.zscore_members(L.members(spark, d)), "member", "pos", value="value")


@query("standardize", f"SELECT member, pos, {r('(value - avg(value) OVER (PARTITION BY member)) / stddev_pop(value) OVER (PARTITION BY member)')} AS value FROM members", "members")
def _(spark, d):
    return show(SS.standardize(L.members(spark, d)), "member", "pos", value="value")


@query("robust_z", f"+a AS (SELECT member, pos, value, median(value) OVER (PARTITION BY member) AS med FROM members), b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY member) AS mad FROM a) SELECT member, pos, {r('CASE WHEN mad > 0 THEN (value - med) / (1.4826 * mad) ELSE 0 END')} AS value FROM b", "members")
def _(spark, d):
    return show(SS.robust_z(L.members(spark, d), "member"), "member", "pos", value="value")


@query("loo_similarity", f"+s AS (SELECT member, value, (sum(value) OVER (PARTITION BY pos) - value) / (count(*) OVER (PARTITION BY pos) - 1) AS o FROM members) SELECT member, {r('corr(value, o)')} AS r, {r('sqrt(avg(power(value - o, 2)))')} AS rms FROM s GROUP BY member", "members")
def _(spark, d):
    return show(SS.loo_similarity(L.members(spark, d)), "member", r="r", rms="rms")


@query("correlation_matrix", f"+{_GM} SELECT a.member AS a, b.member AS b, {r('corr(a.value, b.value)')} AS r FROM gm a JOIN gm b ON a.pos = b.pos AND a.member < b.member GROUP BY 1, 2", "members")
def _(spark, d):
    return show(SS.correlation_matrix(group_maps(spark, d)), "a", "b", r="r")


@query("similarity_basis", f"+{_GM} SELECT a.member AS a, b.member AS b, {r('corr(a.value, b.value)')} AS r, {r('1 - corr(a.value, b.value)')} AS distance FROM gm a JOIN gm b ON a.pos = b.pos AND a.member < b.member GROUP BY 1, 2", "members")
def _(spark, d):
    _, _, pairs = SS.basis(group_maps(spark, d))
    return show(pairs, "a", "b", r="r", distance="distance")


_EXC = "v AS (SELECT member, CASE WHEN member = 0 THEN NULL WHEN member = 1 THEN 3.0 WHEN member = 2 AND pos < 20 THEN NULL ELSE value END AS value FROM gm), n AS (SELECT member, count(value) AS n, var_pop(value) AS v FROM v GROUP BY member), m AS (SELECT median(n) AS m FROM n WHERE n > 0)"


@query("similarity_exclusions", f"+{_GM}, {_EXC} SELECT member, CASE WHEN n = 0 THEN 'all-missing' WHEN n < 0.9 * m THEN 'low-coverage' ELSE 'constant' END AS reason FROM n, m WHERE n = 0 OR n < 0.9 * m OR v = 0", "members")
def _(spark, d):
    g = group_maps(spark, d)
    nan = F.lit(float("nan"))
    v = F.when(F.col("member") == 0, nan).when(F.col("member") == 1, 3.0).when((F.col("member") == 2) & (F.col("pos") < 20), nan).otherwise(F.col("value"))
    out, _, _ = SS.basis(g.withColumn("value", v))
    return out.select("member", "reason")


@query("pair_contributions", f"+{_GM}, {_Z} SELECT a.pos, {r('a.value * b.value / 64')} AS c FROM z a JOIN z b ON a.pos = b.pos WHERE a.member = 0 AND b.member = 1", "members")
def _(spark, d):
    return show(SS.pair_contributions(SS.standardize(group_maps(spark, d)), 0, 1, 64), "pos", c="c")


@query("pair_contribution_sums", f"+{_GM}, {_Z}, c AS (SELECT a.value * b.value / 64 AS c FROM z a JOIN z b ON a.pos = b.pos WHERE a.member = 0 AND b.member = 1) SELECT {r('sum(c)')} AS total, {r('sum(c) FILTER (c > 0)')} AS positive, {r('sum(c) FILTER (c < 0)')} AS negative FROM c", "members")
def _(spark, d):
    return show(SS.sum_over(SS.pair_contributions(SS.standardize(group_maps(spark, d)), 0, 1, 64)), total="total", positive="positive", negative="negative")


@query("dispersion_terms", f"+{_GM}, {_Z} SELECT pos, {r('count(*) * count(*) / 128.0 * var_pop(value)')} AS d FROM z GROUP BY pos", "members")
def _(spark, d):
    return show(SS.dispersion(SS.standardize(group_maps(spark, d)), 64), "pos", d="d")


@query("focused_terms", f"+{_GM}, {_Z}, f AS (SELECT pos, max(value) FILTER (member = 3) AS x, avg(value) FILTER (member <> 3) AS m, var_pop(value) FILTER (member <> 3) AS v FROM z GROUP BY pos) SELECT pos, {r('power(x - m, 2) / 128.0')} AS own, {r('v / 128.0')} AS baseline FROM f", "members")
def _(spark, d):
    return show(SS.focused(SS.standardize(group_maps(spark, d)), 3, 64), "pos", own="own", baseline="baseline")


_FT = f"+{_GM}, {_Z}, s AS (SELECT member, pos, value, (sum(value) OVER p - value) / 9 AS m, (sum(value * value) OVER p - value * value) / 9 AS q FROM z WINDOW p AS (PARTITION BY pos)), ft AS (SELECT member, pos, (power(value - m, 2) + q - m * m) / 128.0 AS term FROM s)"


@query("focused_terms_all", f"{_FT} SELECT member, pos, {r('term')} AS term FROM ft", "members")
def _(spark, d):
    return show(SS.focused_all(SS.standardize(group_maps(spark, d)), 64), "member", "pos", term="term")


_SHARE = f"{_FT}, {_LAB}, sh AS (SELECT member, label, sum(term) AS v, sum(sum(term)) OVER (PARTITION BY member) AS total FROM ft JOIN lab ON lab.pos = ft.pos GROUP BY member, label), shares AS (SELECT member, label, v / total AS share FROM sh WHERE label <> 0)"


def _shares(spark, d):
    z = SS.focused_all(SS.standardize(group_maps(spark, d)), 64).withColumnRenamed("term", "value")
    return R.focused_shares(z, _labels(spark))


@query("focused_share_table", f"{_SHARE} SELECT member, label, {r('share')} AS share FROM shares", "members")
def _(spark, d):
    return show(_shares(spark, d), "member", "label", share="share")


@query("focused_excess", f"{_SHARE}, md AS (SELECT label, median(share) AS med FROM shares GROUP BY label) SELECT s.label, {r('share')} AS share, {r('share / med')} AS excess, CAST(rank() OVER (ORDER BY share / med DESC) AS INTEGER) AS rank FROM shares s JOIN md ON md.label = s.label WHERE member = 4", "members")
def _(spark, d):
    return show(SS.focused_excess(_shares(spark, d), 4), "label", "rank", share="share", excess="excess")


@query("group_terms", f"+{_GM}, {_Z}, g AS (SELECT pos, avg(value) FILTER (member < 4) AS x, avg(value) FILTER (member > 6) AS y, var_pop(value) FILTER (member < 4) AS vx, var_pop(value) FILTER (member > 6) AS vy FROM z GROUP BY pos) SELECT pos, {r('power(x - y, 2) / 128.0')} AS between, {r('vx / 128.0')} AS within_a, {r('vy / 128.0')} AS within_b FROM g", "members")
def _(spark, d):
    return show(SS.group_terms(SS.standardize(group_maps(spark, d)), F.col("member") < 4, F.col("member") > 6, 64), "pos", between="between", within_a="within_a", within_b="within_b")


_BS = "bs AS (SELECT grp AS member, pos, avg(value) AS beta, stddev_samp(value) / sqrt(count(*)) AS se FROM members GROUP BY grp, pos)"


def _beta(spark, d):
    x = F.col("value")
    return L.members(spark, d).groupBy(F.col("grp").alias("member"), "pos").agg(F.avg(x).alias("beta"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"))


@query("noise_floor", f"+{_BS}, v AS (SELECT pos, se * se / var_pop(beta) OVER (PARTITION BY member) AS f FROM bs) SELECT pos, {r('sum(f) * 9 / 128.0')} AS floor FROM v GROUP BY pos", "members")
def _(spark, d):
    return show(SS.noise_floor(_beta(spark, d), 10, 64), "pos", floor="floor")


@query("heterogeneity", f"+{_BS}, {_LAB}, a AS (SELECT label, count(*) AS k, sum(1 / (se * se)) AS w, sum(beta / (se * se)) AS wb, sum(beta * beta / (se * se)) AS wbb, sum(1 / power(se, 4)) AS ww FROM bs JOIN lab ON lab.pos = bs.pos GROUP BY label), q AS (SELECT *, greatest(wbb - wb * wb / w, 0) AS q, k - 1 AS df FROM a) SELECT label, k, {r('q')} AS q, df, {r('CASE WHEN q > 0 THEN greatest(0, (q - df) / q) ELSE 0 END')} AS i2, {r('greatest(0, (q - df) / (w - ww / w))')} AS tau2 FROM q", "members")
def _(spark, d):
    return show(R.heterogeneity(_beta(spark, d).join(_labels(spark), "pos"), "label"), "label", "k", "df", q="q", i2="i2", tau2="tau2")


@query("reliability", f"+{_BS} SELECT member, {r('1 - avg(se * se) / var_pop(beta)')} AS reliability FROM bs GROUP BY member", "members")
def _(spark, d):
    return show(R.reliability(_beta(spark, d), "member"), "member", reliability="reliability")


@query("corrected_similarity", f"+{_BS}, rel AS (SELECT member, 1 - avg(se * se) / var_pop(beta) AS rho FROM bs GROUP BY member), p AS (SELECT a.member AS a, b.member AS b, corr(a.beta, b.beta) AS r FROM bs a JOIN bs b ON a.pos = b.pos AND a.member < b.member GROUP BY 1, 2) SELECT a, b, {r('CASE WHEN x.rho >= 0.01 AND y.rho >= 0.01 THEN greatest(-1, least(1, r / sqrt(x.rho * y.rho))) END')} AS corrected FROM p JOIN rel x ON x.member = a JOIN rel y ON y.member = b", "members")
def _(spark, d):
    b = _beta(spark, d)
    rel = R.reliability(b, "member")
    p = SS.correlation_matrix(b.withColumnRenamed("beta", "value"))
    j = p.join(rel.select(F.col("member").alias("a"), F.col("reliability").alias("ra")), "a").join(rel.select(F.col("member").alias("b"), F.col("reliability").alias("rb")), "b")
    return show(j.select("a", "b", SS.corrected_r(F.col("r"), F.col("ra"), F.col("rb"), 0.01).alias("corrected")), "a", "b", corrected="corrected")


_PM = f"+{_GM}, {_Z}, {_LAB}, pm AS (SELECT label, a.member AS a, b.member AS b, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * b.value) AS sxy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy FROM z a JOIN z b ON a.pos = b.pos AND a.member < b.member JOIN lab ON lab.pos = a.pos GROUP BY 1, 2, 3)"


@query("parcel_moments", f"{_PM} SELECT label, a, b, n, {', '.join(f'{r(c)} AS {c}' for c in ('sx', 'sy', 'sxy', 'sxx', 'syy'))} FROM pm", "members")
def _(spark, d):
    m = SS.parcel_moments(SS.standardize(group_maps(spark, d)), _labels(spark))
    return show(m, "label", "a", "b", "n", **{c: c for c in ("sx", "sy", "sxy", "sxx", "syy")})


@query("parcel_influence", f"{_PM}, t AS (SELECT label, a, b, " + ", ".join(f"sum({c}) OVER w - {c} AS {c}, sum({c}) OVER w AS t{c}" for c in ("n", "sx", "sy", "sxy", "sxx", "syy")) + f" FROM pm WINDOW w AS (PARTITION BY a, b)) SELECT label, a, b, {r('1 - (tsxy - tsx * tsy / tn) / sqrt((tsxx - tsx * tsx / tn) * (tsyy - tsy * tsy / tn))')} AS full, {r('1 - (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))')} AS reduced FROM t", "members")
def _(spark, d):
    m = SS.parcel_moments(SS.standardize(group_maps(spark, d)), _labels(spark))
    return show(SS.parcel_influence(m), "label", "a", "b", full="full", reduced="reduced")


_INF = f"{_PM}, t AS (SELECT label, a, b, " + ", ".join(f"sum({c}) OVER w - {c} AS {c}, sum({c}) OVER w AS t{c}" for c in ("n", "sx", "sy", "sxy", "sxx", "syy")) + " FROM pm WINDOW w AS (PARTITION BY a, b)), f AS (SELECT label, 1 - (tsxy - tsx * tsy / tn) / sqrt((tsxx - tsx * tsx / tn) * (tsyy - tsy * tsy / tn)) AS u, 1 - (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS v FROM t)"


@query("parcel_influence_summary", f"{_INF} SELECT label, {r('corr(u, v)')} AS mantel, {r('avg(abs(u - v))')} AS change FROM f GROUP BY label", "members")
def _(spark, d):
    m = SS.parcel_moments(SS.standardize(group_maps(spark, d)), _labels(spark))
    return show(SS.influence_summary(SS.parcel_influence(m)), "label", mantel="mantel", change="change")


_BW = f"{draws(10, 4)}, bw AS (SELECT b.range AS label, rep, count(*) FILTER (floor(u * 4) = b.range) AS w FROM rnd, range(4) b GROUP BY 1, 2)"


@query("bootstrap_block_weights", f"WITH {_BW} SELECT CAST(label AS INTEGER) AS label, CAST(rep AS INTEGER) AS rep, CAST(w AS INTEGER) AS w FROM bw")
def _(spark, d):
    return SS.bootstrap_weights(spark, 4, 10)


_BD = ", ".join(f"sum({c} * w) AS {c}" for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))


@query("bootstrap_distances", f"{_PM}, {_BW}, bd AS (SELECT rep, a, b, {_BD} FROM pm JOIN bw ON bw.label = pm.label GROUP BY 1, 2, 3) SELECT CAST(rep AS INTEGER) AS rep, a, b, {r('1 - (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))')} AS distance FROM bd", "members")
def _(spark, d):
    m = SS.parcel_moments(SS.standardize(group_maps(spark, d)), _labels(spark))
    return show(SS.moment_distances(m, SS.bootstrap_weights(spark, 4, 10)), "rep", "a", "b", distance="distance")


_SWAP = "[CASE k WHEN i + 1 THEN l[CAST(floor(u * (i + 1)) AS BIGINT) + 1] WHEN CAST(floor(u * (i + 1)) AS BIGINT) + 1 THEN l[i + 1] ELSE l[k] END FOR k IN range(1, 11)]"
_SPL = f"{draws(20, 9)}, sh AS (SELECT range AS rep, 9::BIGINT AS i, range(10) AS l FROM range(20) UNION ALL SELECT sh.rep, i - 1, {_SWAP} FROM sh JOIN rnd ON rnd.rep = sh.rep AND n = 9 - i WHERE i > 0), sp AS (SELECT rep, unnest(l) AS member, unnest(range(10)) AS spot FROM sh WHERE i = 0)"
_SPR = "xy AS (SELECT rep, pos, avg(value) FILTER (spot < 4) AS x, avg(value) FILTER (spot >= 4 AND spot < 8) AS y FROM z JOIN sp ON sp.member = z.member GROUP BY 1, 2), ps AS (SELECT rep, label, sum(power(x - y, 2) / 128.0) AS s FROM xy JOIN lab ON lab.pos = xy.pos GROUP BY 1, 2), rk AS (SELECT rep, s, row_number() OVER (PARTITION BY rep ORDER BY s DESC, label) AS n, sum(s) OVER (PARTITION BY rep) AS total FROM ps)"


@query("random_splits", f"WITH RECURSIVE {_SPL} SELECT CAST(rep AS INTEGER) AS rep, member, CASE WHEN spot < 4 THEN 'a' ELSE 'b' END AS side FROM sp WHERE spot < 8")
def _(spark, d):
    return SS.random_splits(spark, list(range(10)), 4, 4, 20)


@query("random_split_reference", f"WITH RECURSIVE {L.SQL['members']}, {_GM}, {_Z}, {_LAB}, {_SPL}, {_SPR} SELECT CAST(rep AS INTEGER) AS rep, {r('sum(s) / any_value(total)')} AS share FROM rk WHERE n <= 3 GROUP BY rep")
def _(spark, d):
    z = SS.standardize(group_maps(spark, d))
    return show(SS.split_reference(z, SS.random_splits(spark, list(range(10)), 4, 4, 20), _labels(spark), 64), "rep", share="share")


@query("parcel_concentration", f"+{_GM}, {_LAB}, p AS (SELECT label, sum(value * value) AS s, count(*) AS n FROM gm JOIN lab ON lab.pos = gm.pos GROUP BY label), b AS (SELECT * FROM p ORDER BY s DESC, label LIMIT 2) SELECT {r('sum(s) / (SELECT sum(s) FROM p)')} AS top_share, {r('sum(n) / CAST((SELECT sum(n) FROM p) AS DOUBLE)')} AS size_share FROM b", "members")
def _(spark, d):
    p = group_maps(spark, d).join(_labels(spark), "pos").groupBy("label").agg(F.sum(F.col("value") * F.col("value")).alias("sum"), F.count(F.lit(1)).alias("n"))
    return show(SS.concentration(p, 2), top_share="top_share", size_share="size_share")


_SME = "s AS (SELECT member, pos, abs(value) AS x, abs(avg(value) OVER (PARTITION BY member ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS y FROM gm), e AS (SELECT member, quantile_cont(y, 0.99) / quantile_cont(x, 0.99) AS peak, count(*) FILTER (y >= 0.02) / CAST(nullif(count(*) FILTER (x >= 0.02), 0) AS DOUBLE) AS extent, count(*) FILTER ((x >= 0.02) <> (y >= 0.02)) / CAST(count(*) AS DOUBLE) AS disagree FROM s GROUP BY member)"


@query("smoothing_effect", f"+{_GM}, {_SME} SELECT {r('median(peak)')} AS peak, {r('median(extent)')} AS extent, {r('median(disagree)')} AS disagree FROM e", "members")
def _(spark, d):
    g = group_maps(spark, d)
    w = W.partitionBy("member").orderBy("pos").rowsBetween(-1, 1)
    return show(SS.smoothing_effect(g, g.withColumn("value", F.avg("value").over(w)), 0.02), peak="peak", extent="extent", disagree="disagree")


def _distances(spark, d):
    return SS.correlation_matrix(group_maps(spark, d)).select(F.col("a").alias("i"), F.col("b").alias("j"), (1 - F.col("r")).alias("d"))


@query("nearest_neighbours", f"+{_GM}, p AS (SELECT a.member AS a, b.member AS b, 1 - corr(a.value, b.value) AS d FROM gm a JOIN gm b ON a.pos = b.pos AND a.member < b.member GROUP BY 1, 2), q AS (SELECT a AS i, b AS j, d FROM p UNION ALL SELECT b, a, d FROM p), k AS (SELECT i, j, CAST(rank() OVER (PARTITION BY i ORDER BY d) AS INTEGER) AS rank FROM q) SELECT i, j, rank FROM k WHERE rank <= 3", "members")
def _(spark, d):
    return SS.neighbours(_distances(spark, d), 3)


@query("nmds_layout")
def _(spark, d):
    m, ids = E.matrix(_distances(spark, d))
    x, stress, kind = E.nmds(spark, m)
    return spark.createDataFrame([(int(i), float(a), float(b), float(stress), kind) for i, (a, b) in zip(ids, x, strict=True)], "member int, x double, y double, stress double, kind string")


@query("seriation")
def _(spark, d):
    m, ids = E.matrix(_distances(spark, d))
    order, tree = E.seriate(1 - m)
    lab = E.cut_tree(tree, 3)
    return spark.createDataFrame([(n, int(ids[i]), lab[i]) for n, i in enumerate(order)], "at int, member int, cluster int")


@query("bootstrap_stability")
def _(spark, d):
    m = SS.parcel_moments(SS.standardize(group_maps(spark, d)), _labels(spark))
    dist = SS.moment_distances(m, SS.bootstrap_weights(spark, 4, 10))
    full, ids = E.matrix(SS.moment_distances(m).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("distance").alias("d")))
    return SS.ellipse(E.stability(dist, E.classical(full), ids), "member")


@query("envfit_vector")
def _(spark, d):
    m, ids = E.matrix(_distances(spark, d))
    x = E.classical(m)
    lay = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x, strict=True)], "member int, x double, y double")
    cov = group_maps(spark, d).filter("pos < 4").select(F.concat(F.lit("cell"), "pos").alias("name"), "member", "value")
    return E.envfit(lay, cov, permutations=99)


def _cloud(spark, d):
    return L.table(spark, d, "customer").select(F.col("c_acctbal").alias("x"), (F.col("c_acctbal") * 0.5 + F.col("c_custkey") % 97 * 10.0).alias("y"), F.col("c_mktsegment").alias("seg"))


_CLOUD = "cloud AS (SELECT c_acctbal AS x, c_acctbal * 0.5 + c_custkey % 97 * 10.0 AS y, c_mktsegment AS seg FROM customer)"


@query("ellipse", f"WITH {_CLOUD}, s AS (SELECT seg, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM cloud GROUP BY seg), t AS (SELECT *, (a + b) / 2 AS mid, sqrt(power((a - b) / 2, 2) + c * c) AS gap FROM s) SELECT seg, {r('cx')} AS cx, {r('cy')} AS cy, {r('sqrt(2.279 * (mid + gap))')} AS major, {r('sqrt(2.279 * greatest(mid - gap, 0))')} AS minor, {r('atan2(2 * c, a - b) / 2')} AS angle FROM t")
def _(spark, d):
    return show(SS.ellipse(_cloud(spark, d), "seg"), "seg", **{c: c for c in ("cx", "cy", "major", "minor", "angle")})


_XS, _YS = [-500.0, 2000.0, 4500.0, 7000.0], [0.0, 1500.0, 3000.0, 4500.0]


@query("kde_grid", f"WITH {_CLOUD}, g AS (SELECT unnest({_XS}) AS gx), h AS (SELECT unnest({_YS}) AS gy), k AS (SELECT CAST(gx AS DOUBLE) AS gx, CAST(gy AS DOUBLE) AS gy, avg(exp(-(power((x - gx) / 900.0, 2) + power((y - gy) / 500.0, 2)) / 2)) / (2 * pi() * 900.0 * 500.0) AS density FROM cloud, g, h GROUP BY gx, gy) SELECT gx, gy, {r('density * 1e9')} AS density FROM k")
def _(spark, d):
    return show(SS.kde2d(_cloud(spark, d), _XS, _YS, 900.0, 500.0), "gx", "gy", density=F.col("density") * 1e9)


_KDE = f"{_CLOUD}, g AS (SELECT unnest({_XS}) AS gx), h AS (SELECT unnest({_YS}) AS gy), k AS (SELECT gx, gy, avg(exp(-(power((x - gx) / 900.0, 2) + power((y - gy) / 500.0, 2)) / 2)) / (2 * pi() * 900.0 * 500.0) AS density FROM cloud, g, h GROUP BY gx, gy)"


@query("kde_levels", f"WITH {_KDE}, c AS (SELECT density, sum(density) OVER (ORDER BY density DESC ROWS UNBOUNDED PRECEDING) AS cum, sum(density) OVER () AS total FROM k), f AS (SELECT CAST(unnest([0.5, 0.9]) AS DOUBLE) AS fraction) SELECT fraction, {r('max(density) * 1e9')} AS level FROM c, f WHERE cum >= fraction * total GROUP BY fraction")
def _(spark, d):
    return show(SS.density_levels(SS.kde2d(_cloud(spark, d), _XS, _YS, 900.0, 500.0), [0.5, 0.9]), "fraction", level=F.col("level") * 1e9)


@query("scott_bandwidth", f"WITH {_CLOUD} SELECT {r('stddev_samp(x) * power(count(*), -1 / 6.0)')} AS h FROM cloud")
def _(spark, d):
    return show(SS.scott_bandwidth(_cloud(spark, d), "x"), h="h")


@query("procrustes_residual", f"WITH {_CLOUD}, m AS (SELECT x, y, y * 2 + 5 AS u, x * -2 + 1 AS v, avg(x) OVER () AS mx, avg(y) OVER () AS my, avg(y * 2 + 5) OVER () AS mu, avg(x * -2 + 1) OVER () AS mv FROM cloud), t AS (SELECT sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS c, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS s, sum(power(x - mx, 2) + power(y - my, 2)) AS q FROM m) SELECT {r('max(abs((c * (x - mx) - s * (y - my)) / q + mu - u) + abs((s * (x - mx) + c * (y - my)) / q + mv - v))')} AS worst FROM m, t")
def _(spark, d):
    p = _cloud(spark, d).select("x", "y", (F.col("y") * 2 + 5).alias("u"), (F.col("x") * -2 + 1).alias("v"))
    _, out = SS.procrustes(p)
    return show(out.agg(F.max(F.abs(F.col("x2") - F.col("u")) + F.abs(F.col("y2") - F.col("v"))).alias("worst")), worst="worst")


@query("stress_shares", f"WITH p AS (SELECT l_suppkey AS i, l_partkey AS j, l_quantity AS d, l_quantity * 0.9 + 1 AS h FROM lineitem), e AS (SELECT unnest([i, j]) AS i, power(d - h, 2) / 2 AS r FROM p), s AS (SELECT i, sum(r) AS r FROM e GROUP BY i) SELECT i, {r('r / sum(r) OVER ()')} AS share FROM s")
def _(spark, d):
    li = L.table(spark, d, "lineitem")
    p = li.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("d"), (F.col("l_quantity") * 0.9 + 1).alias("disparity"))
    return show(SS.stress_shares(p), "i", share="share")


# ------------------------------------------------------------------ series
for _name in ("mean", "std", "min", "max", "median"):

    def _run(spark, d, name=_name):
        return show(R.temporal(L.series(spark, d), name), "idx", value="value")

    query(f"temporal_{_name}", f"SELECT idx, {r({'mean': 'avg', 'std': 'stddev_samp'}.get(_name, _name) + '(value)')} AS value FROM series GROUP BY idx", "series")(_run)

_WX = "avg(value) OVER (PARTITION BY idx)"
_WS = "stddev_samp(value) OVER (PARTITION BY idx)"
for _name, _f, _sql in (
    ("series_zscore", lambda s: T.scale(s, "zscore"), f"CASE WHEN {_WS} > 0 THEN (value - {_WX}) / {_WS} ELSE 0 END"),
    ("series_center", lambda s: T.scale(s, "mean-center"), f"value - {_WX}"),
    ("series_psc", lambda s: T.scale(s, "psc"), f"CASE WHEN {_WX} <> 0 THEN (value - {_WX}) / {_WX} * 100 ELSE 0 END"),
    ("series_zscore_keep", T.zscore, f"CASE WHEN {_WS} > 0 THEN (value - {_WX}) / {_WS} ELSE value END"),
    ("series_percent_change", lambda s: T.percent_change(s, 30), "CASE WHEN avg(value) FILTER (t < 3) OVER (PARTITION BY idx) > 0 THEN (value - avg(value) FILTER (t < 3) OVER (PARTITION BY idx)) / avg(value) FILTER (t < 3) OVER (PARTITION BY idx) * 100 ELSE value END"),
    ("detrend_mean", lambda s: T.detrend(s, "mean"), f"value - {_WX}"),
    ("detrend_linear", lambda s: T.detrend(s, "linear"), f"value - {_WX} - covar_pop(t, value) OVER (PARTITION BY idx) / var_pop(t) OVER (PARTITION BY idx) * (t - avg(t) OVER (PARTITION BY idx))"),
    ("series_convolve", lambda s: T.convolve(s, [1.0, 2.0, 1.0, 0.5]), "(1.0 * coalesce(lag(value, 2) OVER q, 0) + 2.0 * coalesce(lag(value, 1) OVER q, 0) + value + 0.5 * coalesce(lead(value, 1) OVER q, 0)) / 4.5"),
    ("series_smooth", lambda s: T.smooth(s, 0.5), "(exp(-2.0) * (coalesce(lag(value, 1) OVER q, 0) + coalesce(lead(value, 1) OVER q, 0)) + value) / (1 + 2 * exp(-2.0))"),
):

    def _run(spark, d, f=_f):
        return show(f(L.series(spark, d)), "idx", "t", value="value")

    query(_name, f"SELECT idx, t, {r(_sql)} AS value FROM series WINDOW q AS (PARTITION BY idx ORDER BY t)", "series")(_run)


_ORTH = "o AS (SELECT idx, t, value, t - avg(t) OVER w AS u, power(t - avg(t) OVER w, 2) - var_pop(t) OVER w AS q FROM series WINDOW w AS (PARTITION BY idx))"  # every series has the same even steps


@query("detrend_polynomial", f"+{_ORTH} SELECT idx, t, {r('value - avg(value) OVER w - sum(value * u) OVER w / sum(u * u) OVER w * u - sum(value * q) OVER w / sum(q * q) OVER w * q')} AS value FROM o WINDOW w AS (PARTITION BY idx)", "series")
def _(spark, d):
    return show(T.detrend(L.series(spark, d), "polynomial", 2), "idx", "t", value="value")


_BAS = "bas AS (SELECT CAST(a.range AS INTEGER) AS t, CAST(b.range AS INTEGER) AS t2, sum(CASE WHEN k.range = 0 OR 2 * k.range = 30 THEN 1.0 ELSE 2.0 END / 30 * cos(2 * pi() * k.range * (a.range - b.range) / 30.0)) AS w FROM range(30) a, range(30) b, range(16) k WHERE k.range / 60.0 BETWEEN 0.05 AND 0.2 GROUP BY 1, 2)"
for _name, _f in (("bandpass_basis", lambda s: T.filter_by_basis(s, 30, 0.05, 0.2)), ("bandpass_fourier", lambda s: T.temporal_filter(s, 0.05, 0.2))):

    def _run(spark, d, f=_f):
        return show(f(L.series(spark, d)), "idx", "t", value="value")

    query(_name, f"+{_BAS} SELECT idx, t2 AS t, {r('sum(value * w)')} AS value FROM series JOIN bas ON bas.t = series.t GROUP BY idx, t2", "series")(_run)


@query("seed_correlation", f"+s AS (SELECT t, value AS y FROM series WHERE idx = 3) SELECT idx, {r('CASE WHEN stddev_pop(value) > 0 THEN corr(value, y) ELSE 0 END')} AS value FROM series JOIN s ON s.t = series.t GROUP BY idx", "series")
def _(spark, d):
    return show(T.seed_correlation(L.series(spark, d), 3), "idx", value="value")


@query("time_slice", "SELECT idx, t - 5 AS t, value FROM series WHERE t >= 5 AND t < 12", "series")
def _(spark, d):
    return T.time_slice(L.series(spark, d), 5, 12)


@query("time_concatenate", "SELECT idx, t, value FROM series UNION ALL SELECT idx, t + 30, value FROM series", "series")
def _(spark, d):
    s = L.series(spark, d)
    return T.concatenate(s, s, 30)


@query("time_select", "SELECT idx, CAST(o.n AS INTEGER) AS t, value FROM series JOIN (VALUES (4, 0), (2, 1), (4, 2)) o(t, n) ON o.t = series.t", "series")
def _(spark, d):
    return T.select_times(L.series(spark, d), [4, 2, 4])


@query("series_arrays", "SELECT idx, CAST(count(*) AS INTEGER) AS n, sum(value) AS total FROM series GROUP BY idx", "series")
def _(spark, d):
    a = T.as_arrays(L.series(spark, d))
    return a.select("idx", F.size("series").alias("n"), F.aggregate("series", F.lit(0.0), lambda x, y: x + y).alias("total"))


_FAC = "fac AS (SELECT idx, t, value, t % 2 AS level FROM series)"


def _factor(spark):
    return spark.range(30).select(F.col("id").cast("int").alias("t"), (F.col("id") % 2).cast("int").alias("level"))


@query("split_fill", f"+{_FAC} SELECT level, idx, CAST(row_number() OVER (PARTITION BY level, idx ORDER BY t) - 1 AS INTEGER) AS t, value FROM fac", "series")
def _(spark, d):
    return R.split_fill(L.series(spark, d), _factor(spark))


for _name in ("mean", "std", "median"):

    def _run(spark, d, name=_name):
        return show(R.split_reduce(L.series(spark, d), _factor(spark), name), "idx", value="value")

    query(f"split_reduce_{_name}", f"+{_FAC}, m AS (SELECT idx, level, {({'mean': 'avg', 'std': 'stddev_samp'}.get(_name, _name))}(value) AS v FROM fac GROUP BY idx, level) SELECT idx, {r('avg(v)')} AS value FROM m GROUP BY idx", "series")(_run)


@query("split_reduce_udf", f"+{_FAC}, m AS (SELECT idx, level, max(value) - min(value) AS v FROM fac GROUP BY idx, level) SELECT idx, {r('avg(v)')} AS value FROM m GROUP BY idx", "series")
def _(spark, d):
    def extent(x: pd.Series) -> float:
        return float(x.max() - x.min())

    spread = F.pandas_udf(extent, "double")
    s = L.series(spark, d).join(_factor(spark), "t").groupBy("idx", "level").agg(spread("value").alias("v"))
    return show(s.groupBy("idx").agg(F.avg("v").alias("value")), "idx", value="value")


@query("split_scale", f"+{_FAC} SELECT idx, t, level, {r('CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE value - avg(value) OVER w END')} AS value FROM fac WINDOW w AS (PARTITION BY idx, level)", "series")
def _(spark, d):
    return show(R.split_scale(L.series(spark, d), _factor(spark)), "idx", "t", "level", value="value")


@query("split_clusters", f"SELECT CAST(idx % 4 AS INTEGER) AS label, idx, {r('avg(value)')} AS value FROM series WHERE idx % 4 > 0 GROUP BY idx", "series")
def _(spark, d):
    s = L.series(spark, d)
    lab = s.select("idx").distinct().withColumn("label", (F.col("idx") % 4).cast("int"))
    return show(R.split_clusters(s, lab), "label", "idx", value="value")


@query("split_blocks", "SELECT idx, t, value, CAST(idx % 3 AS INTEGER) AS block FROM series", "series")
def _(spark, d):
    s = L.series(spark, d)
    return R.split_blocks(s, s.select("idx").distinct().withColumn("block", (F.col("idx") % 3).cast("int")))


@query("process_chunks", "SELECT CAST(t // 10 AS INTEGER) AS chunk, count(*) AS n, " + r("sum(value)") + " AS total FROM series GROUP BY 1", "series")
def _(spark, d):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [int(pdf["t"].min()) // 10], "n": [len(pdf)], "total": [pdf["value"].sum()]})

    return show(ST_M.process_chunks(L.series(spark, d), f, "chunk int, n long, total double", 10), "chunk", "n", total="total")


_EV = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, user_id, count(value) AS count, " + r("avg(value)") + " AS mean, " + r("stddev_samp(value)") + " AS sd FROM events GROUP BY 1, 2"


@query("event_moments", _EV)
def _(spark, d):
    return show(ST_M.streaming_moments(L.table(spark, d, "events"), "ts", "user_id", "value"), "start", "user_id", "count", mean="mean", sd="sd")


@query("event_moments_stream", _EV)
def _(spark, d):
    from gridloom.plans.geometry import scratch

    src = spark.readStream.schema(L.table(spark, d, "events").schema).format("parquet").load(d, pathGlobFilter="events*.parquet")
    m = ST_M.completed(ST_M.streaming_moments(src, "ts", "user_id", "value"), scratch(spark))
    return show(m, "start", "user_id", "count", mean="mean", sd="sd")


# ------------------------------------------------------------------ named dimensions
for _name, _sql in (("mean", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("std", "stddev_pop(value)"), ("var", "var_pop(value)"), ("median", "median(value)")):

    def _run(spark, d, name=_name):
        return show(R.reduce_dims(L.hyper(spark, d), ["year"], name), "flag", "status", value="value")

    query(f"hyper_{_name}", f"SELECT flag, status, {r(_sql)} AS value FROM hyper GROUP BY flag, status", "hyper")(_run)


@query("hyper_keep_dims", f"SELECT flag, 0 AS status, 0 AS year, {r('sum(value)')} AS value FROM hyper GROUP BY flag", "hyper")
def _(spark, d):
    return show(R.reduce_dims(L.hyper(spark, d), ["status", "year"], "sum", True), "flag", "status", "year", value="value")


@query("hyper_concat_split", "+c AS (SELECT flag, status, year, value FROM hyper UNION ALL SELECT flag, status, year + 10, value FROM hyper) SELECT flag, status, CAST(CASE WHEN year >= 2000 THEN year - 2000 WHEN year >= 1995 THEN year - 1995 ELSE year END AS INTEGER) AS year, value, CAST((year >= 1995)::INT + (year >= 2000)::INT AS INTEGER) AS segment FROM c", "hyper")
def _(spark, d):
    h = L.hyper(spark, d)
    return R.split_at(R.concat_dim(h, h, "year", 10), "year", [1995, 2000])


@query("hyper_set_sub_volume", "SELECT flag, status, year, CASE WHEN flag = 'A' THEN -value ELSE value END AS value FROM hyper", "hyper")
def _(spark, d):
    h = L.hyper(spark, d)
    return R.set_sub_volume(h, h.filter("flag = 'A'").withColumn("value", -F.col("value")))


@query("hyper_map_along", f"SELECT flag, status, year, {r('value - avg(value) OVER (PARTITION BY flag, status)')} AS value FROM hyper", "hyper")
def _(spark, d):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(value=pdf["value"] - pdf["value"].mean())

    h = L.hyper(spark, d)
    return show(h.groupBy("flag", "status").applyInPandas(f, h.schema), "flag", "status", "year", value="value")


# ------------------------------------------------------------------ designs
@query("cell_means", f"SELECT cond, grp, {r('avg(value)')} AS mean FROM design GROUP BY cond, grp", "design")
def _(spark, d):
    return show(D.cell_means(L.design(spark, d), ["cond", "grp"]), "cond", "grp", mean="mean")


@query("varies_within", "+n AS (SELECT subject, count(DISTINCT cond) AS n FROM design GROUP BY subject) SELECT bool_and(n > 1) AS varies FROM n", "design")
def _(spark, d):
    return D.varies_within(L.design(spark, d), "subject", "cond")


_SUBJ = "sc AS (SELECT subject, cond, grp, avg(value) AS v FROM design GROUP BY subject, cond, grp)"


@query("summarise_between", f"+{_SUBJ} SELECT cond, grp, {r('avg(v)')} AS mean, count(*) AS n FROM sc GROUP BY cond, grp", "design")
def _(spark, d):
    return show(D.summarise(L.design(spark, d), ["cond", "grp"], "subject"), "cond", "grp", "n", mean="mean")


_MOREY = "jj AS (SELECT grp, count(DISTINCT cond) AS J FROM sc GROUP BY grp), ow AS (SELECT sc.*, J, avg(v) OVER (PARTITION BY sc.grp, subject) AS own, count(v) OVER (PARTITION BY sc.grp, subject) = J AS full_ FROM sc JOIN jj ON jj.grp = sc.grp), nm AS (SELECT *, CASE WHEN full_ THEN v - own + avg(v) FILTER (full_) OVER (PARTITION BY grp) END AS norm FROM ow), st AS (SELECT cond, grp, avg(v) AS mean, count(v) AS n, CASE WHEN any_value(J) >= 2 THEN count(norm) ELSE count(v) END AS m, CASE WHEN any_value(J) >= 2 THEN var_samp(norm) * any_value(J) / (any_value(J) - 1) ELSE var_samp(v) END AS var FROM nm GROUP BY cond, grp)"


@query("summarise_intervals", f"WITH RECURSIVE {L.SQL['design']}, {_SUBJ}, {_MOREY}, {t_table('SELECT DISTINCT m - 1 AS df FROM st WHERE m > 1')} SELECT cond, grp, n, {r('mean')} AS mean, {r('mean - q * sqrt(var / m)')} AS lo, {r('mean + q * sqrt(var / m)')} AS hi FROM st LEFT JOIN tq ON tq.df = st.m - 1")
def _(spark, d):
    return show(D.summarise(L.design(spark, d), ["cond", "grp"], "subject", ["cond"]), "cond", "grp", "n", mean="mean", lo="lo", hi="hi")


@query("plot_scene", f"+{_SUBJ} SELECT cond, grp, {r('avg(v)')} AS mean, count(*) AS n FROM sc WHERE cond IN ('A', 'N') GROUP BY cond, grp", "design")
def _(spark, d):
    s = build_scene(L.design(spark, d), PlotSpec("cond", "grp", keep={"cond": ("A", "N")}))
    return show(s["cells"], "cond", "grp", "n", mean="mean")


@query("plot_counts", "SELECT cond, grp, count(DISTINCT subject) AS n FROM design GROUP BY GROUPING SETS ((cond), (grp), ())", "design")
def _(spark, d):
    return R.cell_counts(L.design(spark, d), "cond", "grp")


@query("plot_inferred", "+n AS (SELECT max(c) AS c, max(g) AS g FROM (SELECT subject, count(DISTINCT cond) AS c, count(DISTINCT grp) AS g FROM design GROUP BY subject)) SELECT CASE WHEN c > 1 OR g = 1 THEN 'cond' ELSE 'grp' END AS x, CASE WHEN c > 1 OR g = 1 THEN 'grp' ELSE 'cond' END AS color, CAST(NULL AS VARCHAR) AS facet FROM n", "design")
def _(spark, d):
    x = L.design(spark, d).withColumn("grp", F.col("grp").cast("string"))
    spec = infer_spec(x)
    return spark.createDataFrame([(spec.x, spec.color, spec.facet)], "x string, color string, facet string")


@query("ranks", "SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS rank FROM customer")
def _(spark, d):
    return ST.ranks(L.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "rank")


_RK = "WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)"


@query("spearman", f"{_RK} SELECT {r('corr(x, y)')} AS r, count(*) AS n FROM k")
def _(spark, d):
    return show(ST.spearman(L.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"), "n", r="r")


@query("fit_line", f"SELECT count(*) AS n, {r('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {r('corr(l_extendedprice, l_quantity)')} AS r FROM lineitem")
def _(spark, d):
    s, _ = ST.fit_line(L.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return show(s, "n", slope="slope", intercept="intercept", r="r")


#: the t quantile as a series in 1 / df around the normal one, exact to many digits for hundreds of rows
_Z975 = 1.959963984540054
_TQ = " + ".join([f"{_Z975!r}::DOUBLE", *(f"{x / b!r}::DOUBLE / power(n - 2, {i})" for i, (x, b) in enumerate((((_Z975**3 + _Z975), 4), ((5 * _Z975**5 + 16 * _Z975**3 + 3 * _Z975), 96), ((3 * _Z975**7 + 19 * _Z975**5 + 17 * _Z975**3 - 15 * _Z975), 384), ((79 * _Z975**9 + 776 * _Z975**7 + 1482 * _Z975**5 - 1920 * _Z975**3 - 945 * _Z975), 92160)), 1))])
_FLI = f"s AS (SELECT count(*)::DOUBLE AS n, regr_slope(c_acctbal, c_nationkey) AS b, regr_intercept(c_acctbal, c_nationkey) AS a, avg(c_nationkey) AS mx, regr_sxx(c_acctbal, c_nationkey) AS sxx, regr_syy(c_acctbal, c_nationkey) AS syy FROM customer), q AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS mse, {_TQ} AS tq FROM s), f AS (SELECT c_custkey, a + b * c_nationkey AS fit, 1 / n + power(c_nationkey - mx, 2) / sxx AS lev, c_acctbal AS y, mse, tq, n FROM customer, q)"


@query("fit_line_influence", f"WITH {_FLI} SELECT c_custkey, (power(y - fit, 2) / (2 * mse) * lev / power(1 - lev, 2) > 4 / n) AS influential, {r('fit')} AS fit, {r('fit - tq * sqrt(mse * lev)')} AS lower, {r('fit + tq * sqrt(mse * lev)')} AS upper FROM f")
def _(spark, d):
    _, rows = ST.fit_line(L.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal")
    return show(rows, "c_custkey", "influential", fit="fit", lower="lower", upper="upper")


@query("quantiles", f"SELECT l_returnflag AS flag, {', '.join(r(f'quantile_cont(l_quantity, {q})') + f' AS q{int(q * 100)}' for q in (0.05, 0.25, 0.5, 0.95))} FROM lineitem GROUP BY 1")
def _(spark, d):
    g = L.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*[ST.quantile("l_quantity", q).alias(f"q{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.95)])
    return show(g, "flag", q5="q5", q25="q25", q50="q50", q95="q95")


#: two-sided probabilities for whole df as finite sums over powers of the cosine of atan(t / sqrt(df))
_TCDF = "x AS (SELECT c_custkey, abs(c_acctbal / 4000) AS t, c_custkey % 30 + 1 AS df FROM customer), a AS (SELECT c_custkey, df, atan(t / sqrt(df)) AS th FROM x), e AS (SELECT c_custkey, df, th, k.range AS k, CASE WHEN df % 2 = 0 THEN factorial(CAST(2 * k.range AS INTEGER))::DOUBLE / (power(4.0, k.range) * power(factorial(CAST(k.range AS INTEGER))::DOUBLE, 2)) ELSE power(4.0, k.range) * power(factorial(CAST(k.range AS INTEGER))::DOUBLE, 2) / factorial(CAST(2 * k.range + 1 AS INTEGER))::DOUBLE END * power(cos(th), 2 * k.range) AS term FROM a, range(15) k WHERE k.range < CASE WHEN df % 2 = 0 THEN df // 2 ELSE greatest((df - 1) // 2, 1) END), s AS (SELECT c_custkey, df, th, CASE WHEN df = 1 THEN 0 ELSE sum(term) END AS s FROM e GROUP BY 1, 2, 3)"


@query("student_t_probability", f"WITH {_TCDF} SELECT c_custkey, {r('1 - CASE WHEN df % 2 = 0 THEN sin(th) * s ELSE 2 / pi() * (th + sin(th) * cos(th) * s) END')} AS p, {r('0.05')} AS tail FROM s")
def _(spark, d):
    """Two-sided p of t, and that of the quantile at 0.975."""
    x = L.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 4000).alias("t"), (F.col("c_custkey") % 30 + 1).cast("double").alias("df"))
    x = ST.with_t_quantile(x.withColumn("p", ST.t_p_value("t", "df")), "df", 0.975)
    return show(x.withColumn("tail", ST.t_p_value("tq", "df")), "c_custkey", p="p", tail="tail")


@query("student_t", f"WITH RECURSIVE {t_table('SELECT DISTINCT CAST(range + 1 AS INTEGER) AS df FROM range(30)')}, x AS (SELECT c_custkey, abs(c_acctbal / 4000) AS t, CAST(c_custkey % 30 + 1 AS INTEGER) AS df FROM customer) SELECT c_custkey, {r('1 - (' + t_inside('t', 'df') + ')')} AS p, {r('q')} AS tq FROM x JOIN tq USING (df)")
def _(spark, d):
    x = L.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 4000).alias("t"), (F.col("c_custkey") % 30 + 1).cast("double").alias("df"))
    return show(ST.with_t_quantile(x.withColumn("p", ST.t_p_value("t", "df")), "df", 0.975), "c_custkey", p="p", tq="tq")


def _summaries(spark, d):
    x = F.col("value")
    g = L.design(spark, d).groupBy("cond", "grp").agg(F.avg(x).alias("estimate"), F.stddev_samp(x).alias("sd"), F.count(x).cast("double").alias("n"))
    se = F.col("sd") / F.sqrt("n")
    kind = F.when(F.col("cond") == "A", "se").when(F.col("cond") == "N", "ci_t").otherwise("odd")
    return g.select("cond", "grp", "estimate", (F.col("estimate") - se).alias("lower"), (F.col("estimate") + se).alias("upper"), kind.alias("interval_kind"), F.when(F.col("cond") == "N", 0.95).alias("interval_level"))


@query("summary_row_problems", "SELECT DISTINCT cond, grp, CASE cond WHEN 'A' THEN '' WHEN 'N' THEN 'bounds of this kind need df above 0' ELSE 'unknown interval kind' END AS problems FROM design", "design")
def _(spark, d):
    p = SU.problems(_summaries(spark, d))
    return p.select("cond", "grp", F.concat_ws("; ", "problems").alias("problems"))


@query("summary_import", "SELECT DISTINCT cond, grp, CASE cond WHEN 'A' THEN 'se' WHEN 'N' THEN 'ci_t' ELSE 'custom' END AS interval_kind, CASE WHEN cond NOT IN ('A', 'N') THEN 'odd' END AS original_kind FROM design", "design")
def _(spark, d):
    s = _summaries(spark, d).withColumnsRenamed({"estimate": "value", "lower": "lwr", "upper": "upr"})
    return SU.import_rows(s).select("cond", "grp", "interval_kind", "original_kind")


@query("interval_labels", "SELECT '95% CI (t)' AS label, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT '97.5% CI (t)', count(*) FROM lineitem WHERE l_returnflag <> 'N'")
def _(spark, d):
    li = L.table(spark, d, "lineitem").select(F.lit("{percent}% CI (t)").alias("template"), F.when(F.col("l_returnflag") == "N", 0.95).otherwise(0.975).alias("level"))
    return TX.interval_labels(li, "template", "level")


@query("extract_probe", f"SELECT member AS row, 0 AS axis, {r('avg(value)')} AS value FROM members WHERE pos BETWEEN 10 AND 20 GROUP BY member", "members")
def _(spark, d):
    data = L.members(spark, d).select(F.col("member").alias("row"), "pos", F.lit(0).alias("axis"), "value")
    return show(D.extract(data, spark.range(10, 21).select(F.col("id").alias("pos"))), "row", "axis", value="value")


@query("map_of_rows", f"SELECT pos, {r('avg(value)')} AS value FROM members WHERE grp = 2 GROUP BY pos", "members")
def _(spark, d):
    m = L.members(spark, d)
    data = m.select(F.col("member").alias("row"), "pos", F.lit(0).alias("axis"), "value")
    w = spark.createDataFrame([(0, 1.0)], "axis int, w double")
    return show(D.map_of(data, m.filter("grp = 2").select(F.col("member").alias("row")).distinct(), w), "pos", value="value")


@query("unpivot_basis", f"SELECT vec_id AS member, CAST(t.range AS INTEGER) AS t, {r('CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * (t.range + 1)')} AS value FROM embeddings, range(3) t")
def _(spark, d):
    e = L.table(spark, d, "embeddings").select(F.col("vec_id").alias("member"), F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("values"))
    basis = spark.createDataFrame([(t, a, 1.0 if a == 0 else t + 1.0) for t in range(3) for a in range(2)], "t int, a int, w double")
    return show(D.to_long(e, "values", basis), "member", "t", value="value")


@query("json_props", "SELECT event_id, event_type FROM events WHERE json_valid(props)")
def _(spark, d):
    e = L.table(spark, d, "events")
    return e.filter(F.try_parse_json("props").isNotNull()).select("event_id", "event_type")


@query("map_fingerprints", "+w AS (SELECT member, list_prepend(count(*), list(CAST(CAST(CAST(value AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295 ORDER BY pos)) AS w FROM members GROUP BY member) SELECT member, lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, w), lambda h, x: ((xor(h, x)::HUGEINT * 16777619) & 4294967295)::BIGINT)), 8, '0') AS key FROM w", "members")
def _(spark, d):
    return SS.fingerprint(L.members(spark, d))
