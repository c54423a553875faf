"""Queries on trees of members, lines through planes, supervoxels and stored images."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import layout as L
from gridloom.operators import embed as E
from gridloom.operators import isolines as I
from gridloom.plans.registry import SQL, draws, query, r, show
from gridloom.operators import setstats as SS
from gridloom.operators.supervoxels import supervoxels
from gridloom.plans.geometry import _grid_of_users, scratch
from gridloom.plans.sets import _GM, _distances
from gridloom.plans.volumes import vol
from gridloom.streaming import retract
from gridloom.sources import manifest
from gridloom.sources.images import read_images, write_image

#: UPGMA of the ten group maps by recursion: places hold nodes with their leaves in order; the nearest pair joins at the smaller place
_TREE = """p AS (SELECT a.member AS a, b.member AS b, 1 - corr(a.value, b.value) AS d FROM gm a JOIN gm b ON a.pos = b.pos AND a.member <> b.member GROUP BY 1, 2),
u AS (SELECT 0 AS step, member AS at, CAST(member AS INTEGER) AS node, [member] AS leaves, CAST(NULL AS DOUBLE) AS height, CAST(NULL AS INTEGER) AS l, CAST(NULL AS INTEGER) AS r FROM (SELECT DISTINCT member FROM gm)
    UNION ALL
    SELECT u.step + 1, u.at, CASE WHEN u.at = m.s.i THEN 10 + u.step ELSE u.node END, CASE WHEN u.at = m.s.i THEN u.leaves || m.s.more ELSE u.leaves END, CASE WHEN u.at = m.s.i THEN m.s.h END, CASE WHEN u.at = m.s.i THEN m.s.l END, CASE WHEN u.at = m.s.i THEN m.s.r END
    FROM u, (SELECT arg_min(struct_pack(i := i, j := j, h := h, more := more, l := l, r := r), struct_pack(h := h, i := i, j := j)) AS s FROM
        (SELECT x.at AS i, y.at AS j, avg(p.d) AS h, any_value(y.leaves) AS more, any_value(x.node) AS l, any_value(y.node) AS r FROM u x JOIN u y ON x.at < y.at JOIN p ON list_contains(x.leaves, p.a) AND list_contains(y.leaves, p.b) GROUP BY 1, 2)) AS m
    WHERE m.s.i IS NOT NULL AND u.at <> m.s.j),
merges AS (SELECT node, leaves, height, l, r FROM u WHERE height IS NOT NULL)"""
_REC = "WITH RECURSIVE members AS (SELECT vec_id AS member, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), "


def _tree(spark, d):
    """The average-linkage tree of the group maps, whose ids are 0 to 9."""
    m, _ = E.matrix(_distances(spark, d))
    return E.average_linkage(m)


@query("average_linkage", f"{_REC}{_GM}, {_TREE} SELECT node, {r('height')} AS height, array_to_string(leaves, ',') AS leaves FROM merges")
def _(spark, d):
    b = E.branches(spark, _tree(spark, d)).filter("height is not null")
    return show(b.withColumn("leaves", F.array_join(F.col("leaves").cast("array<string>"), ",")), "node", "leaves", height="height")


_CUTS = """rk AS (SELECT node, leaves, height, l, r, CAST(row_number() OVER (ORDER BY height DESC, node DESC) AS INTEGER) AS until FROM merges),
leaf AS (SELECT DISTINCT CAST(member AS INTEGER) AS node, [member] AS leaves FROM gm),
root AS (SELECT leaves FROM rk WHERE until = 1),
br AS (SELECT n.node, n.leaves, n.until, coalesce(k.until, 0) + 1 AS since, list_position(root.leaves, n.leaves[1]) AS place
    FROM (SELECT node, leaves, until FROM rk UNION ALL SELECT node, leaves, NULL FROM leaf) n LEFT JOIN rk k ON n.node IN (k.l, k.r), root),
gaps AS (SELECT a.until + 1 AS cut, a.height - b.height AS gap FROM rk a JOIN rk b ON b.until = a.until + 1 WHERE a.until + 1 <= 9),
inn AS (SELECT cut, gap, br.*, len(leaves) >= 2 AS large FROM gaps JOIN br ON cut BETWEEN since AND coalesce(until, 99)),
num AS (SELECT *, CASE WHEN large THEN row_number() OVER (PARTITION BY cut, large ORDER BY place) - 1 END AS grp, count(*) FILTER (large) OVER (PARTITION BY cut) AS groups FROM inn),
best AS (SELECT arg_max(cut, struct_pack(f := fits, g := gap, c := -cut)) FILTER (fits = 1) AS best, arg_max(cut, struct_pack(g := gap, c := -cut)) AS wide FROM (SELECT DISTINCT cut, gap, CAST(groups BETWEEN 2 AND 6 AND gap > 0.02 AS INTEGER) AS fits FROM num))"""


@query("suggested_groups", f"{_REC}{_GM}, {_TREE}, {_CUTS} SELECT cut, {r('gap')} AS gap, groups, coalesce(cut = best, false) AS chosen, cut = wide AS widest, CAST(unnest(leaves) AS INTEGER) AS member, CAST(grp AS INTEGER) AS grp FROM num, best")
def _(spark, d):
    s = E.suggest_groups(E.branches(spark, _tree(spark, d)))
    return show(s, "cut", "groups", "chosen", "widest", "member", "grp", gap="gap")


#: all orders of the leaves that turn branches of the tree, the shortest of them, and the three highest branches in its order
_ORDERS = """o AS (SELECT 0 AS step, CAST(member AS INTEGER) AS node, [CAST(member AS INTEGER)] AS leaves FROM (SELECT DISTINCT member FROM gm)
    UNION ALL
    SELECT * FROM (SELECT o.step + 1, o.node, o.leaves FROM o JOIN merges m ON m.node = 10 + o.step WHERE o.node NOT IN (m.l, m.r)
    UNION ALL
    SELECT x.step + 1, m.node, CASE w.range WHEN 0 THEN x.leaves || y.leaves ELSE y.leaves || x.leaves END FROM o x JOIN merges m ON m.node = 10 + x.step AND x.node = m.l JOIN o y ON y.node = m.r, range(2) w)),
len AS (SELECT leaves, (SELECT round(sum(p.d), 9) FROM range(1, 10) k JOIN p ON p.a = leaves[k.range] AND p.b = leaves[k.range + 1]) AS cost FROM o WHERE step = 9),
best AS (SELECT arg_min(leaves, struct_pack(c := cost, a := leaves[1], z := leaves[10])) AS leaves FROM len),
rk AS (SELECT node, leaves, row_number() OVER (ORDER BY height DESC, node DESC) AS until, l, r FROM merges),
br AS (SELECT n.node, n.leaves FROM (SELECT node, leaves, until FROM rk UNION ALL SELECT CAST(member AS INTEGER), [member], 99 FROM (SELECT DISTINCT member FROM gm)) n LEFT JOIN rk k ON n.node IN (k.l, k.r) WHERE coalesce(k.until, 0) < 3 AND n.until >= 3),
num AS (SELECT unnest(br.leaves) AS member, row_number() OVER (ORDER BY (SELECT min(list_position(best.leaves, x)) FROM (SELECT unnest(br.leaves) AS x))) - 1 AS cluster, best.leaves FROM br, best)"""
SQL["seriation"] = f"{_REC}{_GM}, {_TREE}, {_ORDERS} SELECT CAST(list_position(leaves, CAST(member AS INTEGER)) - 1 AS INTEGER) AS at, CAST(member AS INTEGER) AS member, CAST(cluster AS INTEGER) AS cluster FROM num"


#: pieces of lines in every cell, then each line followed from its beginning (or least crossing, for rings)
_ISO = """n AS (SELECT idx // 100 AS plane, idx % 10 AS x, idx // 10 % 10 AS y, CAST(value AS DOUBLE) AS v FROM vol),
c AS (SELECT a.plane, a.x, a.y, l.level, [a.v, b.v, c.v, d.v] AS v FROM n a JOIN n b ON b.plane = a.plane AND b.x = a.x + 1 AND b.y = a.y JOIN n c ON c.plane = a.plane AND c.x = a.x + 1 AND c.y = a.y + 1 JOIN n d ON d.plane = a.plane AND d.x = a.x AND d.y = a.y + 1, (SELECT unnest([10.5::DOUBLE, 25.5::DOUBLE, 40.5::DOUBLE]) AS level) l),
s AS (SELECT c.*, k.range AS k, v[k.range + 1] > level AS here, v[(k.range + 1) % 4 + 1] > level AS then_, (v[1] + v[2] + v[3] + v[4]) / 4 > level AS mid FROM c, range(4) k),
g AS (SELECT plane, x, y, level, v, mid, list(k ORDER BY k) FILTER (here AND NOT then_) AS a, list(k ORDER BY k) FILTER (NOT here AND then_) AS b FROM s GROUP BY ALL),
h AS (SELECT plane, level, x, y, v, unnest(a) AS a, b, mid FROM g),
e AS (SELECT plane, level, x, y, v, a, CASE WHEN len(b) = 1 THEN b[1] WHEN mid THEN (a + 1) % 4 ELSE (a + 3) % 4 END AS b FROM h),
q AS (SELECT plane, level, x, y, v, a, b, unnest([a, b]) AS k, unnest([0, 1]) AS which FROM e),
z AS (SELECT plane, level, a, b, which, x, y, k, x + CASE WHEN k = 1 THEN 1 ELSE 0 END AS lx, y + CASE WHEN k = 2 THEN 1 ELSE 0 END AS ly, k % 2 AS up,
    (level - v[[1, 2, 4, 1][k + 1]]) / (v[[2, 3, 3, 4][k + 1]] - v[[1, 2, 4, 1][k + 1]]) AS t FROM q),
w AS (SELECT plane, level, x, y, a, max(CASE WHEN which = 0 THEN ly * 4294967296 + lx * 2 + up END) AS ea, max(CASE WHEN which = 1 THEN ly * 4294967296 + lx * 2 + up END) AS eb,
    max(CASE WHEN which = 0 THEN lx + CASE WHEN up = 0 THEN t ELSE 0 END END) AS x0, max(CASE WHEN which = 0 THEN ly + CASE WHEN up = 1 THEN t ELSE 0 END END) AS y0,
    max(CASE WHEN which = 1 THEN lx + CASE WHEN up = 0 THEN t ELSE 0 END END) AS x1, max(CASE WHEN which = 1 THEN ly + CASE WHEN up = 1 THEN t ELSE 0 END END) AS y1 FROM z GROUP BY ALL),
open AS (SELECT plane, level, ea AS line, ea, 0 AS nth FROM w WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.plane = w.plane AND o.level = w.level AND o.eb = w.ea)),
walk AS (SELECT plane, level, line, ea AS e, nth FROM open UNION ALL SELECT walk.plane, walk.level, walk.line, w.eb, walk.nth + 1 FROM walk JOIN w ON w.plane = walk.plane AND w.level = walk.level AND w.ea = walk.e),
ring AS (SELECT w.plane, w.level, w.ea FROM w WHERE NOT EXISTS (SELECT 1 FROM walk k WHERE k.plane = w.plane AND k.level = w.level AND k.e = w.ea)),
around AS (SELECT plane, level, ea AS line, ea AS e, 0 AS nth FROM ring UNION ALL SELECT k.plane, k.level, k.line, w.eb, k.nth + 1 FROM around k JOIN w ON w.plane = k.plane AND w.level = k.level AND w.ea = k.e WHERE k.nth = 0 OR k.e <> k.line),
least AS (SELECT plane, level, line FROM around GROUP BY ALL HAVING min(e) = line),
pts AS (SELECT plane, level, ea AS e, x0 AS x, y0 AS y FROM w UNION SELECT plane, level, eb, x1, y1 FROM w),
ranks AS (SELECT * FROM walk UNION ALL SELECT around.* FROM around JOIN least USING (plane, level, line))"""


@query("iso_lines", f"WITH RECURSIVE vol AS (SELECT p_partkey AS idx, p_size AS value FROM part), {_ISO} SELECT plane, level, CAST(line AS BIGINT) AS line, CAST(nth AS BIGINT) AS nth, {r('any_value(x)')} AS x, {r('any_value(y)')} AS y FROM ranks JOIN pts USING (plane, level, e) GROUP BY plane, level, line, nth")
def _(spark, d):
    """Lines at three levels through every plane of the labels."""
    v, _ = vol(spark, d)
    nodes = v.select(F.floor(F.col("idx") / 100).alias("plane"), (F.col("idx") % 10).alias("x"), (F.floor(F.col("idx") / 10) % 10).alias("y"), F.col("label").alias("value"))
    return show(I.iso_lines(nodes, [10.5, 25.5, 40.5]), "plane", "level", "line", "nth", x="x", y="y")


# ------------------------------------------------------------------ images by slabs
@query("image_frames", f"+u AS (SELECT DISTINCT idx FROM series) SELECT t, idx, {r('CAST(value AS FLOAT)')} AS value FROM series WHERE t BETWEEN 5 AND 24 AND idx >= 20", "series")
def _(spark, d):
    """All users' days as one image written in slabs of 512 cells, then the cells that filters leave, read by slabs of 4 kB."""
    s = L.series(spark, d)
    path = f"{scratch(spark)}/days.nii"
    write_image(s, _grid_of_users(s), path, frames=L.DAYS, slab_cells=512)
    got = read_images(spark, path, slab_mb=1 / 256).filter("t >= 5 AND t < 25 AND idx >= 20")
    return show(got.join(s.select("idx").distinct(), "idx"), "t", "idx", value="value")


@query("image_of_labels", "SELECT idx, CAST(label AS DOUBLE) AS value FROM vol", "vol")
def _(spark, d):
    """A compressed image of 16-bit labels: a member a slab."""
    v, g = vol(spark, d)
    path = f"{scratch(spark)}/labels.nii.gz"
    write_image(v.select("idx", F.col("label").cast("double").alias("value")), g, path, "i2", slab_cells=128)
    return read_images(spark, path).select("idx", "value")


# ------------------------------------------------------------------ supervoxels
_K, _WIDTH = 6, 4.0
#: rounds as recursion over all cells: those called within the width of the nearest are taken, then call their neighbours
_SNIC = f"""f AS (SELECT idx, t, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END AS v FROM series WINDOW w AS (PARTITION BY t)),
c AS (SELECT idx, idx % 10 AS i, idx // 10 % 10 AS j, idx // 100 AS k, row_number() OVER (ORDER BY idx) - 1 AS row, count(*) OVER () AS n FROM (SELECT DISTINCT idx FROM series)),
seed AS (SELECT idx, CAST(row // greatest(1, n // {_K}) + 1 AS INTEGER) AS label FROM c WHERE row % greatest(1, n // {_K}) = 0 AND row < greatest(1, n // {_K}) * {_K}),
nb AS (SELECT a.idx AS a, b.idx AS b FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.idx <> b.idx),
g AS (SELECT 0 AS step, c.idx, 0 AS label, seed.label AS pl, CASE WHEN seed.label IS NOT NULL THEN 0.0::DOUBLE END AS pd FROM c LEFT JOIN seed USING (idx)
    UNION ALL
    SELECT q.step + 1, q.idx, CASE WHEN q.label = 0 AND q.pd <= th.th THEN q.pl ELSE q.label END,
        CASE WHEN q.label <> 0 OR q.pd <= th.th THEN q.pl WHEN q.pd IS NULL OR struct_pack(d := n.d, l := n.l) < struct_pack(d := q.pd, l := q.pl) THEN coalesce(n.l, q.pl) ELSE q.pl END,
        CASE WHEN q.label <> 0 OR q.pd <= th.th THEN q.pd WHEN q.pd IS NULL OR struct_pack(d := n.d, l := n.l) < struct_pack(d := q.pd, l := q.pl) THEN coalesce(n.d, q.pd) ELSE q.pd END
    FROM g q, (SELECT min(pd) + {_WIDTH}::DOUBLE AS th FROM g WHERE label = 0) th
    LEFT JOIN (
        SELECT idx, min(struct_pack(d := d, l := label)).d AS d, min(struct_pack(d := d, l := label)).l AS l FROM (
            SELECT call.idx, call.label, any_value(power(cc.i - ce.i, 2) + power(cc.j - ce.j, 2) + power(cc.k - ce.k, 2)) / sqrt(any_value(cc.n)::DOUBLE / {_K}) + sum(power(f.v - fe.v, 2)) / 5 AS d
            FROM (SELECT DISTINCT nb.b AS idx, x.pl AS label FROM g x, (SELECT min(pd) + {_WIDTH}::DOUBLE AS th FROM g WHERE label = 0) h JOIN nb ON nb.a = x.idx WHERE x.label = 0 AND x.pd <= h.th) call
            JOIN c cc ON cc.idx = call.idx
            JOIN (SELECT label, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM (SELECT CASE WHEN label = 0 THEN pl ELSE label END AS label, i, j, k FROM g y JOIN c USING (idx), (SELECT min(pd) + {_WIDTH}::DOUBLE AS th FROM g WHERE label = 0) h WHERE label <> 0 OR y.pd <= h.th UNION ALL SELECT label, i, j, k FROM seed JOIN c USING (idx)) GROUP BY label) ce ON ce.label = call.label
            JOIN f ON f.idx = call.idx
            JOIN (SELECT label, t, avg(v) AS v FROM (SELECT CASE WHEN label = 0 THEN pl ELSE label END AS label, t, v FROM g y JOIN f USING (idx), (SELECT min(pd) + {_WIDTH}::DOUBLE AS th FROM g WHERE label = 0) h WHERE label <> 0 OR y.pd <= h.th UNION ALL SELECT label, t, v FROM seed JOIN f USING (idx)) GROUP BY label, t) fe ON fe.label = call.label AND fe.t = f.t
            GROUP BY call.idx, call.label)
        GROUP BY idx) n ON n.idx = q.idx
    WHERE th.th IS NOT NULL)"""


@query("supervoxels", f"WITH RECURSIVE {L.SQL['series']}, {_SNIC} SELECT idx, label FROM g WHERE step = (SELECT max(step) FROM g)")
def _(spark, d):
    """Users as cells, grown into regions of alike days."""
    s = L.series(spark, d)
    packed = s.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("series"))
    return supervoxels(packed, _grid_of_users(s), _K, width=_WIDTH)


# ------------------------------------------------------------------ a stream with removals
@query("retracted_moments", f"SELECT pos AS cell, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd FROM members WHERE grp <> 3 GROUP BY pos", "members")
def _(spark, d):
    """All maps come, those of one group leave again after the stream has stopped and been started from its checkpoint."""
    at = scratch(spark)
    m = L.members(spark, d).select(F.col("pos").alias("cell"), "value", "grp")
    schema = "cell int, value double, sign int"
    for part in (m.withColumn("sign", F.lit(1)), m.filter("grp = 3").withColumn("sign", F.lit(-1))):
        part.select("cell", "value", "sign").write.mode("append").parquet(f"{at}/changes")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/changes")
        retract.follow(stream, f"{at}/out", f"{at}/checkpoint")
    return show(retract.current(spark, f"{at}/out"), "cell", F.col("count").alias("n"), mean="mean", sd="sd")


# ------------------------------------------------------------------ permutation tests
_REPS = 39
#: the places of members, each replicate's draws for them, and the values in their order
_PERMUTED = f"""lay AS (SELECT a.member, a.value AS x, b.value AS y FROM members a JOIN members b ON b.member = a.member AND b.pos = 1 WHERE a.pos = 0),
plc AS (SELECT member, x, y, row_number() OVER (ORDER BY member) - 1 AS i FROM lay),
{{rnd}},
per AS (SELECT rep + 1 AS rep, n AS i, row_number() OVER (PARTITION BY rep ORDER BY u, n) - 1 AS j FROM rnd WHERE n < (SELECT count(*) FROM plc) UNION ALL SELECT 0, i, i FROM plc)"""


def _rnd(first: int) -> str:
    return draws(_REPS, 100000, first).replace("range(100000) n", "(SELECT i AS range FROM plc) n")


@query("permutation_vectors", f"+{_PERMUTED.format(rnd=_rnd(6))}, c AS (SELECT pos, plc.i AS j, value FROM members JOIN plc USING (member) WHERE pos >= 2 AND pos % 4 = 2), g AS (SELECT pos, rep, covar_pop(x, value) AS a, covar_pop(y, value) AS b, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, var_pop(value) AS t FROM per JOIN plc USING (i) JOIN c USING (j) GROUP BY pos, rep), f AS (SELECT pos, rep, (a * yy - b * xy) / (xx * yy - xy * xy) AS bx, (b * xx - a * xy) / (xx * yy - xy * xy) AS by_, a, b, t FROM g), q AS (SELECT pos, rep, (bx * a + by_ * b) / t AS r2, bx / sqrt(bx * bx + by_ * by_) AS dx, by_ / sqrt(bx * bx + by_ * by_) AS dy FROM f) SELECT 'cell' || o.pos AS name, {r('any_value(o.r2)')} AS r2, {r('(count(*) FILTER (q.r2 >= o.r2 - 1e-12) + 1) / 40.0')} AS p, {r('any_value(o.dx)')} AS dx, {r('any_value(o.dy)')} AS dy FROM q o JOIN q ON q.pos = o.pos AND q.rep > 0 WHERE o.rep = 0 GROUP BY o.pos", "members")
def _(spark, d):
    """All maps laid out by their first two cells; every fourth other cell as a covariate."""
    m = L.members(spark, d)
    lay = m.groupBy("member").agg(F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("x"), F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("y"))
    cov = m.filter("pos >= 2 AND pos % 4 = 2").select(F.concat(F.lit("cell"), "pos").alias("name"), "member", "value")
    return show(E.envfit(lay, cov, permutations=_REPS, seed=5), "name", r2="r2", p="p", dx="dx", dy="dy")


@query("permutation_factors", f"+{_PERMUTED.format(rnd=_rnd(10))}, c AS (SELECT DISTINCT 'label' AS name, plc.i AS j, grp AS value FROM members JOIN plc USING (member) UNION ALL SELECT 'third', i, CAST(member % 3 AS INTEGER) FROM plc), g AS (SELECT name, rep, value, count(*) AS n, sum(x - mx) AS sx, sum(y - my) AS sy, sum(power(x - mx, 2) + power(y - my, 2)) AS q FROM per JOIN plc USING (i) JOIN c USING (j), (SELECT avg(x) AS mx, avg(y) AS my FROM plc) GROUP BY ALL), q AS (SELECT name, rep, sum((sx * sx + sy * sy) / n) / sum(q) AS r2 FROM g GROUP BY ALL) SELECT o.name, {r('any_value(o.r2)')} AS r2, {r('(count(*) FILTER (q.r2 >= o.r2 - 1e-12) + 1) / 40.0')} AS p FROM q o JOIN q ON q.name = o.name AND q.rep > 0 WHERE o.rep = 0 GROUP BY o.name", "members")
def _(spark, d):
    m = L.members(spark, d)
    lay = m.groupBy("member").agg(F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("x"), F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("y"))
    one = m.filter("pos = 0")
    cov = one.select(F.lit("label").alias("name"), "member", F.col("grp").cast("int").alias("value")).union(one.select(F.lit("third"), "member", (F.col("member") % 3).cast("int")))
    return show(E.envfit(lay, cov, "factor", permutations=_REPS, seed=9), "name", r2="r2", p="p")


@query("member_correlations", f"+z AS (SELECT member, pos, (value - avg(value) OVER (PARTITION BY member)) AS v FROM members), s AS (SELECT member, sqrt(sum(v * v)) AS s FROM z GROUP BY member) SELECT a.member AS a, b.member AS b, {r('sum(a.v * b.v) / any_value(x.s * y.s)')} AS r FROM z a JOIN z b ON a.pos = b.pos AND a.member < b.member JOIN s x ON x.member = a.member JOIN s y ON y.member = b.member GROUP BY 1, 2", "members")
def _(spark, d):
    """All pairs of all maps, by tiles of their Gram matrix."""
    return SS.correlation_matrix(L.members(spark, d), digits=6)


# ------------------------------------------------------------------ constraints and lineage
_OBSERVED = {"row_id": "row", "observation_axes": ["nation", "segment", "decile"], "observation_columns": {"row": {}, "name": {"nullable": False}, "nation": {}, "segment": {}, "decile": {}, "note": {"nullable": True}}}
_CUSTOMERS = "o AS (SELECT 'r' || c_custkey % 140 AS row, CASE WHEN c_acctbal >= 0 THEN c_name END AS name, c_nationkey AS nation, CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS segment, CAST(c_custkey % 10 AS INTEGER) AS decile FROM customer)"


@query("constraint_violations", f"WITH {_CUSTOMERS}, a AS (SELECT 'required name' AS rule, CAST(NULL AS VARCHAR) AS key, count(*) AS rows FROM o WHERE name IS NULL UNION ALL SELECT 'required segment', NULL, count(*) FROM o WHERE segment IS NULL UNION ALL SELECT 'row id', row, count(*) FROM o GROUP BY row HAVING count(*) > 1 UNION ALL SELECT 'axes', '{{\"nation\":' || nation || coalesce(',\"segment\":\"' || segment || '\"', '') || ',\"decile\":' || decile || '}}', count(*) FROM o GROUP BY nation, segment, decile HAVING count(*) > 1) SELECT * FROM a WHERE rows > 0")
def _(spark, d):
    c = L.table(spark, d, "customer")
    obs = c.select(
        F.concat(F.lit("r"), (F.col("c_custkey") % 140).cast("string")).alias("row"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_custkey") % 11 > 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_custkey") % 10).cast("int").alias("decile"), F.lit(None).cast("string").alias("note"),
    )
    return manifest.violations(obs, _OBSERVED)


@query("stale_links", "SELECT s_nationkey AS nation, s_nationkey % 4 = 1 OR s_nationkey % 4 = 2 AS stale FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    """A file of supplier names for each nation; a quarter of the links knew other content, a quarter a file that is gone, a quarter no checksum."""
    at = f"{scratch(spark)}/names"
    s = L.table(spark, d, "supplier").select("s_nationkey", "s_name")
    lists = s.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "\n").alias("value"))
    lists.select("value", F.col("s_nationkey").alias("n")).filter("n % 4 <> 2").write.partitionBy("n").text(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(at).select(F.regexp_extract("path", r"n=(\d+)", 1).alias("file"), "content")
    known = F.concat(F.lit("sha256:"), F.sha2(F.concat("value", F.when(F.col("s_nationkey") % 4 == 1, "!").otherwise("\n")), 256))
    links = lists.select(F.col("s_nationkey").alias("nation"), F.col("s_nationkey").cast("string").alias("source"), F.when(F.col("s_nationkey") % 4 != 3, known).alias("checksum"))
    return manifest.stale_links(links, files).select("nation", "stale")


@query("noise_member", f"+{draws(1, 128, 3)}, z AS (SELECT member, pos, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM members WINDOW w AS (PARTITION BY member)) SELECT member, pos, {r('value')} AS value FROM z UNION ALL SELECT (SELECT max(member) + 1 FROM members), CAST(a.n // 2 AS INTEGER), {r('sqrt(-2 * ln(greatest(a.u, 1e-300::DOUBLE))) * cos(2 * pi() * b.u)')} FROM rnd a JOIN rnd b ON b.n = a.n + 1 WHERE a.n % 2 = 0", "members")
def _(spark, d):
    """All maps standardised, and one of noise beside them."""
    return show(SS.noise_member(SS.standardize(L.members(spark, d)), 3), "member", "pos", value="value")
