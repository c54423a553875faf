"""Number rules, geometry, random numbers, t distribution, policies for missing values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import num
from gridloom.functions import stats as ST
from gridloom.grid import Grid
from gridloom.operators import embed as E
from gridloom.operators import reduce as R
from gridloom.operators import setstats as SS
from gridloom.operators import volume as V
from gridloom.rng import mulberry32

NAN = float("nan")


def values(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "idx long, value double")


def test_rounding_goes_up_at_halves(spark):
    d = values(spark, [-0.5, 0.5, 1.5, -1.5]).select(num.js_round("value").alias("r"))
    assert [r[0] for r in d.collect()] == [0, 1, 2, -1]


def test_division_by_zero_is_zero(spark):
    a, b = values(spark, [1, 2]), values(spark, [0, 4])
    assert {r[0]: r[1] for r in V.divide(a, b).collect()} == {0: 0.0, 1: 0.5}


def test_nan_never_compares(spark):
    a = values(spark, [NAN, 3.0, 1.0])
    assert [r["value"] for r in V.greater(a, 2.0).orderBy("idx").collect()] == [False, True, False]
    assert [r["idx"] for r in V.threshold(a, 3.0, "neq").orderBy("idx").collect()] == [0, 2]


def test_volume_stats_with_nan(spark):
    r = R.volume_stats(values(spark, [NAN, 1.0, float("inf")])).first()
    assert math.isnan(r["sum"]) and r["min"] == 1.0 and r["max"] == float("inf") and r["hi"] == 1.0
    assert R.volume_stats(values(spark, [])).first()["sum"] == 0.0


def test_one_sample_t_of_known_values(spark):
    d = spark.createDataFrame([(0, s, float(v)) for s, v in enumerate([1, 2, 3, 4, 5, 6])], "pos int, subject int, value double")
    r = R.group_maps(R.sufficient(d)).first()
    assert r["mean"] == 3.5 and abs(r["sd"] - 1.8708287) < 1e-6 and abs(r["t"] - 4.5825757) < 1e-6
    w = R.two_groups(d, F.col("subject") < 3, F.col("subject") >= 3).first()
    assert abs(w["t"] + 3.6742346) < 1e-6


def test_missing_subjects_are_skipped(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 1, NAN), (0, 2, 3.0)], "pos int, subject int, value double")
    r = R.group_maps(R.sufficient(d)).first()
    assert (r["count"], r["mean"]) == (2, 2.0)


def test_leave_one_out_equals_recomputation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=7)
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "pos int, subject int, value double")
    for r in R.leave_one_out(d).collect():
        o = np.delete(x, r["subject"])
        assert abs(r["loo_mean"] - o.mean()) < 1e-12 and abs(r["loo_m2"] - ((o - o.mean()) ** 2).sum()) < 1e-9


def test_split_scale_leaves_single_samples(spark):
    s = spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0), (0, 2, 3.0)], "idx int, t int, value double")
    f = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "t int, level int")
    got = {r["t"]: r["value"] for r in R.split_scale(s, f).collect()}
    assert got[0] == 5.0 and abs(got[1] + math.sqrt(0.5)) < 1e-12


def test_grid_round_trip_and_reorient(spark):
    g = Grid((3, 4, 5), affine=np.array([[0, 2.0, 0, 1], [-3.0, 0, 0, 2], [0, 0, 1.5, 3], [0, 0, 0, 1]]))
    d = g.cells(spark)
    back = d.select("idx", g.nearest_index(*g.world_of_index("idx")).alias("b")).filter("idx <> b or b is null")
    assert back.count() == 0
    h = g.reorient((2, 0, 1), (True, False, True))
    a = d.select("idx", *[c.alias(n) for c, n in zip(g.world_of_index("idx"), "xyz", strict=True)])
    b = d.select(g.reorient_index("idx", (2, 0, 1), (True, False, True)).alias("idx"), "idx").toDF("new", "idx")
    w = h.cells(spark).select(F.col("idx").alias("new"), *[c.alias(f"{n}2") for c, n in zip(h.world_of_index("idx"), "xyz", strict=True)])
    j = a.join(b, "idx").join(w, "new").filter("abs(x - x2) + abs(y - y2) + abs(z - z2) > 1e-9")
    assert j.count() == 0 and h.dim == (5, 3, 4)
    assert Grid((2, 2, 2)).orientation() == ("right", "anterior", "superior")
    with pytest.raises(ValueError):
        Grid((0, 1, 1))


def test_t_distribution():
    for df, q in ((9, 2.262157), (1, 12.7062), (100, 1.983972)):
        assert abs(ST.t_quantile(0.975, df) - q) < 1e-4
    assert abs(ST.t_p(2.5, 12) - 0.02788) < 1e-4
    assert math.isnan(ST.t_quantile(0.9, 0)) and ST.beta_inc(0.0, 1, 1) == 0.0


def test_within_subject_interval(spark):
    from gridloom.operators.design import summarise

    d = spark.createDataFrame([("s1", "a", 10.0), ("s1", "b", 12.0), ("s2", "a", 0.0), ("s2", "b", 3.0), ("s3", "a", 5.0), ("s3", "b", 6.0)], "subject string, cond string, value double")
    a = summarise(d, ["cond"], "subject").filter("cond = 'a'").first()
    assert a["mean"] == 5 and abs(a["hi"] - a["mean"] - 4.302653 * 5 / math.sqrt(3)) < 1e-4
    w = summarise(d, ["cond"], "subject", ["cond"]).filter("cond = 'a'").first()
    assert abs(w["hi"] - w["mean"] - 4.302653 * 0.5 * math.sqrt(2) / math.sqrt(3)) < 1e-4
    gap = d.filter("not (subject = 's3' and cond = 'b')")
    r = summarise(gap, ["cond"], "subject", ["cond"]).filter("cond = 'a'").first()
    assert r["mean"] == 5 and r["n"] == 3  # incomplete subjects leave the interval only


def test_generator_is_seeded():
    a, b = mulberry32(7), mulberry32(7)
    x = [a() for _ in range(5)]
    assert x == [b() for _ in range(5)] and all(0 <= v < 1 for v in x) and len(set(x)) == 5


def test_decompositions_add_up(spark):
    rng = np.random.default_rng(1)
    k, n = 5, 40
    d = spark.createDataFrame([(m, p, float(v)) for m, row in enumerate(rng.normal(size=(k, n))) for p, v in enumerate(row)], "member int, pos int, value double")
    z = SS.standardize(d)
    r = {(x["a"], x["b"]): x["r"] for x in SS.correlation_matrix(d).collect()}
    assert abs(SS.sum_over(SS.pair_contributions(z, 0, 1, n)).first()["total"] - r[0, 1]) < 1e-9
    assert abs(SS.dispersion(z, n).agg(F.sum("d")).first()[0] - sum(1 - v for v in r.values())) < 1e-9
    f = SS.focused(z, 2, n).agg(F.sum(F.col("own") + F.col("baseline"))).first()[0]
    mean = np.mean([1 - v for (a, b), v in r.items() if 2 in (a, b)])
    assert abs(f - mean) < 1e-9
    total = SS.focused_all(z, n).filter("member = 2").agg(F.sum("term")).first()[0]
    assert abs(total - mean) < 1e-9


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    y, stress, kind = E.nmds(spark, d, starts=2)
    assert kind == "nonmetric" and stress < 0.02
    assert np.abs(E.align(y, x, scale=True) - x).max() < 0.35
    assert list(E.isotonic(np.array([1.0, 3.0, 2.0, 4.0]))) == [1.0, 2.5, 2.5, 4.0]
    t = E.average_linkage(d)
    order = E.optimal_leaf_order(t, d)
    assert sorted(order) == list(range(12)) and E.path_length(order, d) <= E.path_length(t.leaves(22), d) + 1e-12
    assert len(set(E.cut_tree(t, 3))) == 3


def test_blob_with_known_answer(spark):
    from gridloom.operators import components as C

    g = Grid((12, 12, 12), (2.0, 2.0, 2.0), (-20.0, -20.0, -20.0))
    rows = [(i + j * 12 + k * 144, 5.0 if (i, j, k) == (5, 5, 5) else 4.0) for i in (4, 5, 6) for j in (4, 5, 6) for k in (4, 5, 6)]
    c = C.cluster_table(C.label_components(spark.createDataFrame(rows, "idx long, value double"), g, 3.0), g).first()
    assert (c["size"], c["ci"], c["cx"], c["peak"], c["peak_idx"]) == (27, 5.0, -10.0, 5.0, 5 + 60 + 720)
    assert abs(c["mean"] - 4.037037) < 1e-6
    diag = spark.createDataFrame([(0, 1.0), (13 * 12 + 1, 1.0)], "idx long, value double")
    assert C.label_components(diag, g, 0.5, 26).select("label").distinct().count() == 1
    assert C.label_components(diag, g, 0.5, 18).select("label").distinct().count() == 2


def test_components_over_tiles(spark):
    """Components across borders of tiles equal a flood fill, however links between tiles are contracted."""
    from gridloom.operators import components as C
    from gridloom.operators.stencil import neighbour_offsets

    g = Grid((11, 9, 6))
    rng = np.random.default_rng(4)
    on = {int(i): int(rng.integers(0, 2)) for i in np.flatnonzero(rng.random(g.size) < 0.45)}
    cells = spark.createDataFrame(list(on.items()), "idx long, sign int")
    at = lambda i: (i % 11, i // 11 % 9, i // 99)
    for connectivity, same in ((6, None), (26, "sign"), (18, None)):
        want, seen = {}, set()
        for i in sorted(on):
            if i in seen:
                continue
            todo, seen = [i], seen | {i}
            while todo:
                c = todo.pop()
                want[c] = i
                for o in neighbour_offsets(connectivity):
                    p = tuple(x + y for x, y in zip(at(c), o, strict=True))
                    n = p[0] + 11 * p[1] + 99 * p[2]
                    if all(0 <= x < m for x, m in zip(p, g.dim, strict=True)) and n in on and n not in seen and (same is None or on[n] == on[c]):
                        seen.add(n)
                        todo.append(n)
        for edges in (10**6, 0) if connectivity == 6 else (10**6,):
            got = {r["idx"]: r["root"] for r in C.roots(cells, g, connectivity, same, edges, 4).collect()}
            assert got == want
