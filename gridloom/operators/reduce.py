"""Aggregations: whole volumes, per cell over time or subjects, factor splits, named dimensions.

Each function states what it does with NaN: *skips* converts to NULL first, *keeps* lets it through.
Sample statistics divide by n - 1 unless a function says population.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.num import NAN, div, finite, is_finite, not_nan, or_nan, pearson
from gridloom.operators.order import quantiles, quantiles_by, with_totals

# ------------------------------------------------------------------ expressions
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": lambda c: F.min(not_nan(c)),
    "max": lambda c: F.max(not_nan(c)),
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "count": F.count,
}
POPULATION = REDUCERS | {"std": F.stddev_pop, "var": F.var_pop}


def volume_stats(v: DataFrame) -> DataFrame:
    """sum and mean keep NaN (0 if empty); min and max skip it; range is over finite values."""
    return v.agg(
        F.coalesce(F.sum(F.col("value")), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(F.col("value")), F.lit(0.0)).alias("mean"), F.min(not_nan(F.col("value"))).alias("min"), F.max(not_nan(F.col("value"))).alias("max"),
        F.min(finite(F.col("value"))).alias("lo"), F.max(finite(F.col("value"))).alias("hi"), F.count(F.col("value")).alias("n"),
    )


def stat(v: DataFrame, name: str) -> DataFrame:
    """One statistic as a row: mean, std, min, max skip NaN (NaN if nothing is left), sum keeps it, median is exact."""
    x = F.col("value") if name in ("sum", "median") else not_nan(F.col("value"))
    return v.agg(or_nan(REDUCERS[name](x)).alias(name))


def sparsity(v: DataFrame, cells: int) -> DataFrame:
    return v.agg(F.count(F.lit(1)).alias("stored"), (F.count(F.lit(1)) / float(cells)).alias("ratio"))


def temporal(series: DataFrame, name: str) -> DataFrame:
    """(idx, value): mean, std (n - 1), min, max or median over time of each cell; mean and std keep NaN."""
    return series.groupBy("idx").agg(REDUCERS[name](F.col("value")).alias("value"))


def reduce_dims(hyper: DataFrame, dims: list[str], name: str, keep_dims: bool = False) -> DataFrame:
    """Reduce named dimensions; std and var are population values.  ``keep_dims`` leaves them as 0."""
    rest = [c for c in hyper.columns if c not in (*dims, "value")]
    out = hyper.groupBy(*rest).agg(POPULATION[name](F.col("value")).alias("value"))
    return out.withColumns({d: F.lit(0) for d in dims}) if keep_dims else out


# ------------------------------------------------------------------ subject stacks (idx or pos, subject, value)
def sufficient(stack: DataFrame, cell: str = "pos") -> DataFrame:
    """count, sum, mean and m2 of the finite values of each cell; mergeable, so one shuffle of partial results."""
    x = finite("value")
    n = F.count(x)
    return stack.groupBy(cell).agg(n.alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.when(n > 0, F.var_pop(x) * n).alias("m2"))


def _var() -> Column:
    return F.when(F.col("count") > 1, F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("count") - 1))


def group_maps(stats: DataFrame) -> DataFrame:
    """mean, sd, effect (mean / sd) and one-sample t from sufficient statistics; NULL where undefined."""
    v = _var()
    ok = v > 0
    return stats.withColumns({"sd": F.sqrt(v), "effect": F.when(ok, F.col("mean") / F.sqrt(F.when(ok, v))), "t": F.when(ok, F.col("mean") / F.sqrt(F.when(ok, v) / F.col("count")))})


def _side(cond: Column, p: str) -> list[Column]:
    x = F.when(cond, finite("value"))
    return [F.count(x).alias(f"n{p}"), F.avg(x).alias(f"m{p}"), F.var_samp(x).alias(f"v{p}")]


def two_groups(stack: DataFrame, in_a: Column, in_b: Column, cell: str = "pos") -> DataFrame:
    """Difference of means and Welch t per cell in one pass of six conditional aggregates."""
    d = stack.groupBy(cell).agg(*_side(in_a, "a"), *_side(in_b, "b"))
    den = F.when((F.col("na") > 1) & (F.col("nb") > 1), F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))
    return d.select(cell, (F.col("ma") - F.col("mb")).alias("diff"), F.when(den > 0, (F.col("ma") - F.col("mb")) / F.sqrt(F.when(den > 0, den))).alias("t"))


def paired_difference(a: DataFrame, b: DataFrame, cell: str = "pos", subject: str = "subject") -> DataFrame:
    """Subject-wise differences, to be fed to :func:`sufficient`."""
    return a.select(cell, subject, F.col("value").alias("x")).join(b.select(cell, subject, F.col("value").alias("y")), [cell, subject]).select(cell, subject, (F.col("x") - F.col("y")).alias("value"))


def consistency(stack: DataFrame, cutoff: float, output: str = "count", cell: str = "pos") -> DataFrame:
    """Subjects beyond +-cutoff in the direction of the group mean (0 where the mean is 0); share of the valid ones, or their count."""
    x = finite("value")
    d = stack.groupBy(cell).agg(F.avg(x).alias("m"), F.count(x).alias("n"), F.count_if(x > cutoff).alias("up"), F.count_if(x < -cutoff).alias("down"))
    k = F.when(F.col("m") > 0, F.col("up")).when(F.col("m") < 0, F.col("down")).otherwise(0)
    return d.select(cell, F.when(F.col("n") > 0, k if output == "count" else k / F.col("n")).alias("value"))


def leave_one_out(stack: DataFrame, cell: str = "pos") -> DataFrame:
    """Every subject's row with count, mean and m2 of the others, by subtraction from the cell's totals."""
    x = F.col("x")
    d = with_totals(stack.withColumn("x", finite("value")).filter("x is not null"), cell, n=F.count(x), m=F.avg(x), v=F.var_pop(x))
    k = F.col("n") - 1
    mean = F.when(k > 0, (F.col("m") * F.col("n") - F.col("x")) / F.when(k > 0, k))
    m2 = F.greatest(F.col("v") * F.col("n") - (F.col("x") - F.col("m")) * (F.col("x") - mean), F.lit(0.0))
    return d.withColumns({"loo_count": k, "loo_mean": mean, "loo_m2": F.when(k > 0, m2)}).drop("x", "n", "m", "v")


def prevalence(stack: DataFrame, t: float, cell: str = "pos") -> DataFrame:
    """(members above t - members below -t) / finite members."""
    x = finite("value")
    return stack.groupBy(cell).agg(div(F.count_if(x > t) - F.count_if(x < -t), F.count(x)).alias("value"))


#: named reducers of a subject stack; users may add their own
REVIEW: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mean": lambda s: group_maps(sufficient(s)).select("pos", F.col("mean").alias("value")),
    "sd": lambda s: group_maps(sufficient(s)).select("pos", F.col("sd").alias("value")),
    "effect": lambda s: group_maps(sufficient(s)).select("pos", F.col("effect").alias("value")),
    "t": lambda s: group_maps(sufficient(s)).select("pos", F.col("t").alias("value")),
    "consistency": lambda s: consistency(s, 0.0, "proportion"),
}


def review(stack: DataFrame, name: str, subjects: list | None = None, subject: str = "subject") -> DataFrame:
    """A registered reducer over all or some subjects."""
    return REVIEW[name](stack if subjects is None else stack.filter(F.col(subject).isin(subjects)))


def correlate_dims(hyper: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """(a, b, r): for each level of one named dimension and each of another, the correlation of their means over
    the cells of all remaining dimensions; NULL below ``least`` common cells or without variance.
    """
    rest = [c for c in hyper.columns if c not in (a, b, "value")]
    x, y = (hyper.groupBy(c, *rest).agg(F.avg(finite("value")).alias(n)) for c, n in ((a, "x"), (b, "y")))
    return x.join(y, rest).groupBy(a, b).agg(pearson("x", "y", least).alias("r"))


def validate_stack(contrasts: dict[str, DataFrame], subject: str = "subject") -> None:
    """Contrasts must hold the same number of distinct subjects, each once per cell."""
    counts = set()
    for name, d in contrasts.items():
        n, u = d.agg(F.count_distinct(subject), F.max("c")).first() if "c" in d.columns else (d.select(subject).distinct().count(), 1)
        if d.groupBy("pos", subject).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name}: a subject repeats")
        counts.add(n)
    if len(counts) > 1:
        raise ValueError("contrasts differ in subjects")


# ------------------------------------------------------------------ labels and bins
def parcel_sums(cells: DataFrame) -> DataFrame:
    """(parcel, sum, n): per label, label 0 as 'outside', and 'total', in one pass of grouping sets."""
    name = F.when(F.grouping("label") == 1, "total").when(F.col("label") == 0, "outside").otherwise(F.col("label").cast("string"))
    return cells.groupingSets([["label"], []], "label").agg(F.sum("value").alias("sum"), F.count("value").alias("n"), name.alias("parcel")).select("parcel", "sum", "n")


def histogram(v: DataFrame, lo: float, hi: float, bins: int = 72) -> DataFrame:
    """(bin, n) of equal bins, the last one closed; zeros and values outside are skipped, empty bins count 0."""
    at = F.least(F.floor((F.col("value") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    got = v.filter((F.col("value") != 0) & F.col("value").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return v.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def cluster_info(labels: DataFrame, how: str = "mean") -> DataFrame:
    """(label, size, i, j, k): sizes and centres (mean or median) of labelled cells (idx, label, i, j, k), label 0 left out."""
    f = F.avg if how == "mean" else (lambda c: F.percentile(c, F.lit(0.5)))
    return labels.filter("label <> 0").groupBy("label").agg(F.count(F.lit(1)).alias("size"), *[f(a).alias(a) for a in "ijk"])


def heterogeneity(d: DataFrame, by: str) -> DataFrame:
    """Cochran's Q, df, I2 and DerSimonian-Laird tau2 from beta and se, weights 1 / se^2, one pass."""
    w = F.when(is_finite("beta") & is_finite("se") & (F.col("se") > 0), 1 / (F.col("se") * F.col("se")))
    b = F.col("beta")
    a = d.groupBy(by).agg(F.count(w).alias("k"), F.sum(w).alias("w"), F.sum(w * b).alias("wb"), F.sum(w * b * b).alias("wbb"), F.sum(w * w).alias("ww"))
    q = F.greatest(F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w"), F.lit(0.0))
    a = a.filter("k > 0").withColumns({"q": q, "df": F.col("k") - 1})
    c = F.col("w") - F.col("ww") / F.col("w")
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.when(F.col("q") > 0, F.col("q")))).otherwise(0.0)
    tau2 = F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.when(c > 0, c))).otherwise(0.0)
    return a.select(by, "k", "q", "df", i2.alias("i2"), tau2.alias("tau2"))


def reliability(d: DataFrame, by: str) -> DataFrame:
    """1 - mean(se^2) / var_pop(beta) over cells where both are finite."""
    ok = is_finite("beta") & is_finite("se")
    b, s = F.when(ok, F.col("beta")), F.when(ok, F.col("se"))
    return d.groupBy(by).agg((1 - div(F.avg(s * s), F.var_pop(b))).alias("reliability"))


def tukey_outliers(d: DataFrame, by: str | None = None) -> DataFrame:
    """Rows outside the type-7 quartiles -+ 1.5 IQR; none where a group has fewer than 4."""
    if by is None:
        lo, hi = quantiles(d, "value", [0.25, 0.75])
        e = d.withColumns({"q": F.array(*[F.lit(x).cast("double") for x in (lo, hi)]), "n": F.lit(d.filter("value is not null").count())})
    else:
        q = quantiles_by(d, by, ["value"], [0.25, 0.75]).select(F.col(by).alias("__by"), "n", "q")
        e = d.join(q, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    iqr = F.col("q")[1] - F.col("q")[0]
    return e.filter((F.col("n") >= 4) & ((F.col("value") < F.col("q")[0] - 1.5 * iqr) | (F.col("value") > F.col("q")[1] + 1.5 * iqr))).drop("q", "n")


# ------------------------------------------------------------------ factor splits
def split_fill(series: DataFrame, factor: DataFrame) -> DataFrame:
    """(level, idx, t, value): time points by factor level, renumbered from 0 within it."""
    j = series.join(factor, "t")
    return j.select("level", "idx", (F.row_number().over(W.partitionBy("level", "idx").orderBy("t")) - 1).alias("t"), "value")


def split_reduce(series: DataFrame, factor: DataFrame, name: str = "mean") -> DataFrame:
    """FUN per (cell, level), then the unweighted mean over levels."""
    d = series.join(factor, "t").groupBy("idx", "level").agg(REDUCERS[name](F.col("value")).alias("value"))
    return d.groupBy("idx").agg(F.avg("value").alias("value"))


def split_scale(series: DataFrame, factor: DataFrame, center: bool = True, scale: bool = True) -> DataFrame:
    """z-score within (cell, level): levels of one sample stay, sd 0 counts as 1, without centring deviations are from 0."""
    w = W.partitionBy("idx", "level")
    d = series.join(factor, "t").withColumns({"n": F.count("value").over(w), "m": F.avg("value").over(w) if center else F.lit(0.0)})
    dev = F.col("value") - F.col("m")
    ss = F.sum(dev * dev).over(w)
    sd = F.sqrt(ss / F.greatest(F.col("n") - 1, F.lit(1)))
    sd = F.when(sd > 0, sd).otherwise(1.0) if scale else F.lit(1.0)
    return d.select("idx", "t", "level", F.when(F.col("n") >= 2, dev / sd).otherwise(F.col("value")).alias("value"))


def split_blocks(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cells with their block id (blocks: idx, block)."""
    return values.join(blocks, "idx")


def split_clusters(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, idx, value) per label above 0; series are averaged over time."""
    return values.join(labels.filter("label > 0"), "idx").groupBy("label", "idx").agg(F.avg("value").alias("value"))


def split_at(hyper: DataFrame, dim: str, cuts: list[int]) -> DataFrame:
    """Cut a numeric dimension before the given positions: segment number, and the position within it."""
    seg = sum(((F.col(dim) >= c).cast("int") for c in cuts), F.lit(0))
    start = F.lit(0)
    for c in sorted(cuts):
        start = F.when(F.col(dim) >= c, c).otherwise(start)
    return hyper.withColumns({"segment": seg, dim: F.col(dim) - start})


def concat_dim(a: DataFrame, b: DataFrame, dim: str, offset: int) -> DataFrame:
    """``b`` behind ``a`` along a named dimension."""
    return a.unionByName(b.withColumn(dim, F.col(dim) + offset))


def set_sub_volume(hyper: DataFrame, sub: DataFrame) -> DataFrame:
    """Cells of ``sub`` replace those of ``hyper`` (all columns but value are the key)."""
    keys = [c for c in hyper.columns if c != "value"]
    return hyper.join(sub.select(keys), keys, "left_anti").unionByName(sub.select(hyper.columns))


def cell_counts(d: DataFrame, color: str, facet: str) -> DataFrame:
    """Distinct subjects overall, by colour and by facet."""
    return d.groupingSets([[color], [facet], []], color, facet).agg(F.count_distinct("subject").alias("n"))


def focused_shares(z: DataFrame, labels: DataFrame) -> DataFrame:
    """(member, label, share): each parcel's part of a member's total; outside (label 0) counts in the total only."""
    d = z.join(labels, "pos").groupBy("member", "label").agg(F.sum("value").alias("v"))
    return d.withColumn("share", div(F.col("v"), F.sum("v").over(W.partitionBy("member")))).filter("label <> 0").select("member", "label", "share")


def mask_of_members(values: DataFrame) -> DataFrame:
    """Cells where some member is finite and not 0."""
    return values.groupBy("pos").agg(F.bool_or(is_finite("value") & (F.col("value") != 0)).alias("ok")).filter("ok").select("pos")


def nan() -> Column:
    return F.lit(NAN)
