"""Design tables: cell means, intervals between and within subjects, covariates, factor structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.stats import with_t_quantile
from gridloom.num import is_finite
from gridloom.operators.joins import first_seen_levels


def cell_means(d: DataFrame, cols: list[str], value: str = "value") -> DataFrame:
    return d.groupBy(*cols).agg(F.avg(value).alias("mean"))


def varies_within(d: DataFrame, subject: str, column: str) -> DataFrame:
    """One row: whether every subject has more than one level."""
    return d.groupBy(subject).agg(F.count_distinct(column).alias("n")).agg(F.bool_and(F.col("n") > 1).alias("varies"))


def summarise(d: DataFrame, keys: list[str], subject: str | None = None, within: list[str] | None = None, level: float = 0.95, value: str = "value") -> DataFrame:
    """(keys, mean, lo, hi, n): mean of subject cells with a t interval.

    Without ``within`` the interval is between subjects.  With it (columns of ``keys``; Cousineau-Morey) each
    subject is centred on its mean over the J within-cells, variances are scaled by J / (J - 1), and subjects
    that lack a cell leave the interval, not the mean; J < 2 or no subject falls back to between.
    """
    p = 0.5 + level / 2
    cells = d.filter(is_finite(value)).groupBy(*([subject] if subject else []), *keys).agg(F.avg(value).alias("v")) if subject else d.filter(is_finite(value)).select(*keys, F.col(value).alias("v"))
    if subject and within:
        context = [k for k in keys if k not in within]
        levels = cells.select(*keys).distinct().groupBy(*context).agg(F.count(F.lit(1)).alias("J"))
        j = cells.join(levels, context) if context else cells.withColumn("J", levels.select("J").scalar())
        own, ctx = W.partitionBy(*context, subject), W.partitionBy(*context)
        j = j.withColumns({"own": F.avg("v").over(own), "k": F.count("v").over(own)})
        full = F.col("k") == F.col("J")
        grand = F.avg(F.when(full, F.col("v"))).over(ctx)
        j = j.withColumn("norm", F.when(full, F.col("v") - F.col("own") + grand))
        s = j.groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.count("norm").alias("m"), F.var_samp("norm").alias("wv"), F.var_samp("v").alias("bv"), F.first("J").alias("J"))
        ok = F.col("J") >= 2
        s = s.withColumns({"var": F.when(ok, F.col("wv") * F.col("J") / F.when(ok, F.col("J") - 1)).otherwise(F.col("bv")), "m": F.when(ok, F.col("m")).otherwise(F.col("n"))})
    else:
        s = cells.groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.var_samp("v").alias("var")).withColumn("m", F.col("n"))
    s = with_t_quantile(s.withColumn("df", F.col("m") - 1), "df", p)
    half = F.when(F.col("m") > 1, F.col("tq") * F.sqrt(F.col("var") / F.when(F.col("m") > 1, F.col("m"))))
    return s.select(*keys, "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"), "n")


def infer_columns(d: DataFrame, roles: dict[str, str] | None = None, order: str | None = None) -> list[dict]:
    """Name, kind and levels of each column: numeric if its type is and its role is not a factor's.

    ``levels`` of a factor is a DataFrame (level, ord) of all its values, first seen first.
    """
    out, seen_by = [], order or "__order"
    fields = d.schema.fields
    if order is None:
        d = d.withColumn("__order", F.monotonically_increasing_id())
    for f in fields:
        role = (roles or {}).get(f.name)
        numeric = f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") and role not in ("factor", "within", "between", "subject")
        levels = None
        if not numeric:
            levels = first_seen_levels(d.filter(F.col(f.name).isNotNull()).select(F.col(f.name).alias("level"), seen_by), "level", seen_by).select("level", "ord")
        out.append({"name": f.name, "kind": "numeric" if numeric else "factor", "role": role, "levels": levels})
    return out


def to_long(d: DataFrame, axis: str = "values", weights: DataFrame | None = None) -> DataFrame:
    """Rows by axis position; with a basis (t, a, w) the weighted sum per curve point; non-finite rows are dropped."""
    rest = [c for c in d.columns if c != axis]
    e = d.select(*rest, F.posexplode(axis).alias("a", "value"))
    if weights is not None:
        e = e.join(F.broadcast(weights), "a").groupBy(*rest, "t").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return e.filter(is_finite("value"))


def extract(data: DataFrame, probe: DataFrame) -> DataFrame:
    """(row, axis, value): mean of the finite values under a probe's cells."""
    v = F.when(is_finite("value"), F.col("value"))
    return data.join(probe.select("pos").distinct(), "pos", "left_semi").groupBy("row", "axis").agg(F.avg(v).alias("value"))


def map_of(data: DataFrame, rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(pos, value): axis-weighted response of the chosen rows, averaged over them; a missing lag removes a row's cell."""
    d = data.join(rows.select("row"), "row", "left_semi").join(F.broadcast(weights), "axis")
    bad = F.bool_or(~is_finite("value"))
    r = d.groupBy("row", "pos").agg(F.when(~bad, F.sum(F.when(is_finite("value"), F.col("value") * F.col("w"))) / F.sum("w")).alias("v"))
    return r.groupBy("pos").agg(F.avg("v").alias("value"))
