"""Running totals and row numbers in one order over all rows, without a task that sees them all.

A window without a partition sorts everything in one task.  Here rows are dealt by ranges of the order, each
range runs its own window, and only one row per range (its totals) is summed up across ranges.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in ``spark.checkpoint.dir``; a temporary one where none is set on a local master, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gridloom-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read back.

    For tables that many rounds rewrite: a checkpoint inherits what its plan knew of the columns, which grows round by round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    at = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def with_totals(df: DataFrame, key: str, **totals: Column) -> DataFrame:
    """``df`` with aggregates of its rows by a non-null ``key``, as windows over the key would give them.

    The aggregates are combined before any shuffle and joined back (a broadcast where there are few keys), so a
    key with most of the rows is neither sorted nor held by one task.
    """
    t = df.groupBy(F.col(key).alias("__key")).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(t, F.col(key) == F.col("__key")).drop("__key")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], row: str | None = None) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of the column over all rows before in ``order`` (0 for the first).

    ``row``: name of a column for the number of rows before.  ``order`` must not have large groups of ties.
    """
    sums = {**sums, **({row: F.lit(1).cast("long")} if row else {})}
    own = {f"__v{i}": c for i, c in enumerate(sums.values())}
    placed = cut(df.repartitionByRange(*order).withColumns({**own, "__range": F.spark_partition_id()}))
    totals = placed.groupBy("__range").agg(*[F.sum(v).alias(v) for v in own])
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges
    base = totals.select("__range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}b") for v in own])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(F.broadcast(base), "__range")
    for name, v in zip(sums, own, strict=True):
        out = out.withColumn(name, F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{v}b"))
    return out.drop("__range", *own, *[f"{v}b" for v in own])


def quantiles(df: DataFrame, value: str, probabilities: list[float]) -> list[float | None]:
    """Exact type-7 quantiles of a column without nulls; None for an empty one.

    Values are counted first, so a frequent value is one row; only the values at the wanted ranks reach the driver.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    r = cut(running(counts, [F.col("v")], {"before": F.col("n")}))
    total = r.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [None] * len(probabilities)
    spots = [(total - 1) * p for p in probabilities]
    want = sorted({min(int(s) + k, total - 1) for s in spots for k in (0, 1)})
    hit = r.filter(F.exists(F.array(*map(F.lit, want)), lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("n")))).collect()  # two rows a quantile at most
    at = {w: x["v"] for w in want for x in hit if x["before"] <= w < x["before"] + x["n"]}
    return [at[int(s)] + (s - int(s)) * (at[min(int(s) + 1, total - 1)] - at[int(s)]) if s > int(s) else at[int(s)] for s in spots]


#: values of one key that a task may hold for a quantile (a few MB)
HELD = 100_000


def quantiles_by(df: DataFrame, by: str, values: list[str], probabilities: list[float], held: int = HELD) -> DataFrame:
    """by, name (of ``values``), n, q (array): exact type-7 quantiles of several columns for every ``by``, null for no values.

    Where no key has more than ``held`` rows, which is counted first, one aggregate holds each key's values.  Otherwise equal values
    of a key are counted, then all (name, key, value) are put in one order by ranges, whose running totals say
    which of them hold the wanted ranks; so no task holds a key's values, however many keys there are or however large one is.
    """
    kind = df.schema[by].dataType.simpleString()
    long = df.select(F.col(by).alias("__k"), F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")).select("__k", "x.*")
    if (df.groupBy(by).count().agg(F.max("count")).first()[0] or 0) <= held:
        n = F.count("v")
        q = F.percentile("v", F.array(*[F.lit(float(p)) for p in probabilities]))
        return long.groupBy(F.col("__k").alias(by), "name").agg(n.alias("n"), F.coalesce(q, F.array(*[F.lit(None).cast("double")] * len(probabilities))).alias("q"))
    counts = long.groupBy("name", "__k", "v").agg(F.count("v").alias("c"))
    r = running(counts, [F.col("name"), F.col("__k"), F.col("v")], {"before": F.col("c")})
    whole = r.groupBy("name", "__k").agg(F.min("before").alias("base"), F.sum("c").alias("n"))
    named = whole.select(F.col("name").alias("__name"), F.col("__k").alias("__key"), "base", "n")
    j = r.filter("c > 0").select("name", "__k", "v", "c", "before").join(named, (F.col("name") == F.col("__name")) & F.col("__k").eqNullSafe(F.col("__key")))
    first = F.col("before") - F.col("base")
    picks = []
    for i, p in enumerate(probabilities):
        spot = (F.col("n") - 1) * F.lit(float(p))
        low = F.floor(spot)
        holds = lambda rank: (rank >= first) & (rank < first + F.col("c"))
        picks += [F.max(F.when(holds(low), F.col("v"))).alias(f"a{i}"), F.max(F.when(holds(F.least(low + 1, F.col("n") - 1)), F.col("v"))).alias(f"b{i}"), F.max(spot - low).alias(f"f{i}")]
    found = j.groupBy("name", "__k", "n").agg(*picks)
    q = F.array(*[F.when(F.col(f"f{i}") > 0, F.col(f"a{i}") + F.col(f"f{i}") * (F.col(f"b{i}") - F.col(f"a{i}"))).otherwise(F.col(f"a{i}")) for i in range(len(probabilities))])
    some = found.select(F.col("__k").cast(kind).alias(by), "name", "n", q.alias("q"))
    none = whole.filter("n = 0").select(F.col("__k").alias(by), "name", "n", F.array(*[F.lit(None).cast("double")] * len(probabilities)).alias("q"))
    return some.unionByName(none)


def with_quantiles(df: DataFrame, by: str, value: str, probabilities: list[float], name: str) -> DataFrame:
    """``df`` with an array column ``name`` of its key's :func:`quantiles_by` of one column."""
    q = quantiles_by(df, by, [value], probabilities).select(F.col(by).alias("__by"), F.col("q").alias(name))
    return df.join(q, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of rows before each in ``order``."""
    return running(df, order, {}, name)
