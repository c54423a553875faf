"""Incremental forms: mergeable moments on streams, chunked processing.

Count, sum and sum of squares merge by addition, so a streaming aggregate per (window, cell) keeps
constant state per cell and late rows within the watermark are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.num import finite


def streaming_moments(events: DataFrame, time: str, cell: str, value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, cell, count, mean, sd) of finite values per event-time window; works on batch and streaming input."""
    x = finite(value)
    d = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant
    d = d.withWatermark(time, late) if d.isStreaming else d
    n = F.count(x)
    g = d.groupBy(F.window(time, window).alias("w"), cell).agg(n.alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return g.select(F.col("w.start").alias("start"), cell, "count", "mean", "sd")


def completed(result: DataFrame, at: str) -> DataFrame:
    """The result of a streaming aggregate over all that has come, written by tasks as Parquet under ``at`` with its checkpoint; none of it passes the driver."""
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")
        last.append(number)

    result.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = result.sparkSession
    return spark.read.schema(result.schema).parquet(f"{at}/batch={last[-1]}") if last else spark.createDataFrame([], result.schema)


def merge_moments(a: DataFrame, b: DataFrame, cell: str = "pos", sign: int = 1) -> DataFrame:
    """Sufficient statistics of a union (sign 1), or of ``a`` without ``b`` (sign -1), per cell."""
    j = a.join(b.select(cell, *[F.col(c).alias(f"b_{c}") for c in ("count", "sum", "m2")]), cell, "left").fillna(0, ["b_count", "b_sum", "b_m2"])
    n = F.col("count") + sign * F.col("b_count")
    s = F.col("sum") + sign * F.col("b_sum")
    raw = lambda c, t, q: q + F.when(c > 0, t * t / F.when(c > 0, c)).otherwise(0.0)
    total = raw(F.col("count"), F.col("sum"), F.coalesce("m2", F.lit(0.0))) + sign * raw(F.col("b_count"), F.col("b_sum"), F.col("b_m2"))
    m2 = F.when(n > 0, F.greatest(total - s * s / F.when(n > 0, n), F.lit(0.0)))
    return j.select(cell, n.alias("count"), s.alias("sum"), F.when(n > 0, s / F.when(n > 0, n)).alias("mean"), m2.alias("m2"))


def process_chunks(series: DataFrame, f: Callable, schema: str, chunk: int = 100, axis: str = "t", cell_parts: int = 1) -> DataFrame:
    """f(pandas frame) on chunks of consecutive time points, each a group of its own.

    A group holds ``chunk`` rows of every cell; with ``cell_parts`` the cells (idx) are dealt over that many groups,
    for functions that treat cells apart.
    """
    d = series.withColumns({"__chunk": F.floor(F.col(axis) / chunk), "__part": F.pmod(F.xxhash64("idx"), F.lit(cell_parts)) if cell_parts > 1 else F.lit(0)})
    return d.groupBy("__chunk", "__part").applyInPandas(lambda pdf: f(pdf.drop(columns=["__chunk", "__part"])), schema)


def for_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands every micro-batch to ``sink``, once per batch id."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
