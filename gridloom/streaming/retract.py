"""Moments of cells that take removals: a change log of maps in, current statistics out.

A change is (cell, value, sign): +1 adds a member's value, -1 takes it away again, as the log of a set of maps holds it.
Each cell keeps count, mean and sum of squared deviations, whatever the number of members, in Spark's state store; a
batch folds a cell's changes into them by merging the moments of what comes and what goes.  With ``idle`` an
event-time timer drops a cell's state that long after its last change.  A query that is started again with its checkpoint
goes on where it stopped; each change counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField("count", LongType()), StructField("mean", DoubleType()), StructField("m2", DoubleType())])
_EPS = float(np.finfo(float).eps)


def merged(state: tuple[int, float, float], values: np.ndarray, sign: int) -> tuple[int, float, float]:
    """Moments (count, mean, m2) with ``values`` added or taken away; those of an empty set are zeros."""
    n, mean, m2 = state
    k = len(values)
    if not k:
        return state
    if sign < 0 and k > n:
        raise ValueError("more values are removed than there are")
    if sign < 0 and k == n:
        return 0, 0.0, 0.0
    low = float(values.mean())
    own = float(((values - low) ** 2).sum())
    left = n + sign * k
    new = mean + sign * k * (low - mean) / left
    rest = m2 + sign * (own + (low - mean) ** 2 * n * k / left) if n else own
    # rounding may leave a little less than nothing
    return left, new, 0.0 if rest < 0 and rest >= -32 * _EPS * max(1.0, m2) * k else rest


class Moments(StatefulProcessor):
    """State of one cell; the time of an event is needed with ``idle_ms`` only."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", STATE)

    def _row(self, key, n: int, mean: float, m2: float, expired: bool) -> pd.DataFrame:
        sd = float(np.sqrt(max(m2, 0.0) / (n - 1))) if n > 1 else None
        return pd.DataFrame({"cell": [key[0]], "count": [n], "mean": [mean if n else None], "sd": [sd], "expired": [expired]}).astype({"mean": float, "sd": float})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0)
        minus, last = [], -1
        for part in rows:  # what comes first: a change log may hold both changes of a value in one batch
            value, sign = part["value"].to_numpy(float), part["sign"].to_numpy()
            ok = np.isfinite(value)
            now = merged(now, value[ok & (sign > 0)], 1)
            minus.append(value[ok & (sign < 0)])
            if self.idle_ms is not None:
                last = max(last, int(part["time"].max().timestamp() * 1000))
        now = merged(now, np.concatenate(minus), -1)
        self.state.update(now)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                last = max(last, t - self.idle_ms)
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, *now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self._row(key, 0, 0.0, 0.0, True)

    def close(self) -> None:
        pass


def retractable_moments(changes: DataFrame, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """cell, count, mean, sd, expired of every cell that a batch changes, from a stream (cell, value, sign; time, with ``idle``).

    Values that are not finite count neither when they come nor when they go.  ``idle``: an interval as Spark writes it.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = changes.schema["cell"].dataType.simpleString()
    d, idle_ms = changes.select("cell", F.col("value").cast("double"), F.col("sign").cast("int"), *(["time"] if idle else [])), None
    if idle:
        d = d.withWatermark("time", late)
        idle_ms = int(spark.range(1).select((F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).alias("ms")).first()[0])
    out = f"cell {kind}, count long, mean double, sd double, expired boolean"
    return d.groupBy("cell").transformWithStateInPandas(statefulProcessor=Moments(idle_ms), outputStructType=out, outputMode="Update", timeMode="EventTime" if idle else "None")


def follow(changes: DataFrame, at: str, checkpoint: str, idle: str | None = None, late: str = "0 seconds") -> None:
    """Fold all changes that have come since the last call into Parquet files (batch, cell, ...) under ``at``; returns when done."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")

    q = retractable_moments(changes, idle, late).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current(spark: SparkSession, at: str) -> DataFrame:
    """The last statistics of every cell under ``at``."""
    d = spark.read.parquet(at)
    return d.groupBy("cell").agg(F.max_by(F.struct("count", "mean", "sd", "expired"), "batch").alias("x")).select("cell", "x.*")
