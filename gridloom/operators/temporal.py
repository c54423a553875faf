"""Operators along time on series (idx, t, value): scaling, detrending, filters, smoothing.

Everything that a window over (idx) can express stays in the JVM; Fourier filters and polynomial
detrending run as Arrow-batched numpy over one array per cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.stats import dft
from gridloom.num import pearson



def scale(series: DataFrame, method: str = "zscore") -> DataFrame:
    """zscore (n - 1; sd 0 gives 0, one sample has sd 1), mean-center, or psc ((x - m) / m * 100, 0 where m is 0)."""
    d = series.withColumns({"m": F.avg("value").over(W.partitionBy("idx")), "s": F.stddev_samp("value").over(W.partitionBy("idx"))})
    s = F.coalesce("s", F.lit(1.0))
    out = {
        "zscore": F.when(s > 0, (F.col("value") - F.col("m")) / F.when(s > 0, s)).otherwise(0.0),
        "mean-center": F.col("value") - F.col("m"),
        "psc": F.when(F.col("m") != 0, (F.col("value") - F.col("m")) / F.when(F.col("m") != 0, F.col("m")) * 100).otherwise(0.0),
    }[method]
    return d.select("idx", "t", out.alias("value"))


def zscore(series: DataFrame) -> DataFrame:
    """n - 1 z-score; cells with sd 0 stay unchanged."""
    s = F.stddev_samp("value").over(W.partitionBy("idx"))
    return series.select("idx", "t", F.when(s > 0, (F.col("value") - F.avg("value").over(W.partitionBy("idx"))) / F.when(s > 0, s)).otherwise(F.col("value")).alias("value"))


def percent_change(series: DataFrame, length: int) -> DataFrame:
    """Percent change from the mean of the first tenth of the samples, where that mean is above 0."""
    base = F.avg(F.when(F.col("t") < length // 10, F.col("value"))).over(W.partitionBy("idx"))
    return series.select("idx", "t", F.when(base > 0, (F.col("value") - base) / F.when(base > 0, base) * 100).otherwise(F.col("value")).alias("value"))


def detrend(series: DataFrame, method: str = "linear", order: int = 2) -> DataFrame:
    """Residuals of the mean, a line or a polynomial over time."""
    if method == "mean":
        return series.select("idx", "t", (F.col("value") - F.avg("value").over(W.partitionBy("idx"))).alias("value"))
    if method == "linear":
        t = F.col("t").cast("double")
        slope = F.regr_slope(F.col("value"), t).over(W.partitionBy("idx"))
        return series.select("idx", "t", (F.col("value") - F.avg("value").over(W.partitionBy("idx")) - F.coalesce(slope, F.lit(0.0)) * (t - F.avg(t).over(W.partitionBy("idx")))).alias("value"))

    def fit(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        return x - np.polynomial.Polynomial.fit(t, x, min(order, len(t) - 1))(t)

    return _per_cell(series, fit)


def _per_cell(series: DataFrame, f) -> DataFrame:
    """f(values, times) for each cell's series as numpy arrays, Arrow-batched."""

    def run(frames):
        for pdf in frames:
            pdf["value"] = [f(np.asarray(x, float), np.asarray(t, float)) for x, t in zip(pdf["x"], pdf["ts"], strict=True)]
            yield pd.DataFrame({"idx": pdf["idx"], "ts": pdf["ts"], "value": pdf["value"]})

    s = F.array_sort(F.collect_list(F.struct("t", "value")))
    packed = series.groupBy("idx").agg(s.alias("s")).select("idx", F.col("s.t").alias("ts"), F.col("s.value").alias("x"))
    kind = packed.schema["idx"].dataType.simpleString()
    out = packed.mapInPandas(run, f"idx {kind}, ts array<int>, value array<double>")
    return out.select("idx", F.explode(F.arrays_zip("ts", "value")).alias("s")).select("idx", F.col("s.ts").alias("t"), F.col("s.value").alias("value"))


def bin_frequencies(n: int, tr: float) -> np.ndarray:
    return np.arange(n // 2 + 1) / (n * tr)


def spectrum(series: DataFrame, tr: float = 2.0) -> DataFrame:
    """(idx, bin, hz, re, im): the one-sided discrete Fourier transform of each cell's series."""

    def run(frames):
        for pdf in frames:
            for idx, x in zip(pdf["idx"], pdf["x"], strict=True):
                z, hz = dft(np.asarray(x, float)), bin_frequencies(len(x), tr)
                yield pd.DataFrame({"idx": idx, "bin": np.arange(len(z), dtype=np.int32), "hz": hz, "re": z.real, "im": z.imag})

    s = F.array_sort(F.collect_list(F.struct("t", "value")))
    packed = series.groupBy("idx").agg(s.alias("s")).select("idx", F.col("s.value").alias("x"))
    return packed.mapInPandas(run, f"idx {packed.schema['idx'].dataType.simpleString()}, bin int, hz double, re double, im double")


def temporal_filter(series: DataFrame, low: float | None = None, high: float | None = None, tr: float = 2.0) -> DataFrame:
    """Fourier band filter: bins outside [low, high] Hz are zeroed (a high-pass removes the mean)."""
    if low is None and high is None:
        return series

    def f(x, _t):
        hz = bin_frequencies(len(x), tr)
        keep = (hz >= (low if low is not None else -1)) & (hz <= (high if high is not None else math.inf))
        return np.fft.irfft(np.fft.rfft(x) * keep, len(x))

    return _per_cell(series, f)


def filter_by_basis(series: DataFrame, length: int, low: float | None, high: float | None, tr: float = 2.0) -> DataFrame:
    """The same filter as a join with an explicit cosine basis: the projection matrix has length^2 rows, whatever the data."""
    hz = bin_frequencies(length, tr)
    keep = np.flatnonzero((hz >= (low if low is not None else -1)) & (hz <= (high if high is not None else math.inf)))
    t = np.arange(length)
    m = np.zeros((length, length))
    for k in keep:
        w = 1.0 if k == 0 or 2 * k == length else 2.0
        m += w / length * np.cos(2 * math.pi * k * (t[:, None] - t[None, :]) / length)
    rows = [(int(a), int(b), float(m[a, b])) for a in t for b in t]
    basis = series.sparkSession.createDataFrame(rows, "t int, t2 int, w double")
    return series.join(F.broadcast(basis), "t").groupBy("idx", "t2").agg(F.sum(F.col("value") * F.col("w")).alias("value")).withColumnRenamed("t2", "t")


def convolve(series: DataFrame, kernel: list[float]) -> DataFrame:
    """Correlation with a kernel of sum 1, zeros outside, anchor at floor(k / 2)."""
    total, mid, by = sum(kernel), len(kernel) // 2, W.partitionBy("idx").orderBy("t")
    terms = [F.coalesce(F.lead("value", j - mid).over(by) if j > mid else F.lag("value", mid - j).over(by), F.lit(0.0)) * (w / total) for j, w in enumerate(kernel)]
    return series.select("idx", "t", sum(terms[1:], terms[0]).alias("value"))


def gaussian_kernel(sigma: float) -> list[float]:
    n = math.ceil(6 * sigma) | 1
    return [math.exp(-((i - n // 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]


def smooth(series: DataFrame, sigma: float) -> DataFrame:
    return convolve(series, gaussian_kernel(sigma))


def seed_correlation(series: DataFrame, seed: int) -> DataFrame:
    """Pearson correlation of every cell with the seed's series, 0 where one is constant."""
    s = series.filter(F.col("idx") == seed).select("t", F.col("value").alias("y"))
    return series.join(s, "t").groupBy("idx").agg(F.coalesce(pearson("value", "y", 1), F.lit(0.0)).alias("value"))


def time_slice(series: DataFrame, start: int, end: int) -> DataFrame:
    """[start, end) renumbered from 0."""
    return series.filter((F.col("t") >= start) & (F.col("t") < end)).withColumn("t", F.col("t") - start)


def concatenate(a: DataFrame, b: DataFrame, length_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("t", F.col("t") + length_a))


def select_times(series: DataFrame, times: list[int]) -> DataFrame:
    """The given time points in the given order, renumbered; repeats are allowed."""
    order = series.sparkSession.createDataFrame([(t, i) for i, t in enumerate(times)], "t int, new_t int")
    return series.join(F.broadcast(order), "t").select("idx", F.col("new_t").alias("t"), "value")


def stack(volumes: list[DataFrame]) -> DataFrame:
    """Volumes (idx, value) as one series."""
    out = None
    for t, v in enumerate(volumes):
        part = v.select("idx", F.lit(t).alias("t"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def as_arrays(series: DataFrame) -> DataFrame:
    """(idx, series): the values of each cell in time order."""
    s = F.array_sort(F.collect_list(F.struct("t", "value")))
    return series.groupBy("idx").agg(s.alias("s")).select("idx", F.transform("s", lambda x: x["value"]).alias("series"))


def series_at(series: DataFrame, cells: DataFrame) -> DataFrame:
    """Series of the given cells, 0 for cells that have none."""
    last = series.agg(F.max("t").alias("t")).select("t").scalar()
    every = cells.select("idx", F.explode(F.sequence(F.lit(0), last)).alias("t"))
    return every.join(series, ["idx", "t"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
