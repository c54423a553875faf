"""Labels and number formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_number(x: float | None, digits: int = 3) -> str:
    if x is None or not math.isfinite(x):
        return "n/a"
    return f"{x:.{digits}g}"


def significant(x: float, digits: int = 12) -> str:
    return f"{float(f'{x:.{digits}g}'):g}" if abs(x) < 1e6 else f"{x:.{digits}g}"


def describe_threshold(lo: float, hi: float, stat: str, data_range: tuple[float, float]) -> str:
    """What a hidden band (lo, hi) means in words."""
    if not lo < hi:
        return f"all {stat} values shown"
    below, above = data_range[0] <= lo, data_range[1] >= hi
    if below and above and lo == -hi:
        return f"|{stat}| >= {report_number(hi)}"
    parts = ([f"{stat} <= {report_number(lo)}"] if below else []) + ([f"{stat} >= {report_number(hi)}"] if above else [])
    return " or ".join(parts) if parts else f"no {stat} values shown"


def probe_label(kind: str, **p) -> str:
    if kind == "voxel":
        return "voxel (" + ", ".join(str(int(x)) for x in p["ijk"]) + ")"
    if kind == "sphere":
        return f"{report_number(p['radius'])} mm sphere at (" + ", ".join(report_number(x) for x in p["center"]) + ")"
    return p.get("name", "mask")


def interval_label(template: Column, level: Column) -> Column:
    """The template with {percent} replaced by the level in percent, 12 significant digits at most."""
    pct = F.round(level * 100, 10)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", pct), "0+$", ""), r"\.$", "")
    return F.replace(template, F.lit("{percent}"), text)


def interval_labels(d: DataFrame, template: str, level: str) -> DataFrame:
    return d.groupBy(interval_label(F.col(template), F.col(level)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
