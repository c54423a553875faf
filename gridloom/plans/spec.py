"""Plot queries as one declarative object compiled to one plan: filter, unpivot, group, interval."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.design import infer_columns, summarise, varies_within
from gridloom.operators.reduce import cell_counts


@dataclass(frozen=True)
class PlotSpec:
    """Columns for x, colour and facet; levels to keep; the interval's kind."""

    x: str
    color: str | None = None
    facet: str | None = None
    keep: dict[str, tuple] = field(default_factory=dict)
    error: str = "auto"  # auto, between, within, none
    level: float = 0.95

    @property
    def keys(self) -> list[str]:
        return [c for c in (self.x, self.color, self.facet) if c]


def infer_spec(d: DataFrame, subject: str | None = "subject", value: str = "value", roles: dict[str, str] | None = None) -> PlotSpec:
    """x: the first factor that varies within subjects, else the first; colour and facet: the next factors."""
    cols = [c for c in infer_columns(d.drop(value), roles) if c["name"] != subject]
    factors = [c["name"] for c in cols if c["kind"] == "factor"]
    numeric = [c["name"] for c in cols if c["kind"] == "numeric"]
    if subject in d.columns:
        factors.sort(key=lambda c: not varies_within(d, subject, c).first()[0])
    if not factors:
        return PlotSpec(x=numeric[0])
    return PlotSpec(*(factors + [None, None])[:3])


def build_scene(d: DataFrame, spec: PlotSpec, subject: str | None = "subject", value: str = "value") -> dict[str, DataFrame]:
    """cells (keys, mean, lo, hi, n) and counts of subjects overall, by colour and by facet."""
    for c, levels in spec.keep.items():
        d = d.filter(F.col(c).isin(list(levels)))
    within = None
    if subject and spec.error in ("auto", "within"):
        within = [k for k in spec.keys if spec.error == "within" or varies_within(d, subject, k).first()[0]]
    cells = summarise(d, spec.keys, subject, within or None, spec.level, value)
    if spec.error == "none":
        cells = cells.drop("lo", "hi")
    out = {"cells": cells}
    if subject:
        blank = d.withColumns({c: F.lit("all") for c in ("__color", "__facet")})
        out["counts"] = cell_counts(blank.withColumns({"subject": F.col(subject), "__color": F.col(spec.color or "__color"), "__facet": F.col(spec.facet or "__facet")}), "__color", "__facet")
    return out


def summary_scene(table: DataFrame, spec: PlotSpec) -> DataFrame:
    """Stored summaries laid out by facet, colour and x; nothing is recomputed."""
    return table.select(*spec.keys, F.col("estimate").alias("mean"), F.col("lower").alias("lo"), F.col("upper").alias("hi"), "n")
