"""Joins between grids, registries and members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators.order import ranked


def align(a: DataFrame, b: DataFrame, on: str = "idx") -> DataFrame:
    """Cells of both volumes: value, other."""
    return a.join(b.select(on, F.col("value").alias("other")), on)


def resources(rows: DataFrame, registry: DataFrame, ref: str) -> DataFrame:
    """Registry columns for each reference; an error where one is missing or its checksum differs from the row's."""
    j = rows.join(registry.withColumn("__found", F.lit(True)), rows[ref] == registry["resource_id"], "left")
    ok = F.col(ref).isNull() | F.col("__found").isNotNull()
    if "expected_checksum" in rows.columns and "checksum" in registry.columns:
        ok = ok & (F.col("expected_checksum").isNull() | F.col("checksum").isNull() | (F.col("expected_checksum") == F.col("checksum")))
    return j.withColumn(ref, F.when(ok, F.col(ref)).otherwise(F.raise_error(F.lit("unknown resource or checksum mismatch")))).drop("__found")


def covariate(subjects: DataFrame, design: DataFrame, name: str, order: str) -> DataFrame:
    """``name`` for each subject; the last design row wins."""
    last = design.groupBy("subject").agg(F.max_by(name, order).alias(name))
    return subjects.join(last, "subject", "left")


def align_by_id(source: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join on an id, its first occurrence on either side: (key, source order, target order)."""
    first = lambda d, n: d.groupBy(key).agg(F.min(order).alias(n))
    return first(source, "source_pos").join(first(target, "target_pos"), key)


def regrid(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Distinct cells of ``target`` nearest to the given cells of ``source``; the same cells if the grids match."""
    if source.same_geometry(target):
        return cells.select("idx").distinct()
    return cells.select(target.nearest_index(*source.world_of_index("idx")).alias("idx")).filter("idx is not null").distinct()


def pairs(values: DataFrame, key: str = "member", on: str = "pos") -> DataFrame:
    """(a, b, pos, x, y) for members a < b at equal positions."""
    l = values.select(F.col(key).alias("a"), on, F.col("value").alias("x"))  # noqa: E741
    r = values.select(F.col(key).alias("b"), on, F.col("value").alias("y"))
    return l.join(r, on).filter("a < b")


def overlay_labels(base: DataFrame, other: DataFrame) -> DataFrame:
    """Labels of ``other`` where not 0, else of ``base``; other's ids move up by base's maximum + 1 if the ranges meet."""
    end = lambda d, f: d.filter("label <> 0").agg(f("label").alias("m")).select("m").scalar()
    meet = (end(base, F.min) <= end(other, F.max)) & (end(other, F.min) <= end(base, F.max))
    shift = F.coalesce(F.when(meet, end(base, F.max) + 1), F.lit(0))
    j = base.select("idx", F.col("label").alias("t")).join(other.select("idx", F.col("label").alias("o")), "idx", "full_outer")
    return j.select("idx", F.coalesce(F.when(F.col("o") != 0, F.col("o") + shift), "t", F.lit(0)).alias("label"))


def sample_points(points: DataFrame, vol: DataFrame, grid: Grid, world=("x", "y", "z")) -> DataFrame:
    """Points with the value of their nearest cell, NULL outside the grid or for missing cells."""
    p = points.withColumn("idx", grid.nearest_index(*world))
    v = vol.select("idx", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")).alias("value"))
    return p.join(v, "idx", "left")


def first_seen_levels(d: DataFrame, level: str, order: str) -> DataFrame:
    """Distinct levels with their position of first sight."""
    return ranked(d.groupBy(level).agg(F.min(order).alias("first")), [F.col("first"), F.col(level)], "ord").withColumn("ord", F.col("ord").cast("int"))
