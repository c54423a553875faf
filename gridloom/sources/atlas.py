"""Label volumes with a table of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators.volume import integer_labels
from gridloom.sources.nifti import read_volume


def read_atlas(spark: SparkSession, volume: str, names: str, sep: str = ",") -> tuple[DataFrame, DataFrame, Grid]:
    """(labels (idx, label), names (label, name, ...), grid) from local or remote files; cells of label 0 are left out."""
    v, grid = read_volume(spark, volume)
    table = spark.read.csv(names, header=True, sep=sep).withColumn("label", F.col("label").cast("int"))
    return integer_labels(v).filter("label <> 0"), table, grid


def region(labels: DataFrame, names: DataFrame, label: int | None = None, key: str | None = None) -> DataFrame:
    """Cells of a region by its number or its name; unknown and ambiguous names are errors."""
    if label is None:
        hit = [r[0] for r in names.filter(F.col("name") == key).select("label").limit(2).collect()]
        if len(hit) != 1:
            raise ValueError(f"{'no' if not hit else 'more than one'} region is called {key}")
        label = hit[0]
    return labels.filter(F.col("label") == label)


def with_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    return labels.join(names, "label", "left")
