"""Element-wise operators on volumes (idx, value): arithmetic, comparison, masks, sets of cells.

Row-local operators are projections; two volumes meet in one equi-join on ``idx``.  Results are
DOUBLE.  Cells outside a grid or mask simply have no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.num import gt, is_finite, lt

Operand = DataFrame | float | int


def combine(a: DataFrame, b: Operand, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f(value of a, value of b) per cell; cells in one volume only are left out."""
    if isinstance(b, DataFrame):
        both = a.select("idx", F.col("value").alias("x")).join(b.select("idx", F.col("value").alias("y")), "idx")
        return both.select("idx", f(F.col("x"), F.col("y")).alias("value"))
    return a.select("idx", f(F.col("value"), F.lit(float(b))).alias("value"))


def apply(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """A user's column function on every value."""
    return a.withColumn("value", f(F.col("value")))


def add(a: DataFrame, b: Operand) -> DataFrame:
    return combine(a, b, lambda x, y: x + y)


def subtract(a: DataFrame, b: Operand) -> DataFrame:
    return combine(a, b, lambda x, y: x - y)


def multiply(a: DataFrame, b: Operand) -> DataFrame:
    return combine(a, b, lambda x, y: x * y)


def divide(a: DataFrame, b: Operand) -> DataFrame:
    """a / b, 0 where b is 0."""
    return combine(a, b, lambda x, y: F.when(y == 0, 0.0).otherwise(x / F.when(y != 0, y)))


def negate(a: DataFrame) -> DataFrame:
    return apply(a, lambda x: -x)


def absolute(a: DataFrame) -> DataFrame:
    return apply(a, F.abs)


def root(a: DataFrame) -> DataFrame:
    """Square root, 0 for negative values; NaN stays NaN."""
    return apply(a, lambda x: F.sqrt(F.greatest(F.lit(0.0), x)))


def greater(a: DataFrame, b: Operand) -> DataFrame:
    return combine(a, b, gt)


def less(a: DataFrame, b: Operand) -> DataFrame:
    return combine(a, b, lt)


def equal(a: DataFrame, b: Operand, tol: float = 0.0) -> DataFrame:
    return combine(a, b, lambda x, y: ~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) <= tol))


def threshold(a: DataFrame, t: float, op: str = "gt") -> DataFrame:
    """Mask (idx) of cells that compare true; ``neq`` holds for NaN."""
    x, y = F.col("value"), F.lit(float(t))
    ok = {"gt": gt(x, y), "lt": lt(x, y), "gte": ~F.isnan(x) & (x >= y), "lte": ~F.isnan(x) & (x <= y), "eq": ~F.isnan(x) & (x == y), "neq": F.isnan(x) | (x != y)}[op]
    return a.filter(ok).select("idx")


def sparse(a: DataFrame, t: float = 0.0) -> DataFrame:
    """Cells with |value| above t."""
    return a.filter(~F.isnan("value") & (F.abs("value") > t))


def densify(a: DataFrame, grid: Grid, default: float = 0.0) -> DataFrame:
    """Every cell of the grid, ``default`` where there is no row."""
    return grid.cells(a.sparkSession).join(a, "idx", "left").withColumn("value", F.coalesce("value", F.lit(float(default))))


def relabel(a: DataFrame, mapping: dict[float, float], drop_zero: bool = False) -> DataFrame:
    """Exact-match lookup; other values pass through."""
    out = F.col("value")
    if mapping:
        table = F.create_map(*[F.lit(float(x)) for kv in mapping.items() for x in kv])
        out = F.coalesce(F.try_element_at(table, F.col("value").cast("double")), F.col("value"))
    d = a.withColumn("value", out)
    return d.filter("value <> 0") if drop_zero else d


def integer_labels(a: DataFrame, tol: float = 1e-4) -> DataFrame:
    """Values as integer labels; an error where one is not within ``tol`` of an integer of 32 bits."""
    x = F.col("value")
    near = F.rint(x)
    ok = is_finite(x) & (F.abs(x - near) <= tol) & (near >= -(2**31)) & (near < 2**31)
    return a.withColumn("label", F.when(ok, near.cast("int")).otherwise(F.raise_error(F.lit("labels must be integers")).cast("int"))).drop("value")


# sets of cells, each a DataFrame with idx
def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx").intersect(b.select("idx"))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx").union(b.select("idx")).distinct()


def mask_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("idx", F.lit(1).alias("a")).distinct(), b.select("idx", F.lit(1).alias("b")).distinct()
    return x.join(y, "idx", "full_outer").filter(F.col("a").isNull() | F.col("b").isNull()).select("idx")


def mask_not(a: DataFrame, grid: Grid) -> DataFrame:
    return grid.cells(a.sparkSession).join(a.select("idx"), "idx", "left_anti")


def inside_mask(values: DataFrame, mask: DataFrame) -> DataFrame:
    return values.join(mask.select("idx"), "idx", "left_semi")


def outside_mask(values: DataFrame, mask: DataFrame) -> DataFrame:
    return values.join(mask.select("idx"), "idx", "left_anti")


# slices and probes
def slice_of(a: DataFrame, grid: Grid, axis: int, at: int) -> DataFrame:
    """(row, col, value) of one plane; rows run along the later of the other two axes."""
    c = grid.axes_of("idx")
    u, v = [x for x in range(3) if x != axis]
    return a.filter(c[axis] == at).select(c[v].alias("row"), c[u].alias("col"), "value")


def display_slice(a: DataFrame, grid: Grid, axis: int, at: int) -> DataFrame:
    """As :func:`slice_of` with row 0 on top."""
    v = max(x for x in range(3) if x != axis)
    return slice_of(a, grid, axis, at).withColumn("row", F.lit(grid.dim[v] - 1) - F.col("row"))


def slice_pixel_to_cell(grid: Grid, axis: int, at: int, row: int, col_: int) -> tuple[int, ...]:
    """The cell under a pixel of :func:`display_slice`; :func:`cell_to_slice_pixel` is its inverse."""
    u, v = [x for x in range(3) if x != axis]
    out = [0, 0, 0]
    out[axis], out[u], out[v] = at, col_, grid.dim[v] - 1 - row
    return tuple(out)


def cell_to_slice_pixel(grid: Grid, axis: int, cell: tuple[int, ...]) -> tuple[int, int]:
    u, v = [x for x in range(3) if x != axis]
    return grid.dim[v] - 1 - cell[v], cell[u]


def orthogonal_slices(a: DataFrame, grid: Grid, world) -> DataFrame:
    """The three planes through a world point, tagged; an error outside the grid."""
    if not grid.contains(world):
        raise ValueError("the point is outside the grid")
    g = [int(x + 0.5) for x in grid.grid_point(world)]
    out = None
    for name, axis in (("axial", 2), ("coronal", 1), ("sagittal", 0)):
        part = slice_of(a, grid, axis, min(g[axis], grid.last_slice(axis))).withColumn("plane", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sphere_positions(a: DataFrame, grid: Grid, center: tuple[int, ...], radius: float) -> DataFrame:
    """Cells within ``radius`` voxels of a cell."""
    d = sum(((c - int(m)) * (c - int(m)) for c, m in zip(grid.axes_of("idx"), center, strict=True)), F.lit(0))
    return a.filter(d <= radius * radius)


def sphere_probe(a: DataFrame, grid: Grid, world, radius: float) -> DataFrame:
    """Cells within ``radius`` mm of a world point."""
    d = sum(((c - float(m)) * (c - float(m)) for c, m in zip(grid.world_of_index("idx"), world, strict=True)), F.lit(0.0))
    return a.filter(d <= radius * radius)


def box(a: DataFrame, grid: Grid, lo, hi) -> DataFrame:
    ok = F.lit(True)
    for c, x, y in zip(grid.axes_of("idx"), lo, hi, strict=True):
        ok = ok & c.between(int(x), int(y))
    return a.filter(ok)


def reorient(a: DataFrame, grid: Grid, order, flip) -> DataFrame:
    """The same cells under permuted and flipped axes (no shuffle)."""
    return a.withColumn("idx", grid.reorient_index("idx", order, flip))


def hidden(v: Column, lo: float, hi: float) -> Column:
    """Display rule: values strictly inside (lo, hi), and missing ones, are hidden."""
    return ~is_finite(v) | ((F.lit(lo) < F.lit(hi)) & (v > lo) & (v < hi))


def color(v: Column, lut: list[tuple[float, float, float, float]], lo: float, hi: float) -> Column:
    """Colour from a table: index floor(clamped position * (n - 1)), 0-based."""
    at = F.floor(F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * (len(lut) - 1)).cast("int")
    return F.get(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in lut]), at)
