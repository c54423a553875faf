"""Grid geometry: driver-side metadata that turns into column expressions.

The linear index runs along the first axis first: ``i + j*nx + k*nx*ny``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import permutations, product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.num import col, js_round

#: axis names by world axis and direction
POSITIVE, NEGATIVE = ("right", "anterior", "superior"), ("left", "posterior", "inferior")


@dataclass(frozen=True)
class Grid:
    """dim, spacing, origin and a homogeneous affine from grid to world; checked on construction."""

    dim: tuple[int, ...]
    spacing: tuple[float, ...] = ()
    origin: tuple[float, ...] = ()
    affine: np.ndarray | None = field(default=None, compare=False)

    def __post_init__(self):
        d = len(self.dim)
        set_ = lambda k, v: object.__setattr__(self, k, v)
        if any(int(n) != n or n <= 0 for n in self.dim):
            raise ValueError("dimensions must be positive integers")
        set_("spacing", tuple(float(s) for s in self.spacing) or (1.0,) * d)
        set_("origin", tuple(float(s) for s in self.origin) or (0.0,) * d)
        if self.affine is None:
            a = np.eye(d + 1)
            a[:d, :d], a[:d, d] = np.diag(self.spacing), self.origin
            set_("affine", a)
        else:
            a = np.array(self.affine, float)
            if not np.isfinite(a).all() or abs(np.linalg.det(a)) < 1e-300:
                raise ValueError("the affine must be finite and invertible")
            r = a.shape[0] - 1
            set_("affine", a)
            set_("spacing", tuple(np.linalg.norm(a[:r, :r], axis=0)))
            set_("origin", tuple(a[:r, r]))

    @property
    def size(self) -> int:
        return int(np.prod([int(n) for n in self.dim]))

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.affine)

    # index <-> grid
    def axes_of(self, idx: Column | str) -> list[Column]:
        """Grid coordinates of a linear index, one column per axis."""
        out, stride = [], 1
        for n in self.dim:
            q = col(idx) if stride == 1 else F.floor(col(idx) / stride)
            out.append((q % int(n)).cast("int"))
            stride *= int(n)
        return out

    def index_of(self, *coords: Column | str) -> Column:
        """Linear index; no bounds check, fractional coordinates pass through."""
        out, stride = F.lit(0), 1
        for c, n in zip(coords, self.dim, strict=False):
            out = out + col(c) * stride
            stride *= int(n)
        return out

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.size).withColumnRenamed("id", "idx")

    def with_axes(self, df: DataFrame, names=("i", "j", "k")) -> DataFrame:
        return df.withColumns(dict(zip(names, self.axes_of("idx"), strict=False)))

    def inside(self, *coords: Column | str) -> Column:
        ok = F.lit(True)
        for c, n in zip(coords, self.dim, strict=False):
            ok = ok & (col(c) >= 0) & (col(c) < int(n))
        return ok

    # grid <-> world
    def _linear(self, m: np.ndarray, coords) -> list[Column]:
        d = m.shape[0] - 1
        cs = [col(c) for c in coords] + [F.lit(0.0)] * (d - len(coords))
        return [sum((cs[b] * float(m[a, b]) for b in range(d)), F.lit(float(m[a, d]))) for a in range(d)]

    def to_world(self, *coords: Column | str) -> list[Column]:
        return self._linear(self.affine, coords)

    def to_grid(self, *world: Column | str) -> list[Column]:
        return self._linear(self.inverse, world)

    def nearest_index(self, *world: Column | str) -> Column:
        """Index of the nearest cell, NULL outside the grid."""
        g = [js_round(c) for c in self.to_grid(*world)]
        return F.when(self.inside(*g), self.index_of(*g))

    def world_of_index(self, idx: Column | str) -> list[Column]:
        return self.to_world(*self.axes_of(idx))

    def point(self, g) -> np.ndarray:
        d = self.affine.shape[0] - 1
        return (self.affine @ np.r_[np.asarray(g, float), np.zeros(d - len(g)), 1.0])[:d]

    def grid_point(self, w) -> np.ndarray:
        d = self.affine.shape[0] - 1
        return (self.inverse @ np.r_[np.asarray(w, float), 1.0])[:d]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.point((0,) * len(self.dim)), self.point([n - 1 for n in self.dim])

    def centroid(self) -> np.ndarray:
        return self.point([(n - 1) / 2 for n in self.dim])

    def contains(self, world) -> bool:
        g = self.grid_point(world)
        return bool(((g >= 0) & (g < np.array(self.dim[: len(g)]))).all())

    # derived grids
    def with_dim(self, dim) -> Grid:
        """The same field of view in another resolution; obliquity is dropped."""
        spacing = [s * n / m for s, n, m in zip(self.spacing, self.dim, dim, strict=True)]
        return Grid(tuple(dim), tuple(spacing), self.origin)

    def with_spacing(self, spacing) -> Grid:
        dim = [max(1, int(np.floor(n * s / t + 0.5))) for n, s, t in zip(self.dim, self.spacing, spacing, strict=True)]
        return Grid(tuple(dim), tuple(spacing), self.origin)

    def drop_axis(self, axis: int) -> Grid:
        keep = [a for a in range(len(self.dim)) if a != axis]
        return Grid(tuple(self.dim[a] for a in keep), tuple(self.spacing[a] for a in keep), tuple(self.origin[a] for a in keep))

    def add_axis(self, n: int, spacing: float = 1.0) -> Grid:
        return Grid((*self.dim, n), (*self.spacing, spacing), (*self.origin, 0.0))

    def reorient(self, order: tuple[int, ...], flip: tuple[bool, ...]) -> Grid:
        """Axes permuted and flipped so that world coordinates stay."""
        d = len(self.dim)
        m = np.zeros((d + 1, d + 1))
        m[d, d] = 1
        for new, old in enumerate(order):
            m[old, new] = -1 if flip[new] else 1
            if flip[new]:
                m[old, d] = self.dim[old] - 1
        return replace(self, dim=tuple(self.dim[o] for o in order), affine=self.affine @ m)

    def reorient_index(self, idx: Column | str, order, flip) -> Column:
        """The index that a cell gets under :meth:`reorient`."""
        c = self.axes_of(idx)
        moved = [F.lit(self.dim[o] - 1) - c[o] if f else c[o] for o, f in zip(order, flip, strict=True)]
        return self.reorient(order, flip).index_of(*moved)

    def orientation(self) -> tuple[str, ...]:
        """The nearest anatomical axes: of all signed permutations, the one of greatest trace."""
        q = self.affine[:3, :3] / np.linalg.norm(self.affine[:3, :3], axis=0)
        q, _ = np.linalg.qr(q) if abs(np.linalg.det(q)) > 1e-12 else (q, None)
        q = q * np.sign(np.sum(q * self.affine[:3, :3], axis=0))
        best = max(((p, s) for p in permutations(range(3)) for s in product((1, -1), repeat=3)), key=lambda ps: sum(q[ps[0][a], a] * ps[1][a] for a in range(3)))
        return tuple((POSITIVE if s > 0 else NEGATIVE)[a] for a, s in zip(*best, strict=True))

    def mapping_from(self, other: Grid) -> tuple[tuple[int, ...], tuple[bool, ...]]:
        """(order, flip) that turns ``other``'s axes into this grid's."""
        mine, theirs = self.orientation(), other.orientation()
        opposite = dict(zip(POSITIVE + NEGATIVE, NEGATIVE + POSITIVE, strict=True))
        order = tuple(next(i for i, b in enumerate(theirs) if b in (a, opposite[a])) for a in mine)
        return order, tuple(theirs[o] != a for o, a in zip(order, mine, strict=True))

    def matrix_to(self, other: Grid) -> np.ndarray:
        """From this grid's cells to the other's."""
        return other.inverse @ self.affine

    def axis_matrix(self, other: Grid) -> np.ndarray:
        order, flip = other.mapping_from(self)
        m = np.zeros((3, 3))
        for new, old in enumerate(order):
            m[new, old] = -1 if flip[new] else 1
        return m

    # sequences and slices
    def along(self, axis: int, step: int = 1) -> list[int]:
        return list(range(0, self.dim[axis], step))

    def world_along(self, axis: int, step: int = 1) -> list[float]:
        return [self.origin[axis] + self.spacing[axis] * i for i in self.along(axis, step)]

    def last_slice(self, axis: int) -> int:
        return self.dim[axis] - 1

    def valid_slice(self, axis: int, i: int) -> bool:
        return isinstance(i, int) and 0 <= i < self.dim[axis]

    def center_slice(self, axis: int) -> int:
        return self.dim[axis] // 2

    def slice_bounds(self, axis: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """World corners of one slice."""
        lo, hi = [0] * 3, [n - 1 for n in self.dim[:3]]
        lo[axis] = hi[axis] = i
        return self.point(lo), self.point(hi)

    # compatibility
    def same_geometry(self, other: Grid, tol: float = 1e-6) -> bool:
        """Equal dims and affines within an absolute tolerance."""
        return self.dim == other.dim and bool(np.abs(self.affine - other.affine).max() <= tol)

    def compatible(self, other: Grid, tol: float = 1e-4) -> bool:
        """Equal dims and orientation, affines within a relative tolerance."""
        scale = np.maximum(np.abs(self.affine), 1.0)
        return self.dim == other.dim and self.orientation() == other.orientation() and bool((np.abs(self.affine - other.affine) <= tol * scale).all())

    def registers_to(self, layer: Grid, tol: float = 1e-4) -> list[tuple[float, float]] | None:
        """Per axis (scale, shift) from this grid's cells to ``layer``'s, None if they are rotated or sheared."""
        m = self.matrix_to(layer)[:3]
        off = m[:, :3] - np.diag(np.diag(m[:, :3]))
        return None if np.abs(off).max() > tol else [(float(m[a, a]), float(m[a, 3])) for a in range(3)]


def require_same_geometry(a: Grid, b: Grid, tol: float = 1e-6) -> None:
    if not a.same_geometry(b, tol):
        raise ValueError("the grids differ")


def axis_vectors(axes: tuple[str, str, str]) -> np.ndarray:
    """Unit directions of three anatomical axis names."""
    m = np.zeros((3, 3))
    for a, name in enumerate(axes):
        sign, names = (1, POSITIVE) if name in POSITIVE else (-1, NEGATIVE)
        m[names.index(name), a] = sign
    return m


def safe_center(*grids: Grid, axis: int) -> int:
    """A slice index that is valid in all grids, near their centres."""
    return min(min(g.center_slice(axis), h.last_slice(axis)) for g in grids for h in grids)
