"""NIfTI-1/2 images: headers, cells and files.

Headers, and images that come as (file, content), go over ``spark.read.format("binaryFile")`` (any store Spark can read); stored
images are read and written by slabs with the data source of :mod:`gridloom.sources.images`.  One row per cell.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid

#: fixed values of the format: data type codes
CODES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
CODE_OF = {v: k for k, v in CODES.items()}
#: file-name formats; only single files can be read
FORMATS = {"NIFTI_GZ": (".nii.gz",), "NIFTI": (".nii",), "NIFTI_DUAL": (".hdr", ".img"), "NIFTI_DUAL_GZ": (".hdr.gz", ".img.gz"), "AFNI": (".HEAD", ".BRIK", ".BRIK.gz")}
HEADER = "file string, rank int, dim array<int>, spacing array<double>, origin array<double>, datatype string, bitpix int, affine array<array<double>>, qform_code int, sform_code int, vox_offset double, scl_slope double, scl_inter double"


def format_of(path: str) -> str:
    """The format by file name; an error if no descriptor fits."""
    for name, ends in FORMATS.items():
        if path.endswith(ends):
            return name
    raise ValueError(f"no format for {path}")


def readable(path: str) -> None:
    if not format_of(path).startswith("NIFTI") or "DUAL" in format_of(path):
        raise ValueError(f"{format_of(path)} files cannot be read: {path}")


def scaling(slope: float, inter: float) -> tuple[float, float] | None:
    """None if the slope is 0 or not finite; a non-finite intercept counts as 0."""
    if not np.isfinite(slope) or slope == 0:
        return None
    return float(slope), float(inter) if np.isfinite(inter) else 0.0


def scaled(value: Column, slope: Column, inter: Column) -> Column:
    """The same rule as a column expression."""
    on = (slope != 0) & ~F.isnan(slope) & (F.abs(slope) != float("inf"))
    ok = ~F.isnan(inter) & (F.abs(inter) != float("inf"))
    return F.when(on, value * slope + F.when(ok, inter).otherwise(0.0)).otherwise(value)


def voxel_sizes(affine: np.ndarray) -> list[float]:
    return np.linalg.norm(np.asarray(affine)[:3, :3], axis=0).tolist()


def _rotation(b: float, c: float, d: float) -> np.ndarray:
    a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
    return np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b],
    ])


def _quaternion(r: np.ndarray) -> np.ndarray:
    """(b, c, d) with a >= 0 of a proper rotation."""
    k = np.array([
        [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
        [r[0, 2] - r[2, 0], r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]],
        [r[1, 0] - r[0, 1], r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1]],
    ])
    q = np.linalg.eigh(k)[1][:, -1]
    return (q if q[0] >= 0 else -q)[1:]


def parse_header(raw: bytes) -> dict:
    """Header fields, byte order and grid affine (sform, else qform, else spacing) of an unpacked image."""
    for order in "<>":
        size = struct.unpack(order + "i", raw[:4])[0]
        if size in (348, 540):
            break
    else:
        raise ValueError("not a NIfTI image")
    if size == 348:
        dim = struct.unpack(order + "8h", raw[40:56])
        code, bitpix = struct.unpack(order + "2h", raw[70:74])
        pix = struct.unpack(order + "8f", raw[76:108])
        off, slope, inter = struct.unpack(order + "3f", raw[108:120])
        q, s = struct.unpack(order + "2h", raw[252:256])
        quat = struct.unpack(order + "6f", raw[256:280])
        rows = struct.unpack(order + "12f", raw[280:328])
    else:
        code, bitpix = struct.unpack(order + "2h", raw[12:16])
        dim = struct.unpack(order + "8q", raw[16:80])
        pix = struct.unpack(order + "8d", raw[104:168])
        (off,) = struct.unpack(order + "q", raw[168:176])
        slope, inter = struct.unpack(order + "2d", raw[176:192])
        q, s = struct.unpack(order + "2i", raw[344:352])
        quat = struct.unpack(order + "6d", raw[352:400])
        rows = struct.unpack(order + "12d", raw[400:496])
    if code not in CODES:
        raise ValueError(f"data type {code} is not supported")
    rank = dim[0]
    affine = np.eye(4)
    if s > 0:
        affine[:3] = np.reshape(rows, (3, 4))
    elif q > 0:
        f = -1.0 if pix[0] < 0 else 1.0
        affine[:3, :3] = _rotation(*quat[:3]) * np.array([pix[1], pix[2], pix[3] * f])
        affine[:3, 3] = quat[3:]
    else:
        affine[:3, :3] = np.diag([p or 1.0 for p in pix[1:4]])
    tr = float(pix[4]) if np.isfinite(pix[4]) and pix[4] > 0 else 1.0
    return {"order": order, "rank": rank, "dim": list(dim[1 : rank + 1]), "spacing": [float(x) for x in pix[1 : rank + 1]], "origin": affine[:3, 3].tolist(), "datatype": CODES[code], "bitpix": bitpix, "affine": affine.tolist(), "qform_code": q, "sform_code": s, "vox_offset": float(off), "scl_slope": float(slope), "scl_inter": float(inter), "tr": tr}


def unpack(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def head(raw: bytes, size: int = 1024) -> bytes:
    """The first bytes of an image; of a compressed one no more than these are unpacked."""
    return zlib.decompressobj(31).decompress(raw, size) if raw[:2] == b"\x1f\x8b" else raw[:size]


def apply_scaling(data: np.ndarray, h: dict, dtype: str = "f4") -> np.ndarray:
    """Stored values as a header scales them; scaled values get ``dtype``, 32-bit unsigned ones double, others their own type."""
    sc = scaling(h["scl_slope"], h["scl_inter"])
    if sc:
        return (data.astype(np.float64) * sc[0] + sc[1]).astype(dtype)
    return data.astype(np.float64) if h["datatype"] == "u4" else data


def decode(raw: bytes, times: list[int] | None = None, dtype: str = "f4") -> tuple[dict, np.ndarray]:
    """(header, values (t, cells)); scaled values get ``dtype``, 32-bit unsigned ones double, others their own type."""
    raw = unpack(raw)
    h = parse_header(raw)
    if h["rank"] not in (3, 4):
        raise ValueError("only images of rank 3 or 4 can be read")
    n = int(np.prod(h["dim"][:3]))
    nt = h["dim"][3] if h["rank"] == 4 else 1
    kind = np.dtype(h["order"] + h["datatype"])
    at = int(h["vox_offset"])
    if len(raw) < at + n * nt * kind.itemsize:
        raise ValueError("corrupt file: the image is truncated")
    data = np.frombuffer(raw, kind, n * nt, at).reshape(nt, n)
    times = list(range(nt)) if times is None else times
    if not times or min(times) < 0 or max(times) >= nt:
        raise ValueError("no such volume")
    return h, apply_scaling(data[times], h, dtype)


def grid_of(header: dict) -> Grid:
    return Grid(tuple(header["dim"][:3]), affine=np.array(header["affine"]))


def _binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    for p in [paths] if isinstance(paths, str) else paths:
        if "." in p.rsplit("/", 1)[-1] and "*" not in p:
            readable(p)
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row of header fields per file; spacing is as stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"file": f, **parse_header(head(c))} for f, c in zip(pdf["file"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEADER.split(", ")])

    return _binary(spark, paths).mapInPandas(run, HEADER)


def cells_of(files: DataFrame, times: list[int] | None = None, dtype: str = "f4") -> DataFrame:
    """(file, t, idx, value) of images (file, content) of rank 3 or 4; only the asked times are turned into rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for f, c in zip(pdf["file"], pdf["content"], strict=True):
                _, data = decode(c, times, dtype)
                for n, row in enumerate(data):
                    yield pd.DataFrame({"file": f, "t": np.int32(n if times is None else times[n]), "idx": np.arange(len(row)), "value": row.astype(np.float64)})

    return files.mapInPandas(run, "file string, t int, idx long, value double")


def read_cells(spark: SparkSession, paths: str | list[str], times: list[int] | None = None, dtype: str = "f4") -> DataFrame:
    """(file, t, idx, value) of stored images, read by slabs (see :mod:`gridloom.sources.images`).

    Stores that only Spark can open: ``cells_of(spark.read.format("binaryFile")...)``, a file a task.
    """
    from gridloom.sources.images import read_images

    return read_images(spark, paths, times, dtype=dtype)


def read_volume(spark: SparkSession, path: str, index: int = 0, dtype: str = "f4") -> tuple[DataFrame, Grid]:
    """(idx, value) of one volume, and its grid."""
    h = read_headers(spark, path).first().asDict()
    return read_cells(spark, path, [index], dtype).select("idx", "value"), grid_of(h)


def read_series(spark: SparkSession, path: str, times: list[int] | None = None) -> tuple[DataFrame, Grid]:
    """(idx, t, value) of a 4-D image with times renumbered in the asked order."""
    if times is not None and not times:
        raise ValueError("no time points asked for")
    h = read_headers(spark, path).first().asDict()
    d = read_cells(spark, path, times)
    if times is not None:
        new = F.create_map(*[F.lit(x) for n, t in enumerate(times) for x in (t, n)])
        d = d.withColumn("t", F.element_at(new, F.col("t")))
    return d.select("idx", "t", "value"), grid_of(h)


# ------------------------------------------------------------------ writing
def round_clamp(x: np.ndarray, kind: str) -> np.ndarray:
    """Halves up, then clamped to the integer range; floats are cast."""
    t = np.dtype(kind)
    if t.kind == "f":
        return x.astype(t)
    i = np.iinfo(t)
    return np.clip(np.floor(np.nan_to_num(x) + 0.5), i.min, i.max).astype(t)


def round_clamp_column(v: Column, lo: float, hi: float, to: str = "long") -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(v + 0.5))).cast(to)


def header_bytes(grid: Grid, nt: int, kind: str = "f4", tr: float | None = None, order: str = "<", slope: float = 1.0, inter: float = 0.0) -> bytes:
    """The header of a single-file NIfTI-1 image: sform always, qform where the affine is a rotation and a scale.

    ``order``: byte order; ``slope`` and ``inter``: the scaling that readers apply to the stored values.
    """
    dims = [*grid.dim[:3], *([nt] if nt > 1 or tr is not None else [])]
    if any(not 1 <= d <= 32767 for d in dims):
        raise ValueError("dimensions must be 1 to 32767")
    a = grid.affine
    size = np.array(voxel_sizes(a))
    r = a[:3, :3] / size
    q, sign = np.zeros(3), 1.0
    proper = np.abs(r.T @ r - np.eye(3)).max() <= 1e-4
    if proper:
        sign = -1.0 if np.linalg.det(r) < 0 else 1.0
        q = _quaternion(r * np.array([1, 1, sign]))
    h = bytearray(352)
    struct.pack_into(order + "i", h, 0, 348)
    struct.pack_into(order + "8h", h, 40, len(dims), *dims, *[1] * (7 - len(dims)))
    struct.pack_into(order + "2h", h, 70, CODE_OF[kind], np.dtype(kind).itemsize * 8)
    struct.pack_into(order + "8f", h, 76, sign, *size, tr or 0.0, 0, 0, 0)
    struct.pack_into(order + "3f", h, 108, 352.0, slope, inter)
    h[123] = 10  # mm and seconds
    struct.pack_into(order + "2h", h, 252, int(proper), 1)
    struct.pack_into(order + "6f", h, 256, *q, *a[:3, 3])
    struct.pack_into(order + "12f", h, 280, *a[:3].ravel())
    h[344:348] = b"n+1\x00"
    return bytes(h)


def encode(data: np.ndarray, grid: Grid, kind: str = "f4", tr: float | None = None, order: str = "<", slope: float = 1.0, inter: float = 0.0) -> bytes:
    """A single-file image of (t, cells) values (see :func:`header_bytes`)."""
    return header_bytes(grid, data.shape[0], kind, tr, order, slope, inter) + round_clamp(np.asarray(data), kind).astype(order + kind).tobytes()


def write_options(path: str, fmt: str | None = None, compress: bool | None = None) -> bool:
    """Whether to compress: the name decides, contradicting options are an error."""
    if not path.endswith((".nii", ".nii.gz")):
        raise ValueError("write .nii or .nii.gz files")
    gz = path.endswith(".gz")
    if compress is not None and compress != gz or fmt is not None and fmt != ("NIFTI_GZ" if gz else "NIFTI"):
        raise ValueError("options contradict the file name")
    return gz


def encoded(cells: DataFrame, grid: Grid, by: str, kind: str = "f4", gz: bool = False, tr: float | None = None, **options) -> DataFrame:
    """(by, content; ``options`` of :func:`encode`): one image per group of cells (by, t, idx, value), cells without a row 0; a group must fit one task, as its file does."""
    n = grid.size
    key = cells.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["t"].to_numpy() if "t" in pdf else np.zeros(len(pdf), int)
        data = np.zeros((int(t.max()) + 1, n))
        data[t, pdf["idx"].to_numpy()] = pdf["value"]
        raw = encode(data, grid, kind, tr, **options)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [gzip.compress(raw, mtime=0) if gz else raw]})

    return cells.groupBy(by).applyInPandas(run, f"{by} {key}, content binary")


def write_volume(cells: DataFrame, grid: Grid, path: str, kind: str = "f4", fmt: str | None = None, compress: bool | None = None, tr: float | None = None) -> None:
    """One volume (idx, value) or series (idx, t, value) as a file, written by tasks (see :mod:`gridloom.sources.images`)."""
    from gridloom.sources.images import write_image

    write_options(path, fmt, compress)
    write_image(cells, grid, path, kind, tr)


def sha256_ok(content: bytes, checksum: str) -> bool:
    kind, _, digest = checksum.partition(":")
    if kind != "sha256":
        raise ValueError("only sha256 checksums are known")
    return hashlib.sha256(content).hexdigest() == digest.lower()


def verified(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """Files (file, checksum) whose stored content has another checksum."""
    got = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("actual"))
    return files.join(got, "file", "left").filter(F.col("actual").isNull() | (F.lower("checksum") != F.col("actual")))
