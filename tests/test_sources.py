"""Files: images, delimited text, manifests, summary tables, streams."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.sources import atlas, delimited, images, manifest, nifti, summary
from gridloom.streaming import moments


def cells(spark, data):
    return spark.createDataFrame([(int(t), int(i), float(v)) for t, row in enumerate(data) for i, v in enumerate(row)], "t int, idx long, value double")


@pytest.mark.parametrize("kind", ["f4", "f8", "i2", "u1", "i4", "u2", "i1", "u4"])
def test_image_round_trip(spark, tmp_path, kind):
    g = Grid((3, 2, 4), (2.0, 3.0, 1.5), (-1.0, 2.0, 5.0))
    data = np.arange(24.0)[None] + 0.4 * (kind[0] == "f")
    path = str(tmp_path / "a.nii.gz")
    nifti.write_volume(cells(spark, data).drop("t"), g, path, kind)
    v, h = nifti.read_volume(spark, path)
    got = np.array([r["value"] for r in v.orderBy("idx").collect()])
    assert np.abs(got - data[0]).max() < 1e-5 and h.same_geometry(g, 1e-5)


def test_series_scaling_and_byte_order(spark, tmp_path):
    g = Grid((2, 2, 2))
    raw = bytearray(nifti.encode(np.arange(24.0).reshape(3, 8), g, "i2", 1.5))
    big = bytearray(raw)
    h = nifti.parse_header(bytes(raw))
    assert h["tr"] == 1.5 and h["dim"] == [2, 2, 2, 3]
    raw[112:120] = np.array([2.0, 1.0], "<f4").tobytes()
    (tmp_path / "s.nii").write_bytes(bytes(raw))
    s, _ = nifti.read_series(spark, str(tmp_path / "s.nii"), [2, 0])
    got = {(r["t"], r["idx"]): r["value"] for r in s.collect()}
    assert got[0, 0] == 33.0 and got[1, 7] == 15.0
    assert nifti.scaling(0, 1) is None and nifti.scaling(2, float("nan")) == (2.0, 0.0)
    big[:4] = big[:4][::-1]
    for a, z, w in ((40, 56, 2), (70, 74, 2), (76, 120, 4), (252, 256, 2), (256, 328, 4)):
        big[a:z] = np.frombuffer(bytes(big[a:z]), f"u{w}").byteswap().tobytes()
    big[352:] = np.frombuffer(bytes(big[352:]), "u2").byteswap().tobytes()
    _, data = nifti.decode(gzip.compress(bytes(big)))
    assert data[1, 3] == 11
    with pytest.raises(ValueError):
        nifti.decode(bytes(raw[:360]))
    with pytest.raises(ValueError):
        nifti.format_of("x.txt")
    with pytest.raises(ValueError):
        nifti.write_options("a.nii", compress=True)


def test_rotated_affine_survives(spark):
    c, s = np.cos(0.3), np.sin(0.3)
    a = np.array([[2 * c, -2 * s, 0, 4], [2 * s, 2 * c, 0, 5], [0, 0, -3, 6], [0, 0, 0, 1.0]])
    h = nifti.parse_header(nifti.encode(np.zeros((1, 8)), Grid((2, 2, 2), affine=a)))
    assert h["qform_code"] == 1 and np.abs(np.array(h["affine"]) - a).max() < 1e-5
    raw = bytearray(nifti.encode(np.zeros((1, 8)), Grid((2, 2, 2), affine=a)))
    raw[254:256] = b"\0\0"  # without the sform the quaternion must give the same
    assert np.abs(np.array(nifti.parse_header(bytes(raw))["affine"]) - a).max() < 1e-5


def test_delimited(spark, tmp_path):
    head, rows = delimited.parse('a , b\n1,""\n\n,"x ""y"""\n')
    assert head == ["a", "b"] and rows == [["1", ""], [None, 'x "y"']]
    p = tmp_path / "t.csv"
    p.write_text('id,x,ok,n\n1,2.5,true,7\n2,,0,\n')
    d = delimited.read_typed(spark, str(p), {"id": "string", "x": "float64", "ok": "bool", "n": "int32"})
    assert [tuple(r) for r in d.orderBy("id").collect()] == [("1", 2.5, True, 7), ("2", None, False, None)]
    with pytest.raises(ValueError):
        delimited.read_typed(spark, str(p), {"id": "string"})
    with pytest.raises(Exception, match="not a float64"):
        delimited.read_typed(spark, str(p), {"id": "string", "x": "string", "ok": "float64", "n": "string"}).collect()
    q = tmp_path / "c.tsv"
    q.write_text("participant_id\tage\tsex\nsub-01\t20\tF\nsub-02\tn/a\tM\n")
    c = delimited.read_covariates(spark, str(q))
    assert [tuple(r) for r in c.orderBy("participant_id").collect()] == [("01", 20.0, "F"), ("02", None, "M")]


def test_manifest_dataset(spark, tmp_path):
    g = Grid((2, 2, 1))
    for n, v in (("a", 1.0), ("b", 2.0)):
        (tmp_path / f"{n}.nii").write_bytes(nifti.encode(np.array([[0, v, v, np.nan]]), g))
    (tmp_path / "obs.csv").write_text("row,subject,img,x1,x2\nr1,s1,ra,1,2\nr2,s2,rb,3,4\n")
    (tmp_path / "res.csv").write_text("resource_id,backend,locator\nra,nifti,a.nii\nrb,nifti,b.nii\n")
    m = {
        "spec_version": "0.1", "dataset_id": "d", "storage_profile": "p", "observation_table": {"path": "obs.csv", "format": "csv"}, "row_id": "row", "observation_axes": ["subject"],
        "observation_columns": {"row": {"dtype": "string"}, "subject": {"dtype": "string", "semantic_role": "subject"}, "img": {"dtype": "string"}, "x1": {"dtype": "float64"}, "x2": {"dtype": "float64"}},
        "features": {
            "map": {"logical": {"kind": "volume", "axes": ["x", "y", "z"], "dtype": "float32", "support_ref": "s"}, "encodings": [{"type": "ref", "binding": {"resource_id": {"column": "img"}}}]},
            "vec": {"logical": {"kind": "vector", "axes": ["k"], "dtype": "float64"}, "encodings": [{"type": "columns", "binding": {"columns": ["x1", "x2"]}}]},
        },
        "supports": {"s": {"support_type": "volume", "grid_id": "g"}}, "resources": {"path": "res.csv", "format": "csv"},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(m))
    d = manifest.open_dataset(spark, f"file:{tmp_path}/manifest.json")
    assert [r["vector"] for r in d.resolve("vec").orderBy("row").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    rows, columns, subject = d.design()
    assert subject == "subject" and rows.columns == ["subject"]
    b = d.backing("map")
    assert sorted((r["row"], r["pos"], r["value"]) for r in b.collect()) == [("r1", 1, 1.0), ("r1", 2, 1.0), ("r2", 1, 2.0), ("r2", 2, 2.0)]
    for change in ({"extra": 1}, {"row_id": "nope"}, {"features": {}}, {"extensions": {"y": 1}}):
        with pytest.raises(ValueError):
            manifest.validate(m | change)
    with pytest.raises(ValueError, match="not unique"):
        manifest.check_rows(d.rows.union(d.rows), m)


def test_summary_tables(spark, tmp_path):
    good = "estimate,lower,upper,interval_kind,interval_level,df,cond\n1.5,1,2,ci_t,0.95,9,a\n2,,,none,,,b\n"
    p = tmp_path / "s.csv"
    p.write_text(good)
    d = summary.read_summary(spark, str(p))
    assert d.count() == 2 and d.schema["estimate"].dataType.typeName() == "double"
    assert [r[0] for r in summary.to_text(d.orderBy("cond")).collect()] == ["1.5,1,2,ci_t,0.95,9,a", "2,,,none,,,b"]
    for row in ("1,2,1,se,,,a", "1,0,2,ci_t,0.95,,a", "1,0,2,odd,,,a", "1,0,,se,,,a", "1,0,2,none,,,a", "01,0,2,se,,,a", "1,,,sd,,,a", "1,0,2,ci_t,1.5,3,a"):
        p.write_text(good.split("\n")[0] + "\n" + row + "\n")
        with pytest.raises(Exception):  # noqa: B017
            summary.read_summary(spark, str(p)).collect()
    with pytest.raises(ValueError):
        summary.validate_descriptor({"version": "0.1.0", "tables": {"t": {"table": {"path": "../x", "format": "csv"}}}})


def test_atlas(spark, tmp_path):
    (tmp_path / "l.nii").write_bytes(nifti.encode(np.array([[0, 1, 2, 2.0]]), Grid((2, 2, 1))))
    (tmp_path / "n.csv").write_text("label,name\n1,left\n2,right\n")
    lab, names, _ = atlas.read_atlas(spark, str(tmp_path / "l.nii"), str(tmp_path / "n.csv"))
    assert sorted(r["idx"] for r in atlas.region(lab, names, key="right").collect()) == [2, 3]
    with pytest.raises(ValueError):
        atlas.region(lab, names, key="none")


def test_streaming_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    ev = spark.range(200).select((F.col("id") % 7).alias("cell"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("value"))
    ev.write.parquet(src)
    q = moments.streaming_moments(spark.readStream.schema(ev.schema).parquet(src), "ts", "cell", "value").writeStream.format("memory").queryName("m_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = moments.streaming_moments(ev, "ts", "cell", "value")
    assert sorted(map(tuple, spark.table("m_test").collect())) == sorted(map(tuple, batch.collect()))


# ------------------------------------------------------------------ images by slabs
@pytest.mark.parametrize("name", ["i.nii", "i.nii.gz"])
def test_slabs_are_written_and_read_by_tasks(spark, tmp_path, name):
    rng = np.random.default_rng(8)
    data = np.round(rng.normal(0, 50, (5, 60)))
    data[2, 10:50] = 0  # cells without rows
    g = Grid((3, 4, 5), (2.0, 2.5, 3.0), (-9.0, 1.0, 4.0))
    d = cells(spark, data).filter("value <> 0").repartition(7)
    path = f"{tmp_path}/{name}"
    images.write_image(d, g, path, "i2", tr=1.5, slab_cells=32)
    assert os.listdir(tmp_path) == [name]  # nothing is left beside it
    raw = (tmp_path / name).read_bytes()
    h, back = nifti.decode(raw)
    assert nifti.grid_of(h).same_geometry(g, 1e-4) and h["dim"] == [3, 4, 5, 5] and (back == data).all()
    plain = gzip.decompress(raw) if name.endswith("gz") else raw
    assert plain == nifti.encode(data, g, "i2", 1.5)
    got = images.read_images(spark, path, slab_mb=100 / (1 << 20))
    assert got.rdd.getNumPartitions() == (1 if name.endswith("gz") else -(-len(raw) // 100))
    assert {(r["t"], r["idx"]): r["value"] for r in got.collect()} == {(t, i): v for t, x in enumerate(data) for i, v in enumerate(x)}
    some = got.filter("t IN (1, 4) AND idx > 7 AND idx <= 30")
    assert {(r["t"], r["idx"]): r["value"] for r in some.collect()} == {(t, i): data[t, i] for t in (1, 4) for i in range(8, 31)}
    assert {r["t"] for r in images.read_images(spark, path, [3, 0]).collect()} == {0, 3}
    with pytest.raises(Exception, match="no such volume"):
        images.read_images(spark, path, [9]).collect()


def test_filters_leave_bytes_unread(tmp_path):
    data = np.arange(6 * 1000.0).reshape(6, 1000)
    path = f"{tmp_path}/a.nii"
    (tmp_path / "a.nii").write_bytes(nifti.encode(data, Grid((10, 10, 10)), "f4"))
    reader = images.ImageReader({"path": path, "slab_mb": "0.002"})
    list(reader.pushFilters([images.EqualTo(("t",), 3), images.GreaterThan(("idx",), 989), images.LessThanOrEqual(("idx",), 995)]))
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert [x for b in got for x in b.column("value").to_pylist()] == list(range(3990, 3996))
    other = images.ImageReader({"path": str(tmp_path)})
    list(other.pushFilters([images.In(("file",), ("elsewhere.nii",))]))
    assert other.partitions() == []


def test_failed_writes_leave_nothing(spark, tmp_path):
    d = cells(spark, np.ones((1, 60))).drop("t").withColumn("idx", F.col("idx") + 10)
    for name in ("x.nii", "x.nii.gz"):
        with pytest.raises(Exception, match="outside the image"):
            images.write_image(d, Grid((3, 4, 5)), f"{tmp_path}/{name}", slab_cells=16)
        assert os.listdir(tmp_path) == []
    (tmp_path / "t.nii").write_bytes(nifti.encode(np.ones((1, 60)), Grid((3, 4, 5)))[:-5])
    with pytest.raises(Exception, match="truncated"):
        images.read_images(spark, f"{tmp_path}/t.nii").collect()
