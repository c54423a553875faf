"""Streams with removals against batch statistics."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from gridloom.streaming import retract

SCHEMA = "cell int, value double, sign int, time timestamp"


def test_merging_and_removing():
    rng = np.random.default_rng(1)
    x, y = rng.normal(1e6, 1, 40), rng.normal(3, 2, 25)
    n, mean, m2 = retract.merged(retract.merged((0, 0.0, 0.0), x, 1), y, 1)
    both = np.r_[x, y]
    assert n == 65 and np.isclose(mean, both.mean()) and np.isclose(m2, ((both - both.mean()) ** 2).sum())
    n, mean, m2 = retract.merged((n, mean, m2), x, -1)
    assert n == 25 and np.isclose(mean, y.mean(), atol=1e-6) and np.isclose(m2, ((y - y.mean()) ** 2).sum(), rtol=1e-2)
    assert retract.merged((25, mean, m2), y, -1) == (0, 0.0, 0.0)


def test_stream_equals_batch_after_removals_and_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    at = str(tmp_path)
    rows = [(c, float(v), 1, datetime(2024, 1, 1) + timedelta(hours=h)) for c in range(5) for v, h in zip(rng.normal(c, 2, 30), range(30), strict=True)] + [(4, float("nan"), 1, datetime(2024, 1, 1))]
    gone = [(c, v, -1, t) for i, (c, v, _, t) in enumerate(rows) if i % 3 == 0 or c == 2]
    for part in (rows[:80], rows[80:] + gone[:10], gone[10:]):
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{at}/changes")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/changes").drop("time")
        retract.follow(stream, f"{at}/out", f"{at}/checkpoint")  # each call goes on from the checkpoint
    left = [(c, v) for i, (c, v, _, _) in enumerate(rows) if i % 3 and c != 2 and np.isfinite(v)]
    got = {r["cell"]: r for r in retract.current(spark, f"{at}/out").collect()}
    assert set(got) == set(range(5)) and got[2]["count"] == 0 and got[2]["mean"] is None
    for c in (0, 1, 3, 4):
        v = np.array([x for k, x in left if k == c])
        assert got[c]["count"] == len(v) and np.isclose(got[c]["mean"], v.mean()) and np.isclose(got[c]["sd"], v.std(ddof=1))


def test_idle_cells_are_dropped(spark, tmp_path):
    at = str(tmp_path)
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    parts = ([(1, 5.0, 1, day(0)), (2, 7.0, 1, day(0))], [(2, 9.0, 1, day(3))], [(2, 1.0, 1, day(6))], [(1, 4.0, 1, day(7))])
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/changes")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{at}/changes")
        retract.follow(stream, f"{at}/out", f"{at}/checkpoint", idle="4 days")
    got = {r["cell"]: tuple(r)[1:] for r in retract.current(spark, f"{at}/out").collect()}
    assert got[2][0] == 3 and got[1] == (1, 4.0, None, False)  # cell 1 began anew
    assert spark.read.parquet(f"{at}/out").filter(F.col("expired") & (F.col("cell") == 1)).count() == 1
