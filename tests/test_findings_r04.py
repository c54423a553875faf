"""Work that did not fit its limits: tests for each finding of the fourth round."""

import re

import duckdb
import numpy as np
import pytest

from gridloom.num import rounded, rounded_array
from gridloom.operators import setstats
from gridloom.sources import manifest


def test_product_is_written_piece_by_piece(spark, monkeypatch):
    """What an explode holds ends at pieces of blocks, and values are made before rows meet them (F1)."""
    for k, n in (("ROWS", 50), ("CELLS", 40), ("PIECE", 7)):
        monkeypatch.setattr(manifest, k, n)
    cells = spark.createDataFrame([(f"/d/{f}", t, i, 0.0 if i == 5 else float("nan") if i == 6 and t else i / 3 + t + (7 if f == "b" else 0)) for f in "ab" for t in range(2) for i in range(101)], "file string, t int, idx long, value double")
    monkeypatch.setattr(manifest, "read_cells", lambda spark, files: cells)
    rows = spark.createDataFrame([(f"r{n}", "a" if n < 110 else "b") for n in range(125)] + [("none", None)], "row string, locator string")

    class Held(manifest.Dataset):
        def resolve(self, feature):
            return rows

    out = Held(spark, "/d", {"row_id": "row"}, rows, None).backing("map", each=rounded)
    want = sorted((f"r{n}", i, t, "nan" if i == 6 and t else f"{i / 3 + t + (7 if n >= 110 else 0):.6f}") for n in range(125) for t in range(2) for i in range(101) if i != 5)
    got = sorted((r["row"], r["pos"], r["axis"], f"{r['value']:.6f}") for r in out.collect())
    assert got == want
    plan = [x.strip(" :+-") for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    first = lambda what: next(n for n, x in enumerate(plan) if what in x)
    assert first("Generate explode(cells") < first("Repartition") < first("Join") < first("round(")
    between = plan[: first("Repartition")]
    assert not any("round(" in x or "slice(" in x for x in between)
    assert [x.split("#")[0] for x in plan if x.startswith(("Generate explode(cells", "Generate explode(rows", "Repartition"))] == ["Generate explode(cells", "Generate explode(rows", "Repartition 4, false", "Generate explode(rows", "Generate explode(cells", "Repartition 4, true"]


@pytest.mark.parametrize("held", [True, False])
def test_maps_are_shipped_a_bounded_number_of_times(spark, monkeypatch, held):
    """Blocks of narrow maps grow with the members, and pairs equal their definition with and without missing cells (F2)."""
    monkeypatch.setattr(setstats, "BLOCK", 5)
    monkeypatch.setattr(setstats, "STRIPE", 3)
    monkeypatch.setattr(setstats, "SLICE", 2048 if held else 7)
    rng = np.random.default_rng(4)
    for missing in (0.0, 0.3):
        x = rng.normal(size=(40, 9)) * 10 + 500
        x[7], x[11] = 3.25, x[12]
        x[rng.random(x.shape) < missing] = np.nan
        x[20] = np.nan
        x[21, :6] = np.nan
        if not missing:
            x = np.delete(x, [20, 21], axis=0)
        d = spark.createDataFrame([(m, p + 100, float(x[m, p])) for m in range(len(x)) for p in range(9)], "member int, pos int, value double")
        for block, digits in ((None, 6), (6, None), (1, 6)):
            out = setstats.correlation_matrix(d, block=block, digits=digits)
            got = {(q["a"], q["b"]): q["r"] for q in out.collect()}
            seen = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if (np.isfinite(x[a]) & np.isfinite(x[b])).any()]
            assert sorted(got) == seen and out.schema["a"].dataType.typeName() == "integer"
            for a, b in seen:
                ok = np.isfinite(x[a]) & np.isfinite(x[b])
                p, q = x[a, ok], x[b, ok]
                if ok.sum() < 3 or np.ptp(p) == 0 or np.ptp(q) == 0:
                    assert got[a, b] is None
                else:
                    assert abs(got[a, b] - np.corrcoef(p, q)[0, 1]) < (6e-7 if digits else 1e-9)
                    assert digits is None or f"{got[a, b]:.12f}".endswith("000000")
            m = {(q["a"], q["b"]): q for q in setstats.pair_moments(d, block=block).collect()}
            assert sorted(m) == seen
            for a, b in seen[::7]:
                ok = np.isfinite(x[a]) & np.isfinite(x[b])
                p, q = x[a, ok], x[b, ok]
                assert np.allclose([m[a, b][c] for c in ("n", "mx", "my", "cxy", "cxx", "cyy")], [ok.sum(), p.mean(), q.mean(), ((p - p.mean()) * (q - q.mean())).sum(), ((p - p.mean()) ** 2).sum(), ((q - q.mean()) ** 2).sum()], atol=1e-8)
    wide = spark.range(30000).selectExpr("id member", "cast(id % 2 * 8 as int) pos", "1.0D value")
    plan = setstats.correlation_matrix(wide)._jdf.queryExecution().optimizedPlan().toString()
    blocks = int(re.search(r"pmod\(xxhash64\(.*?\), (\d+)\)", plan)[1])  # as often a map is shipped
    assert blocks == (12 if held else 6000)


def test_rounding_in_tasks():
    x = np.array([0.0, -0.0, 0.5, -0.5, 1.25e-6, 0.4999995, -0.4999995, 1.0, -1.0, 1e300, -1e300, np.inf, np.nan, 2.5e-7, 4.9999999e-7, 1234.5678905])
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0", [v]).fetchone()[0] for v in x.tolist()]
    got = rounded_array(x, 6)
    assert np.array_equal(got, np.array(want), equal_nan=True) and not np.signbit(got[1])
