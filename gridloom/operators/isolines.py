"""Iso-lines of planes of grid nodes: marching squares by a case table, lines by list ranking.

Every cell's corner pattern is joined with the few rows of a case table that say on which side a line enters and leaves.
Lines have what lies above the level on their left, so a side that one cell's line leaves by is where the neighbour's line
comes in: each crossing has one successor at most, and all lines are linked lists.  Their order comes from
pointer jumping, whose rounds grow with the logarithm of the longest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.num import is_finite
from gridloom.operators.order import cut, stored

KEY = ("plane", "level")
#: corners of a cell counter-clockwise; side k runs from corner k to the next
CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


def cases() -> list[tuple[int, bool, int, int]]:
    """(corners above the level as bits, middle above, side where a line begins, side where it ends).

    Around the cell a line begins where inside turns to outside and ends where it turns back.  Of two lines through a saddle,
    each goes round an outside corner if the middle is inside, else round an inside one.
    """
    out = []
    for code in range(16):
        inside = [code >> k & 1 for k in range(4)]
        begin = [k for k in range(4) if inside[k] and not inside[(k + 1) % 4]]
        end = [k for k in range(4) if not inside[k] and inside[(k + 1) % 4]]
        for middle in (False, True):
            for s in begin:
                out.append((code, middle, s, end[0] if len(end) == 1 else (s + (1 if middle else 3)) % 4))
    return out


def _side(side: Column, what) -> Column:
    """One of four columns by a side's number."""
    return F.element_at(F.array(*[what(k) for k in range(4)]), side + 1)


def segments(nodes: DataFrame, levels: list[float]) -> DataFrame:
    """plane, level, a, b, ax, ay, bx, by: directed pieces of lines in the cells of ``nodes`` (plane, x, y, value; x, y >= 0).

    A crossing's number (a, b) belongs to the side of a cell.  A node counts as inside where it is above the level; NaN, null and nodes
    that are missing are outside, and cells with a missing node have no lines.
    """
    spark = nodes.sparkSession
    around = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("x") - dx).alias("cx"), (F.col("y") - dy).alias("cy")) for k, (dx, dy) in enumerate(CORNERS)]))
    d = nodes.select("plane", F.col("x").cast("long"), F.col("y").cast("long"), F.col("value").cast("double"), around.alias("c"))
    d = d.groupBy("plane", F.col("c.cx").alias("x"), F.col("c.cy").alias("y")).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("c.k") == k, F.col("value"))).alias(f"v{k}") for k in range(4)])
    d = d.filter("n = 4").withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    above = lambda v: F.coalesce(~F.isnan(v) & (v > F.col("level")), F.lit(False))
    code = sum((above(F.col(f"v{k}")).cast("int") * (1 << k) for k in range(4)), F.lit(0))
    middle = above((F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")) / 4)
    table = spark.createDataFrame(cases(), "code int, middle boolean, begin int, finish int")  # 28 rows
    d = d.withColumns({"code": code, "middle": middle}).join(F.broadcast(table), ["code", "middle"])

    def share(a, b):
        t = (F.col("level") - a) / F.when(a != b, b - a)
        return F.when(is_finite(t), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.5)

    x, y, v = F.col("x").cast("long"), F.col("y").cast("long"), [F.col(f"v{k}") for k in range(4)]
    along = [share(v[0], v[1]), share(v[1], v[2]), share(v[3], v[2]), share(v[0], v[3])]
    low = [(0, 0, 0), (1, 0, 1), (0, 1, 0), (0, 0, 1)]  # the side's lower node and whether it is upright
    number = lambda k: F.shiftleft(y + low[k][1], 32) + (x + low[k][0]) * 2 + low[k][2]
    px = lambda k: (x + low[k][0]).cast("double") + (F.lit(0.0) if low[k][2] else along[k])
    py = lambda k: (y + low[k][1]).cast("double") + (along[k] if low[k][2] else F.lit(0.0))
    ends = [_side(F.col(side), f).alias(n + name) for n, side in (("a", "begin"), ("b", "finish")) for name, f in (("", number), ("x", px), ("y", py))]
    return d.select(*KEY, *ends)


def _jump(points: DataFrame) -> DataFrame:
    """``points`` (KEY, e, prv) with ptr, far, steps, low after pointer jumping: ptr is null for all that reach a beginning.

    For others, which lie on rings, ``low`` is the least number of the ring.
    """
    at = F.col("e")
    d = cut(points.select(*KEY, "e", F.col("prv").alias("ptr"), F.coalesce("prv", at).alias("far"), F.col("prv").isNotNull().cast("long").alias("steps"), F.least(at, F.coalesce("prv", at)).alias("low")))
    while True:
        there = d.select(*KEY, F.col("e").alias("ptr"), F.col("ptr").alias("p2"), F.col("far").alias("f2"), F.col("steps").alias("s2"), F.col("low").alias("l2"))
        j = d.join(there, [*KEY, "ptr"], "left")
        low = F.least("low", F.coalesce("l2", "low"))
        moved = F.col("ptr").isNotNull() & (F.col("p2").isNull() | (low != F.col("low")))
        d = stored(j.select(*KEY, "e", F.col("p2").alias("ptr"), F.coalesce("f2", "far").alias("far"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), low.alias("low"), moved.alias("moved")))
        if d.filter("moved").isEmpty():
            return d.drop("moved")
        d = d.drop("moved")


def chain(pieces: DataFrame) -> DataFrame:
    """plane, level, line, nth, x, y: the points of every line in order.

    ``line`` is the number of a line's first crossing, of a ring its least; rings end with the point where they begin.
    """
    begin = pieces.select(*KEY, F.col("a").alias("e"), F.col("b").alias("nxt"), F.lit(None).cast("long").alias("prv"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    end = pieces.select(*KEY, F.col("b").alias("e"), F.lit(None).cast("long").alias("nxt"), F.col("a").alias("prv"), F.col("bx").alias("x"), F.col("by").alias("y"))
    points = cut(begin.union(end).groupBy(*KEY, "e").agg(*[F.max(c).alias(c) for c in ("nxt", "prv", "x", "y")]))
    first = _jump(points)
    ranks = first.filter("ptr is null").select(*KEY, "e", F.col("far").alias("line"), F.col("steps").alias("nth"))
    rings = first.filter("ptr is not null").select(*KEY, "e", "low")
    if not rings.isEmpty():
        opened = points.join(rings, [*KEY, "e"]).withColumn("prv", F.when(F.col("e") != F.col("low"), F.col("prv")))
        turn = _jump(opened).select(*KEY, "e", F.col("far").alias("line"), F.col("steps").alias("nth"))
        around = turn.groupBy(*KEY, F.col("line").alias("e")).agg(F.max("line").alias("line"), F.count(F.lit(1)).alias("nth"))
        ranks = ranks.unionByName(turn).unionByName(around)
    return ranks.join(points.select(*KEY, "e", "x", "y"), [*KEY, "e"]).select(*KEY, "line", "nth", "x", "y")


def iso_lines(nodes: DataFrame, levels: list[float]) -> DataFrame:
    """:func:`chain` of :func:`segments`; levels that are not finite have no lines."""
    return chain(segments(nodes, [v for v in levels if abs(v) < float("inf")]))


def to_layout(lines: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Lines in grid coordinates moved to layout coordinates."""
    return lines.withColumns({"x": x0 + F.col("x") * dx, "y": y0 + F.col("y") * dy})
