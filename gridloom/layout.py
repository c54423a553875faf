"""Long layouts of the driver's tables: volume, set of maps, series, hyper array and design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid

DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """(idx, value, label, brand) of ``part`` on a 10 x 10 x n grid; one cheap aggregate gives the depth."""
    part = table(spark, sf_dir, "part")
    top = part.agg(F.max("p_partkey")).first()[0]
    vol = part.select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("label"), F.col("p_brand").alias("brand"))
    return vol, Grid((10, 10, int(top) // 100 + 1), (2.0, 2.5, 3.0), (-9.0, -11.25, -20.0))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, pos, value, grp) of ``embeddings``: one map of 64 cells per row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("member"), F.col("label").alias("grp"), F.posexplode("embedding").alias("pos", "v")).select("member", "pos", F.col("v").cast("double").alias("value"), "grp")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, t, value): daily sums per user, dense over the users and ``DAYS`` days, 0 where nothing happened."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("idx"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"), "value")
    day = e.groupBy("idx", "t").agg(F.sum("value").alias("value"))
    packed = day.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("m"))
    dense = packed.select("idx", "m", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("t"))
    return dense.select("idx", "t", F.coalesce(F.try_element_at("m", F.col("t")), F.lit(0.0)).alias("value"))


def hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, status, year, value): quantities of ``lineitem`` summed into three named dimensions."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("value"))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, cond, grp, value): supplier, return flag, the supplier's region, and price."""
    li, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    sup = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_regionkey").alias("grp"))
    return li.join(sup, li.l_suppkey == sup.s_suppkey).select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("cond"), "grp", F.col("l_extendedprice").alias("value"))


#: the same views as DuckDB common table expressions
SQL = {
    "vol": "vol AS (SELECT p_partkey AS idx, p_retailprice AS value, p_size AS label, p_brand AS brand FROM part)",
    "gdim": "gdim AS (SELECT 10 AS nx, 10 AS ny, CAST(max(p_partkey) // 100 + 1 AS BIGINT) AS nz FROM part)",
    "members": "members AS (SELECT vec_id AS member, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
    "series": "dayv AS (SELECT user_id AS idx, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, sum(value) AS value FROM events GROUP BY 1, 2), "
    "series AS (SELECT u.idx, CAST(d.range AS INTEGER) AS t, coalesce(dayv.value, 0.0) AS value FROM (SELECT DISTINCT idx FROM dayv) u CROSS JOIN range(30) d LEFT JOIN dayv ON dayv.idx = u.idx AND dayv.t = d.range)",
    "hyper": "hyper AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)",
    "design": "design AS (SELECT l_suppkey AS subject, l_returnflag AS cond, n_regionkey AS grp, l_extendedprice AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)",
}
