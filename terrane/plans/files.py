"""Sinks and sources: what is written comes back."""

import uuid

from pyspark.sql import functions as F

from ..operators import rows as R
from ..operators import series as S
from ..operators import spatial
from ..sources import io, raster
from ..sources.adapters import ALIGNED, table
from .registry import query
from .series import aligned


def place(spark, name):
    return f"{io.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_nationkey, nullif(s_acctbal, 0) AS s_acctbal FROM supplier")
def csv_scan(spark, d):
    """Typed CSV with NaN for missing numbers."""
    at = place(spark, "csv")
    s = table(spark, d, "supplier").withColumn("s_acctbal", F.nullif("s_acctbal", F.lit(0.0)))
    io.write_csv(s, at)
    return io.nan_to_null(io.read_csv(spark, at, "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"))


@query("SELECT n_name AS value FROM nation")
def list_scan(spark, d):
    """One column without a header."""
    at = place(spark, "list")
    io.write_lines(table(spark, d, "nation").select("n_name"), at)
    return io.read_list(spark, at)


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS \"To_remove\" FROM orders")
def blacklist_scan(spark, d):
    at = place(spark, "blacklist")
    table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("To_remove")).write.option("header", True).option("sep", "\t").csv(at)
    return io.read_blacklist(spark, at)


@query(f"WITH {ALIGNED}, v AS (SELECT field_id, rel_day, arg_max(value, obs_date) AS value FROM aligned WHERE rel_day BETWEEN -50 AND 50 GROUP BY 1, 2) SELECT CAST(field_id AS VARCHAR) AS field_id, CAST(rel_day AS INTEGER) AS rel_day, value FROM v WHERE value IS NOT NULL")
def series_scan(spark, d):
    """A column for each field, a row for each day, as files and back."""
    at = place(spark, "series")
    io.write_series(S.spine(aligned(spark, d)), at)
    return io.read_series(spark, at)


@query("SELECT 'grid.tif' AS file_name, p_partkey // 40 AS row, p_partkey % 40 AS col, 500000 + (p_partkey % 40 + 0.5) * 3 AS x, 3300000 - (p_partkey // 40 + 0.5) * 3 AS y, CAST(p_size AS DOUBLE) AS size, CAST(nullif(p_partkey % 7, 0) AS DOUBLE) AS week FROM part")
def image_scan(spark, d):
    """A grid as a GeoTIFF image of two bands, and the image as a table of cells."""
    at = place(spark, "images")
    k = F.col("p_partkey")
    cells = table(spark, d, "part").select(F.lit("grid.tif").alias("image"), F.floor(k / 40).alias("row"), (k % 40).alias("col"), F.col("p_size").alias("size"), (k % 7).alias("week"))
    raster.write_geotiff(cells, at, "image", ["size", "week"], 500000.0, 3300000.0, 3.0, -3.0).collect()
    return raster.read_geotiff(spark, at, ["size", "week"]).where("size IS NOT NULL")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem")
def columns_matching(spark, d):
    return R.keep_matching(table(spark, d, "lineitem"), "key$|quantity")


@query("SELECT s_suppkey, round(30 + (s_suppkey % 100) / 100, 6) AS lat, round(74 + (s_suppkey % 70) / 35, 6) AS lon FROM supplier")
def utm_inverse(spark, d):
    """Degrees of projected points are the degrees they come from."""
    lat, lon = 30 + (F.col("s_suppkey") % 100) / 100, 74 + (F.col("s_suppkey") % 70) / 35
    e, n = spatial.utm(lat, lon)
    there = table(spark, d, "supplier").select("s_suppkey", e.alias("e"), n.alias("n"))
    back = spatial.from_utm(F.col("e"), F.col("n"))
    return there.select("s_suppkey", F.round(back[0], 6).alias("lat"), F.round(back[1], 6).alias("lon"))
