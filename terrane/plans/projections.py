"""Spectral indices and other row-wise projections."""

from pyspark.sql import functions as F

from ..functions import indices
from ..operators import rows as R
from ..operators import spatial, workflows
from ..sources.adapters import BAND_OBS, band_obs, table
from .registry import query

B, G, RD, N, S1, S2, E2, E3 = "(blue / 10000)", "(green / 10000)", "(red / 10000)", "(nir / 10000)", '("SWIR1" / 10000)', '("SWIR2" / 10000)', '("redEdge2" / 10000)', '("redEdge3" / 10000)'
INDEX_SQL = {
    "ndvi": "10000 * ((nir - red) / nullif(nir + red, 0))",
    "evi2": f"25000 * (({N} - {RD}) / ({N} + 1 + 2.4 * {RD}))",
    "savi": f"15000 * (({N} - {RD}) / ({N} + {RD} + 0.5))",
    "msavi": f"5000 * ((2 * {N} + 1) - CASE WHEN (2 * {N} + 1) ** 2 - 8 * ({N} - {RD}) >= 0 THEN sqrt((2 * {N} + 1) ** 2 - 8 * ({N} - {RD})) END)",
    "bareSoil": f"10000 * ((({N} + {G}) - ({RD} + {B})) / ({N} + {G} + {RD} + {B})) * 100 + 100",
    "sr": "10000 * (nir / nullif(red, 0))",
    "bai": f"10000 / ((0.06 - {N}) ** 2 + (0.1 - {RD}) ** 2)",
    "CI": f"CASE WHEN blue IS NOT NULL THEN 10000 * (({B} + {G} + {RD}) + 15 * greatest(abs({B} - {G}), abs({B} - {RD}), abs({RD} - {G}))) END",
    "ndmi": "10000 * ((nir - green) / (nir + green + 0.000000001))",
    "NBR": '10000 * ((nir - "SWIR2") / nullif(nir + "SWIR2", 0))',
    "NBR2": '10000 * (("SWIR1" - "SWIR2") / nullif("SWIR1" + "SWIR2", 0))',
    "MIRBI": f"10000 * (10 * {S2} - 9.8 * {S1} + 2)",
    "baiS": f"10000 * (1 - sqrt({E2} * {E3} * {N} / {RD})) * (({S2} - {N}) / sqrt({S2} + {N}) + 1)",
    "BurnScar": f'10000 * ((("SWIR2" - red) / ("SWIR2" + red)) / ({G} * {G} + {RD} * {RD} + {N} * {N}))',
    "ndwi": '10000 * ((nir - "SWIR1") / (nir + "SWIR1" + 0.000000001))',
}


def add(name):
    @query(f"WITH {BAND_OBS} SELECT pix, l_orderkey, l_linenumber, l_suppkey, round({INDEX_SQL[name]}, 4) AS value FROM band_obs", name=f"idx_{name}")
    def index(spark, d):
        return band_obs(spark, d).select("pix", "l_orderkey", "l_linenumber", "l_suppkey", F.round(indices.measure(name), 4).alias("value"))


for _name in INDEX_SQL:
    add(_name)


@query(f"""WITH {BAND_OBS} SELECT pix, l_orderkey, l_linenumber, l_suppkey, round(5000 * (2 * {N} + 1) - ((2 * {N} + 1) ** 2 - 8 * ({N} - {RD})) / 2, 4) AS msavi,
  round(10000 * ((({N} + {G}) - (red + blue)) / (nir + green + red + blue)) * 100 + 100, 4) AS bare_soil, round(100 / ((0.06 - {N}) ** 2 + (0.1 - {RD}) ** 2), 4) AS bai FROM band_obs""")
def idx_variants(spark, d):
    return band_obs(spark, d).select(
        "pix", "l_orderkey", "l_linenumber", "l_suppkey", F.round(indices.msavi(literal=True), 4).alias("msavi"), F.round(indices.bare_soil(literal=True), 4).alias("bare_soil"), F.round(indices.bai(series=True), 4).alias("bai")
    )


@query("""WITH f AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') || '_3B_clip.tif' AS name FROM orders)
SELECT o_orderkey, split_part(name, '_', 1) AS field_id, CAST(strptime(substr(split_part(name, '_', 2), 1, 8), '%Y%m%d') AS DATE) AS obs_date, regexp_replace(name, '\\.tif$', '') AS stem, substr(name, 1, 12) AS image_id FROM f""")
def filename_parse(spark, d):
    name = F.concat_ws("_", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("3B"), F.lit("clip.tif"))
    files = table(spark, d, "orders").select("o_orderkey", name.alias("name"))
    return files.select("o_orderkey", *[c.alias(k) for k, c in R.file_parts(F.col("name")).items()], F.substring("name", 1, 12).alias("image_id"))


@query("SELECT p_partkey, CAST(500000 + (p_partkey % 40 + 0.5) * 3.0 AS DOUBLE) AS x, CAST(3300000 + (p_partkey // 40 + 0.5) * -3.0 AS DOUBLE) AS y FROM part")
def grid_coords(spark, d):
    x, y = spatial.grid_coords(F.col("p_partkey"), 40, 500000.0, 3300000.0, 3.0, -3.0)
    return table(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y"))


@query("SELECT p_partkey FROM part WHERE 500000 + (p_partkey % 40 + 0.5) * 3.0 BETWEEN 500010 AND 500070 AND 3300000 + (p_partkey // 40 + 0.5) * -3.0 BETWEEN 3299800 AND 3299990")
def clip_to_box(spark, d):
    x, y = spatial.grid_coords(F.col("p_partkey"), 40, 500000.0, 3300000.0, 3.0, -3.0)
    return spatial.clip(table(spark, d, "part").select("p_partkey"), x, y, (500010.0, 3299800.0, 500070.0, 3299990.0))


@query("""WITH g AS (SELECT p_partkey, 500000 + (p_partkey % 40 + 0.5) * 3.0 AS x, 3300000 + (p_partkey // 40 + 0.5) * -3.0 AS y FROM part)
SELECT p_partkey FROM g WHERE y < 3299990 AND y > 3299800 + (x - 500010) * 0 AND x >= 500010 AND (3299990 - y) / 190 >= (x - 500010) / 60 AND x < 500010 + 60 * (3299990 - y) / 190""")
def clip_to_polygon(spark, d):
    x, y = spatial.grid_coords(F.col("p_partkey"), 40, 500000.0, 3300000.0, 3.0, -3.0)
    ring = [(500010.0, 3299990.0), (500010.0, 3299800.0), (500070.0, 3299800.0)]
    return table(spark, d, "part").where(spatial.inside(x, y, ring)).select("p_partkey")


@query("SELECT c_custkey, concat_ws('_', CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR)) AS pixel_id, CAST(trunc(c_acctbal) AS INTEGER) AS whole, coalesce(nullif(c_acctbal, 0), -1) AS filled FROM customer")
def ids_and_casts(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.concat_ws("_", c.c_nationkey.cast("string"), c.c_custkey.cast("string")).alias("pixel_id"), c.c_acctbal.cast("int").alias("whole"), F.coalesce(F.nullif(c.c_acctbal, F.lit(0.0)), F.lit(-1.0)).alias("filled"))


@query(f"WITH {BAND_OBS} SELECT pix, l_orderkey, l_linenumber, l_suppkey, round((coalesce(blue, 0) + coalesce(CASE WHEN l_linenumber < 4 THEN red END, 0) + coalesce(nir, 0)) / nullif(CAST(blue IS NOT NULL AS INT) + CAST((CASE WHEN l_linenumber < 4 THEN red END) IS NOT NULL AS INT) + CAST(nir IS NOT NULL AS INT), 0), 6) AS mean FROM band_obs")
def row_mean(spark, d):
    b = band_obs(spark, d).withColumn("red", F.when(F.col("l_linenumber") < 4, F.col("red")))
    return b.select("pix", "l_orderkey", "l_linenumber", "l_suppkey", F.round(R.mean_of_columns(["blue", "red", "nir"]), 6).alias("mean"))


UTM_SQL = """WITH p AS (SELECT s_suppkey, radians(30 + (s_suppkey % 100) / 100) AS phi, radians(74 + (s_suppkey % 70) / 35 - 75) AS lam FROM supplier),
c AS (SELECT *, 6378137.0 AS a, 0.0066943799901413165 AS e2, 0.006739496742276434 AS ep2 FROM p),
q AS (SELECT s_suppkey, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, ep2 * cos(phi) ** 2 AS c, cos(phi) * lam AS aa, ep2, tan(phi) AS tn,
  a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - (35 * e2 ** 3 / 3072) * sin(6 * phi)) AS m FROM c)
SELECT s_suppkey, round(0.9996 * n * (aa + (1 - t + c) * aa ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * ep2) * aa ** 5 / 120) + 500000, 3) AS east,
  round(0.9996 * (m + n * tn * (aa ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * aa ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * ep2) * aa ** 6 / 720)), 3) AS north FROM q"""


@query(UTM_SQL)
def utm_projection(spark, d):
    s = table(spark, d, "supplier")
    e, n = spatial.utm(30 + (F.col("s_suppkey") % 100) / 100, 74 + (F.col("s_suppkey") % 70) / 35)
    return s.select("s_suppkey", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query("""WITH p AS (SELECT p_partkey // 40 AS r, p_partkey % 40 AS c, p_retailprice AS v, (p_partkey // 40 + 0.5) * 2 - 0.5 AS y, (p_partkey % 40 + 0.5) * 2 - 0.5 AS x FROM part),
s AS (SELECT CAST(nr AS BIGINT) AS new_row, CAST(nc AS BIGINT) AS new_col, v, (1 - abs(nr - y) / 2) * (1 - abs(nc - x) / 2) AS w FROM (SELECT *, unnest(generate_series(CAST(2 * r - 1 AS BIGINT), CAST(2 * r + 2 AS BIGINT))) AS nr FROM p) q, generate_series(0, 90) g(nc) WHERE nr >= 0 AND abs(nr - y) < 2 AND abs(nc - x) < 2)
SELECT 1 AS image, new_row, new_col, round(sum(v * w) / sum(w), 6) AS value FROM s GROUP BY ALL""")
def resample_grid(spark, d):
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_retailprice").alias("value"), F.lit(1).alias("image"))
    return spatial.resample(p, ["image"], "row", "col", "value", 2.0)


@query("""SELECT l_suppkey AS image, count(*) AS cells, count(DISTINCT l_linenumber) AS height, count(DISTINCT l_partkey) AS width, min(l_partkey) AS "minX", max(l_partkey) AS "maxX", min(l_linenumber) AS "minY", max(l_linenumber) AS "maxY",
  count(*) FILTER (l_tax = 0) AS nodata, min(nullif(l_tax, 0)) AS low, max(nullif(l_tax, 0)) AS high, round(avg(nullif(l_tax, 0)), 6) AS mean FROM lineitem GROUP BY 1""")
def raster_summary(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), "l_partkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("v"))
    return workflows.raster_summary(li, "image", "l_partkey", "l_linenumber", "v")


@query("""SELECT s_suppkey, '{"minX":' || s_suppkey || ',"minY":' || s_nationkey || ',"maxX":' || (s_suppkey + 1) || ',"maxY":' || (s_nationkey + 1) || '}' AS extent FROM supplier""")
def extent_json(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", spatial.extent_json(s.s_suppkey, s.s_nationkey, s.s_suppkey + 1, s.s_nationkey + 1).alias("extent"))
