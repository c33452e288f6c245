"""Joins, set operations and reshaping."""

from pyspark.sql import functions as F

from ..operators import rows as R
from ..operators import spatial, workflows
from ..operators.series import union_tagged
from ..sources.adapters import BAND_OBS, LABELS, band_obs, labels, table
from ..sources.io import consolidate
from .registry import query


@query(f"WITH {LABELS} SELECT d.doc_id, d.source, l.label, CASE WHEN l.unique_id IS NULL THEN 'NONTRAINING' ELSE 'TRAINING' END AS \"set\" FROM documents d LEFT JOIN labeled l ON l.unique_id = d.doc_id")
def label_left_join(spark, d):
    docs, y = table(spark, d, "documents").select("doc_id", "source"), labels(spark, d)
    out = docs.join(y, docs.doc_id == y.unique_id, "left")
    return out.select("doc_id", "source", "label", F.when(F.col("unique_id").isNull(), "NONTRAINING").otherwise("TRAINING").alias("set"))


@query("""WITH a AS (SELECT l_partkey, round(avg(l_quantity), 6) AS "redAvg" FROM lineitem WHERE l_linenumber < 5 GROUP BY 1), b AS (SELECT l_partkey, round(avg(l_quantity), 6) AS "redAvg_S", count(*) AS "numSentinel" FROM lineitem WHERE l_linenumber >= 5 GROUP BY 1)
SELECT a.l_partkey AS pixel_id, "redAvg", "redAvg_S", "numSentinel" FROM a JOIN b USING (l_partkey)""")
def sensor_merge(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "pixel_id")
    a = li.where("l_linenumber < 5").groupBy("pixel_id").agg(F.round(F.avg("l_quantity"), 6).alias("redAvg"))
    b = li.where("l_linenumber >= 5").groupBy("pixel_id").agg(F.round(F.avg("l_quantity"), 6).alias("redAvg"), F.count(F.lit(1)).alias("imgCount"))
    return a.join(b.withColumnsRenamed({"redAvg": "redAvg_S", "imgCount": "numSentinel"}), "pixel_id")


@query("""WITH q AS (SELECT l_suppkey AS img_id, CASE WHEN l_suppkey % 11 <> 0 THEN l_linenumber - 1 END AS udm, CAST(l_returnflag = 'N' AS INTEGER) AS b1, CAST(l_linestatus = 'O' AS INTEGER) AS b3, CAST(l_returnflag = 'R' AS INTEGER) AS b6, l_linenumber % 4 AS b8 FROM lineitem),
c AS (SELECT s_suppkey AS img_id, s_acctbal / 100 AS clouds_meta FROM supplier WHERE s_nationkey <> 3),
r AS (SELECT img_id, round(CASE WHEN count(udm) > 0 THEN 100.0 * count(*) FILTER (udm > 1) / count(*) FILTER (udm <> 1) END, 6) AS percent_notclear_udm_1, round(100.0 * count(*) FILTER (b8 > 1) / count(*) FILTER (b8 <> 1), 6) AS percent_notclear_udm_2,
  round(100.0 * (count(*) FILTER (b8 <> 1) - count(*) FILTER (b1 <> 0)) / count(*) FILTER (b8 <> 1), 6) AS percent_notclear_udm2, round(100.0 * count(*) FILTER (b6 + b3 <> 0) / count(*) FILTER (b8 <> 1), 6) AS percent_cs_udm2,
  round(100.0 * count(*) FILTER (b6 + b3 <> 0 OR b8 > 1) / count(*) FILTER (b8 <> 1), 6) AS percent_csorig_udm2 FROM q GROUP BY 1)
SELECT img_id, clouds_meta, percent_notclear_udm_1, percent_notclear_udm_2, percent_notclear_udm2, percent_cs_udm2, percent_csorig_udm2 FROM c FULL JOIN r USING (img_id)""")
def cloud_report(spark, d):
    """The six estimates, with images that lack metadata or the older mask."""
    li = table(spark, d, "lineitem")
    is_ = lambda c, v: (F.col(c) == v).cast("int")
    q = li.select(
        F.col("l_suppkey").alias("img_id"), F.when(F.col("l_suppkey") % 11 != 0, F.col("l_linenumber") - 1).alias("udm"), is_("l_returnflag", "N").alias("b1"), is_("l_linestatus", "O").alias("b3"), is_("l_returnflag", "R").alias("b6"),
        (F.col("l_linenumber") % 4).alias("b8"),
    )
    meta = table(spark, d, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("img_id"), (F.col("s_acctbal") / 100).alias("clouds_meta"))
    return workflows.compare_clouds(q, meta, "img_id")


LINES = range(1, 8)


@query(f"SELECT l_partkey AS pixel_id, {', '.join(f'round(avg(l_discount) FILTER (l_linenumber = {k}), 6) AS pred_{k}' for k in LINES)} FROM lineitem GROUP BY 1")
def outer_reduce(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "pixel_id")
    parts = [li.where(F.col("l_linenumber") == k).groupBy("pixel_id").agg(F.round(F.avg("l_discount"), 6).alias(f"pred_{k}")) for k in LINES]
    return R.outer_reduce(parts, "pixel_id")


@query(f"SELECT l_partkey AS pixel_id, {', '.join(f'max(l_quantity) FILTER (l_linenumber = {k}) AS run{k}' for k in LINES)} FROM lineitem GROUP BY 1")
def partition_consolidate(spark, d):
    runs = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("pixel_id"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("part")).agg(F.max("l_quantity").alias("meanPred"))
    return consolidate(runs, "pixel_id", "part", "meanPred")


AOI = 'aoi AS (SELECT s_suppkey AS id, 30 + (s_suppkey % 37) * 0.11 AS "minLat", 30 + (s_suppkey % 37) * 0.11 + 0.35 AS "maxLat", 74 + (s_suppkey % 23) * 0.17 AS "minLon", 74 + (s_suppkey % 23) * 0.17 + 0.3 AS "maxLon" FROM supplier)'
FOOT = 'foot AS (SELECT n_nationkey AS id, 30 + n_nationkey * 0.15 AS "minLat", 30 + n_nationkey * 0.15 + 1.2 AS "maxLat", 74 + (n_nationkey % 5) * 0.7 AS "minLon", 74 + (n_nationkey % 5) * 0.7 + 0.9 AS "maxLon" FROM nation)'


@query(f"""WITH {AOI}, {FOOT} SELECT a.id, CAST(b.id AS INTEGER) AS b_id FROM aoi a JOIN foot b ON NOT (a."maxLat" < b."minLat" OR a."maxLon" < b."minLon" OR a."minLon" > b."maxLon" OR a."minLat" > b."maxLat")""")
def bbox_overlap(spark, d):
    k = F.col("s_suppkey")
    y, x = 30 + (k % 37) * 0.11, 74 + (k % 23) * 0.17
    a = table(spark, d, "supplier").select(k.alias("id"), y.alias("minLat"), (y + 0.35).alias("maxLat"), x.alias("minLon"), (x + 0.3).alias("maxLon"))
    n = F.col("n_nationkey")
    v, u = 30 + n * 0.15, 74 + (n % 5) * 0.7
    b = table(spark, d, "nation").select(n.alias("id"), v.alias("minLat"), (v + 1.2).alias("maxLat"), u.alias("minLon"), (u + 0.9).alias("maxLon"))
    return spatial.bbox_overlap(a, b, 0.5).select("id", "b_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_margins(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").count().withColumnRenamed("count", "n")


@query("SELECT 'tilled' AS kind, o_orderkey AS id, o_totalprice AS v, CAST(NULL AS VARCHAR) AS note FROM orders UNION ALL SELECT 'burned', c_custkey, c_acctbal, c_mktsegment FROM customer")
def union_tag(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("note"))
    return union_tagged({"tilled": a, "burned": b}, "kind")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def setdiff(spark, d):
    """Customers without a finished order."""
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query(f"WITH {BAND_OBS} SELECT band, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT 'blue' AS band, blue AS v FROM band_obs UNION ALL SELECT 'green', green FROM band_obs UNION ALL SELECT 'nir', nir FROM band_obs) GROUP BY 1")
def unpivot_bands(spark, d):
    long = band_obs(spark, d).select("blue", "green", "nir").unpivot([], ["blue", "green", "nir"], "band", "v")
    return long.groupBy("band").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


DAYS = range(1, 32)


@query(f"SELECT user_id AS field_id, {', '.join(f'round(sum(value) FILTER (dayofmonth(ts) = {k}), 4) AS day{k}' for k in DAYS)} FROM events GROUP BY 1")
def pivot_days(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("field_id"), F.concat(F.lit("day"), F.day("ts")).alias("k"), "value")
    names = [f"day{k}" for k in DAYS]
    p = e.groupBy("field_id").pivot("k", names).agg(F.sum("value"))
    return p.select("field_id", *[F.round(c, 4).alias(c) for c in names])


@query("SELECT a.l_partkey AS pixel_id, round(a.m - b.m, 6) AS diff FROM (SELECT l_partkey, avg(l_discount) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a JOIN (SELECT l_partkey, avg(l_discount) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b USING (l_partkey)")
def version_compare(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "pixel_id")
    side = lambda s, n: li.where(F.col("l_linestatus") == s).groupBy("pixel_id").agg(F.avg("l_discount").alias(n))
    return side("O", "a").join(side("F", "b"), "pixel_id").select("pixel_id", F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query("WITH f AS (SELECT substr(CAST(o_custkey AS VARCHAR), 1, 3) AS p, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN f ON p = CAST(c_custkey AS VARCHAR)")
def prefix_first_match(spark, d):
    """The first order whose customer number starts with a customer's; null where none does."""
    o = table(spark, d, "orders").select(F.substring(F.col("o_custkey").cast("string"), 1, 3).alias("p"), "o_orderkey")
    first = R.first_by(o, ["p"], [F.col("o_orderkey")])
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(first, F.col("c_custkey").cast("string") == F.col("p"), "left").select("c_custkey", "o_orderkey")


@query("WITH f AS (SELECT CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') || '_3B_clip.tif' AS file_name, CAST(o_orderdate AS DATE) AS obs_date, o_custkey FROM orders) SELECT file_name, obs_date, c_custkey AS unique_id, c_mktsegment FROM f JOIN customer ON c_custkey = o_custkey")
def image_field_join(spark, d):
    name = F.concat_ws("_", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("3B"), F.lit("clip.tif"))
    fields = table(spark, d, "customer").select(F.col("c_custkey").alias("unique_id"), "c_mktsegment")
    return workflows.image_fields(table(spark, d, "orders").select(name.alias("file_name")), fields)


@query(f"SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '_udm_' || l_linenumber AS file_name FROM lineitem WHERE lpad(CAST(l_orderkey AS VARCHAR), 9, '0') IN (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') FROM orders WHERE o_orderstatus = 'F')")
def keep_listed(spark, d):
    """Files that share their id with an image that was kept."""
    padded = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    files = table(spark, d, "lineitem").select(F.concat(padded("l_orderkey"), F.lit("_udm_"), F.col("l_linenumber").cast("string")).alias("file_name"))
    kept = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(padded("o_orderkey"), F.lit("_AnalyticMS_clip.tif")).alias("name"))
    return R.only_listed(files, F.col("file_name"), kept, 1, 9)


@query(f"WITH {BAND_OBS} SELECT pix, l_orderkey, l_linenumber, l_suppkey, CASE WHEN s_suppkey IS NOT NULL THEN blue END AS blue, CASE WHEN s_suppkey IS NOT NULL THEN red END AS red FROM band_obs LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def coords_member(spark, d):
    """Observations of pixels without coordinates stay as rows of nulls."""
    obs = band_obs(spark, d).select("pix", "l_orderkey", "l_linenumber", "l_suppkey", "blue", "red")
    known = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return R.mask_unknown(obs, known, ["l_suppkey"], ["blue", "red"])


@query("WITH a AS (SELECT l_partkey AS pixel_id, min(l_suppkey) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS pixel_id, min(l_suppkey) AS x FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT pixel_id, a.x AS left_x, b.x AS right_x FROM a JOIN b USING (pixel_id) WHERE a.x <> b.x")
def coord_check(spark, d):
    """Pixels of two tables whose coordinates differ."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "pixel_id")
    a = li.groupBy("pixel_id").agg(F.min("l_suppkey").alias("left_x"))
    b = li.where("l_linestatus = 'O'").groupBy("pixel_id").agg(F.min("l_suppkey").alias("right_x"))
    return a.join(b, "pixel_id").where("left_x <> right_x")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS \"OID\" FROM customer")
def surrogate_id(spark, d):
    return R.row_id(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), [F.col("c_mktsegment"), F.col("c_custkey")])


@query("WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders), w AS (SELECT s_suppkey * 3 AS id, s_nationkey AS week FROM supplier) SELECT o_orderkey, o_totalprice, week FROM n JOIN w USING (id)")
def select_row_ids(spark, d):
    """Rows by their place in a table, bound with the week that the list of places gives."""
    numbered = R.row_id(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], "id")
    wanted = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_nationkey").alias("week"))
    return numbered.join(wanted, "id").select("o_orderkey", "o_totalprice", "week")
