"""Scans, filters and row selection."""

from pyspark.sql import functions as F

from ..functions import masks
from ..operators import rows as R
from ..sources.adapters import BAND_OBS, LABELS, band_obs, labels, table
from .registry import query


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
def scan_prune(spark, d):
    wanted = ["l_quantity", "l_orderkey", "l_partkey", "no_such_column"]
    li = table(spark, d, "lineitem")
    return R.keep_columns(li.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")), wanted)


@query("SELECT p_partkey, p_size FROM part WHERE CASE WHEN p_size <= 5 THEN 1 WHEN p_size <= 40 THEN 0 END IS DISTINCT FROM 1")
def filter_border_nullsafe(spark, d):
    border = F.when(F.col("p_size") <= 5, 1).when(F.col("p_size") <= 40, 0)
    return R.without(table(spark, d, "part"), border).select("p_partkey", "p_size")


@query(f"WITH {BAND_OBS} SELECT pix, l_orderkey, l_linenumber, blue, nir FROM band_obs WHERE blue IS NOT NULL AND nir IS NOT NULL")
def dropna_any(spark, d):
    return band_obs(spark, d).select("pix", "l_orderkey", "l_linenumber", "blue", "nir").na.drop("any")


@query(f"WITH {BAND_OBS} SELECT pix, count(nir) AS n FROM band_obs GROUP BY pix HAVING count(nir) > 0")
def drop_unobserved(spark, d):
    return band_obs(spark, d).groupBy("pix").agg(F.count("nir").alias("n")).where("n > 0")


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS obs_date FROM lineitem WHERE month(l_shipdate) * 100 + day(l_shipdate) < 1216")
def month_day_cutoff(spark, d):
    li = table(spark, d, "lineitem").where(R.before_month_day(F.col("l_shipdate")))
    return li.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("obs_date"))


@query(f"WITH {BAND_OBS} SELECT pix, count(blue) AS img_count, CASE WHEN count(blue) >= 28 THEN round(avg(nir) + 0.0000131717, 4) END AS nir_avg FROM band_obs GROUP BY pix")
def min_obs_filter(spark, d):
    g = band_obs(spark, d).groupBy("pix").agg(F.count("blue").alias("img_count"), F.avg("nir").alias("m"))
    return g.select("pix", "img_count", F.when(F.col("img_count") >= 28, F.round(F.col("m") + 0.0000131717, 4)).alias("nir_avg"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labeled(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unlabeled(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_discount FROM lineitem WHERE l_orderkey % 997 NOT IN (SELECT l_orderkey % 997 FROM lineitem GROUP BY 1 HAVING max(CASE WHEN l_orderkey % 3 = 0 THEN l_discount ELSE 0 END) = 0)")
def blank_groups_anti(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    return R.without_blank_groups(li, F.col("l_orderkey") % 997, F.when(F.col("l_orderkey") % 3 == 0, F.col("l_discount")).otherwise(0.0))


@query("SELECT s_suppkey, s_name FROM supplier WHERE substr(s_name, 1, 18) NOT IN (SELECT substr('Supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), 1, 18) FROM orders WHERE o_custkey < 50)")
def blacklist_contains(spark, d):
    listed = table(spark, d, "orders").where("o_custkey < 50").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("To_remove"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return R.without_listed(s, F.col("s_name"), listed, 1, 18)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey NOT IN (7, 11, 13)")
def literal_blacklist(spark, d):
    return table(spark, d, "orders").where(~F.col("o_custkey").isin(7, 11, 13)).select("o_orderkey", "o_orderpriority")


Q = {"b1": "l_linenumber % 2", "b3": "CAST(l_returnflag = 'R' AS INTEGER)", "b6": "CAST(l_linestatus = 'O' AS INTEGER)", "b8": "l_linenumber % 3"}
QUALITY = f"quality AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, {', '.join(f'{v} AS {k}' for k, v in Q.items())} FROM lineitem)"


def quality(spark, d):
    """Bits of an eight-band mask from line attributes."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") % 2).alias("b1"), (F.col("l_returnflag") == "R").cast("int").alias("b3"),
        (F.col("l_linestatus") == "O").cast("int").alias("b6"), (F.col("l_linenumber") % 3).alias("b8"),
    )


@query(f"WITH {QUALITY} SELECT l_suppkey, count(*) FILTER (b8 <> 0) AS udm, count(*) FILTER (b1 = 0) AS notclear, count(*) FILTER (b6 <> 0 OR b3 <> 0) AS cs, count(*) FILTER (b6 <> 0 OR b3 <> 0 OR b8 <> 0) AS csorig, count(*) FILTER (b8 = 1) AS blackfill FROM quality GROUP BY 1")
def mask_udm2_variants(spark, d):
    c = F.col
    kinds = {"udm": masks.udm(c("b8")), "notclear": masks.not_clear(c("b1")), "cs": masks.cloud_shadow(c("b3"), c("b6")), "csorig": masks.cloud_shadow_udm(c("b3"), c("b6"), c("b8")), "blackfill": masks.blackfill(c("b8"))}
    return quality(spark, d).groupBy("l_suppkey").agg(*[F.count_if(m).alias(k) for k, m in kinds.items()])


@query("SELECT l_linenumber, count(*) FILTER (l_linenumber IN (8, 9)) AS light, count(*) FILTER (l_linenumber IN (2, 8, 9, 10)) AS \"full\", count(*) FILTER (l_linenumber IN (0, 1, 2, 8, 9, 10, 11)) AS \"all\" FROM lineitem GROUP BY 1")
def mask_scl(spark, d):
    scl = F.col("l_linenumber")
    kinds = {"light": masks.scene(scl, "light"), "full": masks.scene(scl, "full"), "all": masks.scene(scl, "full", shadow=True, low_quality=True)}
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(*[F.count_if(m).alias(k) for k, m in kinds.items()])


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS v FROM lineitem")
def apply_mask_bands(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", masks.apply(F.col("l_quantity"), masks.binary(F.col("l_linenumber") % 3)).alias("v"))


@query("SELECT l_suppkey, l_orderkey, nullif(l_discount, 0) AS v FROM lineitem")
def nodata_to_null(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", masks.nodata(F.col("l_discount")).alias("v"))


@query(f"WITH {QUALITY} SELECT l_suppkey, round(coalesce(100.0 * count(*) FILTER (l_quantity <> 1 AND (b6 <> 0 OR b3 <> 0)) / nullif(count(*) FILTER (l_quantity <> 1), 0), 100), 6) AS percent_masked FROM quality GROUP BY 1")
def percent_masked(spark, d):
    m = masks.percent_masked(F.col("l_quantity") != 1, masks.cloud_shadow(F.col("b3"), F.col("b6")))
    return quality(spark, d).groupBy("l_suppkey").agg(F.round(m, 6).alias("percent_masked"))


@query(f"WITH {LABELS} SELECT unique_id, label, treatment FROM labeled WHERE treatment IS NOT NULL AND NOT (treatment = 'de')")
def filter_treatment(spark, d):
    return labels(spark, d).where("treatment IS NOT NULL AND treatment <> 'de'")


@query("SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def distinct_dates(spark, d):
    return table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")).distinct()


@query("SELECT l_partkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM (SELECT l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def dedupe_first(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return R.first_by(li, ["l_partkey"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")]).select("l_partkey", "l_linenumber")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS BIGINT) AS chunk FROM orders")
def chunk_rows(spark, d):
    return R.chunk_number(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 1000)


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS rec FROM orders")
def cumcount(spark, d):
    return R.numbered(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_preview(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, max(o_orderkey) AS last_order FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def missing_outputs(spark, d):
    from ..sources.io import missing_only

    poor = table(spark, d, "customer").where("c_acctbal <= 0").select(F.col("c_custkey").alias("o_custkey"))
    return missing_only(table(spark, d, "orders"), poor, "o_custkey").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))


