"""The domain's tables over the driver's: observations, quality, series, events, labels.

Each has a DataFrame form and, beside it, the SQL of the same rows for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BANDS = ["blue", "green", "red", "redEdge1", "redEdge2", "redEdge3", "nir", "SWIR1", "SWIR2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def band_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, pix, obs_date, order keys, nine bands; masked observations have null bands."""
    c = F.col
    raw = {"blue": c("l_quantity") * 100, "green": 500 + c("l_discount") * 20000, "red": 300 + c("l_tax") * 20000, "nir": c("l_extendedprice") / 10}
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus", *[v.alias(k) for k, v in raw.items()])
    li = li.withColumns({
        "SWIR1": c("blue") * 0.5 + c("green"), "SWIR2": c("red") + c("l_linenumber") * 250,
        "redEdge1": c("red") * 0.75 + c("nir") * 0.25, "redEdge2": c("red") * 0.5 + c("nir") * 0.5, "redEdge3": c("red") * 0.25 + c("nir") * 0.75,
    })
    seen = ~((c("l_linenumber") == 7) & (c("l_linestatus") == "O"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    keys = [c("p_brand").alias("field_id"), c("l_partkey").alias("pix"), c("l_shipdate").cast("date").alias("obs_date"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "p_size"]
    return li.join(part, c("l_partkey") == c("p_partkey")).select(*keys, *[F.when(seen, c(b)).alias(b) for b in BANDS])


ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]

BAND_OBS = """raw AS (SELECT *, l_quantity * 100 AS blue0, 500 + l_discount * 20000 AS green0, 300 + l_tax * 20000 AS red0, l_extendedprice / 10 AS nir0,
  NOT (l_linenumber = 7 AND l_linestatus = 'O') AS seen FROM lineitem JOIN part ON l_partkey = p_partkey),
band_obs AS (SELECT p_brand AS field_id, l_partkey AS pix, CAST(l_shipdate AS DATE) AS obs_date, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_linestatus, p_size,
  CASE WHEN seen THEN blue0 END AS blue, CASE WHEN seen THEN green0 END AS green, CASE WHEN seen THEN red0 END AS red,
  CASE WHEN seen THEN red0 * 0.75 + nir0 * 0.25 END AS "redEdge1", CASE WHEN seen THEN red0 * 0.5 + nir0 * 0.5 END AS "redEdge2", CASE WHEN seen THEN red0 * 0.25 + nir0 * 0.75 END AS "redEdge3",
  CASE WHEN seen THEN nir0 END AS nir, CASE WHEN seen THEN blue0 * 0.5 + green0 END AS "SWIR1", CASE WHEN seen THEN red0 + l_linenumber * 250 END AS "SWIR2" FROM raw)"""


def ts_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, obs_date, value: daily means of a field's observations."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("field_id"), F.col("ts").cast("date").alias("obs_date"), "value")
    return e.groupBy("field_id", "obs_date").agg(F.round(F.avg("value"), 6).alias("value"))


def burn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, preburn, burn: the first purchase day, and the last day seen at least three days before."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("field_id"), F.col("ts").cast("date").alias("d"), "event_type")
    burn = F.min(F.when(F.col("event_type") == "purchase", F.col("d"))).over(W.partitionBy("field_id"))
    dated = e.withColumn("burn", burn)
    out = dated.groupBy("field_id", "burn").agg(F.max(F.when(F.col("d") <= F.date_sub("burn", 3), F.col("d"))).alias("preburn"))
    return out.where("burn IS NOT NULL AND preburn IS NOT NULL").select("field_id", "preburn", "burn")


TS_OBS = "ts_obs AS (SELECT user_id AS field_id, CAST(ts AS DATE) AS obs_date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"
BURN = """burns0 AS (SELECT user_id AS field_id, min(CAST(ts AS DATE)) AS burn FROM events WHERE event_type = 'purchase' GROUP BY 1),
burns AS (SELECT b.field_id, max(CAST(e.ts AS DATE)) AS preburn, b.burn FROM burns0 b JOIN events e ON e.user_id = b.field_id AND CAST(e.ts AS DATE) <= b.burn - 3 GROUP BY b.field_id, b.burn)"""
ALIGNED = f"""{TS_OBS}, {BURN},
al0 AS (SELECT t.*, b.preburn, b.burn, CAST(ceil((b.burn - b.preburn) / 2.0) AS INTEGER) AS e FROM ts_obs t JOIN burns b USING (field_id)),
aligned AS (SELECT field_id, CASE WHEN obs_date >= burn THEN (obs_date - burn) + e WHEN obs_date <= preburn THEN (obs_date - preburn) - e ELSE 0 END AS rel_day, obs_date, value FROM al0)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id, label, treatment (the stratum; null for one source in four)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(y, "doc_id").select(F.col("doc_id").alias("unique_id"), "label", F.when(F.col("source").substr(-1, 1).isin("1", "5"), None).otherwise(F.col("lang")).alias("treatment"))


LABELS = """labeled AS (SELECT d.doc_id AS unique_id, l.quality AS label, CASE WHEN right(d.source, 1) IN ('1', '5') THEN NULL ELSE d.lang END AS treatment
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row keys, field_id, pred (0 to 1, null where masked), label."""
    li = table(spark, sf_dir, "lineitem")
    pred = F.when(F.col("l_linenumber") != 7, F.round(F.col("l_discount") * 10, 2))
    return li.select(F.col("l_suppkey").alias("field_id"), "l_orderkey", "l_linenumber", pred.alias("pred"), (F.col("l_linestatus") == "O").cast("int").alias("label"))


PREDS = "preds AS (SELECT l_suppkey AS field_id, l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN round(l_discount * 10, 2) END AS pred, CAST(l_linestatus = 'O' AS INTEGER) AS label FROM lineitem)"
