"""Splits, folds and scores of predictions."""

from pyspark.sql import functions as F

from ..operators import evaluate, splits
from ..sources.adapters import LABELS, PREDS, labels, preds, table
from .registry import query

H = "({0} * (2654435761 * (2 * {1} + 1) % 4294967296) + {1} * 40503) % 4294967296"


@query(f"{f'WITH {PREDS}'} SELECT count(*) FILTER (pred >= 0.5 AND label = 1) AS \"TruePos\", count(*) FILTER (pred >= 0.5 AND label = 0) AS \"FalsePos\", count(*) FILTER (pred < 0.5 AND label = 1) AS \"MissedPos\", count(*) FILTER (pred < 0.5 AND label = 0) AS \"TrueNeg\", round(count(*) FILTER ((pred >= 0.5) = (label = 1)) / count(*), 6) AS \"OA\" FROM preds WHERE pred IS NOT NULL")
def confusion_counts(spark, d):
    return evaluate.confusion(preds(spark, d))


@query(f"WITH {PREDS} SELECT field_id, count(*) FILTER (pred >= 0.5 AND label = 1) AS \"TruePos\", count(*) FILTER (pred >= 0.5 AND label = 0) AS \"FalsePos\", count(*) FILTER (pred < 0.5 AND label = 1) AS \"MissedPos\", count(*) FILTER (pred < 0.5 AND label = 0) AS \"TrueNeg\", round(count(*) FILTER ((pred >= 0.5) = (label = 1)) / count(*), 6) AS \"OA\" FROM preds WHERE pred IS NOT NULL GROUP BY 1")
def confusion_by_field(spark, d):
    return evaluate.confusion(preds(spark, d), by=["field_id"])


MEASURES = {"mean": "avg(pred)", "p10": "quantile_cont(pred, 0.1)", "p25": "quantile_cont(pred, 0.25)", "p50": "median(pred)", "p75": "quantile_cont(pred, 0.75)", "p90": "quantile_cont(pred, 0.9)"}
FIELD_SCORES = f"{PREDS}, f AS (SELECT field_id, {', '.join(f'round({e}, 4) AS {n}' for n, e in MEASURES.items())}, CAST(avg(label) > 0.5 AS INTEGER) AS label FROM preds GROUP BY 1)"
SWEEP_SRC = f"{FIELD_SCORES}, t AS (SELECT CAST(k AS INTEGER) AS k FROM generate_series(1, 99) s(k)), l AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS measure, {n} AS v, label FROM f' for n in MEASURES)}), sweep AS (SELECT measure, round(k / 100, 2) AS threshold, round(avg(CASE WHEN (v > round(k / 100, 2)) = (label = 1) THEN 1 ELSE 0 END), 6) AS fit FROM l, t WHERE v IS NOT NULL GROUP BY measure, k)"


@query(f"WITH {FIELD_SCORES} SELECT * FROM f")
def field_scores(spark, d):
    """A field's mean and five percentiles of its predictions, in one aggregation, with its label."""
    p = F.percentile("pred", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    g = preds(spark, d).groupBy("field_id").agg(F.round(F.avg("pred"), 4).alias("mean"), p.alias("p"), (F.avg("label") > 0.5).cast("int").alias("label"))
    return g.select("field_id", "mean", *[F.round(F.col("p")[k], 4).alias(n) for k, n in enumerate(list(MEASURES)[1:])], "label")


@query(f"WITH {SWEEP_SRC} SELECT measure, threshold, fit FROM sweep")
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(field_scores(spark, d), list(MEASURES))


@query(f"WITH {SWEEP_SRC}, m AS (SELECT measure, max(fit) AS fit FROM sweep GROUP BY 1) SELECT measure, fit, round(quantile_cont(threshold, 0.5), 4) AS threshold FROM sweep JOIN m USING (measure, fit) GROUP BY 1, 2")
def best_threshold(spark, d):
    return evaluate.best_threshold(evaluate.threshold_sweep(field_scores(spark, d), list(MEASURES)))


@query(f"WITH {PREDS}, s AS (SELECT pred, sum(label) AS pos, sum(1 - label) AS neg FROM preds WHERE pred IS NOT NULL GROUP BY 1), c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM c")
def auc_rank(spark, d):
    return evaluate.auc(preds(spark, d))


@query(f"WITH {PREDS}, s AS (SELECT pred, sum(label) AS pos, sum(1 - label) AS neg FROM preds WHERE pred IS NOT NULL GROUP BY 1) SELECT pred AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr FROM s WINDOW w AS (ORDER BY pred DESC)")
def roc_points(spark, d):
    return evaluate.roc_curve(preds(spark, d))


@query(f"WITH {PREDS}, a AS (SELECT l_linenumber % 5 AS rep, count(*) FILTER ((pred >= 0.5) = (label = 1)) / count(*) AS oa FROM preds WHERE pred IS NOT NULL GROUP BY 1) SELECT round(avg(round(oa, 6)), 6) AS mean_oa, count(*) AS reps FROM a")
def mean_oa(spark, d):
    reps = preds(spark, d).withColumn("rep", F.col("l_linenumber") % 5)
    return evaluate.confusion(reps, by=["rep"]).agg(F.round(F.avg("OA"), 6).alias("mean_oa"), F.count(F.lit(1)).alias("reps"))


@query(f"SELECT doc_id, r <= ceil(round(0.01 * n, 9)) AS test FROM (SELECT doc_id, row_number() OVER (ORDER BY {H.format('doc_id', 6888)}, doc_id) AS r, count(*) OVER () AS n FROM documents)")
def split_99_1(spark, d):
    return splits.test_share(table(spark, d, "documents").select("doc_id"), "doc_id", 0.01, 6888)


@query(f"WITH {LABELS} SELECT field_id, rec, fold FROM (SELECT unique_id AS field_id, label AS rec, CASE WHEN treatment IS NOT NULL THEN CAST(ntile(5) OVER (PARTITION BY treatment ORDER BY {H.format('unique_id', 8)}, unique_id) - 1 AS BIGINT) END AS fold FROM labeled) WHERE fold IS NOT NULL")
def fields_with_fold(spark, d):
    """Fields without a fold, as they lack a stratum, are no part of a k-fold table."""
    y = labels(spark, d)
    folds = splits.folds_stratified(y.select("unique_id", "treatment"), "unique_id", "treatment", 5, 8)
    out = splits.with_fold(y.select("unique_id", "label"), folds, "unique_id")
    return out.select(F.col("unique_id").alias("field_id"), F.col("label").alias("rec"), F.col("HO").alias("fold"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {H.format('doc_id', 8)}, doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(0.2 * n)")
def holdout_20(spark, d):
    return splits.holdout_fields(table(spark, d, "documents"), "doc_id", 0.2, 8)


@query(f"WITH h AS (SELECT field_id FROM (SELECT l_suppkey AS field_id, row_number() OVER (ORDER BY {H.format('l_suppkey', 3)}, l_suppkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem)) WHERE r <= floor(0.2 * n)) SELECT CASE WHEN l_suppkey IN (SELECT field_id FROM h) THEN 'HOLDOUT' ELSE 'TRAINING' END AS part, count(*) AS n, count(DISTINCT l_suppkey) AS fields FROM lineitem GROUP BY 1")
def grouped_split(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("field_id"))
    train, held = splits.separate(rows, splits.holdout_fields(rows, "field_id", 0.2, 3), "field_id")
    both = train.withColumn("part", F.lit("TRAINING")).unionByName(held.withColumn("part", F.lit("HOLDOUT")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("field_id").alias("fields"))


@query(f"WITH {LABELS}, r AS (SELECT unique_id, label, row_number() OVER (PARTITION BY label ORDER BY {H.format('unique_id', 5)}, unique_id) AS r FROM labeled) SELECT unique_id, label FROM r WHERE label = 0 OR r <= (SELECT count(*) FROM labeled WHERE label = 0)")
def balance(spark, d):
    return splits.balance(labels(spark, d).select("unique_id", "label"), "unique_id", "label", 5)


@query(f"WITH {LABELS} SELECT unique_id, treatment, CASE WHEN treatment IS NOT NULL THEN CAST(ntile(5) OVER (PARTITION BY treatment ORDER BY {H.format('unique_id', 8)}, unique_id) - 1 AS BIGINT) END AS \"HO\" FROM labeled")
def kfold_strat(spark, d):
    return splits.folds_stratified(labels(spark, d).select("unique_id", "treatment"), "unique_id", "treatment", 5, 8)


@query(f"SELECT s_suppkey, CAST((row_number() OVER (ORDER BY {H.format('s_suppkey', 8)}, s_suppkey) - 1) // ((SELECT count(*) FROM supplier) // 5 + 1) AS BIGINT) AS \"HO\" FROM supplier")
def kfold_chunk(spark, d):
    return splits.folds_chunked(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 5, 8)


@query(f"SELECT l_suppkey, l_orderkey FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {H.format('l_orderkey', 2)}, l_orderkey) AS r FROM lineitem) WHERE r = 1")
def one_pixel_per_field(spark, d):
    return splits.one_per_group(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey", 2)


@query(f"WITH {LABELS}, f AS (SELECT treatment, CASE WHEN treatment IS NOT NULL THEN CAST(ntile(5) OVER (PARTITION BY treatment ORDER BY {H.format('unique_id', 8)}, unique_id) - 1 AS BIGINT) END AS \"HO\" FROM labeled) SELECT treatment, coalesce(\"HO\", 99) AS fold, count(*) AS n FROM f GROUP BY CUBE (treatment, coalesce(\"HO\", 99))")
def fold_balance(spark, d):
    f = splits.folds_stratified(labels(spark, d), "unique_id", "treatment", 5, 8)
    return f.cube("treatment", F.coalesce("HO", F.lit(99)).alias("fold")).count().withColumnRenamed("count", "n")


@query(f"WITH {PREDS}, r AS (SELECT field_id, l_linenumber % 3 AS rep, avg(pred) AS pred FROM preds GROUP BY 1, 2) SELECT field_id, round(avg(pred), 6) AS mean_pred, count(pred) AS reps FROM r GROUP BY 1")
def mean_pred_over_reps(spark, d):
    r = preds(spark, d).groupBy("field_id", (F.col("l_linenumber") % 3).alias("rep")).agg(F.avg("pred").alias("pred"))
    return r.groupBy("field_id").agg(F.round(F.avg("pred"), 6).alias("mean_pred"), F.count("pred").alias("reps"))


@query(f"""WITH {PREDS}, s AS (SELECT field_id, avg(pred) AS "meanPred" FROM preds GROUP BY 1), t AS (SELECT DISTINCT field_id FROM preds WHERE field_id % 3 = 0), h AS (SELECT DISTINCT field_id FROM preds WHERE field_id % 6 = 0), a AS (SELECT field_id, avg(pred) AS "AvgPred" FROM preds WHERE l_linenumber = 2 GROUP BY 1), y AS (SELECT field_id, CAST(avg(label) > 0.5 AS INTEGER) AS label FROM preds WHERE field_id % 3 = 0 GROUP BY 1)
SELECT s.field_id, round(CASE WHEN t.field_id IS NOT NULL AND a."AvgPred" IS NOT NULL THEN a."AvgPred" ELSE s."meanPred" END, 6) AS pred, CAST(t.field_id IS NOT NULL AS INTEGER) AS training, CAST(h.field_id IS NOT NULL AS INTEGER) AS holdout, y.label FROM s LEFT JOIN t USING (field_id) LEFT JOIN h ON h.field_id = s.field_id LEFT JOIN a ON a.field_id = s.field_id LEFT JOIN y ON y.field_id = s.field_id""")
def final_dataset(spark, d):
    p = preds(spark, d)
    scores = p.groupBy("field_id").agg(F.avg("pred").alias("meanPred"))
    averages = p.where("l_linenumber = 2").groupBy("field_id").agg(F.avg("pred").alias("AvgPred"))
    y = p.where("field_id % 3 = 0").groupBy("field_id").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    return evaluate.final_table(scores, p.where("field_id % 3 = 0"), p.where("field_id % 6 = 0"), averages, y, "field_id")


@query("SELECT l_suppkey AS field_id, coalesce(max(l_discount) FILTER (l_linenumber = 7), max(l_discount) FILTER (l_linenumber < 7)) AS pred FROM lineitem GROUP BY 1")
def coalesce_predictions(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("field_id")).agg(F.coalesce(F.max(F.when(F.col("l_linenumber") == 7, F.col("l_discount"))), F.max(F.when(F.col("l_linenumber") < 7, F.col("l_discount")))).alias("pred"))


@query("SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linreg(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))
