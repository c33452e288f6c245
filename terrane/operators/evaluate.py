"""Scores of predictions: confusion counts, thresholds, rank-based AUC, final tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import materialised


def confusion(df: DataFrame, pred: str = "pred", label: str = "label", cut: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """TruePos, FalsePos, MissedPos, TrueNeg and OA; null predictions and labels are left out."""
    up, yes = F.col(pred) >= cut, F.col(label) == 1
    n = lambda c: F.count_if(c)
    rows = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    out = rows.groupBy(*(by or [])).agg(n(up & yes).alias("TruePos"), n(up & ~yes).alias("FalsePos"), n(~up & yes).alias("MissedPos"), n(~up & ~yes).alias("TrueNeg"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("OA", F.round(F.try_divide(F.col("TruePos") + F.col("TrueNeg"), F.col("n")), 6)).drop("n")


def threshold_sweep(df: DataFrame, measures: list[str], label: str = "label") -> DataFrame:
    """measure, threshold, fit: the share of rows whose ``measure > threshold`` equals the label, for 0.01 to 0.99.

    Rows are reduced to counts by value and label first, so the 99 thresholds multiply
    a histogram and not the rows.
    """
    long = df.select(label, *measures).unpivot([label], measures, "measure", "value").where(F.col("value").isNotNull() & F.col(label).isNotNull())
    hist = long.groupBy("measure", F.ceil(F.round(F.col("value") * 100, 9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(99))).alias("t")
    right = F.when(F.col("bin") > F.col("t"), F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    return hist.select("*", steps).groupBy("measure", "t").agg(F.round(F.sum(right) / F.sum("n"), 6).alias("fit")).select("measure", F.round(F.col("t") / 100, 2).alias("threshold"), "fit")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """measure, fit, threshold: the median of the thresholds that fit best."""
    top = F.max("fit").over(W.partitionBy("measure"))
    return sweep.withColumn("top", top).where("fit = top").groupBy("measure", "fit").agg(F.round(F.percentile("threshold", F.lit(0.5)), 4).alias("threshold"))


def in_ranges(df: DataFrame, value: str, ranges: int) -> DataFrame:
    """Adds __range, ascending with ``value`` (double, no nulls), about evenly filled."""
    cuts = sorted(set(df.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.005)))
    return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=value, outputCol="__range").transform(df) if cuts else df.withColumn("__range", F.lit(0.0))


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], ranges: int = 64) -> DataFrame:
    """keys, n and the exact percentiles ``points`` (name: share), linear between neighbours, of groups of any size.

    For few groups with many distinct values, where an aggregate would hold them all: rows
    are counted by value, the counts are summed within ranges of values and shifted by the
    ranges before, and each percentile is read off the values that hold its place. Groups
    without a value have no row.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    counts = in_ranges(materialised(rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")), "counts"), "__v", ranges)
    sums = counts.groupBy(*keys, "__range").agg(F.sum("__n").alias("__m"))
    whole, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"), F.sum("__m").over(whole).alias("__total"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__range") == F.col("__r"))
    upto = F.sum("__n").over(W.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.withColumn("__upto", upto).join(bases, same).withColumn("__upto", F.col("__upto") + F.col("__base"))
    held = lambda place: F.max(F.when((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto")), F.col("__v")))
    at = {name: F.round(F.lit(p) * (F.col("__total") - 1), 9) for name, p in points.items()}
    ends = [c for name, x in at.items() for c in (held(F.floor(x)).alias(f"__{name}_lo"), held(F.ceil(x)).alias(f"__{name}_hi"))]
    found = placed.groupBy(*keys).agg(F.max("__total").alias("__total"), *ends)
    between = lambda name: F.col(f"__{name}_lo") + (at[name] - F.floor(at[name])) * (F.col(f"__{name}_hi") - F.col(f"__{name}_lo"))
    return found.select(*keys, F.col("__total").alias("n"), *[between(name).alias(name) for name in points])


def by_score(df: DataFrame, pred: str, label: str, ranges: int = 64) -> DataFrame:
    """score, pos, neg and below (negatives of smaller scores) by distinct score; null and NaN predictions are left out.

    The running sum is taken within ranges of scores, which approximate quantiles part
    evenly, and shifted by the sums of the ranges before.
    """
    rows = df.select(F.col(pred).cast("double").alias("score"), F.col(label).alias("y")).where("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL")
    by = materialised(rows.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "scores")
    at = in_ranges(by, "score", ranges)
    sums = at.groupBy("__range").agg(F.sum("neg").alias("n"))
    base = sums.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    local = F.coalesce(F.sum("neg").over(W.partitionBy("__range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("__local", local).join(F.broadcast(base), "__range").select("score", "pos", "neg", (F.col("__local") + F.col("__base")).alias("below"))


def auc(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Area under the ROC curve from rank sums, ties at half; one row."""
    won = by_score(df, pred, label).withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return won.agg(F.round(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg").cast("double")), 6).alias("auc"))


def roc_curve(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """threshold, fpr, tpr: the rates of rows with a score of the threshold or more, for each distinct score."""
    up = F.col(label)
    turned = df.select((-F.col(pred)).alias("__turned"), (1 - up).alias("__no"), up.alias("__yes"))
    # negatives of scores above are those below in the turned order; the same for positives
    no = by_score(turned.select("__turned", F.col("__yes").alias("y")), "__turned", "y").select((-F.col("score")).alias("threshold"), "pos", "neg", F.col("below").alias("no_above"))
    yes = by_score(turned.select("__turned", F.col("__no").alias("y")), "__turned", "y").select((-F.col("score")).alias("threshold"), F.col("below").alias("yes_above"))
    total = no.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    rate = lambda c, n: F.round(F.try_divide(c.cast("double"), F.lit(float(n or 0))), 6)
    return no.join(yes, "threshold").select("threshold", rate(F.col("no_above") + F.col("neg"), total.N).alias("fpr"), rate(F.col("yes_above") + F.col("pos"), total.P).alias("tpr"))


def flag(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """A 0/1 column: is the key among ``ids``?"""
    known = ids.select(key).distinct().withColumn("__in", F.lit(1))
    return df.join(known, key, "left").withColumn(name, F.coalesce("__in", F.lit(0))).drop("__in")


def final_table(scores: DataFrame, training: DataFrame, holdout: DataFrame, averages: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Predictions with training and holdout flags and labels; training rows take their average hold-out prediction.

    scores: key, meanPred; averages: key, AvgPred. Right sides are made unique first.
    """
    out = flag(flag(scores.dropDuplicates([key]), training, key, "training"), holdout, key, "holdout")
    out = out.join(averages.groupBy(key).agg(F.avg("AvgPred").alias("AvgPred")), key, "left").join(labels.select(key, label).dropDuplicates([key]), key, "left")
    pred = F.when((F.col("training") == 1) & F.col("AvgPred").isNotNull(), F.col("AvgPred")).otherwise(F.col("meanPred"))
    return out.select(key, F.round(pred, 6).alias("pred"), "training", "holdout", label)


