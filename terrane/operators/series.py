"""Series of fields: gaps, alignment to an event, matched observations, separability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_stats(obs: DataFrame, field: str = "field_id", date: str = "obs_date") -> DataFrame:
    """field, n_dates, mean_gap, max_gap in days, from distinct dates; mean hours are cut to whole ones. Fields with one date are omitted."""
    days = obs.select(field, date).distinct()
    gap = F.datediff(date, F.lag(date).over(W.partitionBy(field).orderBy(date)))
    out = days.withColumn("gap", gap).groupBy(field).agg(F.count(F.lit(1)).alias("n_dates"), F.avg("gap").alias("m"), F.max("gap").alias("x")).where("n_dates > 1")
    return out.select(field, "n_dates", F.round((F.col("m") * 24).cast("int") / 24, 6).alias("mean_gap"), F.col("x").cast("double").alias("max_gap"))


def daily_mean(obs: DataFrame, field: str, date: str, value: str, calendar: bool = True) -> DataFrame:
    """Mean by day; with ``calendar`` days between a field's first and last one are there, with null."""
    means = obs.groupBy(field, date).agg(F.round(F.avg(value), 6).alias("value"))
    if not calendar:
        return means
    spans = means.groupBy(field).agg(F.min(date).alias("a"), F.max(date).alias("b")).select(field, F.explode(F.sequence("a", "b")).alias(date))
    return spans.join(means, [field, date], "left")


def align(obs: DataFrame, events: DataFrame, field: str = "field_id", date: str = "obs_date") -> DataFrame:
    """Adds rel_day: days from an event that lies between ``preburn`` and ``burn``, which are half their distance away."""
    both = obs.join(events, field)
    half = F.ceil(F.datediff("burn", "preburn") / 2).cast("int")
    rel = F.when(F.col(date) >= F.col("burn"), F.datediff(date, "burn") + half).when(F.col(date) <= F.col("preburn"), F.datediff(date, "preburn") - half).otherwise(0)
    return both.withColumn("rel_day", rel.cast("int")).drop("preburn", "burn")


def spine(aligned: DataFrame, reach: int = 50, field: str = "field_id", value: str = "value", extend: bool = False) -> DataFrame:
    """Every relative day from -reach to reach of each field, null where nothing was seen; one value a day (the last date's).

    extend: days seen beyond the reach, and those up to them, are there as well. A
    field's series is at most a value for each date of the window, so it is gathered
    in one aggregation and spread again without a join.
    """
    near = F.struct("rel_day", "obs_date", F.col(value).alias("v"))
    held = aligned.groupBy(field).agg(
        F.collect_list(near if extend else F.when(F.col("rel_day").between(-reach, reach), near)).alias("seen"),
        F.least(F.min("rel_day"), F.lit(-reach)).alias("lo"), F.greatest(F.max("rel_day"), F.lit(reach)).alias("hi"),
    )
    days = F.sequence("lo", "hi") if extend else F.sequence(F.lit(-reach), F.lit(reach))
    day = lambda d: F.struct(d.alias("rel_day"), F.array_max(F.filter("seen", lambda x: x["rel_day"] == d))["v"].alias(value))
    return held.select(field, F.inline(F.transform(days, day)))


def pre_post_unmatched(aligned: DataFrame, days: int, exact: bool = False) -> DataFrame:
    """Values up to (or exactly) ``days`` before and after, with their class."""
    near = F.abs("rel_day") == days if exact else F.abs("rel_day").between(1, days)
    return aligned.where(near & F.col("value").isNotNull()).withColumn("class", F.when(F.col("rel_day") < 0, "pre").otherwise("post"))


def pre_post_matched(aligned: DataFrame, field: str = "field_id") -> DataFrame:
    """Last value before and first from the event on, by field; fields that lack either are dropped. No join is needed."""
    seen = F.col("value").isNotNull()
    pre = lambda c: F.max_by(F.when((F.col("rel_day") < 0) & seen, F.col(c)), F.when((F.col("rel_day") < 0) & seen, F.struct("rel_day", "obs_date")))
    post = lambda c: F.min_by(F.when((F.col("rel_day") >= 0) & seen, F.col(c)), F.when((F.col("rel_day") >= 0) & seen, F.struct("rel_day", "obs_date")))
    out = aligned.groupBy(field).agg(pre("value").alias("PreBurn"), post("value").alias("PostBurn"), pre("rel_day").alias("a"), post("rel_day").alias("b"))
    return out.where("PreBurn IS NOT NULL AND PostBurn IS NOT NULL").select(field, "PreBurn", "PostBurn", F.col("b").alias("DaysSinceBurn"), (F.col("b") - F.col("a")).alias("ObsInterval"))


def days_since(aligned: DataFrame, pre: int, post1: int, post2: int, field: str = "field_id") -> DataFrame:
    """Last value within ``pre`` days before, and first value within [post1, post2) after the event."""
    before = F.col("rel_day").between(-pre, -1) & F.col("value").isNotNull()
    after = (F.col("rel_day") >= post1) & (F.col("rel_day") < post2) & F.col("value").isNotNull()
    at = F.struct("rel_day", "obs_date")
    return aligned.groupBy(field).agg(
        F.max_by(F.when(before, F.col("value")), F.when(before, at)).alias("pre"), F.min_by(F.when(after, F.col("value")), F.when(after, at)).alias("post")
    )


def filled(full: DataFrame, field: str = "field_id", value: str = "value") -> DataFrame:
    """Adds ff (last value seen so far) and bf (next value seen)."""
    w = W.partitionBy(field).orderBy("rel_day")
    return full.withColumns({
        "ff": F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "bf": F.first(value, ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })


def image_diff(full: DataFrame, field: str = "field_id") -> DataFrame:
    """Change of the filled series to the next day, at the day before it."""
    ff = filled(full, field)
    return ff.withColumn("diff", F.lead("ff").over(W.partitionBy(field).orderBy("rel_day")) - F.col("ff"))


def burn_signal(aligned: DataFrame, max_pre: int, max_post: int, field: str = "field_id") -> DataFrame:
    """n, signal: mean over fields of the last value before the event less the value n - 1 days after it."""
    pre = days_since(aligned, max_pre, 0, 1, field).select(field, "pre")
    by_day = aligned.where(F.col("rel_day").between(1, max_post - 2)).groupBy(field, "rel_day").agg(F.max_by("value", "obs_date").alias("v"))
    return by_day.join(pre, field).groupBy((F.col("rel_day") + 1).alias("n")).agg(F.round(F.avg(F.col("pre") - F.col("v")), 6).alias("signal"))


def false_signal_rate(diffs: DataFrame, signals: DataFrame, field: str = "field_id") -> DataFrame:
    """period, n, signal, rate: the share of fields with a day, before or after the event, whose change exceeds the signal.

    Fields are reduced to one row with both largest changes before they meet the
    signals, of which there is one for each day of the window.
    """
    most = diffs.groupBy(field).agg(F.max(F.when(F.col("rel_day") < 0, F.col("diff"))).alias("pre"), F.max(F.when(F.col("rel_day") > 0, F.col("diff"))).alias("post"))
    long = most.unpivot([field], ["pre", "post"], "period", "most")
    both = signals.select(F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("period"), "n", "signal")
    return long.join(both, "period").groupBy("period", "n", "signal").agg(F.round(F.avg(F.coalesce((F.col("most") > F.col("signal")).cast("int"), F.lit(0))), 6).alias("rate"))


def separability(p: Column, q: Column) -> Column:
    """|mean p - mean q| / (std p + std q), of populations, nulls left out."""
    return F.try_divide(F.abs(F.avg(p) - F.avg(q)), F.stddev_pop(p) + F.stddev_pop(q))


def divergences(p: Column, q: Column) -> dict[str, Column]:
    """Sums over rows of two positive vectors: Bhattacharyya, Jeffries-Matusita, Jensen-Shannon and an f-divergence."""
    bc = F.sum(F.sqrt(p * q))
    b = -F.ln(bc)
    m = (p + q) / 2
    return {
        "bhattacharyya_coefficient": bc,
        "bhattacharyya_distance": b,
        "jeffries_matusita": 2 * (1 - F.exp(-b)),
        "jensen_shannon": F.sum(p * F.ln(p / m)) / 2 + F.sum(q * F.ln(q / m)) / 2,
        "f_divergence": F.sum(q * (p / q) * F.ln(p / q)),
    }


def sample_per_group(df: DataFrame, group: list[str], key: Column, n: int, seed: int) -> DataFrame:
    """n rows of each group by a hash of their key: the same ones in every run."""
    from .rows import hash_rank

    rank = F.row_number().over(W.partitionBy(*group).orderBy(hash_rank(key, seed), key))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(tag, F.lit(k)) for k, f in frames.items()])
