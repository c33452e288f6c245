"""Event-aligned series, matched observations and separability."""

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import workflows
from ..sources.adapters import ALIGNED, BURN, TS_OBS, burn_events, table, ts_obs
from .registry import query


def aligned(spark, d):
    return S.align(ts_obs(spark, d), burn_events(spark, d))


@query(f"""WITH {TS_OBS}, g AS (SELECT field_id, obs_date - lag(obs_date) OVER (PARTITION BY field_id ORDER BY obs_date) AS gap FROM ts_obs)
SELECT field_id, count(*) AS n_dates, round(CAST(trunc(avg(gap) * 24) AS INTEGER) / 24, 6) AS mean_gap, CAST(max(gap) AS DOUBLE) AS max_gap FROM g GROUP BY 1 HAVING count(*) > 1""")
def gap_stats(spark, d):
    return S.gap_stats(ts_obs(spark, d))


@query("""WITH m AS (SELECT user_id AS field_id, CAST(ts AS DATE) AS obs_date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), s AS (SELECT field_id, CAST(unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS DATE) AS obs_date FROM m GROUP BY 1)
SELECT field_id, obs_date, value FROM s LEFT JOIN m USING (field_id, obs_date)""")
def daily_mean(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("field_id"), F.col("ts").cast("date").alias("obs_date"), "value")
    return S.daily_mean(e, "field_id", "obs_date", "value")


@query("WITH p AS (SELECT user_id AS field_id, event_type, CAST(ts AS DATE) AS obs_date, avg(value) AS v FROM events GROUP BY 1, 2, 3) SELECT field_id, obs_date, round(avg(v), 6) AS avg_value FROM p GROUP BY 1, 2")
def avg_of_pixels(spark, d):
    e = table(spark, d, "events")
    p = e.groupBy(F.col("user_id").alias("field_id"), "event_type", F.col("ts").cast("date").alias("obs_date")).agg(F.avg("value").alias("v"))
    return p.groupBy("field_id", "obs_date").agg(F.round(F.avg("v"), 6).alias("avg_value"))


@query(f"WITH {ALIGNED} SELECT field_id, obs_date, value, CAST(rel_day AS INTEGER) AS rel_day FROM aligned")
def event_align(spark, d):
    return aligned(spark, d).select("field_id", "obs_date", "value", "rel_day")


@query(f"WITH {ALIGNED}, v AS (SELECT field_id, rel_day, arg_max(value, obs_date) AS value FROM aligned WHERE rel_day BETWEEN -50 AND 50 GROUP BY 1, 2), s AS (SELECT DISTINCT field_id, CAST(r AS INTEGER) AS rel_day FROM aligned, generate_series(-50, 50) t(r)) SELECT s.field_id, s.rel_day, value FROM s LEFT JOIN v ON v.field_id = s.field_id AND v.rel_day = s.rel_day")
def event_spine(spark, d):
    return S.spine(aligned(spark, d))


@query(f"""WITH {BURN}, o AS (SELECT user_id AS field_id, CAST(ts AS DATE) AS obs_date, 1000 + value AS red, 3000 + 2 * value AS nir FROM events), t AS (SELECT field_id, obs_date, round(avg(10000 * ((nir - red) / nullif(nir + red, 0))), 6) AS value FROM o GROUP BY 1, 2),
a0 AS (SELECT t.*, b.preburn, b.burn, CAST(ceil((b.burn - b.preburn) / 2.0) AS INTEGER) AS e FROM t JOIN burns b USING (field_id)),
a AS (SELECT field_id, obs_date, value, CASE WHEN obs_date >= burn THEN (obs_date - burn) + e WHEN obs_date <= preburn THEN (obs_date - preburn) - e ELSE 0 END AS rel_day FROM a0),
v AS (SELECT field_id, rel_day, arg_max(value, obs_date) AS value FROM a GROUP BY 1, 2), s AS (SELECT field_id, CAST(unnest(generate_series(least(min(rel_day), -50), greatest(max(rel_day), 50))) AS INTEGER) AS rel_day FROM a GROUP BY 1)
SELECT field_id, rel_day, value FROM s LEFT JOIN v USING (field_id, rel_day)""")
def series_build(spark, d):
    """The whole job: an index by day and field, aligned to the field's event, over its extended range."""
    e = table(spark, d, "events").select(F.col("user_id").alias("field_id"), F.col("ts").cast("date").alias("obs_date"), (1000 + F.col("value")).alias("red"), (3000 + 2 * F.col("value")).alias("nir"))
    return workflows.series_build(e, burn_events(spark, d), "ndvi")


@query("WITH r AS (SELECT user_id AS field_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * (2654435761 * 15 % 4294967296) + 7 * 40503) % 4294967296, event_id) AS k FROM events) SELECT field_id, event_id FROM r WHERE k <= 5")
def sample_n_per_field(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("field_id"), "event_id")
    return S.sample_per_group(e, ["field_id"], F.col("event_id"), 5, 7)


@query(f"WITH {ALIGNED} SELECT field_id, obs_date, value, CASE WHEN rel_day < 0 THEN 'pre' ELSE 'post' END AS class FROM aligned WHERE abs(rel_day) BETWEEN 1 AND 5 AND value IS NOT NULL")
def pre_post_unmatched(spark, d):
    return S.pre_post_unmatched(aligned(spark, d), 5).select("field_id", "obs_date", "value", "class")


@query(f"""WITH {ALIGNED}, p AS (SELECT field_id, arg_max(value, (rel_day, obs_date)) FILTER (rel_day < 0) AS "PreBurn", arg_min(value, (rel_day, obs_date)) FILTER (rel_day >= 0) AS "PostBurn", max(rel_day) FILTER (rel_day < 0) AS a, min(rel_day) FILTER (rel_day >= 0) AS b FROM aligned WHERE value IS NOT NULL GROUP BY 1)
SELECT field_id, "PreBurn", "PostBurn", CAST(b AS INTEGER) AS "DaysSinceBurn", CAST(b - a AS INTEGER) AS "ObsInterval" FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def pre_post_matched(spark, d):
    return S.pre_post_matched(aligned(spark, d))


SINCE = "arg_max(value, (rel_day, obs_date)) FILTER (rel_day BETWEEN -{0} AND -1) AS pre, arg_min(value, (rel_day, obs_date)) FILTER (rel_day >= {1} AND rel_day < {2}) AS post"


@query(f"WITH {ALIGNED} SELECT field_id, {SINCE.format(8, 1, 8)} FROM aligned GROUP BY 1")
def days_since_burn(spark, d):
    return S.days_since(aligned(spark, d), 8, 1, 8)


SPINED = f"{ALIGNED}, v AS (SELECT field_id, rel_day, arg_max(value, obs_date) AS value FROM aligned WHERE rel_day BETWEEN -50 AND 50 GROUP BY 1, 2), sp AS (SELECT DISTINCT field_id, CAST(r AS INTEGER) AS rel_day FROM aligned, generate_series(-50, 50) t(r)), full_ AS (SELECT sp.field_id, sp.rel_day, value FROM sp LEFT JOIN v ON v.field_id = sp.field_id AND v.rel_day = sp.rel_day), ff AS (SELECT field_id, rel_day, last_value(value IGNORE NULLS) OVER (PARTITION BY field_id ORDER BY rel_day ROWS UNBOUNDED PRECEDING) AS ff, first_value(value IGNORE NULLS) OVER (PARTITION BY field_id ORDER BY rel_day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM full_), di AS (SELECT *, lead(ff) OVER (PARTITION BY field_id ORDER BY rel_day) - ff AS diff FROM ff)"


@query(f"WITH {SPINED} SELECT field_id, rel_day, ff, bf, round(diff, 6) AS diff FROM di")
def ffill_diff(spark, d):
    return S.image_diff(S.spine(aligned(spark, d))).select("field_id", "rel_day", "ff", "bf", F.round("diff", 6).alias("diff"))


SIGNAL = f"pr AS (SELECT field_id, {SINCE.format(8, 0, 1)} FROM aligned GROUP BY 1), dv AS (SELECT field_id, rel_day, arg_max(value, obs_date) AS v FROM aligned WHERE rel_day BETWEEN 1 AND 12 GROUP BY 1, 2), sig AS (SELECT CAST(rel_day + 1 AS INTEGER) AS n, round(avg(pre - v), 6) AS signal FROM dv JOIN pr USING (field_id) GROUP BY 1)"


@query(f"WITH {ALIGNED}, {SIGNAL} SELECT n, signal FROM sig")
def burn_signal(spark, d):
    return S.burn_signal(aligned(spark, d), 8, 14)


NOISE = "SELECT '{0}' AS period, n, signal, round(avg(CASE WHEN most > signal THEN 1 ELSE 0 END), 6) AS rate FROM (SELECT field_id, max(diff) AS most FROM di WHERE rel_day {1} 0 GROUP BY 1), sig GROUP BY n, signal"


@query(f"WITH {SPINED}, {SIGNAL} {NOISE.format('pre', '<')} UNION ALL {NOISE.format('post', '>')}")
def noise_vs_signal(spark, d):
    a = aligned(spark, d)
    return S.false_signal_rate(S.image_diff(S.spine(a)), S.burn_signal(a, 8, 14))


SEP = "round(abs(avg(p) - avg(q)) / nullif(stddev_pop(p) + stddev_pop(q), 0), 6)"


@query(f"WITH {ALIGNED}, m AS (SELECT field_id, {SINCE.format(8, 1, 8)} FROM aligned GROUP BY 1) SELECT round(abs(avg(pre) - avg(post)) / (stddev_pop(pre) + stddev_pop(post)), 6) AS m, count(pre) AS n_pre, count(post) AS n_post FROM m")
def separability_m(spark, d):
    m = S.days_since(aligned(spark, d), 8, 1, 8)
    return m.agg(F.round(S.separability(F.col("pre"), F.col("post")), 6).alias("m"), F.count("pre").alias("n_pre"), F.count("post").alias("n_post"))


@query(f"WITH {ALIGNED}, pr AS (SELECT field_id, {SINCE.format(8, 0, 1)} FROM aligned GROUP BY 1), a AS (SELECT avg(pre) AS mp, stddev_pop(pre) AS sp FROM pr) SELECT CAST(rel_day AS INTEGER) AS rel_day, round(abs(any_value(mp) - avg(value)) / (any_value(sp) + stddev_pop(value)), 6) AS m FROM aligned, a WHERE rel_day BETWEEN 1 AND 14 GROUP BY 1")
def separability_by_day(spark, d):
    a = aligned(spark, d)
    pre = S.days_since(a, 8, 0, 1).agg(F.avg("pre").alias("mp"), F.stddev_pop("pre").alias("sp"))
    days = a.where("rel_day BETWEEN 1 AND 14").groupBy("rel_day").agg(F.avg("value").alias("mq"), F.stddev_pop("value").alias("sq"))
    return days.join(F.broadcast(pre)).select("rel_day", F.round(F.try_divide(F.abs(F.col("mp") - F.col("mq")), F.col("sp") + F.col("sq")), 6).alias("m"))


@query("""WITH t AS (SELECT l_linenumber, CAST(l_quantity AS DOUBLE) / 1e5 AS p, l_extendedprice / 1e8 AS q FROM lineitem), s AS (SELECT l_linenumber, sum(sqrt(p * q)) AS bc, sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 AS js, sum(q * (p / q) * ln(p / q)) AS f FROM t GROUP BY 1)
SELECT l_linenumber, round(bc, 5) AS bhattacharyya_coefficient, round(-ln(bc), 5) AS bhattacharyya_distance, round(2 * (1 - bc), 5) AS jeffries_matusita, round(js, 5) AS jensen_shannon, round(f, 5) AS f_divergence FROM s""")
def divergences(spark, d):
    t = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity") / 1e5).alias("p"), (F.col("l_extendedprice") / 1e8).alias("q"))
    return t.groupBy("l_linenumber").agg(*[F.round(c, 5).alias(k) for k, c in S.divergences(F.col("p"), F.col("q")).items()])


TILLED = "SELECT '{0}' AS kind, {3} FROM aligned GROUP BY field_id"


@query(f"WITH {ALIGNED}, b AS ({TILLED.format('tilled', 0, 0, SINCE.format(8, 1, 8))} UNION ALL {TILLED.format('new', 0, 0, SINCE.format(3, 1, 3))} UNION ALL {TILLED.format('old', 0, 0, SINCE.format(3, 5, 9))}) SELECT kind, count(*) AS n, round(avg(pre), 6) AS pre_mean, round(stddev_pop(pre), 6) AS pre_std, round(avg(post), 6) AS post_mean, round(stddev_pop(post), 6) AS post_std FROM b WHERE pre IS NOT NULL AND post IS NOT NULL GROUP BY 1")
def tilled_vs_burned(spark, d):
    a = aligned(spark, d)
    parts = {"tilled": S.days_since(a, 8, 1, 8), "new": S.days_since(a, 3, 1, 3), "old": S.days_since(a, 3, 5, 9)}
    both = S.union_tagged(parts, "kind").na.drop("any", subset=["pre", "post"])
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("pre"), 6).alias("pre_mean"), F.round(F.stddev_pop("pre"), 6).alias("pre_std"), F.round(F.avg("post"), 6).alias("post_mean"), F.round(F.stddev_pop("post"), 6).alias("post_std")
    )



@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def daily_windows(spark, d):
    from ..streaming.daily import daily_means

    return daily_means(table(spark, d, "events")).select(F.col("window.start").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))
