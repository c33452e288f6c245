"""The largest sustained change between neighbouring observations of a series.

A drop is the smallest difference whose following ``buf`` observations stay below a
threshold (usually the series' mean); a spike mirrors it. For drops the candidate
window ends one observation earlier than for spikes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def change_columns(value: str, threshold: Column, buf: int, kind: str, keys: list[str], order: list[str]) -> tuple[Column, Column]:
    """(difference of a sustained candidate, difference of any candidate) for each row, null elsewhere.

    Rows must have non-null values. The best one of a group is the minimum (drop) or
    maximum (spike) of the first, else the opposite extreme of the second.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    n = F.count(value).over(W.partitionBy(*keys))
    i = F.row_number().over(w) - 1
    window = n - (buf + 1) if kind == "drop" else n - buf
    diff = F.lead(value, 1).over(w) - F.col(value)
    sustained = F.lit(True)
    for k in range(2, 2 + buf):
        later = F.lead(value, k).over(w)
        sustained = sustained & (later < threshold if kind == "drop" else later > threshold)
    candidate = (i <= window - 2) & (window >= 2)
    return F.when(candidate & sustained, diff), F.when(candidate, diff)


def best(kind: str, sustained: Column, any_: Column) -> Column:
    return F.coalesce(F.min(sustained), F.max(any_)) if kind == "drop" else F.coalesce(F.max(sustained), F.min(any_))


def max_change(df: DataFrame, keys: list[str], order: list[str], value: str, buf: int, kind: str, digits: int = 6) -> DataFrame:
    """keys, change: with the series' mean, rounded to ``digits``, as the threshold. One shuffle on the keys."""
    seen = df.where(F.col(value).isNotNull()).withColumn("__mean", F.round(F.avg(value).over(W.partitionBy(*keys)), digits))
    a, b = change_columns(value, F.col("__mean"), buf, kind, keys, order)
    return seen.withColumns({"__s": a, "__a": b}).groupBy(*keys).agg(best(kind, F.col("__s"), F.col("__a")).alias("change"))


def max_change_exact(df: DataFrame, keys: list[str], order: list[str], value: str, buf: int, kind: str, digits: int = 6, tries: int = 10) -> DataFrame:
    """As ``max_change``, with the search of the original procedure and its limit of ``tries``.

    Candidates are tried from the smallest (largest) on, at the places that a scan of
    the series meets; one that fails goes with all equal differences, the scan goes on
    from the next place, and after a whole scan it stops when the tries are used up.
    An untested candidate may then be the result.
    """
    sign = 1 if kind == "drop" else -1
    series = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"])
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(series.alias("v"), F.round(F.avg(value), digits).alias("m"))
    rows = rows.withColumn("l", F.size("v") - (buf + 1 if kind == "drop" else buf))
    v, m, last = F.col("v"), F.col("m"), F.col("l")
    rows = rows.withColumn("d", F.when(last >= 2, F.transform(F.sequence(F.lit(0), last - 2), lambda i: sign * (F.get(v, i + 1) - F.get(v, i)))))
    d = F.col("d")

    def sustained(i: Column) -> Column:
        ok = F.lit(True)
        for k in range(2, 2 + buf):
            ok = ok & (sign * F.get(v, i + k) < sign * m)
        return F.coalesce(ok, F.lit(False))

    start = F.struct(F.array_min(d).alias("c"), F.lit(0).alias("t"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        i = k % (last - 1)
        over = s["done"] | ((i == 0) & (s["t"] >= F.least(last, F.lit(tries))))
        meets = ~over & (F.get(d, i) == s["c"])
        fails = meets & ~sustained(i)
        after = F.array_min(F.filter(d, lambda x: x > s["c"]))
        return F.struct(
            F.when(fails, F.coalesce(after, s["c"])).otherwise(s["c"]).alias("c"),
            (s["t"] + fails.cast("int")).alias("t"),
            (over | (meets & ~fails)).alias("done"),
        )

    steps = F.sequence(F.lit(0), F.least(last, F.lit(tries)) * (last - 1) - 1)
    return rows.select(*keys, F.when(last >= 2, sign * F.aggregate(steps, start, step)["c"]).alias("change"))
