"""Temporal features of pixels, and their roll-up to fields, each in one aggregation.

A feature is named by a measure (band or index) and a statistic: Avg, Max, Min, Rng,
Stdv, a percentile (20), or Drop0-2 and Spike0-2, the sustained changes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indices import INDICES, measure
from ..sources.adapters import BANDS
from .change import best

MEASURES = sorted([*BANDS, *INDICES], key=len, reverse=True)
#: Measures whose statistics are cut to whole numbers.
WHOLE = {"blue", "green", "red", "nir", "SWIR1", "SWIR2", "bareSoil", "CI", "bai", "baiS"}
STAT = re.compile(r"(Avg|Max|Min|Rng|Stdv|Med|Drop[012]|Spike[012]|\d\d)$")


def parse(name: str) -> tuple[str, str]:
    """(measure, statistic) of a feature's name; the longest measure wins, as some end in digits."""
    for m in MEASURES:
        if name.startswith(m) and (s := STAT.fullmatch(name[len(m) :])):
            return m, s[1]
    raise ValueError(f"not a feature: {name}")


def known_features(names: list[str]) -> list[str]:
    """Those that can be computed; misspelt ones are ignored, as in variable lists."""
    out = []
    for n in names:
        try:
            parse(n)
        except ValueError:
            continue
        out.append(n)
    return out


def whole(name: str) -> bool:
    m, s = parse(name)
    return m in WHOLE and not (m == "nir" and s.isdigit()) and not s.startswith(("Drop", "Spike"))


def pixel_features(df: DataFrame, features: list[str], keys: list[str], order: list[str], min_obs: int = 4, count_on: str = "blue", digits: int | None = 6) -> DataFrame:
    """keys, imgCount and the features of each pixel; null features below ``min_obs`` observations.

    Measures are computed once per row. Windows and aggregation share one shuffle on
    the keys; percentiles of a column are taken together.
    """
    wanted = {f: parse(f) for f in features}
    used = sorted({m for m, _ in wanted.values()})
    changes = {f: (m, s) for f, (m, s) in wanted.items() if s[:-1] in ("Drop", "Spike")}
    base = list(dict.fromkeys([*keys, *(order if changes else [])]))
    rows = df.select(*[F.col(c) for c in base], F.col(count_on).alias("__count"), *[measure(m).alias(f"m_{m}") for m in used])
    if changes:
        rows = _with_changes(rows, changes, keys, order)
    points: dict[str, list[int]] = {}
    for m, s in wanted.values():
        if s.isdigit():
            points.setdefault(m, []).append(int(s))
    aggs = [F.count("__count").alias("imgCount")]
    aggs += [F.percentile(f"m_{m}", F.array(*[F.lit(p / 100) for p in ps])).alias(f"p_{m}") for m, ps in points.items()]
    simple = {"Avg": F.avg, "Max": F.max, "Min": F.min, "Stdv": F.stddev_samp, "Med": F.median}
    for f, (m, s) in wanted.items():
        if s in simple:
            aggs.append(simple[s](f"m_{m}").alias(f"f_{f}"))
        elif s == "Rng":
            hi, lo = F.max(f"m_{m}"), F.min(f"m_{m}")
            cut = lambda c: F.round(c, 6).cast("int")
            aggs.append((cut(hi) - cut(lo) if m in WHOLE else hi - lo).alias(f"f_{f}"))
        elif not s.isdigit():
            aggs.append(best("drop" if s.startswith("Drop") else "spike", F.col(f"s_{f}"), F.col(f"a_{f}")).alias(f"f_{f}"))
    grouped = rows.groupBy(*keys).agg(*aggs)

    def value(f: str, m: str, s: str) -> Column:
        v = F.col(f"p_{m}")[points[m].index(int(s))] if s.isdigit() else F.col(f"f_{f}")
        # rounded first, so that the noise of the last bits cannot move a whole number
        v = F.round(v, 6).cast("int") if whole(f) else v if digits is None else F.round(v, digits)
        return F.when(F.col("imgCount") >= min_obs, v).alias(f)

    return grouped.select(*keys, "imgCount", *[value(f, m, s) for f, (m, s) in wanted.items()])


def _with_changes(rows: DataFrame, changes: dict[str, tuple[str, str]], keys: list[str], order: list[str]) -> DataFrame:
    """Adds s_ and a_ (sustained and any candidate differences) of each change feature.

    Nulls take no place in a series. They are skipped inside the windows, so that all
    measures share one order of the rows, and one sort.
    """
    by, at = ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{o}`" for o in order)
    over = f"OVER (PARTITION BY {by} ORDER BY {at})"
    reach: dict[str, int] = {}
    for m, s in changes.values():
        reach[m] = max(reach.get(m, 0), int(s[-1]))
    ahead = {f"l{k}_{m}": F.expr(f"lead(`m_{m}`, {k}) IGNORE NULLS {over}") for m, buf in reach.items() for k in range(1, 2 + buf)}
    place = {f"i_{m}": F.expr(f"count(`m_{m}`) OVER (PARTITION BY {by} ORDER BY {at} ROWS UNBOUNDED PRECEDING) - 1") for m in reach}
    whole = W.partitionBy(*keys)
    rows = rows.select("*", *[c.alias(k) for k, c in (ahead | place).items()])
    rows = rows.select("*", *[F.round(F.avg(f"m_{m}").over(whole), 6).alias(f"t_{m}") for m in reach], *[F.count(f"m_{m}").over(whole).alias(f"n_{m}") for m in reach])
    out = {}
    for f, (m, s) in changes.items():
        drop, buf = s.startswith("Drop"), int(s[-1])
        window = F.col(f"n_{m}") - (buf + 1 if drop else buf)
        candidate = F.col(f"m_{m}").isNotNull() & (F.col(f"i_{m}") <= window - 2) & (window >= 2)
        diff = F.col(f"l1_{m}") - F.col(f"m_{m}")
        sustained = F.lit(True)
        for k in range(2, 2 + buf):
            later = F.col(f"l{k}_{m}")
            sustained = sustained & (later < F.col(f"t_{m}") if drop else later > F.col(f"t_{m}"))
        out |= {f"s_{f}": F.when(candidate & sustained, diff), f"a_{f}": F.when(candidate, diff)}
    return rows.withColumns(out)


#: Roll-up statistics by the prefix of their names.
ROLLUP = {
    "avg": lambda c: F.avg(c), "med": lambda c: F.median(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c), "std": lambda c: F.stddev_samp(c), "sum": lambda c: F.sum(c),
    "10": lambda c: F.percentile(c, F.lit(0.10)), "25": lambda c: F.percentile(c, F.lit(0.25)), "75": lambda c: F.percentile(c, F.lit(0.75)), "90": lambda c: F.percentile(c, F.lit(0.90)),
}


def field_rollup(pixels: DataFrame, features: list[str], border: Column, field: str = "field_id", stats: tuple[str, ...] = ("avg", "med", "std", "10", "25", "75", "90"), digits: int = 4) -> DataFrame:
    """One row for each field with border and interior pixels: b_ and i_ statistics of each feature, and imgcount_avg.

    Fields that lack either kind of pixel are dropped. A condition selects the
    pixels, so all statistics come from one pass over the table.
    """
    flagged = pixels.withColumn("__border", border)
    aggs = [F.round(F.avg("imgCount"), digits).alias("imgcount_avg"), F.count_if("__border").alias("b_pixels"), F.count_if(~F.col("__border")).alias("i_pixels")]
    for f in features:
        for side, flag in (("b", F.col("__border")), ("i", ~F.col("__border"))):
            c = F.when(flag, F.col(f).cast("double"))
            aggs += [F.round(ROLLUP[s](c), digits).alias(f"{side}_{f}_{s}") for s in stats]
    return flagged.groupBy(field).agg(*aggs).where("b_pixels > 0 AND i_pixels > 0")


#: Statistics of the field table: (name, feature, statistic). Border pixels: changes and means.
DROPS = {"nir": "nirDrop1", "bsi": "bareSoilDrop1", "ndvi": "ndviDrop2", "sr": "srDrop1"}
SPIKES = {"red": "redSpike0", "blue": "blueSpike0"}
PLAIN = {"blue": "blue", "green": "green", "red": "red", "nir": "nir", "sr": "sr", "ndvi": "ndvi", "bsi": "bareSoil"}


def border_stats() -> list[tuple[str, str, str]]:
    out = [(f"b_{m}_drop_{s}", f, s) for m, f in DROPS.items() for s in ("avg", "10", "25")]
    out += [(f"b_red_spike_{s}", SPIKES["red"], s) for s in ("avg", "90", "75")] + [("b_blue_spike_avg", SPIKES["blue"], "avg")]
    return out + [(f"b_{m}_{name}", PLAIN[m] + "Avg", s) for name, s in (("avg", "avg"), ("stdv", "std")) for m in ("blue", "red", "nir", "ndvi", "bsi", "sr")]


def interior_stats() -> list[tuple[str, str, str]]:
    named = lambda s: "stdv" if s == "std" else s
    out = [(f"i_{m}_drop_{named(s)}", f, s) for m, f in DROPS.items() for s in ("avg", "med", "min", "std", "10", "25")]
    out += [(f"i_{m}_spike_{named(s)}", f, s) for m, f in SPIKES.items() for s in ("avg", "med", "max", "std", "90", "75")]
    # the middle of the pixels' extremes, the mean of their means and deviations
    return out + [(f"i_{m}_{name}", f + stat, s) for m, f in PLAIN.items() for name, stat, s in (("avg", "Avg", "avg"), ("max", "Max", "med"), ("min", "Min", "med"), ("stdv", "Stdv", "avg"))]


def field_features() -> list[str]:
    """The pixel features that the field table is made of."""
    return list(dict.fromkeys(f for _, f, _ in [*border_stats(), *interior_stats()]))


def field_table(pixels: DataFrame, border: Column, size: Column, field: str = "field_id", digits: int | None = 4) -> DataFrame:
    """field, imgcount_avg, FieldSize, b_Pixcount, 28 border and 64 interior statistics; fields that lack either kind of pixel are dropped.

    One pass: a condition selects the pixels, and percentiles of a feature share their buffer.
    """
    flagged = pixels.withColumns({"__border": border, "__size": size})
    cut = lambda c: c if digits is None else F.round(c, digits)
    aggs = [cut(F.avg("imgCount")).alias("imgcount_avg"), cut(F.avg("__size")).alias("FieldSize"), F.count_if("__border").alias("b_Pixcount"), F.count_if(~F.col("__border")).alias("__inner")]
    for stats, flag in ((border_stats(), F.col("__border")), (interior_stats(), ~F.col("__border"))):
        aggs += [cut(ROLLUP[s](F.when(flag, F.col(f).cast("double")))).alias(name) for name, f, s in stats]
    return flagged.groupBy(field).agg(*aggs).where("b_Pixcount > 0 AND __inner > 0").drop("__inner")
