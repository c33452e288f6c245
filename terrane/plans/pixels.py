"""Per-pixel features, sustained changes and field roll-ups."""

from pyspark.sql import functions as F

from ..operators import change, evaluate, features
from ..sources.adapters import BAND_OBS, ORDER, band_obs, table
from .projections import INDEX_SQL
from .registry import query

KEYS = ["field_id", "pix"]


def i(expr: str) -> str:
    return f"CAST(trunc(round({expr}, 6)) AS INTEGER)"


def sql_feature(name: str, least: int = 4, whole_only: bool = False) -> str:
    m, s = features.parse(name)
    c = f'"v_{m}"'
    p = lambda q: f"quantile_cont({c}, {int(q) / 100})"
    if s == "Rng":
        e = f"{i(f'max({c})')} - {i(f'min({c})')}" if m in features.WHOLE else f"max({c}) - min({c})" if whole_only else f"round(max({c}) - min({c}), 6)"
    else:
        e = {"Avg": f"avg({c})", "Max": f"max({c})", "Min": f"min({c})", "Stdv": f"stddev_samp({c})", "Med": f"median({c})"}.get(s) or p(s)
        e = i(e) if features.whole(name) else e if whole_only else f"round({e}, 6)"
    return f'CASE WHEN count(blue) >= {least} THEN {e} END AS "{name}"'


def pixel_sql(names: list[str], least: int = 4, unrounded: bool = False) -> str:
    used = sorted({features.parse(n)[0] for n in names})
    cols = ", ".join(f'{INDEX_SQL.get(m, chr(34) + m + chr(34))} AS "v_{m}"' for m in used)
    return f"WITH {BAND_OBS}, m AS (SELECT field_id, pix, blue, {cols} FROM band_obs) SELECT field_id, pix, count(blue) AS \"imgCount\", {', '.join(sql_feature(n, least, unrounded) for n in names)} FROM m GROUP BY field_id, pix"


def stats(measures: list[str], suffixes: list[str]) -> list[str]:
    return [m + s for m in measures for s in suffixes]


BAND_STATS = stats(["blue", "green", "red", "nir", "SWIR1", "SWIR2"], ["Avg", "Max", "Min", "Rng", "Stdv"]) + ["redEdge3Avg", "redEdge3Min"]
PERCENTILES = ["red80", "red20", "nir20", "redEdge320", "ndvi25", "ndvi10", "sr25", "sr10", "bareSoil20", "bareSoil10", "CI80", "MIRBI80", "BurnScar80"]
INDEX_STATS = stats(["ndvi", "sr", "evi2", "savi", "msavi", "NBR", "NBR2", "MIRBI", "BurnScar", "bai", "baiS", "CI", "bareSoil"], ["Avg", "Max", "Min"]) + ["ndviRng", "ndviStdv", "srRng", "CIRng", "bareSoilRng"]


@query(pixel_sql(BAND_STATS))
def pixel_stats_bands(spark, d):
    return features.pixel_features(band_obs(spark, d), BAND_STATS, KEYS, ORDER)


@query(pixel_sql(PERCENTILES))
def pixel_percentiles(spark, d):
    return features.pixel_features(band_obs(spark, d), PERCENTILES, KEYS, ORDER)


@query(pixel_sql(INDEX_STATS))
def pixel_stats_indices(spark, d):
    return features.pixel_features(band_obs(spark, d), INDEX_STATS, KEYS, ORDER)


def change_sql(value: str, buf: int, kind: str, source: str = BAND_OBS, table_: str = "band_obs", keys: str = "field_id, pix", order: str = ", ".join(ORDER)) -> str:
    sign, agg, other = ("<", "min", "max") if kind == "drop" else (">", "max", "min")
    sus = " AND ".join([f"lead(v, {k}) OVER w {sign} m" for k in range(2, 2 + buf)]) or "TRUE"
    win = f"n - {buf + 1 if kind == 'drop' else buf}"
    return f"""WITH {source}, s AS (SELECT {keys}, {order}, {value} AS v FROM {table_} WHERE {value} IS NOT NULL),
t AS (SELECT *, round(avg(v) OVER (PARTITION BY {keys}), 6) AS m, count(*) OVER (PARTITION BY {keys}) AS n FROM s),
u AS (SELECT {keys}, n, row_number() OVER w - 1 AS i, lead(v, 1) OVER w - v AS diff, ({sus}) AS sus FROM t WINDOW w AS (PARTITION BY {keys} ORDER BY {order}))
SELECT {keys}, coalesce({agg}(diff) FILTER (i <= {win} - 2 AND {win} >= 2 AND sus), {other}(diff) FILTER (i <= {win} - 2 AND {win} >= 2)) AS change FROM u GROUP BY {keys}"""


def add_change(kind: str, buf: int):
    value = "red" if kind == "drop" else "blue"

    @query(change_sql(value, buf, kind), name=f"{kind}_buf{buf}")
    def run(spark, d):
        return change.max_change(band_obs(spark, d), KEYS, ORDER, value, buf, kind)


for _kind in ("drop", "spike"):
    for _buf in (0, 1, 2):
        add_change(_kind, _buf)


def exact_sql(value: str, buf: int, kind: str, tries: int = 10) -> str:
    """The search step by step: place k of the scan, the candidate c, the tries t; one row of state for each series and step."""
    sign, off = (1, buf + 1) if kind == "drop" else (-1, buf)
    holds = " AND ".join([f"{sign} * v[i + {k + 1}] < {sign} * m" for k in range(2, 2 + buf)]) or "TRUE"
    return f"""WITH RECURSIVE {BAND_OBS}, a AS (SELECT field_id, pix, list({value} ORDER BY {", ".join(ORDER)}) AS v, round(avg({value}), 6) AS m, count(*) - {off} AS l FROM band_obs WHERE {value} IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, [{sign} * (v[j + 1] - v[j]) for j in generate_series(1, l - 1)] AS d FROM a WHERE l >= 2),
r AS (SELECT field_id, pix, v, m, l, d, list_min(d) AS c, 0 AS t, 0 AS k, FALSE AS done FROM b
  UNION ALL SELECT field_id, pix, v, m, l, d, CASE WHEN meets AND NOT ok THEN coalesce(list_min([x for x in d if x > c]), c) ELSE c END, t + CAST(meets AND NOT ok AS INTEGER), k + 1, over_ OR (meets AND ok)
  FROM (SELECT *, coalesce({holds}, FALSE) AS ok, NOT over_ AND d[i + 1] = c AS meets FROM (SELECT *, k % (l - 1) AS i, done OR (k % (l - 1) = 0 AND t >= least(l, {tries})) AS over_ FROM r WHERE NOT done AND k < least(l, {tries}) * (l - 1)))),
e AS (SELECT field_id, pix, {sign} * arg_max(c, k) AS change FROM r GROUP BY 1, 2)
SELECT field_id, pix, change FROM a LEFT JOIN e USING (field_id, pix)"""


@query(exact_sql("red", 1, "drop"))
def drop_exact(spark, d):
    return change.max_change_exact(band_obs(spark, d), KEYS, ORDER, "red", 1, "drop")


@query(exact_sql("blue", 2, "spike"))
def spike_exact(spark, d):
    return change.max_change_exact(band_obs(spark, d), KEYS, ORDER, "blue", 2, "spike")


FIVE, THREE = ["Avg", "Max", "Min", "Rng", "Stdv"], ["Avg", "Max", "Min"]
DROP3, SPIKE3 = [f"Drop{k}" for k in range(3)], [f"Spike{k}" for k in range(3)]
#: Every statistic of every measure.
MATRIX = {
    "blue": FIVE + SPIKE3, "green": FIVE + ["Spike0", "Drop0"], "red": FIVE + ["80", "20"] + DROP3 + ["Spike0"], "nir": FIVE + ["20"] + DROP3, "SWIR1": FIVE + DROP3[:2], "SWIR2": FIVE + DROP3[:2],
    "redEdge3": ["Avg", "Min", "20"] + DROP3[:2], "ndvi": FIVE + ["25", "10", "Drop2"], "sr": FIVE + ["25", "10"] + DROP3, "bareSoil": FIVE + ["20", "10"] + DROP3[1:], "CI": THREE + ["80", "Rng"] + DROP3 + SPIKE3,
    "bai": THREE + DROP3, "baiS": THREE + DROP3, "NBR": THREE + DROP3[:2], "NBR2": THREE + DROP3[:2], "MIRBI": THREE + ["80"] + SPIKE3[:2], "BurnScar": THREE + ["80"] + SPIKE3[:2], "evi2": THREE, "savi": THREE, "msavi": THREE,
}
FULL = [m + s for m, many in MATRIX.items() for s in many]


def is_change(name: str) -> bool:
    return features.parse(name)[1][:-1] in ("Drop", "Spike")


def matrix_sql(names: list[str], digits: int | None = 6) -> str:
    """Statistics from one aggregation, each sustained change from a query of its own."""
    joins, cols = [], []
    for k, n in enumerate(x for x in names if is_change(x)):
        m, s = features.parse(n)
        joins.append(f"LEFT JOIN ({change_sql(INDEX_SQL.get(m, m if m.islower() else chr(34) + m + chr(34)), int(s[-1]), s[:-1].lower())}) c{k} ON c{k}.field_id = px.field_id AND c{k}.pix = px.pix")
        value = f"c{k}.change" if digits is None else f"round(c{k}.change, {digits})"
        cols.append(f'CASE WHEN "imgCount" >= 4 THEN {value} END AS "{n}"')
    plain = [n for n in names if not is_change(n)]
    return f"SELECT px.*, {', '.join(cols)} FROM ({pixel_sql(plain, unrounded=digits is None)}) px {' '.join(joins)}"


#: Means and percentiles often end in a five where they are cut; the shift keeps engines, which round it either way, together.
SHIFT = 0.0000131717
FULL_SQL = f"""SELECT field_id, pix, "imgCount", {', '.join(f'"{n}"' if features.whole(n) else f'round("{n}" + {SHIFT}, 4) AS "{n}"' for n in FULL)} FROM ({matrix_sql(FULL, None)})"""


@query(FULL_SQL)
def pixel_features(spark, d):
    """Every name of the matrix: bands, indices, percentiles and sustained changes, in one shuffle."""
    out = features.pixel_features(band_obs(spark, d), features.known_features(FULL + ["redDopr0"]), KEYS, ORDER, digits=None)
    return out.withColumns({n: F.round(F.col(n) + SHIFT, 4) for n in FULL if not features.whole(n)})


ROLL_STATS = {"avg": "avg({c})", "med": "median({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "10": "quantile_cont({c}, 0.1)", "25": "quantile_cont({c}, 0.25)", "75": "quantile_cont({c}, 0.75)", "90": "quantile_cont({c}, 0.9)"}


def rollup_sql() -> str:
    parts = []
    for stats_, flag in ((features.border_stats(), "border"), (features.interior_stats(), "NOT border")):
        for name, f, s in stats_:
            c = f'CASE WHEN {flag} THEN CAST("{f}" AS DOUBLE) END'
            parts.append(f'round({ROLL_STATS[s].format(c=c)} + {SHIFT}, 4) AS "{name}"')
    return f"""WITH px AS ({matrix_sql(features.field_features(), None)}), f AS (SELECT px.*, p_size, p_size <= 15 AS border FROM px JOIN part ON p_partkey = px.pix)
SELECT field_id, round(avg("imgCount") + {SHIFT}, 4) AS imgcount_avg, round(avg(p_size) + {SHIFT}, 4) AS "FieldSize", count(*) FILTER (border) AS "b_Pixcount", {', '.join(parts)} FROM f GROUP BY field_id HAVING count(*) FILTER (border) > 0 AND count(*) FILTER (NOT border) > 0"""


@query(rollup_sql())
def field_rollup(spark, d):
    """The whole field table: 29 border and 64 interior columns."""
    px = features.pixel_features(band_obs(spark, d), features.field_features(), KEYS, ORDER, digits=None)
    sized = px.join(table(spark, d, "part").select(F.col("p_partkey").alias("pix"), "p_size"), "pix")
    out = features.field_table(sized, F.col("p_size") <= 15, F.col("p_size"), digits=None)
    return out.withColumns({c: F.round(F.col(c) + SHIFT, 4) for c, t in out.dtypes if t == "double"})


@query("SELECT l_partkey AS pix, arg_max(CAST(l_shipdate AS DATE), (l_quantity, -l_orderkey, -l_linenumber, -l_suppkey)) AS best_date FROM lineitem GROUP BY 1")
def argmax_image(spark, d):
    li = table(spark, d, "lineitem")
    at = F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_suppkey"))
    return li.groupBy(F.col("l_partkey").alias("pix")).agg(F.max_by(F.col("l_shipdate").cast("date"), at).alias("best_date"))


@query("SELECT s_suppkey, count(l_orderkey) AS num_images FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_discount > 0.095 GROUP BY 1")
def image_count_left(spark, d):
    few = table(spark, d, "lineitem").where("l_discount > 0.095").select("l_suppkey", "l_orderkey")
    s = table(spark, d, "supplier")
    return s.join(few, s.s_suppkey == few.l_suppkey, "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("num_images"))


@query("SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY ALL")
def band_mean_std_incl_mean(spark, d):
    """Standard deviation over n values and their mean: the population's."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("std"))


@query("SELECT l_returnflag, median(l_quantity) AS med, round(var_samp(l_quantity), 6) AS var, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def median_by_group(spark, d):
    li = table(spark, d, "lineitem")
    med = evaluate.percentiles(li, ["l_returnflag"], "l_quantity", {"med": 0.5}).drop("n")
    rest = li.groupBy("l_returnflag").agg(F.round(F.var_samp("l_quantity"), 6).alias("var"), F.countDistinct("l_suppkey").alias("n"))
    return med.join(rest, "l_returnflag")


@query("SELECT s_suppkey AS field_id, sum(l_linenumber)::BIGINT AS num_images, round(avg(l_discount), 6) AS mean, round(quantile_cont(l_discount, 0.25), 6) AS p25, round(quantile_cont(l_discount, 0.5), 6) AS p50, round(quantile_cont(l_discount, 0.75), 6) AS p75, round(quantile_cont(l_discount, 0.9), 6) AS p90 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def field_quantiles(spark, d):
    p = F.percentile("l_discount", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("field_id")).agg(F.sum("l_linenumber").cast("long").alias("num_images"), F.round(F.avg("l_discount"), 6).alias("mean"), p.alias("p"))
    return g.select("field_id", "num_images", "mean", *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p25", "p50", "p75", "p90"))])


@query(f"WITH {BAND_OBS}, u AS (SELECT field_id, 'blue' AS band, blue AS v FROM band_obs UNION ALL SELECT field_id, 'nir', nir FROM band_obs UNION ALL SELECT field_id, 'red', red FROM band_obs) SELECT band, field_id, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 FROM u GROUP BY ALL")
def box_stats(spark, d):
    long = band_obs(spark, d).select("field_id", "blue", "nir", "red").unpivot(["field_id"], ["blue", "nir", "red"], "band", "v")
    g = evaluate.percentiles(long, ["band", "field_id"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return g.select("band", "field_id", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])
