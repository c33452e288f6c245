"""Whole jobs: what the command line offers, on tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indices, masks
from ..sources.adapters import BANDS
from . import evaluate, features, model, rows, series, spatial, splits


def ring_of(wkt: str) -> list[tuple[float, float]]:
    """Corners of the outer ring of a WKT polygon."""
    body = re.search(r"POLYGON\s*\(\s*\(([^)]*)\)", wkt, re.IGNORECASE)
    if not body:
        raise ValueError(f"not a polygon: {wkt[:60]!r}")
    corners = [tuple(float(x) for x in p.split()[:2]) for p in body[1].split(",")]
    return corners[:-1] if len(corners) > 1 and corners[0] == corners[-1] else corners


def clip_images(footprints: DataFrame, aoi: DataFrame, cell: float = 0.5) -> DataFrame:
    """(image_id, unique_id) of the images that each area of interest needs."""
    met = spatial.bbox_overlap(footprints.select("image_id", "minLat", "maxLat", "minLon", "maxLon"), aoi.select("unique_id", "minLat", "maxLat", "minLon", "maxLon"), cell)
    return met.select("image_id", F.col("b_unique_id").alias("unique_id"))


def clip_to_poly(obs: DataFrame, wkt: str, x: str = "x", y: str = "y") -> DataFrame:
    """Observations with their centre in the polygon."""
    return obs.where(spatial.inside(F.col(x), F.col(y), ring_of(wkt)))


def rm_blanks(obs: DataFrame, image: str = "image_id", band: str = "blue", length: int = 21) -> DataFrame:
    return rows.without_blank_groups(obs, F.substring(image, 1, length), F.coalesce(F.col(band), F.lit(0.0)))


def rm_images(obs: DataFrame, blacklist: DataFrame, image: str = "image_id", start: int = 12, length: int = 20) -> DataFrame:
    return rows.without_listed(obs, F.col(image), blacklist, start, length)


def mask_images(obs: DataFrame, kind: str, image: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(observations with masked bands null, percent masked by image). kind: udm, udm2, csorig, light, full, binary."""
    b = lambda k: F.col(f"b{k}")
    mask = {
        "udm": lambda: masks.udm(b(1)), "udm2": lambda: masks.cloud_shadow(b(3), b(6)), "csorig": lambda: masks.cloud_shadow_udm(b(3), b(6), b(8)),
        "light": lambda: masks.scene(F.col("scl"), "light"), "full": lambda: masks.scene(F.col("scl"), "full"), "binary": lambda: masks.binary(F.col("mask")),
    }[kind]()
    bands = [c for c in BANDS if c in obs.columns]
    shares = obs.groupBy(image).agg(F.round(masks.percent_masked(F.coalesce(F.col(bands[0]) != 0, F.lit(False)), mask), 6).alias("percentMasked"))
    return obs.withColumns({c: masks.apply(masks.nodata(F.col(c)), mask) for c in bands}), shares


def compare_clouds(quality: DataFrame, meta: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """Six estimates of an image's clouds side by side, in percent of the pixels that hold data.

    quality: image, udm (of the older mask file: 0 clear, 1 fill, above unusable) and b1
    (1 clear), b3, b6, b8 (as udm) of the newer one; a mask that is null all over, as its
    file is missing, gives null. meta: image and clouds_meta, the share in the metadata.
    """
    n, c = F.count_if, F.col

    def share(hidden, fill):
        valid = n(fill != 1)
        return F.round(F.when(F.count(fill) > 0, F.coalesce(F.try_divide(100.0 * hidden, valid), F.lit(100.0))), 6)

    hidden = (c("b6") + c("b3")) != 0
    out = quality.groupBy(image).agg(
        share(n(c("udm") > 1), c("udm")).alias("percent_notclear_udm_1"), share(n(c("b8") > 1), c("b8")).alias("percent_notclear_udm_2"),
        share(n(c("b8") != 1) - n(c("b1") != 0), c("b8")).alias("percent_notclear_udm2"),
        share(n(hidden), c("b8")).alias("percent_cs_udm2"), share(n(hidden | (c("b8") > 1)), c("b8")).alias("percent_csorig_udm2"),
    )
    return rows.outer_reduce([meta, out], image) if meta is not None else out


def raster_summary(obs: DataFrame, image: str, x: str, y: str, value: str) -> DataFrame:
    """Size, extent, holes and values of each image of a table of cells."""
    c = F.col(value)
    return obs.groupBy(image).agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct(y).alias("height"), F.countDistinct(x).alias("width"), F.min(x).alias("minX"), F.max(x).alias("maxX"), F.min(y).alias("minY"), F.max(y).alias("maxY"),
        F.count_if(c.isNull()).alias("nodata"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c), 6).alias("mean"),
    )


def image_fields(files: DataFrame, fields: DataFrame, name: str = "file_name", key: str = "unique_id") -> DataFrame:
    """The files whose name starts with a field's id, with the field's columns and the date of the image."""
    parts = rows.file_parts(F.col(name))
    parsed = files.select(F.col(name), parts["field_id"].alias("__id"), parts["obs_date"].alias("obs_date"))
    return parsed.join(fields, F.col("__id") == F.col(key).cast("string")).drop("__id")


def series_build(obs: DataFrame, events: DataFrame, measure: str, field: str = "field_id", date: str = "obs_date") -> DataFrame:
    """field, rel_day, value: the daily mean of a measure, aligned to each field's event, over 50 days or more to either side."""
    if measure not in features.MEASURES:
        raise ValueError(f"{measure} is none of {sorted(features.MEASURES)}")
    # the days of the calendar between observations have no value and come back with the spine
    daily = series.daily_mean(obs.select(field, date, indices.measure(measure).alias("v")), field, date, "v", calendar=False)
    return series.spine(series.align(daily, events, field, date), field=field, extend=True)


def pixel_calcs(obs: DataFrame, wanted: list[str], field: str = "field_id", pix: str = "pix", order: tuple[str, ...] = ("obs_date", "image_id"), min_obs: int = 4) -> DataFrame:
    """pixel_id, imgCount and the wanted features; unknown names are ignored."""
    out = features.pixel_features(obs, features.known_features(wanted), [field, pix], list(order), min_obs)
    return out.withColumn("pixel_id", F.concat_ws("_", F.col(field).cast("string"), F.col(pix).cast("string")))


def labelled(pixels: DataFrame, labels: DataFrame, wanted: list[str], field: str = "field_id", border: bool = False) -> DataFrame:
    """Complete pixels with the label of their field; border pixels only on demand."""
    px = pixels if border or "border" not in pixels.columns else rows.without(pixels, F.col("border"))
    y = labels.select(F.col("unique_id").cast("string").alias(field), "label").dropDuplicates([field])
    return px.withColumn(field, F.col(field).cast("string")).na.drop("any", subset=[c for c in wanted if c in px.columns]).join(y, field, "left")


def bootstrap(pixels: DataFrame, names: list[str], reps: int, share: float = 0.2, seed: int = 8, field: str = "field_id", key: str = "pixel_id", fit: bool = False, trees: int = 100, depth: int = 12) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(hold-out predictions by rep, accuracy by rep, mean prediction of all pixels): fields are held out whole."""
    train = pixels.where("label IS NOT NULL")
    held_out, scores, everything = [], [], []
    for i in range(reps):
        a, b = splits.separate(train, splits.holdout_fields(train, field, share, seed + i), field)
        forest = model.fit_forest(a, names, trees=trees, depth=depth, seed=seed + i)
        held_out.append(model.score(forest, b, names).select(key, field, "label", F.lit(i).alias("rep"), "pred"))
        scores.append(evaluate.confusion(held_out[-1]).withColumn("rep", F.lit(i)))
        if fit:
            everything.append(model.score(forest, pixels, names).select(key, field, "pred"))
    union = lambda many: reduce(lambda x, y: x.unionByName(y), many)
    whole = union(everything).groupBy(key, field).agg(F.avg("pred").alias("meanPred")) if fit else None
    return union(held_out), union(scores), whole


def mean_accuracy(pixels: DataFrame, names: list[str], reps: int, **options) -> float:
    """Mean overall accuracy over repeated hold-outs."""
    return bootstrap(pixels, names, reps, **options)[1].agg(F.avg("OA")).first()[0] or 0.0
