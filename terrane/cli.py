"""Command line: python -m terrane.cli VERB --option value ... Tables are Parquet or CSV paths."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import features, model, rows, splits, workflows
from .sources import io, raster, shapes

VERSION = "0.1.0"

#: Options of each verb: name, type, default (None: required).
VERBS: dict[str, list[tuple[str, type, object]]] = {
    "version": [],
    "read_images": [("images", str, None), ("bands", str, None), ("out", str, None)],
    "read_shapes": [("shapes", str, None), ("out", str, None)],
    "clip_images": [("footprints", str, None), ("aoi", str, None), ("out", str, None)],
    "clip_to_poly": [("obs", str, None), ("wkt", str, None), ("out", str, None)],
    "split_file": [("table", str, None), ("key", str, None), ("nrows", int, 75), ("out", str, None)],
    "rm_blanks": [("obs", str, None), ("out", str, None)],
    "rm_images": [("obs", str, None), ("rm_file", str, None), ("out", str, None)],
    "compare_clouds": [("quality", str, None), ("out", str, None)],
    "mask": [("obs", str, None), ("kind", str, "udm2"), ("out", str, None)],
    "pixel_calcs": [("obs", str, None), ("variables", str, None), ("min_obs", int, 4), ("out", str, None)],
    "bootstrap": [("pixels", str, None), ("labels", str, None), ("variables", str, None), ("reps", int, 5), ("share", float, 0.2), ("seed", int, 8), ("out", str, None)],
    "series": [("obs", str, None), ("events", str, None), ("measure", str, None), ("out", str, None)],
    "field_table": [("pixels", str, None), ("out", str, None)],
    "accuracy": [("pixels", str, None), ("labels", str, None), ("variables", str, None), ("seed", int, 8), ("out", str, None)],
    "select_variables": [("pixels", str, None), ("labels", str, None), ("variables", str, None), ("add", str, ""), ("remove", str, ""), ("reps", int, 5), ("out", str, None)],
    "loocv": [("pixels", str, None), ("labels", str, None), ("variables", str, None), ("seed", int, 8), ("out", str, None)],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrane", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, options in VERBS.items():
        v = verbs.add_parser(verb)
        for name, kind, default in options:
            v.add_argument(f"--{name}", type=kind, default=default, required=default is None)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    load = lambda path: io.as_df(spark, path)
    save = lambda df, part="": df.write.mode("overwrite").parquet(a.out + part)
    names = lambda: [r.value for r in io.read_list(spark, a.variables).collect()]
    if a.verb == "read_images":
        save(raster.read_geotiff(spark, a.images, a.bands.split(",")))
    elif a.verb == "read_shapes":
        save(shapes.read_shapefile(spark, a.shapes))
    elif a.verb == "clip_images":
        save(workflows.clip_images(load(a.footprints), io.read_csv(spark, a.aoi, io.AOI)))
    elif a.verb == "clip_to_poly":
        save(workflows.clip_to_poly(load(a.obs), a.wkt))
    elif a.verb == "split_file":
        io.write_chunks(load(a.table), [F.col(a.key)], a.nrows, a.out)
    elif a.verb == "rm_blanks":
        save(workflows.rm_blanks(load(a.obs)))
    elif a.verb == "rm_images":
        save(workflows.rm_images(load(a.obs), io.read_blacklist(spark, a.rm_file)))
    elif a.verb == "compare_clouds":
        io.write_csv(workflows.compare_clouds(load(a.quality)), a.out, ".")
    elif a.verb == "mask":
        obs, shares = workflows.mask_images(load(a.obs), a.kind)
        save(obs)
        io.write_csv(shares, a.out + "_percent_masked", ".")
    elif a.verb == "pixel_calcs":
        save(workflows.pixel_calcs(load(a.obs), names(), min_obs=a.min_obs))
    elif a.verb == "series":
        long = workflows.series_build(load(a.obs), load(a.events), a.measure)
        save(long, "/long")
        io.write_series(long, a.out + "/wide")
    elif a.verb == "field_table":
        save(features.field_table(load(a.pixels), F.col("border") == 1, F.col("FieldSize")))
    else:
        wanted = names()
        px = workflows.labelled(load(a.pixels), load(a.labels), wanted)
        wanted = [c for c in rows.keep_columns(px, wanted).columns]
        if a.verb == "bootstrap":
            held, scores, whole = workflows.bootstrap(px, wanted, a.reps, a.share, a.seed, fit=True)
            save(held, "/holdout")
            save(scores, "/accuracy")
            save(whole, "/all")
        elif a.verb == "accuracy":
            train = px.where("label IS NOT NULL")
            parted = splits.test_share(train.withColumn("__n", F.xxhash64("pixel_id")), "__n", 0.01, a.seed)
            save(model.quick_accuracy(parted.where("NOT test"), parted.where("test"), wanted, "__n", seed=a.seed), "/quick")
            save(model.fold_accuracy(parted.drop("test"), wanted, "__n", 3, seed=a.seed), "/folds")
        elif a.verb == "select_variables":
            listed = lambda path: [r.value for r in io.read_list(spark, path).collect()] if path else []
            px = workflows.labelled(load(a.pixels), load(a.labels), [*wanted, *listed(a.add)])
            chosen, _ = model.select_by_lists(wanted, lambda v: workflows.mean_accuracy(px, v, a.reps), add=listed(a.add), remove=listed(a.remove))
            io.write_lines(spark.createDataFrame([(v,) for v in chosen], "variable string"), a.out)
        else:
            train = px.where("label IS NOT NULL")
            fields = [r[0] for r in splits.holdout_fields(train, "field_id", 1.0, a.seed).collect()]
            save(model.leave_one_out(train, wanted, "field_id", fields, seed=a.seed))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(VERSION)
    else:
        run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
