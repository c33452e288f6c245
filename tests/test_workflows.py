import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import cli
from terrane.operators import workflows
from terrane.plans import models


def obs(spark):
    df = spark.range(600).select((F.col("id") % 6).cast("string").alias("field_id"), (F.col("id") % 30).alias("pix"), F.expr("date_add(DATE '2019-10-01', CAST(id / 30 AS INT))").alias("obs_date"))
    v = F.xxhash64("pix", "obs_date") % 1000
    bump = F.when(F.col("field_id").cast("int") % 2 == 0, 900).otherwise(0)
    return df.withColumns({"image_id": F.concat("field_id", F.lit("_"), F.date_format("obs_date", "yyyyMMdd")), "blue": F.abs(v).cast("double") + 1, "green": F.lit(700.0), "red": F.abs(v) + 300.0 + bump, "nir": F.lit(4000.0), "x": (F.col("pix") % 5).cast("double"), "y": F.floor(F.col("pix") / 5).cast("double")})


def test_ring_and_polygon(spark):
    wkt = "POLYGON ((-0.5 -0.5, 2.5 -0.5, 2.5 1.5, -0.5 1.5, -0.5 -0.5))"
    assert len(workflows.ring_of(wkt)) == 4
    got = {(r.x, r.y) for r in workflows.clip_to_poly(obs(spark), wkt).select("x", "y").distinct().collect()}
    assert got == {(x, y) for x in (0, 1, 2) for y in (0, 1)}
    with pytest.raises(ValueError):
        workflows.ring_of("POINT (1 2)")


def test_masks_and_clouds(spark):
    q = spark.createDataFrame([("i", u, u % 2, 0, int(u == 3), u % 3, float(u)) for u in range(6)], "image_id string, udm int, b1 int, b3 int, b6 int, b8 int, blue double")
    r = workflows.compare_clouds(q).first()
    # five pixels hold data in the older mask, four in the newer one (b8 is 0, 1, 2, 0, 1, 2)
    assert (r.percent_notclear_udm_1, r.percent_notclear_udm_2, r.percent_notclear_udm2) == (80.0, 50.0, 25.0)
    assert (r.percent_cs_udm2, r.percent_csorig_udm2) == (25.0, 75.0)
    meta = spark.createDataFrame([("i", 7.5), ("j", 1.0)], "image_id string, clouds_meta double")
    both = {x.image_id: x for x in workflows.compare_clouds(q.withColumn("udm", F.lit(None).cast("int")), meta).collect()}
    assert both["i"].percent_notclear_udm_1 is None and both["i"].clouds_meta == 7.5 and both["i"].percent_cs_udm2 == 25.0 and both["j"].percent_cs_udm2 is None
    seen, share = workflows.mask_images(q, "udm2")
    assert sorted(x.blue for x in seen.where("blue IS NOT NULL").collect()) == [1, 2, 4, 5] and share.first().percentMasked == 20.0


def test_verbs_from_observations_to_predictions(spark, tmp_path, capsys):
    p = lambda n: str(tmp_path / n)
    obs(spark).write.parquet(p("obs.parquet"))
    (tmp_path / "v.csv").write_text("redAvg\nredMax\nndvi10\nredDopr0\n")
    cli.main(["pixel_calcs", "--obs", p("obs.parquet"), "--variables", p("v.csv"), "--out", p("px.parquet")])
    px = spark.read.parquet(p("px.parquet"))
    assert px.count() == 30 and set(px.columns) == {"field_id", "pix", "imgCount", "redAvg", "redMax", "ndvi10", "pixel_id"}
    spark.createDataFrame([(str(k), int(k % 2 == 0)) for k in range(6)], "unique_id string, label int").write.parquet(p("y.parquet"))
    cli.main(["bootstrap", "--pixels", p("px.parquet"), "--labels", p("y.parquet"), "--variables", p("v.csv"), "--reps", "2", "--share", "0.34", "--out", p("bs")])
    acc = spark.read.parquet(p("bs/accuracy")).collect()
    assert len(acc) == 2 and all(r.TruePos + r.FalsePos + r.MissedPos + r.TrueNeg == 10 for r in acc)
    assert spark.read.parquet(p("bs/all")).count() == 30
    cli.main(["rm_blanks", "--obs", p("obs.parquet"), "--out", p("nb.parquet")])
    assert spark.read.parquet(p("nb.parquet")).count() == 600
    cli.main(["split_file", "--table", p("px.parquet"), "--key", "pixel_id", "--nrows", "8", "--out", p("chunks")])
    assert len(list((tmp_path / "chunks").glob("chunk=*"))) == 4
    assert spark.read.option("header", True).csv(p("chunks")).count() == 30
    spark.createDataFrame([(str(k), "2019-10-06", "2019-10-10") for k in range(6)], "field_id string, preburn string, burn string").selectExpr("field_id", "to_date(preburn) AS preburn", "to_date(burn) AS burn").write.parquet(p("ev.parquet"))
    cli.main(["series", "--obs", p("obs.parquet"), "--events", p("ev.parquet"), "--measure", "red", "--out", p("ts")])
    long = spark.read.parquet(p("ts/long"))
    assert long.count() == 6 * 101 and long.where("value IS NOT NULL").count() > 60
    wide = spark.read.option("header", True).csv(p("ts/wide"))
    assert wide.columns == ["rel_day", *[f"AVG_{k}" for k in range(6)]] and wide.count() == 101
    (tmp_path / "add.csv").write_text("ndvi10\n")
    (tmp_path / "few.csv").write_text("redAvg\nredMax\n")
    cli.main(["select_variables", "--pixels", p("px.parquet"), "--labels", p("y.parquet"), "--variables", p("few.csv"), "--add", p("add.csv"), "--remove", p("few.csv"), "--reps", "1", "--out", p("sel")])
    assert 1 <= spark.read.text(p("sel")).count() <= 3
    cli.main(["accuracy", "--pixels", p("px.parquet"), "--labels", p("y.parquet"), "--variables", p("few.csv"), "--out", p("acc")])
    assert {x.kind for x in spark.read.parquet(p("acc/quick")).collect()} <= {"test", "out of bag"} and spark.read.parquet(p("acc/folds")).count() == 3
    cli.main(["version"])
    assert capsys.readouterr().out.strip() == cli.VERSION


def test_images_of_areas(spark):
    foot = spark.createDataFrame([("a", 30.0, 31.0, 74.0, 75.0), ("b", 40.0, 41.0, 74.0, 75.0)], "image_id string, minLat double, maxLat double, minLon double, maxLon double")
    aoi = spark.createDataFrame([("u", 30.5, 30.6, 74.9, 75.1)], "unique_id string, minLat double, maxLat double, minLon double, maxLon double")
    assert workflows.clip_images(foot, aoi).collect() == [("a", "u")]
    listed = spark.createDataFrame([("20191129_040301_0f36_",)], "To_remove string")
    im = spark.createDataFrame([("1234567890_20191129_040301_0f36_x.tif",), ("1234567890_20191130_040301_0f36_x.tif",)], "image_id string")
    assert workflows.rm_images(im, listed).count() == 1


def test_every_field_is_held_out_and_every_feature_tried(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, k % 5, int(v[9] > 0), *map(float, v)) for k, v in enumerate(rng.standard_normal((120, 64)))]
    px = spark.createDataFrame(rows, "pixel_id long, field_id long, label int, " + ", ".join(f"{f} double" for f in models.FEATURES)).cache()
    monkeypatch.setattr(models, "pixels", lambda spark, d: px)
    out = models.loocv(spark, "").collect()
    assert sorted(x.pixel_id for x in out) == list(range(120)) and all(x.pred is not None for x in out)
    tried = []
    monkeypatch.setattr(models.M, "fit_forest", lambda train, names, **_: names)
    monkeypatch.setattr(models.M, "score", lambda model, held, names: names)
    monkeypatch.setattr(models.M, "accuracy", lambda names: tried.append(names) or len({"f9", "f12", "f15"} & set(names)) / 3)
    monkeypatch.setattr(models, "split", lambda spark, d: (px, px))
    assert {x.feature for x in models.forward_select(spark, "").collect()} == {"f9", "f12", "f15"}
    assert {n[0] for n in tried if len(n) == 1} == set(models.FEATURES)


def test_forward_select_splits_once_and_keeps_all_rows(spark, monkeypatch):
    rows = [(k, k % 5, k % 2, *[float(k)] * 64) for k in range(100)]
    px = spark.createDataFrame(rows, "pixel_id long, field_id long, label int, " + ", ".join(f"{f} double" for f in models.FEATURES)).repartition(16)
    monkeypatch.setattr(models, "pixels", lambda spark, d: px)
    read = []
    seen = lambda df: read.append((df.storageLevel.useMemory, df.rdd.getNumPartitions(), df.count()))
    monkeypatch.setattr(models.M, "fit_forest", lambda train, names, **_: seen(train))
    monkeypatch.setattr(models.M, "score", lambda model, held, names: seen(held))
    monkeypatch.setattr(models.M, "accuracy", lambda _: 0.0)
    models.forward_select(spark, "")
    assert set(read) == {(True, 1, 80), (True, 1, 20)}
    monkeypatch.setattr(models.M, "PART_ROWS", 30)
    assert (g := models.M.gathered(px, models.FEATURES)).rdd.getNumPartitions() == 4 and g.count() == 100


def test_gathered_features_give_the_same_forest(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(v[1] + v[2] > 0), *[None if k % 9 == j else float("nan") if k % 11 == j else float(x) for j, x in enumerate(v)]) for k, v in enumerate(rng.standard_normal((90, 3)))]
    px = spark.createDataFrame(rows, "pixel_id long, label int, a double, b double, c double").coalesce(1)
    packed = models.M.gathered(px, ["a", "b", "c"])
    for names in (["a"], ["c", "b"], ["b", "a", "c"]):
        one, two = (sorted(models.M.score(models.M.fit_forest(t, names, trees=5, depth=4), t, names).select("pixel_id", "label", "pred").collect()) for t in (px, packed))
        assert one == two and len(one) == sum(all(r[2 + "abc".index(n)] is not None and r[2 + "abc".index(n)] == r[2 + "abc".index(n)] for n in names) for r in rows)


def test_files_of_fields_and_rasters(spark):
    files = spark.createDataFrame([("12_20191101_3B_x.tif",), ("13_20191102_3B_x.tif",)], "file_name string")
    fields = spark.createDataFrame([(12, "u")], "unique_id int, village string")
    [r] = workflows.image_fields(files, fields).collect()
    assert (r.file_name, r.unique_id, r.village, str(r.obs_date)) == ("12_20191101_3B_x.tif", 12, "u", "2019-11-01")
    cells = spark.createDataFrame([("i", x, y, None if x == y else float(x + y)) for x in range(3) for y in range(2)], "image string, x int, y int, v double")
    [r] = workflows.raster_summary(cells, "image", "x", "y", "v").collect()
    assert (r.cells, r.width, r.height, r.nodata, r.low, r.high, r.minX, r.maxY) == (6, 3, 2, 2, 1.0, 3.0, 0, 1)
    with pytest.raises(ValueError):
        workflows.series_build(cells, cells, "purple")


def test_lone_sessions_only_may_do_without_a_shared_folder(spark):
    from types import SimpleNamespace

    from terrane.sources import io

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://far:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        io.shared_folder(far)
