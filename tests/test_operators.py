"""Values worked out by hand, invariants, and comparison with plain Python models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import indices, masks
from terrane.operators import change, evaluate, features, model, rows, series, spatial, splits
from terrane.sources import io
from terrane.streaming.daily import daily_means


def as_series(spark, *seqs):
    data = [(g, i, float(v) if v is not None else None) for g, s in enumerate(seqs) for i, v in enumerate(s)]
    return spark.createDataFrame(data, "g int, t int, v double")




def loop(seq, buf, thresh, kind, limit=10):
    """The search step by step: candidates from the extreme on, tried where a scan meets them."""
    sign = 1 if kind == "drop" else -1
    s = [sign * x for x in seq]
    n = len(s) - (buf + 1 if kind == "drop" else buf)
    if n < 2:
        return None
    d = [s[i + 1] - s[i] for i in range(n - 1)]
    left, c, tries = sorted(set(d)), min(d), 0
    while tries < min(n, limit):
        for i, x in enumerate(d):
            if x != c:
                continue
            if all(s[i + k] < sign * thresh for k in range(2, 2 + buf)):
                return sign * c
            left = [y for y in left if y > c]
            tries += 1
            c = left[0] if left else c
    return sign * c


SERIES = [[5, 9, 2, 1, 1, 8, 3, 7], [9, 1, 8, 1, 8, 8, 9], [9, 2, 8, 7, 8, 7, 9, 9]]


def test_exact_change_equals_a_loop(spark):
    rng = random.Random(3)
    seqs = SERIES + [[float(rng.randint(0, 6)) if k % 2 else rng.random() for _ in range(rng.randint(1, 26))] for k in range(150)]
    df = as_series(spark, *seqs)
    for kind in ("drop", "spike"):
        for buf in (0, 1, 2):
            got = {r.g: r.change for r in change.max_change_exact(df, ["g"], ["t"], "v", buf, kind).collect()}
            for g, s in enumerate(seqs):
                want = loop(s, buf, round(sum(s) / len(s), 6), kind)
                assert got[g] == pytest.approx(want) if want is not None else got[g] is None, (s, buf, kind)


def test_change_by_hand(spark):
    df = as_series(spark, [5, 9, 2, 1, 1, 8, 3, 7])  # mean 4.5
    one = lambda buf, kind: change.max_change(df, ["g"], ["t"], "v", buf, kind).first().change
    assert (one(0, "drop"), one(1, "drop"), one(1, "spike")) == (-7, -7, 0)


def test_change_skips_nulls_and_short_series(spark):
    df = as_series(spark, [5, None, 9, 2, None, 1, 1, 8, 3, 7], [1, 2], [None])
    got = {r.g: r.change for r in change.max_change(df, ["g"], ["t"], "v", 0, "drop").collect()}
    assert got == {0: -7, 1: None}


def test_percentiles_are_linear(spark):
    df = spark.createDataFrame([(1, float(i), float(v), 1.0) for i, v in enumerate([1, 2.5, 4, 7.25, 9])], "pix int, t double, redEdge3 double, blue double")
    r = features.pixel_features(df, ["redEdge320", "redEdge3Rng"], ["pix"], ["t"]).first()
    assert r.redEdge320 == pytest.approx(2.2) and r.redEdge3Rng == 8 and r.imgCount == 5


def test_feature_names():
    assert features.parse("SWIR1Drop0") == ("SWIR1", "Drop0")
    assert features.parse("redEdge320") == ("redEdge3", "20")
    assert features.parse("NBR2Min") == ("NBR2", "Min")
    assert features.known_features(["redDopr0", "ndvi10"]) == ["ndvi10"]


def test_index_nulls_and_zero_division(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (None, 5.0, 1.0), (3000.0, 1000.0, None)], "nir double, red double, blue double").withColumn("green", F.lit(500.0))
    got = df.select(indices.ndvi().alias("n"), indices.ci().alias("c")).collect()
    assert [r.n for r in got] == [None, None, 5000.0] and got[2].c is None and got[0].c is not None


def test_bands_of_indices_suffice(spark):
    for name, bands in indices.INDEX_BANDS.items():
        df = spark.range(1).select(*[F.lit(1000.0 + 300 * k).alias(b) for k, b in enumerate(bands)])
        assert df.select(indices.measure(name).alias("v")).first().v is not None
        for b in bands:
            with pytest.raises(Exception, match=b):
                df.drop(b).select(indices.measure(name))


def test_masks_give_null(spark):
    df = spark.createDataFrame([(8, 1.0), (2, 2.0), (4, float("nan"))], "scl int, v double")
    assert [r[0] for r in df.select(masks.apply(F.col("v"), masks.scene(F.col("scl"), "light"))).collect()][:2] == [None, 2.0]
    assert df.select(masks.nodata(F.col("v"), 2)).collect() == [(1.0,), (None,), (None,)]
    none = df.where("scl > 100").groupBy().agg(masks.percent_masked(F.lit(True), F.lit(True)).alias("p"))
    assert none.first().p == 100.0


def test_alignment_around_an_event(spark):
    d = lambda m, k: dt.date(2019, m, k)
    obs = spark.createDataFrame([("a", x, 1.0) for x in (d(11, 4), d(11, 5), d(11, 1), d(10, 31), d(11, 2), d(11, 3))], "field_id string, obs_date date, value double")
    ev = spark.createDataFrame([("a", d(11, 1), d(11, 4))], "field_id string, preburn date, burn date")
    got = {r.obs_date: r.rel_day for r in series.align(obs, ev).collect()}
    assert [got[x] for x in (d(11, 4), d(11, 5), d(11, 1), d(10, 31), d(11, 2), d(11, 3))] == [2, 3, -2, -3, 0, 0]


def test_fold_sizes(spark):
    df = spark.createDataFrame([(k, "x" if k < 13 else None) for k in range(18)], "id long, s string")
    f = splits.folds_stratified(df, "id", "s", 5, 1).groupBy("HO").count().collect()
    assert sorted(r["count"] for r in f if r.HO is not None) == [2, 2, 3, 3, 3] and [r["count"] for r in f if r.HO is None] == [5]
    c = splits.folds_chunked(spark.range(10), "id", 5, 1).groupBy("HO").count().orderBy("HO").collect()
    assert [r["count"] for r in c] == [3, 3, 3, 1]


def test_no_field_on_both_sides(spark):
    px = spark.range(500).select((F.col("id") % 37).alias("f"), "id")
    a, b = splits.separate(px, splits.holdout_fields(px, "f", 0.2, 4), "f")
    assert not {r.f for r in a.select("f").collect()} & {r.f for r in b.select("f").collect()} and a.count() + b.count() == 500


def test_hash_rank_is_that_of_whole_numbers(spark):
    keys = [0, 1, 65535, 65536, 2**31, 2**32 - 1, 2**40 + 7, 2**62 + 3, 10**18]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(rows.hash_rank(F.col("k"), 8)).collect()]
    assert got == [(k * 2654435761 * 17 + 8 * 40503) % 2**32 for k in keys]


def test_seeds_draw_other_fields(spark):
    drawn = [frozenset(r[0] for r in splits.holdout_fields(spark.range(200), "id", 0.2, k).collect()) for k in range(4)]
    assert all(len(a) == 40 for a in drawn) and all(len(a & b) < 25 for i, a in enumerate(drawn) for b in drawn[i + 1 :])


def test_ranks_within_strata(spark):
    data = [(k, None if k % 50 == 0 else "hot" if k % 3 else "cold") for k in range(3000)]
    out = splits.ranked(spark.createDataFrame(data, "id long, s string"), ["s"], "id", 8).collect()
    for s in (None, "hot", "cold"):
        ids = sorted((k for k, t in data if t == s), key=lambda k: ((k * 2654435761 * 17 + 8 * 40503) % 2**32, k))
        assert {r.id: r["__rank"] for r in out if r.s == s} == {k: n for n, k in enumerate(ids)} and all(r["__total"] == len(ids) for r in out if r.s == s)
    assert splits.ranked(spark.createDataFrame([], "id long, s string"), ["s"], "id", 8).count() == 0
    assert splits.test_share(spark.range(250), "id", 0.01, 3).where("test").count() == 3


def test_chunks_keep_every_row(spark, tmp_path):
    """A wide table, with adaptive partitions: reading the chunks and counting them must see the same ranges."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("payload"), F.lit(None).cast("int").alias("x"))
        out = rows.chunk_number(df, [F.col("k")], 75)
        assert out.count() == 20_000 and out.columns == ["k", "payload", "x", "chunk"]
        got = out.collect()
        assert len(got) == 20_000 and all(r.chunk == r.k // 75 + 1 for r in got)
        io.write_chunks(df, [F.col("k")], 75 * 60, str(tmp_path / "c"))
        back = spark.read.option("header", True).csv(str(tmp_path / "c")).groupBy("chunk").count().collect()
        assert sorted((int(r.chunk), r["count"]) for r in back) == [(1, 4500), (2, 4500), (3, 4500), (4, 4500), (5, 2000)]
        assert rows.chunk_number(df.limit(0), [F.col("k")], 75).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_outer_reduce_is_a_join(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None), (None, 3.0)], "k int, x double")
    b = spark.createDataFrame([(2, "b"), (3, "c"), (None, "n")], "k int, y string")
    got = sorted(map(str, rows.outer_reduce([a, b], "k").collect()))
    assert got == sorted(map(str, a.join(b, "k", "full").collect()))
    with pytest.raises(Exception, match="repeats"):
        rows.outer_reduce([a, b.unionByName(b)], "k").collect()


def test_listed_and_unknown(spark):
    files = spark.createDataFrame([("0001_udm",), ("0002_udm",), (None,)], "f string")
    assert [r.f for r in rows.only_listed(files, F.col("f"), spark.createDataFrame([("0001_clip.tif",)], "n string"), 1, 4).collect()] == ["0001_udm"]
    obs = spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 7.0)], "pix int, v double")
    assert sorted(map(tuple, rows.mask_unknown(obs, spark.createDataFrame([(1,), (1,)], "pix int"), ["pix"], ["v"]).collect()), key=str) == [(1, 5.0), (2, None), (2, None)]


def test_percentiles_of_large_groups(spark):
    rng = random.Random(12)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), float(rng.randint(0, 5)), None])) for _ in range(900)] + [("c", 2.5), ("d", None)]
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in evaluate.percentiles(df, ["g"], "v", points).collect()}
    want = {r.g: r for r in df.where("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(p)).alias(n) for n, p in points.items()]).collect()}
    assert set(got) == set(want) and "d" not in got
    for g, r in want.items():
        assert got[g].n == r.n and all(got[g][n] == pytest.approx(r[n]) for n in points)


def test_scores_by_rank_equal_pairs(spark):
    rng = random.Random(4)
    data = [(rng.choice([rng.random(), round(rng.random(), 1)]), int(rng.random() < 0.4)) for _ in range(600)] + [(None, 1), (float("nan"), 0), (0.5, None)]
    df = spark.createDataFrame(data, "pred double, label int")
    sound = [(p, y) for p, y in data[:600]]
    pos, neg = [p for p, y in sound if y], [p for p, y in sound if not y]
    pairs = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert evaluate.auc(df).first().auc == pytest.approx(pairs / len(pos) / len(neg), abs=1e-6)
    curve = {r.threshold: (r.fpr, r.tpr) for r in evaluate.roc_curve(df).collect()}
    assert set(curve) == {p for p, _ in sound}
    for t, (fpr, tpr) in curve.items():
        assert fpr == pytest.approx(sum(q >= t for q in neg) / len(neg), abs=1e-6) and tpr == pytest.approx(sum(p >= t for p in pos) / len(pos), abs=1e-6)


def test_confusion_adds_up_and_auc(spark):
    data = [(0.1, 0), (0.6, 0), (0.6, 1), (0.9, 1), (None, 1), (0.5, 0)]
    df = spark.createDataFrame(data, "pred double, label int")
    r = evaluate.confusion(df).first()
    assert (r.TruePos, r.FalsePos, r.MissedPos, r.TrueNeg) == (2, 2, 0, 1)
    assert evaluate.auc(df).first().auc == pytest.approx(5.5 / 6, abs=1e-6)


def test_spine_extends_to_what_was_seen(spark):
    df = spark.createDataFrame([("a", -60, dt.date(2019, 1, 1), 1.0), ("a", 3, dt.date(2019, 3, 1), 2.0), ("b", 0, dt.date(2019, 3, 1), 5.0)], "field_id string, rel_day int, obs_date date, value double")
    got = series.spine(df, extend=True).groupBy("field_id").agg(F.min("rel_day").alias("lo"), F.max("rel_day").alias("hi"), F.count("value").alias("n")).collect()
    assert sorted(map(tuple, got)) == [("a", -60, 50, 2), ("b", -50, 50, 1)]


def test_field_table_has_every_column(spark):
    names = features.field_features()
    data = [(f, p, float(p), 9, p % 3 == 0) for f in ("u", "v") for p in range(8)] + [("w", 1, 1.0, 9, True)]
    px = spark.createDataFrame(data, "field_id string, pix int, x double, imgCount int, edge boolean").select("*", *[(F.col("x") + k).alias(n) for k, n in enumerate(names)])
    out = features.field_table(px, F.col("edge"), F.col("x"))
    assert len([c for c in out.columns if c.startswith("b_")]) == 29 and len([c for c in out.columns if c.startswith("i_")]) == 64
    got = {r.field_id: r for r in out.collect()}
    assert set(got) == {"u", "v"}  # a field of border pixels only has no row
    r, k = got["u"], {n: i for i, n in enumerate(names)}
    border, inner = [0.0, 3.0, 6.0], [1.0, 2.0, 4.0, 5.0, 7.0]
    assert (r.b_Pixcount, r.imgcount_avg, r.FieldSize) == (3, 9, 3.5)
    assert r.b_nir_drop_avg == pytest.approx(sum(border) / 3 + k["nirDrop1"]) and r.i_blue_max == pytest.approx(sorted(inner)[2] + k["blueMax"])
    assert r.i_blue_spike_90 == pytest.approx(6.2 + k["blueSpike0"], abs=1e-4) and r.i_sr_stdv == pytest.approx(sum(inner) / 5 + k["srStdv"], abs=1e-4)


def test_null_border_stays(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "border int")
    assert rows.without(df, F.col("border")).count() == 2


def test_bbox_touching_counts_once(spark):
    box = "id int, minLat double, maxLat double, minLon double, maxLon double"
    a = spark.createDataFrame([(1, 0.0, 3.0, 0.0, 3.0), (2, 9.0, 9.5, 9.0, 9.5)], box)
    b = spark.createDataFrame([(7, 3.0, 4.0, 3.0, 4.0), (8, -5.0, 5.0, -5.0, 5.0), (9, 4.0, 3.0, 0.0, 1.0)], box)
    assert sorted((r.id, r.b_id) for r in spatial.bbox_overlap(a, b, 1.0).collect()) == [(1, 7), (1, 8)]


def test_boxes_of_any_width_equal_brute_force(spark):
    rng = random.Random(6)
    box = "id int, minLat double, maxLat double, minLon double, maxLon double"

    def boxes(n):
        out = []
        for k in range(n):
            w, h = rng.choice([0.0, 0.01, 0.4, 3.0, 50.0, 4000.0]) * rng.random(), rng.choice([0.01, 0.4, 3.0, 900.0]) * rng.random()
            y, x = rng.uniform(-60, 60), rng.uniform(-60, 60)
            out.append((k, y, y + h, x, x + w))
        return out

    a, b = boxes(70), boxes(70)
    want = {(p[0], q[0]) for p in a for q in b if p[2] >= q[1] and q[2] >= p[1] and p[4] >= q[3] and q[4] >= p[3]}
    odd = [(900, None, 1.0, 0.0, 1.0), (901, 0.0, float("inf"), 0.0, 1.0), (902, 5.0, 4.0, 0.0, 1.0)]
    got = [(r.id, r.b_id) for r in spatial.bbox_overlap(spark.createDataFrame(a + odd, box), spark.createDataFrame(b, box), 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_utm_of_a_known_point(spark):
    e, n = spatial.utm(F.lit(30.0), F.lit(75.0))  # on the central meridian of zone 43
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(500000, abs=1e-3) and r.n == pytest.approx(3318785.35, abs=0.5)


def test_utm_there_and_back(spark):
    df = spark.createDataFrame([(30.25, 76.5), (-33.5, 73.1), (0.0, 75.0)], "lat double, lon double")
    for south, part in ((False, df.where("lat >= 0")), (True, df.where("lat < 0"))):
        e, n = spatial.utm(F.col("lat"), F.col("lon"), south=south)
        lat, lon = spatial.from_utm(F.col("e"), F.col("n"), south=south)
        for r in part.withColumns({"e": e, "n": n}).select("lat", "lon", "n", lat.alias("a"), lon.alias("b")).collect():
            assert r.a == pytest.approx(r.lat, abs=1e-8) and r.b == pytest.approx(r.lon, abs=1e-8) and 0 <= r.n <= 10_000_000


def test_resample_keeps_a_plane(spark):
    df = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(4) for c in range(4)], "r int, c int, v double")
    got = {(x.new_row, x.new_col): x.v for x in spatial.resample(df, [], "r", "c", "v", 2.0).collect()}
    assert got[(3, 3)] == pytest.approx(((3.5 / 2 - 0.5) * 4) + (3.5 / 2 - 0.5), abs=1e-6)


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",AVG_1,AVG_2\n-1.0,5.5,NaN\n1.0,NaN,7\n0.0,1,NaN\n")
    got = sorted(tuple(r) for r in io.read_series(spark, str(tmp_path / "s.csv")).collect())
    assert got == [("1", -1, 5.5), ("1", 0, 1.0), ("2", 1, 7.0)]
    (tmp_path / "m.xml").write_text('<a xmlns:p="u"><p:bottomLeft><p:latitude>1.5</p:latitude><p:longitude>2</p:longitude></p:bottomLeft><p:topRight><p:latitude>3</p:latitude><p:longitude>4</p:longitude></p:topRight><p:cloudCoverPercentage>12.5</p:cloudCoverPercentage></a>')
    m = io.read_metadata(spark, str(tmp_path / "m.xml")).first()
    assert (m.minLat, m.minLon, m.maxLat, m.maxLon, m.cloud_percent) == (1.5, 2, 3, 4, 12.5)
    (tmp_path / "l.txt").write_text("To_remove\n20191129_040301_0f36_\n")
    assert io.read_blacklist(spark, str(tmp_path / "l.txt")).count() == 1
    io.write_csv(spark.createDataFrame([(1, None)], "a int, b double"), str(tmp_path / "o"), ".")
    assert "1,." in "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    io.write_chunks(spark.range(25), [F.col("id")], 10, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("chunk=*")) == ["chunk=1", "chunk=2", "chunk=3"]
    assert io.manifest(spark, str(tmp_path), "*.xml").count() == 1
    wide = io.consolidate(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "a", 1.0)], "k int, p string, v double"), "k", "p", "v")
    assert {r.k: (r.a, r.b) for r in wide.collect()} == {1: (0.5, 0.25), 2: (1.0, None)}


def test_stream_equals_table(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(t(h), "a", float(h)) for h in range(0, 96, 7)], "ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = daily_means(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((str(r.window.start), r.n, r["mean"]) for r in d.collect())
    assert key(spark.table("daily")) == key(daily_means(df))


def two_classes(spark, n=240):
    rng = random.Random(1)
    return spark.createDataFrame([(k, k % 12, k % 2, k % 2 + rng.random() * 0.4, rng.random()) for k in range(n)], "id long, f long, label int, x double, y double")


def test_out_of_bag_and_folds(spark):
    df = two_classes(spark)
    bag = model.out_of_bag(df, ["x", "y"], "id", bags=6, trees=30, depth=5).collect()
    assert 200 < len(bag) <= 240 and sum((r.pred > 0.5) == (r.label == 1) for r in bag) > 0.95 * len(bag)
    quick = {r.kind: r for r in model.quick_accuracy(df.where("id >= 40"), df.where("id < 40"), ["x", "y"], "id", trees=20, depth=5).collect()}
    assert quick["test"].OA == 1.0 and quick["test"].TruePos + quick["test"].TrueNeg == 40 and quick["out of bag"].OA > 0.95
    folds = model.fold_accuracy(df, ["x", "y"], "id", 3, trees=20, depth=5).collect()
    assert sorted(r.HO for r in folds) == [0, 1, 2] and all(r.OA > 0.95 and r.TruePos + r.FalsePos + r.MissedPos + r.TrueNeg == 80 for r in folds)


def test_one_pixel_of_each_field(spark):
    scores, importances = model.single_pixel_forests(two_classes(spark), ["x", "y"], "f", "id", 3, share=0.25, trees=5, depth=3)
    got = scores.collect()
    assert sorted(r.rep for r in got) == [0, 1, 2] and all(r.TruePos + r.FalsePos + r.MissedPos + r.TrueNeg == 3 for r in got)
    assert len(importances) == 3


def test_selection_by_lists():
    worth = {"a1": 1, "a2": 3, "b": 2, "c": 0, "d": -1}
    rate = lambda names: sum(worth[n] for n in names)
    chosen, best = model.select_by_lists(["a1", "d"], rate, switch=[["a1", "a2"]], add=["b", "c"], remove=["d", "b"])
    assert set(chosen) == {"a2", "b", "c"} and best == 5


def test_components_and_regression(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.standard_normal((80, 4)) @ r.standard_normal((4, 4))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, a double, b double, c double, d double")
    fit = model.linear_model(df, ["b", "c", "d"], "a")
    want = np.linalg.lstsq(np.c_[x[:, 1:], np.ones(80)], x[:, 0], rcond=None)[0]
    assert np.allclose([*fit.coefficients, fit.intercept], want, atol=1e-6)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = np.array([v.pc for v in model.principal_components(df, ["a", "b", "c", "d"], 2).orderBy("id").collect()])
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(z @ axes.T), atol=1e-6)


def test_incomplete_rows_are_skipped(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 1.0)], "id int, x double, y double")
    assert [r.id for r in model.assemble(df, ["x", "y"]).collect()] == [1]


def test_forest_separates(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, k % 10, k % 2, k % 2 + rng.random() * 0.4, rng.random()) for k in range(200)], "id long, f long, label int, x double, y double")
    fit = model.fit_forest(df, ["x", "y"], trees=5, depth=3)
    assert model.importances(fit, ["x", "y"])[0][0] == "x"
    s = model.score(fit, df, ["x", "y"])
    assert model.accuracy(s) == 1.0 and model.roc_auc(s) == 1.0
