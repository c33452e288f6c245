"""Models on the embeddings as pixel features: forests, folds, components, regression."""

from pyspark.sql import functions as F

from ..operators import model as M
from ..operators import splits, workflows
from ..sources.adapters import table
from .registry import query

#: Every component of a vector is a feature.
FEATURES = [f"f{k}" for k in range(64)]
TREES = 100


def pixels(spark, d):
    """pixel_id, field_id, label and 64 features; a field's pixels stay together in every split."""
    e = table(spark, d, "embeddings")
    cols = [F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)]
    wide = e.select(F.col("vec_id").alias("pixel_id"), (F.col("vec_id") % 50).alias("field_id"), (F.col("label") % 2).alias("label"), *cols)
    # cached, as every fit reads it; the cache also keeps 64 aliases of one array out of the optimizer's constraints
    return wide.persist()


def split(spark, d):
    px = pixels(spark, d)
    return splits.separate(px, splits.holdout_fields(px, "field_id", 0.2, 8), "field_id")


@query(None)
def rf_holdout(spark, d):
    train, held = split(spark, d)
    return M.score(M.fit_forest(train, FEATURES, trees=TREES, depth=8), held, FEATURES).select("pixel_id", "field_id", "label", F.round("pred", 6).alias("pred"))


@query(None)
def rf_importance(spark, d):
    train, _ = split(spark, d)
    rows = M.importances(M.fit_forest(train, FEATURES, trees=TREES, depth=8), FEATURES)
    return spark.createDataFrame(rows, "feature string, importance double")


@query(None)
def rf_kfold(spark, d):
    px = pixels(spark, d)
    folds = splits.folds_chunked(px.select("field_id").distinct(), "field_id", 3, 8)
    return M.cross_validate(px.join(folds, "field_id"), FEATURES, "HO", 3, trees=TREES, depth=6).select("pixel_id", "field_id", "HO", F.round("pred", 6).alias("pred"))


@query(None)
def loocv(spark, d):
    px = pixels(spark, d)
    fields = [x.field_id for x in px.select("field_id").distinct().orderBy("field_id").collect()]
    return M.leave_one_out(px, FEATURES, "field_id", fields, trees=20, depth=5).select("pixel_id", "field_id", F.round("pred", 6).alias("pred"))


@query(None)
def rf_confusion(spark, d):
    from ..operators.evaluate import confusion

    train, held = split(spark, d)
    return confusion(M.score(M.fit_forest(train, FEATURES, trees=TREES, depth=8), held, FEATURES))


@query(None)
def rf_quick(spark, d):
    """Accuracy on 1 % of the rows, held out by hash, and out of bag."""
    px = splits.test_share(pixels(spark, d), "pixel_id", 0.01, 6888)
    return M.quick_accuracy(px.where("NOT test"), px.where("test"), FEATURES, "pixel_id", trees=TREES, depth=8)


@query(None)
def rf_cv3(spark, d):
    return M.fold_accuracy(pixels(spark, d), FEATURES, "pixel_id", 3, trees=TREES, depth=8)


@query(None)
def rf_single_pixels(spark, d):
    return M.single_pixel_forests(pixels(spark, d), FEATURES, "field_id", "pixel_id", 5, trees=TREES, depth=6)[0]


@query(None)
def select_variables(spark, d):
    """Forms of a variable compete, further ones join and others leave, each rated by repeated hold-outs."""
    px = pixels(spark, d).persist()
    rate = lambda names: workflows.mean_accuracy(px, names, 2, trees=10, depth=5)
    half = len(FEATURES) // 2
    chosen, best = M.select_by_lists(FEATURES[:half], rate, switch=[FEATURES[:3]], add=FEATURES[half : half + 4], remove=FEATURES[half - 4 : half])
    return spark.createDataFrame([(n, best) for n in chosen], "feature string, accuracy double")


@query(None)
def forward_select(spark, d):
    train, held = (M.gathered(x, FEATURES) for x in split(spark, d))
    rate = lambda names: M.accuracy(M.score(M.fit_forest(train, names, trees=5, depth=4), held, names))
    chosen, best = M.select_features(train, FEATURES, rate, most=len(FEATURES))
    train.unpersist()
    held.unpersist()
    return spark.createDataFrame([(n, best) for n in chosen], "feature string, accuracy double")


@query(None)
def pca(spark, d):
    out = M.principal_components(pixels(spark, d), FEATURES, 3)
    return out.select("pixel_id", *[F.round(F.col("pc")[k], 6).alias(f"pc{k}") for k in range(3)])


@query(None)
def linear_model(spark, d):
    fit = M.linear_model(pixels(spark, d), FEATURES[1:], "f0")
    return spark.createDataFrame([(n, float(c)) for n, c in zip(FEATURES[1:], fit.coefficients)] + [("(intercept)", float(fit.intercept))], "feature string, coefficient double")
