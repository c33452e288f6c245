"""Random forests and their evaluation on pyspark.ml, with folds that keep fields together."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialised, shared_folder
from . import splits
from .evaluate import confusion
from .rows import hash_rank

#: Fits that run side by side; each is a distributed job of its own.
AT_ONCE = 4
#: Rows of a part of a table that many fits read: fewer parts than cores leave the cores to other fits. And the column of its features.
PART_ROWS, GATHERED = 10_000, "__gathered"


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with all features, as a vector. One condition on an array: a condition for each of a hundred columns would stall the optimizer."""
    if GATHERED in df.columns:
        names = df.schema[GATHERED].metadata["names"]
        cut = VectorSlicer(inputCol=GATHERED, outputCol="features", indices=[names.index(f) for f in features]).transform(df)
        return cut.where(F.forall(vector_to_array("features"), lambda x: ~F.isnan(x))).drop(GATHERED)
    whole = df.withColumn("__values", F.array(*[F.col(c).cast("double") for c in features])).where(F.forall("__values", lambda x: x.isNotNull() & ~F.isnan(x)))
    return whole.withColumn("features", array_to_vector("__values")).drop("__values")


def gathered(df: DataFrame, features: list[str]) -> DataFrame:
    """All rows, their features in one vector of which ``assemble`` takes any part (null as NaN), written once and cached.

    For tables that hundreds of fits read: neither the rows nor the code and the plan of
    a fit are made anew for other features. In parts of about PART_ROWS rows, or those
    it has if they are larger: a fit is a dozen stages, and where these have little to do
    each part costs more than its rows.
    """
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    parts = max(1, -(-df.count() // PART_ROWS))
    packed = df.select(*[c for c in df.columns if c not in features], array_to_vector(values).alias(GATHERED, metadata={"names": features}))
    return materialised(packed.coalesce(parts), "gathered").coalesce(parts).persist()


def fit_vectors(rows: DataFrame, label: str = "label", trees: int = 100, depth: int = 12, seed: int = 8, weight: str | None = None):
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return (rf.setWeightCol(weight) if weight else rf).fit(rows)


def fit_forest(train: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 12, seed: int = 8):
    return fit_vectors(assemble(train, features), label, trees, depth, seed)


def score_vectors(model, rows: DataFrame, out: str = "pred") -> DataFrame:
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def score(model, df: DataFrame, features: list[str], out: str = "pred") -> DataFrame:
    return score_vectors(model, assemble(df, features), out)


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, (float(x) for x in model.featureImportances.toArray())), key=lambda p: -p[1])


def roc_auc(scored: DataFrame, pred: str = "pred", label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=pred, labelCol=label).evaluate(scored.withColumn(pred, F.col(pred).cast("double")))


def cross_validate(df: DataFrame, features: list[str], fold: str, k: int, label: str = "label", trees: int = 100, depth: int = 8, seed: int = 8) -> DataFrame:
    """All rows with the prediction of the model that did not see their fold (null fold: none). Vectors are made once and cached."""
    rows = assemble(df.where(F.col(fold).isNotNull()), features).persist()

    def part(i: int) -> DataFrame:
        model = fit_vectors(rows.where(F.col(fold) != i), label, trees, depth, seed + i)
        return score_vectors(model, rows.where(F.col(fold) == i))

    with ThreadPool(min(k, AT_ONCE)) as pool:
        return reduce(lambda a, b: a.unionByName(b), pool.map(part, range(k)))


def leave_one_out(df: DataFrame, features: list[str], field: str, fields: list, label: str = "label", trees: int = 100, depth: int = 6, seed: int = 8) -> DataFrame:
    """As ``cross_validate``, with each of the given fields held out once.

    One fit for each field is what the method asks for; they share the cached vectors,
    run some at a time, and each writes its scores, so the result's plan does not grow
    with the number of fields.
    """
    rows = assemble(df, features).persist()
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/loocv-{uuid.uuid4().hex}"

    def part(job: tuple[int, object]) -> str:
        n, f = job
        model = fit_vectors(rows.where(F.col(field) != f), label, trees, depth, seed)
        scored = score_vectors(model, rows.where(F.col(field) == f))
        scored.write.parquet(f"{folder}/held={n}")
        return scored.schema.json()

    with ThreadPool(AT_ONCE) as pool:
        pool.map(part, list(enumerate(fields)))
    rows.unpersist()
    return df.sparkSession.read.parquet(folder).drop("held")


def out_of_bag(df: DataFrame, features: list[str], key: str, bags: int = 10, label: str = "label", trees: int = 100, depth: int = 12, seed: int = 8) -> DataFrame:
    """key, label, pred: the mean prediction of the trees that did not see a row.

    The forest is grown in ``bags`` parts. A row's weight in a part is a Poisson number
    with mean one, from the hash of its key (the bootstrap of large tables), and rows of
    weight zero, about a third, are scored by it.
    """
    rows = assemble(df, features).persist()
    steps = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815]  # Poisson(1), cumulative

    def part(b: int) -> DataFrame:
        u = hash_rank(F.col(key), 1000 * seed + b) / 2.0**32
        weight = reduce(lambda c, k: F.when(u < steps[k], float(k)).otherwise(c), range(len(steps) - 1, -1, -1), F.lit(float(len(steps))))
        weighed = rows.withColumn("weight", weight)
        model = fit_vectors(weighed.where("weight > 0"), label, max(1, trees // bags), depth, seed + b, "weight")
        return score_vectors(model, weighed.where("weight = 0")).select(key, label, "pred")

    with ThreadPool(AT_ONCE) as pool:
        parts = pool.map(part, range(bags))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(key, label).agg(F.avg("pred").alias("pred"))


def quick_accuracy(train: DataFrame, test: DataFrame, features: list[str], key: str, label: str = "label", trees: int = 100, depth: int = 12, seed: int = 8) -> DataFrame:
    """kind (test, out of bag), the confusion counts and OA: of a forest on rows that it did not see, and of its bags."""
    tested = confusion(score(fit_forest(train, features, label, trees, depth, seed), test, features), "pred", label)
    bagged = confusion(out_of_bag(train, features, key, label=label, trees=trees, depth=depth, seed=seed), "pred", label)
    return tested.withColumn("kind", F.lit("test")).unionByName(bagged.withColumn("kind", F.lit("out of bag")))


def fold_accuracy(df: DataFrame, features: list[str], key: str, k: int = 3, label: str = "label", trees: int = 100, depth: int = 12, seed: int = 8) -> DataFrame:
    """HO and the confusion counts with OA of each of k folds of rows, stratified by label."""
    folds = splits.folds_stratified(df, key, label, k, seed)
    return confusion(cross_validate(folds, features, "HO", k, label, trees, depth, seed), "pred", label, by=["HO"])


def single_pixel_forests(df: DataFrame, features: list[str], field: str, key: str, reps: int, share: float = 0.1, label: str = "label", trees: int = 100, depth: int = 12, seed: int = 8) -> tuple[DataFrame, list[list[tuple[str, float]]]]:
    """(confusion counts and OA by rep, importances by rep) of forests that see one pixel of each field, another one each time."""
    rows = assemble(df, features).persist()

    def part(i: int) -> tuple[DataFrame, list[tuple[str, float]]]:
        drawn = splits.test_share(splits.one_per_group(rows, field, key, seed + i), key, share, seed + i)
        model = fit_vectors(drawn.where("NOT test"), label, trees, depth, seed + i)
        return confusion(score_vectors(model, drawn.where("test")), "pred", label).withColumn("rep", F.lit(i)), importances(model, features)

    with ThreadPool(min(reps, AT_ONCE)) as pool:
        parts = pool.map(part, range(reps))
    return reduce(lambda a, b: a.unionByName(b), [s for s, _ in parts]), [m for _, m in parts]


def accuracy(scored: DataFrame, label: str = "label") -> float:
    return confusion(scored, "pred", label).first()["OA"] or 0.0


def select_features(df: DataFrame, pool: list[str], rate: Callable[[list[str]], float], start: list[str] | None = None, most: int = 30) -> tuple[list[str], float]:
    """Forward selection with removal: add the best variable while the rating grows, then drop those it does not need."""
    chosen, best = list(start or []), rate(start) if start else 0.0
    with ThreadPool(AT_ONCE) as side:
        while len(chosen) < most:
            left = [f for f in pool if f not in chosen]
            tried = []
            for k in range(0, len(left), AT_ONCE):
                some = left[k : k + AT_ONCE]
                tried += zip(side.map(lambda f: rate([*chosen, f]), some), some)  # noqa: B023
                # what fits have sent to executors goes only when the driver collects its garbage
                if df is not None:
                    df.sparkSession._jvm.System.gc()
            if not tried or max(tried)[0] < best or (chosen and max(tried)[0] == best):
                break
            best, f = max(tried)
            chosen.append(f)
    for f in list(chosen):
        rest = [g for g in chosen if g != f]
        if rest and (r := rate(rest)) >= best:
            chosen, best = rest, r
    return chosen, best


def select_by_lists(base: list[str], rate: Callable[[list[str]], float], switch: list[list[str]] | None = None, add: list[str] | None = None, remove: list[str] | None = None) -> tuple[list[str], float]:
    """Variables and their rating after three steps: of each group in ``switch`` only the best form stays, variables of ``add``
    join and variables of ``remove`` leave where the rating does not fall."""
    chosen = list(base)
    best = rate(chosen)
    for forms in switch or []:
        rest = [v for v in chosen if v not in forms]
        best, form = max(((rate([*rest, v]), v) for v in forms), key=lambda x: x[0])
        chosen = [*rest, form]
    for v in add or []:
        if v not in chosen and (r := rate([*chosen, v])) >= best:
            chosen, best = [*chosen, v], r
    for v in remove or []:
        rest = [c for c in chosen if c != v]
        if v in chosen and rest and (r := rate(rest)) >= best:
            chosen, best = rest, r
    return chosen, best


def principal_components(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """Adds pc: the scores of the first k components of centred and scaled features."""
    rows = assemble(df, features)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    return PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled).withColumn("pc", vector_to_array("pc")).drop("features", "scaled")


def linear_model(df: DataFrame, features: list[str], target: str):
    return LinearRegression(featuresCol="features", labelCol=target).fit(assemble(df, features))
