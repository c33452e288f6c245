"""Hold-outs, balancing and folds that repeat exactly: ranks by a hash of an id, not by a generator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import first_by, hash_rank

#: Ranges of the hash in which rows are ranked; their sizes give the ranks in the whole.
RANGES = 256


def ranked(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """Adds __rank (from 0, in the order of the key's hash within ``by``) and __total (rows of ``by``).

    Hash ranges are ranked apart and shifted by the sizes of those before, so that a
    stratum with most of the rows, or a table without strata, is not one task's work.
    """
    dealt = df.withColumn("__h", hash_rank(F.col(key), seed)).withColumn("__range", F.floor(F.col("__h") / (2**32 // RANGES)).cast("int"))
    sizes = dealt.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__r"), before.alias("__base"), F.sum("n").over(W.partitionBy(*by)).alias("__total"))
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("__range") == F.col("__r"))
    local = F.row_number().over(W.partitionBy(*by, "__range").orderBy("__h", key)) - 1
    return dealt.join(sizes, same).withColumn("__rank", (local + F.col("__base")).cast("long")).select(*df.columns, "__rank", "__total")


def holdout_fields(fields: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """floor(share * n) of the distinct keys."""
    ids = fields.select(key).where(F.col(key).isNotNull()).distinct()
    return ranked(ids, [], key, seed).where(F.col("__rank") < F.floor(F.col("__total") * share)).select(key)


def separate(df: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(training, hold-out): all rows of a key are on one side."""
    return df.join(held, key, "left_anti"), df.join(held, key, "left_semi")


def test_share(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds test: true for ceil(share * n) rows."""
    return ranked(df, [], key, seed).withColumn("test", F.col("__rank") < F.ceil(F.round(F.col("__total") * share, 9))).drop("__rank", "__total")


def balance(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """As many positives as negatives: the positives of the lowest hash ranks stay, all negatives do."""
    no = df.where(F.col(label) == 0)
    kept = ranked(df.where(F.col(label) == 1), [], key, seed).where(F.col("__rank") < no.count()).drop("__rank", "__total")
    return no.unionByName(kept)


def folds_stratified(df: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    """Adds HO: fold 0 to k - 1, sizes within a stratum differ by one at most; a null stratum gets none."""
    small, more = F.floor(F.col("__total") / k), F.col("__total") % k
    r = F.col("__rank")
    tile = F.when(r < more * (small + 1), F.floor(r / (small + 1))).otherwise(more + F.floor((r - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return ranked(df, [stratum], key, seed).withColumn("HO", F.when(F.col(stratum).isNotNull(), tile).cast("long")).drop("__rank", "__total")


def folds_chunked(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Adds HO by chunks of floor(n / k) + 1 in hash order; the last one is short or empty. ``df`` has a row for each field."""
    return ranked(df, [], key, seed).withColumn("HO", F.floor(F.col("__rank") / (F.floor(F.col("__total") / k) + 1)).cast("long")).drop("__rank", "__total")


def with_fold(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Rows of the fields that have a fold, with it; fields without one leave the table."""
    return df.join(folds.where(F.col("HO").isNotNull()).select(key, "HO"), key)


def one_per_group(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One row of each group by hash rank."""
    return first_by(df, [group], [hash_rank(F.col(key), seed), F.col(key)])
