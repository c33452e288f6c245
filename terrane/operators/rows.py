"""Row selection, keys and reshaping shared by the pipelines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import materialised


def without(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag is not 1; a null flag stays."""
    return df.where(~flag.eqNullSafe(F.lit(1)))


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the order of ``df``; unknown names are ignored."""
    names = set(wanted)
    return df.select(*[c for c in df.columns if c in names])


def keep_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def before_month_day(date: Column, cutoff: int = 1216) -> Column:
    """Month and day, as MMDD, lie before the cutoff."""
    return F.month(date) * 100 + F.day(date) < cutoff


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in a stated order. An aggregation, so a key with most of the rows is reduced where they lie."""
    row = F.struct(*[F.col(c) for c in df.columns])
    at = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(row, at).alias("__row")).select("__row.*")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "rec") -> DataFrame:
    """Rank within the keys, from 0."""
    return df.withColumn(out, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def hash_rank(key: Column, seed: int) -> Column:
    """(key * m + seed * 40503) modulo 2 ** 32, m = 2654435761 * (2 * seed + 1): the same in any engine, another order for
    another seed. In halves, so that no key overflows."""
    m = 2654435761 * (2 * seed + 1) % 2**32
    k = F.pmod(key.cast("long"), F.lit(1 << 32))
    low, high = k % 65536, F.shiftright(k, 16)
    return (low * m + (high * m % 65536) * 65536 + seed * 40503) % 4294967296


def without_blank_groups(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """Drops groups (images, and what shares their id) whose largest value is 0."""
    keyed = df.withColumn("__group", group)
    blank = keyed.groupBy("__group").agg(F.max(value).alias("__most")).where("__most = 0").select("__group")
    return keyed.join(blank, "__group", "left_anti").drop("__group")


def without_listed(df: DataFrame, name: Column, blacklist: DataFrame, start: int, length: int) -> DataFrame:
    """Drops rows whose name has a listed id at a fixed place: a hash join, not a search of each name for each id."""
    ids = blacklist.select(F.substring(blacklist.columns[0], 1, length).alias("__id")).distinct()
    return df.withColumn("__id", F.substring(name, start, length)).join(ids, "__id", "left_anti").drop("__id")


def only_listed(df: DataFrame, name: Column, keep: DataFrame, start: int, length: int) -> DataFrame:
    """Keeps rows whose name shares its id, at a fixed place, with one of the names in ``keep``."""
    ids = keep.select(F.substring(keep.columns[0], start, length).alias("__id")).distinct()
    return df.withColumn("__id", F.substring(name, start, length)).join(ids, "__id", "left_semi").drop("__id")


def mask_unknown(df: DataFrame, known: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose keys are not among ``known`` (pixels without coordinates) stay, with null values, as a later selection of complete rows expects."""
    there = known.select(*keys).distinct().withColumn("__there", F.lit(True))
    return df.join(there, keys, "left").withColumns({v: F.when(F.col("__there"), F.col(v)) for v in values}).drop("__there")


def mean_of_columns(columns: list[str]) -> Column:
    """Row-wise mean of the columns that are not null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.try_divide(total, n)


def file_parts(name: Column) -> dict[str, Column]:
    """field id and date of file names like <field>_<yyyymmdd>_<rest>.tif."""
    rest = F.split_part(name, F.lit("_"), F.lit(2))
    return {"field_id": F.split_part(name, F.lit("_"), F.lit(1)), "obs_date": F.to_date(F.substring(rest, 1, 8), "yyyyMMdd"), "stem": F.regexp_replace(name, r"\.tif$", "")}


def row_id(df: DataFrame, order: list[Column], out: str = "OID") -> DataFrame:
    """Adds the 0-based place of each row in the whole table's order.

    Sorted ranges of rows are written once with their places, so that the sizes that
    shift them are those of the very ranges that were numbered, and no task holds all rows.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialised(ordered.withColumns({"__part": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()}), "ranges")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each range, whatever the number of rows
    before = sizes.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    local = F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(F.broadcast(before), "__part").withColumn(out, (local + F.col("__base")).cast("long")).drop("__part", "__pos", "__base")


def chunk_number(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Fixed-size chunks of an ordered table, from 1: every row stays, and all chunks but the last hold ``size`` rows."""
    return row_id(df, order, "__place").withColumn("chunk", (F.floor(F.col("__place") / size) + 1).cast("long")).drop("__place")


def outer_reduce(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of tables that each have ``key``, once, and columns of their own: one shuffle for all of them.

    A key that a table repeats is an error, as a join would multiply its rows. Rows with a
    null key match nothing and stay rows of their own.
    """
    every = {c: t for f in frames for c, t in f.dtypes if c != key}
    wide = lambda f: [F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in every.items()]
    tall = reduce(lambda a, b: a.unionByName(b), [f.select(key, F.lit(k).alias("__from"), *wide(f)) for k, f in enumerate(frames)])
    once = [F.count_if(F.col("__from") == k) <= 1 for k in range(len(frames))]
    joined = tall.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in every], reduce(lambda a, b: a & b, once).alias("__once"))
    sound = F.when(F.col("__once"), F.col(key)).otherwise(F.raise_error(F.lit(f"a table repeats a {key}")).cast(dict(frames[0].dtypes)[key]))
    return joined.select(sound.alias(key), *every).unionByName(tall.where(F.col(key).isNull()).select(key, *every))
