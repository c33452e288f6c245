"""What the corpus operators share: the work folder, ranks, and components of a graph."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.io import shared_folder

#: Folders of the workspaces that are open, oldest first.
OPEN: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever Spark can reach it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the workspaces that are opened within, at the end: for steps whose result is written elsewhere by then."""
    n = len(OPEN)
    try:
        yield
    finally:
        while len(OPEN) > n:
            delete(spark, OPEN.pop())


class Workspace:
    """Tables that cut lineage: each is written once to the shared folder and read from there.

    A lost executor costs the tasks it ran; what a finished table holds stays readable.
    Results read from these tables, so they stay until ``scratch`` ends or the folder
    is emptied.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        OPEN.append(self.root)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def salted_row_number(df: DataFrame, keys: list[str], order: list[Column], spread: Column, out: str, buckets: int = 256) -> DataFrame:
    """Adds ``out``: 0-based rank within ``keys``, ordered by (bucket of ``spread``, ``order``).

    A key may hold most of all rows: its rows are ranked within ``buckets`` hash
    buckets, and the ranks are shifted by the sizes of the buckets before. Only the
    sizes (keys x buckets rows) meet in one place. ``spread`` is a 64-bit hash. ``df``
    must not have columns named __bucket, __base, __size, __b2 or __ and a key.
    """
    b, base, size = "__bucket", "__base", "__size"
    dealt = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(size))
    before = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(b).alias("__b2"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(base))
    same = F.col(b) == F.col("__b2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    ranked = dealt.withColumn(out, F.row_number().over(W.partitionBy(*keys, b).orderBy(*order)) - 1)
    joined = ranked.join(bases, same, "left")
    return joined.withColumn(out, (F.col(out) + F.col(base)).cast("long")).drop(b, base, "__b2", *[f"__{k}" for k in keys])


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Local contraction: each node merges into the neighbour of least random priority
    (itself included), edges are rewritten to the survivors, and the rounds repeat
    until no edge is left. Priorities are hashes, so long chains shrink by a factor
    per round. Nothing is collected; every round is a table in the shared folder.
    """
    prio = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    live = ws.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(prio("b")).alias("m"))
        parent = ws.save(best.select(F.col("a").alias("node"), F.least(prio("a"), F.col("m"))["v"].alias("up")), "parents")
        rounds.append(parent)
        p, q = parent.select(F.col("node").alias("a"), F.col("up").alias("pa")), parent.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        moved = live.join(p, "a").select("pa", "b").distinct().join(q, "b").where("pa <> pb")
        live = ws.save(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not rounds:
        return ws.spark.createDataFrame([], "node long, component long")
    root = rounds[-1].select("node", F.col("up").alias("root"))
    for parent in rounds[-2::-1]:
        later = root.select(F.col("node").alias("up"), "root")
        root = parent.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    root = ws.save(root, "roots")
    least = root.groupBy("root").agg(F.min("node").alias("low")).select("root", F.least("low", "root").alias("component"))
    return ws.save(root.join(least, "root").select("node", "component"), "components")
