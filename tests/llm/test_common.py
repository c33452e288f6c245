import random

from pyspark.sql import functions as F

from terrane.llm.common import Workspace, connected_components, salted_row_number, scratch


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(1000, 1060)]  # a chain in the order of the ids
    edges += [(5000, 5000 + k) for k in range(1, 50)]  # a star
    edges += [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]  # loops and repeats among them
    edges += [(33093, 41455), (41455, 12631)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(Workspace(spark, "t"), df).collect()}
    assert got == {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_nothing(spark):
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_row_number(spark):
    rows = [(k % 3 if k % 7 else None, k) for k in range(500)] + [(1, 5), (1, 5)]
    df = spark.createDataFrame(rows, "g int, v long")
    out = salted_row_number(df, ["g"], [F.col("v")], F.xxhash64("v"), "rank", 16).collect()
    for g in {r[0] for r in rows}:
        assert sorted(r.rank for r in out if r.g == g) == list(range(sum(1 for x in rows if x[0] == g)))


def test_scratch_is_deleted(spark):
    import os

    keep = Workspace(spark, "keep")
    with scratch(spark):
        gone = Workspace(spark, "gone")
        kept = keep.save(gone.save(spark.range(5), "x"), "y")
    assert kept.count() == 5 and not os.path.exists(gone.root.removeprefix("file://")) and os.path.exists(keep.root.removeprefix("file://"))
