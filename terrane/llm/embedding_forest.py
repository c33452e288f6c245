"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits a label's vectors again and again by a random direction at a median;
of some directions the one that tears least apart counts. Vectors closer to the split
than the spill go to both sides. The spill follows from how far two linked vectors can
lie apart: at 20 levels a pair at the threshold is torn in one tree with a probability
of about 0.09, in all three with 0.001, and closer pairs hardly ever.

The top of each tree is fitted on the driver, on a bounded sample of all vectors.
Leaves that hold too many vectors are split further, each by a subtree fitted on a
sample of its own vectors, in rounds, until they are small or no direction splits them
(vectors that lie together closer than the spill). So the depth grows with the data,
and the number of comparisons for a vector does not.

Within leaves all pairs are compared exactly, as products of blocks of bounded size; a
pair that meets in several leaves counts in the first one that both visit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components

BLOCK = 2048
#: Levels of a subtree, directions tried for each split, vectors below which a sample says nothing about a split.
LEVELS, TRIES, FEW = 10, 3, 32
#: Share of a node's vectors that may go to both sides.
TORN = 0.4
#: Vectors on which the subtree of one leaf is fitted.
FIT = 1024


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spill_of(cosine: float, dim: int) -> float:
    """Three quarters of the deviation of the distance, along a random direction, of two vectors at the threshold."""
    return 1.5 * math.sqrt(2 - 2 * cosine) / math.sqrt(dim) / 2


def directions(seed: int, dim: int) -> np.ndarray:
    way = np.random.default_rng(seed & (2**63 - 1)).standard_normal((dim, LEVELS * TRIES))
    return way / np.linalg.norm(way, axis=0, keepdims=True)


def fit(sample: np.ndarray, expected: float, spill: float, leaf: int, seed: int) -> dict[int, tuple[int, float]]:
    """{node: (direction, cut)} of a subtree; node 1 is its root, 2n and 2n + 1 are the children of n."""
    cuts: dict[int, tuple[int, float]] = {}
    if len(sample) < FEW or expected <= leaf:
        return cuts
    p = sample @ directions(seed, sample.shape[1])
    share = expected / len(sample)
    at = [(1, np.arange(len(sample)))]
    for level in range(LEVELS):
        nxt = []
        for node, rows in at:
            if len(rows) < FEW or len(rows) * share <= leaf:
                continue
            v = p[rows, level * TRIES : (level + 1) * TRIES]
            cut = np.median(v, axis=0)
            torn = (np.abs(v - cut) <= spill).mean(0)
            k = int(torn.argmin())
            if torn[k] > TORN:
                continue
            cuts[node] = (level * TRIES + k, float(cut[k]))
            nxt += [(2 * node, rows[v[:, k] <= cut[k] + spill]), (2 * node + 1, rows[v[:, k] >= cut[k] - spill])]
        at = nxt
    return cuts


def route(x: np.ndarray, cuts: dict[int, tuple[int, float]], spill: float, seed: int) -> list[list[int]]:
    """The leaves (node numbers) of each unit vector in a subtree."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    p = x @ directions(seed, x.shape[1]) if cuts else None
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node not in cuts:
            for i in rows.tolist():
                out[i].append(node)
        elif len(rows):
            k, cut = cuts[node]
            v = p[rows, k]
            todo += [(2 * node, rows[v <= cut + spill]), (2 * node + 1, rows[v >= cut - spill])]
    return out


def named(*parts) -> int:
    """A 64-bit name of a leaf."""
    from xxhash import xxh3_64_intdigest

    return int(np.array(xxh3_64_intdigest(repr(parts).encode()), np.uint64).view(np.int64))


def packed(cuts: dict[int, tuple[int, float]]) -> bytes:
    return np.array([(n, k, c) for n, (k, c) in cuts.items()], "i8,i8,f8").tobytes()


def unpacked(raw: bytes) -> dict[int, tuple[int, float]]:
    return {int(n): (int(k), float(c)) for n, k, c in np.frombuffer(raw, "i8,i8,f8")}


def compare(rows: DataFrame, cosine: float) -> DataFrame:
    """For groups of (leaf, i, j): links counted by vector (other null), and edges that join what is linked."""

    none = pd.DataFrame({"digest": [], "vec_id": [], "other": [], "links": []})

    def block(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        leaf = g["leaf"].iloc[0]
        a = g[g["own"] == i]
        b = a if i == j else g[g["own"] == j]
        if not len(a) or not len(b):
            return none
        raw = [np.array([np.asarray(v, np.float64) for v in s["embedding"]]) for s in (a, b)]
        norms = [np.sqrt((r * r).sum(1)) for r in raw]
        near = (raw[0] @ raw[1].T) / norms[0][:, None] / norms[1][None, :] >= cosine
        if i == j:
            near = np.triu(near, 1)
        p, q = np.nonzero(near)
        if not len(p):
            return none
        width = max(max(map(len, a["leaves"])), max(map(len, b["leaves"])))
        pad = lambda s: np.array([[*v, *[v[-1]] * (width - len(v))] for v in s["leaves"]])
        la, lb = pad(a), pad(b)
        ids_a, ids_b = a["vec_id"].to_numpy(np.int64), b["vec_id"].to_numpy(np.int64)
        wa, wb = a["weight"].to_numpy(np.int64), b["weight"].to_numpy(np.int64)
        # joined by a breadth-first walk over the link matrix
        n_a = len(a)
        m = n_a if i == j else n_a + len(b)
        whole = np.zeros((m, m), bool)
        if i == j:
            whole |= near | near.T
        else:
            whole[:n_a, n_a:] = near
            whole[n_a:, :n_a] = near.T
        names = ids_a if i == j else np.concatenate([ids_a, ids_b])
        keys = list(a["digest"]) if i == j else [*a["digest"], *b["digest"]]
        left, edges = np.ones(m, bool), []
        for s in np.flatnonzero(whole.any(1)):
            if not left[s]:
                continue
            front, left[s], seen = np.array([s]), False, []
            while len(front):
                front = np.flatnonzero(whole[front].any(0) & left)
                left[front] = False
                seen.append(front)
            edges += [(names[s], names[k]) for part in seen for k in part]
        counts = np.zeros(m, np.int64)
        shift = 0 if i == j else n_a
        step = max(1, 4_000_000 // width**2)
        for lo in range(0, len(p), step):
            x, y = p[lo : lo + step], q[lo : lo + step]
            # leaves ascend: the first of a's that b visits too
            both = (la[x][:, :, None] == lb[y][:, None, :]).any(2)
            first = la[x][np.arange(len(x)), both.argmax(1)] == leaf
            np.add.at(counts, x[first], wb[y[first]])
            np.add.at(counts, y[first] + shift, wa[x[first]])
        got = np.flatnonzero(counts)
        return pd.DataFrame({
            "digest": [*[keys[k] for k in got], *[None] * len(edges)],
            "vec_id": pd.array([*[None] * len(got), *[e[0] for e in edges]], "Int64"),
            "other": pd.array([*[None] * len(got), *[e[1] for e in edges]], "Int64"),
            "links": [*counts[got], *[0] * len(edges)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            for key, g in pdf.groupby(["leaf", "i", "j"], sort=False):
                if key != last and held:
                    yield block(pd.concat(held))
                    held = []
                last = key
                held.append(g)
        if held:
            yield block(pd.concat(held))

    return rows.mapInPandas(run, "digest binary, vec_id long, other long, links long")


def grown(ws: Workspace, placed: DataFrame, vectors: DataFrame, spill_at: float, leaf: int) -> DataFrame:
    """``placed`` (digest, leaf) with leaves of more than 2 * ``leaf`` vectors split by subtrees of their own, round by round."""
    closed = None
    while True:
        sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf)
        over = ws.save(sizes if closed is None else sizes.join(closed, "leaf", "left_anti"), "oversize")
        if over.isEmpty():
            return placed
        big = placed.join(over, "leaf").join(vectors.select("digest", "embedding"), "digest")
        # about FIT vectors of each leaf, whatever it holds
        drawn = big.where(F.pmod(F.xxhash64("digest", "leaf"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * FIT / F.col("n"))

        def subtree(g: pd.DataFrame) -> pd.DataFrame:
            x = unit(list(g["embedding"]))
            name = int(g["leaf"].iloc[0])
            cuts = fit(x, float(g["n"].iloc[0]), spill_at / math.sqrt(x.shape[1]), leaf, name)
            return pd.DataFrame({"leaf": [name], "cuts": [packed(cuts)]})

        cuts = ws.save(drawn.select("leaf", "n", "embedding").groupBy("leaf").applyInPandas(subtree, "leaf long, cuts binary"), "cuts")
        able = cuts.where(F.octet_length("cuts") > 0)

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, g in pdf.groupby("leaf"):
                    x = unit(list(g["embedding"]))
                    to = route(x, unpacked(g["cuts"].iloc[0]), spill_at / math.sqrt(x.shape[1]), int(name))
                    yield pd.DataFrame({"digest": [d for d, t in zip(g["digest"], to) for _ in t], "leaf": [named(int(name), n) for t in to for n in t]})

        split = big.join(able, "leaf").select("digest", "leaf", "embedding", "cuts").mapInPandas(send, "digest binary, leaf long")
        placed = ws.save(placed.join(able.select("leaf"), "leaf", "left_anti").select("digest", "leaf").unionByName(split), "placed")
        shut = over.select("leaf").join(able.select("leaf"), "leaf", "left_anti")
        closed = ws.save(shut if closed is None else closed.unionByName(shut), "closed")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, trees: int = 3, leaf: int = 1024, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Links vectors of equal, non-null labels and equal length whose cosine, in double
    precision, is at least ``cosine``. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; neither do rows with a null vec_id,
    whose component is null and which are kept. Equal vectors are compared once, and
    count as links of each other. Rows that repeat a vec_id count as rows, each with
    the links of its own vector, and are one node: they have one component. Other
    columns are ignored, whatever their names; an empty table gives an empty one.

    The tops of the trees are fitted on at most ``sample`` vectors, those of the least
    hashes; every vector is indexed.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "forest")
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & (square > 0)
    text = F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("embedding").cast("array<string>"), ","))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(usable, F.unhex(F.md5(text))).alias("digest"), F.col("embedding"))
    classes = ws.save(
        rows.where("digest IS NOT NULL").groupBy("digest").agg(
            F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"), F.concat_ws("/", F.first("label"), F.first(F.size("embedding")).cast("string")).alias("space")
        ),
        "classes",
    )
    total = classes.count()
    drawn = classes.select("space", "embedding").orderBy(F.xxhash64("digest"), "digest").limit(sample).toPandas()
    spill_at = spill_of(cosine, 1)
    tops: dict[str, list[tuple[int, dict]]] = {}
    for s, g in drawn.groupby("space"):
        x = unit(list(g["embedding"]))
        seeds = [named(seed, s, t) for t in range(trees)]
        tops[s] = [(n, fit(x, total * len(g) / len(drawn), spill_at / math.sqrt(x.shape[1]), leaf, n)) for n in seeds]
        if not any(cuts for _, cuts in tops[s]):
            tops[s] = tops[s][:1]  # one leaf: the other trees would compare the same pairs

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, g in pdf.groupby("space"):
                x = unit(list(g["embedding"]))
                for name, cuts in tops.get(s, [(named(seed, s, t), {}) for t in range(trees)]):
                    to = route(x, cuts, spill_at / math.sqrt(x.shape[1]), name)
                    yield pd.DataFrame({"digest": [d for d, t in zip(g["digest"], to) for _ in t], "leaf": [named(name, n) for t in to for n in t]})

    placed = ws.save(classes.select("digest", "space", "embedding").mapInPandas(visit, "digest binary, leaf long"), "placed")
    placed = grown(ws, placed, classes, spill_at, leaf)
    held = ws.save(placed.groupBy("digest").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), "leaves")
    spread = held.select("digest", "leaves", F.explode("leaves").alias("leaf"))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cells = spread.join(sizes, "leaf").withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    cells = cells.select("digest", "leaves", "leaf", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.select("digest", "leaves", "leaf", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    loaded = cells.join(classes.select("digest", "vec_id", "weight", "embedding"), "digest").repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    found = ws.save(compare(loaded, cosine), "links")
    # ids that stand for several vectors tie their classes together
    known = rows.where("digest IS NOT NULL").select("vec_id", "digest")
    several = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo < hi").select("vec_id")
    several = ws.save(several, "several")
    tied = known.join(several, "vec_id").select(F.col("vec_id").alias("a"), "digest").join(classes.select("digest", F.col("vec_id").alias("b")), "digest").where("a <> b").select("a", "b")
    edges = found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    components = connected_components(ws, edges.unionByName(tied)).withColumnRenamed("node", "vec_id")
    links = found.where("other IS NULL").groupBy("digest").agg(F.sum("links").alias("links"))
    of = classes.select("digest", "vec_id", "weight").join(links, "digest", "left").join(components, "vec_id", "left")
    of = of.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("of_vector"))
    out = rows.select("vec_id", "digest").join(of, "digest", "left")
    component = F.coalesce("of_vector", "vec_id")
    if not several.isEmpty():
        out = out.join(several.join(components, "vec_id").select("vec_id", F.col("component").alias("of_id")), "vec_id", "left")
        component = F.coalesce("of_id", "of_vector", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
