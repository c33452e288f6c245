"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed once to 64 bits. The top of a hash picks
one of k buckets; what follows is compressed to a register: of the least one in the
bucket, the count of leading zeros and ten mantissa bits, two bytes. Empty registers
borrow from the first filled bucket in a random order of their own, which keeps the
chance that two sets agree in a register at their Jaccard index, whatever their
sizes. Bands of registers are the keys of candidate buckets. A candidate pair's
Jaccard index is estimated from the registers that are equal and not borrowed,
corrected for those that collide by chance, and what may reach the threshold is
confirmed on the full sets.

Buckets are never expanded into pairs. Equal sets are one node from the start. In a
first round each bucket's members are compared with its smallest one; what this links
becomes a component. In a second round only buckets with several components count,
and there the members outside the largest component are compared with all that meet
the same component, in blocks of bounded size. So each candidate pair is compared
unless its two ends are known to be connected, and components lose no link between
candidates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components

MEMO_WORDS = 400_000
#: Members of a bucket that are compared with one block of others at a time.
BLOCK = 512
MANTISSA = 10
SIGNATURE = "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"
SETS = "doc_id long, digest binary, hashes binary, registers binary"
TO_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
TO_SETS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("hashes", pa.binary()), ("registers", pa.binary())])


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` registers so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Signer:
    """Sets, registers and band keys of texts."""

    def __init__(self, width: int, rows: int, bands: int):
        rng = np.random.default_rng(20240)
        self.width, self.rows, self.bands = width, rows, bands
        self.words = WordHashes()
        self.factors = rng.integers(1, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
        k = self.k = rows * bands
        # where the k buckets begin, and the order in which an empty one asks the others
        self.floors = np.array([-(-(b << 64) // k) for b in range(k)], np.uint64)
        self.order = np.argsort(rng.random((k, k)), 1).argsort(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the word shingles; A-Z count as a-z, words end at ASCII white space."""
        if not isinstance(text, str):
            return np.empty(0, np.uint64)
        words = text.encode("utf-8", "surrogatepass").lower().split()
        n, w = len(words), self.width
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if n < w:
            out = np.uint64(n)
            for k in range(n):
                out = mix64((h[k : k + 1] + out) * self.factors[k])[0]
            return np.array([out], np.uint64)
        acc = h[: n - w + 1] * self.factors[0]
        for k in range(1, w):
            part = h[k : n - w + 1 + k]
            acc = acc + ((part << np.uint64(k)) | (part >> np.uint64(64 - k))) * self.factors[k]
        return np.unique(mix64(acc))

    def registers(self, values: np.ndarray) -> np.ndarray:
        """The register of each bucket, of sorted hashes; 0 where it is empty."""
        at = np.searchsorted(values, self.floors)
        filled = np.flatnonzero(at < np.append(at[1:], len(values)))
        # a hash is bucket / k and a rest: the rest, as a fraction of 2**64
        rest = values[at[filled]] * np.uint64(self.k)
        fraction, exponent = np.frexp(((rest >> np.uint64(11)) | np.uint64(1)).astype(np.float64))
        mantissa = ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64)
        out = np.zeros(self.k, np.uint16)
        out[filled] = 1 + ((53 - exponent) << MANTISSA | mantissa)
        return out

    def densified(self, registers: np.ndarray) -> np.ndarray:
        """Empty registers borrow from the first filled bucket in their order."""
        filled, empty = np.flatnonzero(registers), np.flatnonzero(registers == 0)
        if len(empty):
            registers = registers.copy()
            registers[empty] = registers[filled[self.order[np.ix_(empty, filled)].argmin(1)]]
        return registers

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        parts = registers.reshape(len(registers), self.bands, self.rows).astype(np.uint64)
        acc = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(self.rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
        return acc.view(np.int64)


def chance(n: int, m: int, k: int) -> float:
    """Probability that a bucket of k holds equal registers of two sets of n and m elements without common ones."""
    levels = np.arange(0, 54)
    top, low = 2.0**-levels, 2.0 ** -(levels + 1)
    # the least hash of a bucket lies in [low, top) with this probability, evenly over the mantissas but for its slope
    share = lambda x: np.exp(-x / k * low) - np.exp(-x / k * top)
    return float((share(n) * share(m)).sum() / (1 << MANTISSA))


def estimate(x: np.ndarray, y: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard index from the registers of one set and, by row, of others, and from how many buckets it is."""
    equal = ((x == y) & (x > 0)).sum(-1)
    used = np.maximum(((x > 0) | (y > 0)).sum(-1), 1)
    p = len(x) * chance(n, m, len(x)) / used
    return (equal / used - p) / (1 - p), used


def may_reach(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> np.ndarray:
    """Is the estimate within six deviations of the threshold, or above?"""
    t = percent / 100
    got, used = estimate(x, y, n, m)
    return got >= t - 6 * np.sqrt(t * (1 - t) / used)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Roots:
    """Union of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def digest_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, signer: Signer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digests, bands = [], [], []
            for text in b.column("text").to_pylist():
                s = signer.shingles(text)
                size.append(len(s))
                digests.append(digest_of(s) if len(s) else None)
                bands.append(signer.densified(signer.registers(s)) if len(s) else None)
            full = [i for i, r in enumerate(bands) if r is not None]
            for i, keys in zip(full, signer.band_keys(np.stack([bands[i] for i in full])) if full else []):
                bands[i] = keys
            columns = [b.column("doc_id"), b.column("text_key"), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=TO_SIGNATURE)

    return docs.mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame, signer: Signer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, digest_of(s), s.tobytes(), signer.registers(s).tobytes()) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if len(s := signer.shingles(t))]
            columns = list(zip(*rows)) or [()] * len(TO_SETS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TO_SETS)], schema=TO_SETS)

    return docs.mapInArrow(run, SETS)


def linked_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, b, ha, ra, hb, rb) whose sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (ha, ra, hb, rb) in enumerate(zip(pdf["ha"], pdf["ra"], pdf["hb"], pdf["rb"])):
                n, m = len(ha) // 8, len(hb) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                if not may_reach(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16), n, m, percent):
                    continue
                common = overlap(np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64))
                keep[i] = 100 * common >= percent * (n + m - common)
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) linked across components, for groups of (key, mb, ob): minor rows against other rows."""

    def block(g: pd.DataFrame) -> list[tuple[int, int]]:
        minor, other = g[g["minor"]], g[~g["minor"]]
        if not len(minor) or not len(other):
            return []
        ids = {d: k for k, d in enumerate(dict.fromkeys([*minor["doc_id"], *other["doc_id"]]))}
        comps: dict = {}
        roots = Roots(len(ids))
        for d, c in zip([*minor["doc_id"], *other["doc_id"]], [*minor["comp"], *other["comp"]]):
            roots.union(comps.setdefault(c, ids[d]), ids[d])
        sets = [np.frombuffer(h, np.uint64) for h in other["hashes"]]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        every = np.concatenate(sets)
        regs = np.stack([np.frombuffer(r, np.uint16) for r in other["registers"]])
        names = other["doc_id"].tolist()
        out = []
        for d, h, r in zip(minor["doc_id"], minor["hashes"], minor["registers"]):
            mine = np.frombuffer(h, np.uint64)
            n = len(mine)
            open_ = (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)) & may_reach(np.frombuffer(r, np.uint16), regs, n, n, percent)
            if not open_.any():
                continue
            common = np.zeros(len(sets), np.int64)
            some = np.flatnonzero(open_)
            if len(some) < 0.3 * len(sets):
                common[some] = [overlap(mine, sets[k]) for k in some]
            else:
                at = np.searchsorted(mine, every)
                at[at == n] = 0
                common = np.bincount(owner[mine[at] == every], minlength=len(sets))
            for k in np.flatnonzero(open_ & (100 * common >= percent * (n + sizes - common))):
                if roots.union(ids[d], ids[names[k]]):
                    out.append((d, names[k]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def flush() -> pd.DataFrame:
            got = block(pd.concat(held)) if held else []
            return pd.DataFrame(got, columns=["a", "b"]).astype("int64")

        for pdf in batches:
            for key, g in pdf.groupby(["key", "mb", "ob"], sort=False):
                if key != last and held:
                    yield flush()
                    held = []
                last = key
                held.append(g)
        yield flush()

    return rows.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, rows: int = 5, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Links sets of ``width``-word shingles with 100 * intersection >= percent * union.
    Texts with fewer words are one shingle; null, empty and blank texts have none and
    link with nothing. component_id is the smallest doc_id reachable, kept marks it.
    Rows that repeat a doc_id are one node with the links of them all, so they have one
    component; rows with a null id link with nothing, have a null component and are
    kept. Other columns are ignored, whatever their names; an empty table gives an
    empty one. A pair at the threshold is no candidate with probability ``miss``.
    """
    return labelled(docs, width, percent, rows, miss).select("doc_id", "n_shingles", "component_id", "kept")


def labelled(docs: DataFrame, width: int, percent: int, rows: int, miss: float) -> DataFrame:
    """The rows of ``near_duplicates`` with digest (of the set) and text_key."""
    spark = docs.sparkSession
    ws = Workspace(spark, "neardup")
    signer = Signer(width, rows, bands_for(percent / 100, rows, miss))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = ws.save(signatures(texts.withColumn("text_key", F.xxhash64("text")), signer), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = ws.save(full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("doc_id", F.explode("bands").alias("key"))
    shared = ws.save(banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("key", "lead"), "buckets")
    member = ws.save(banded.join(shared, "key"), "members")

    # what has a partner grows with the corpus, so its ids are never broadcast
    pairs = ws.save(member.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = ws.save(full_sets(texts.join(needed.hint("merge"), "doc_id", "left_semi"), signer).dropDuplicates(["doc_id", "digest"]), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha"), F.col("registers").alias("ra"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"), F.col("registers").alias("rb"))
    # ids that stand for several texts tie the classes of these texts together
    several = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo < hi").select("doc_id")
    several = ws.save(several, "several")
    tied = full.join(several, "doc_id").select(F.col("doc_id").alias("a"), "digest").join(classes.select("digest", F.col("doc_id").alias("b")), "digest").where("a <> b").select("a", "b")
    first = ws.save(linked_pairs(pairs.join(left, "a").join(right, "b"), percent).unionByName(tied).distinct(), "links")
    known = connected_components(ws, first)

    placed = member.select("key", "doc_id").distinct().join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = ws.save(placed.select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp")), "placed")
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    mixed = ws.save(mixed, "mixed")
    # a member travels once for each largest component that it meets, not for each bucket
    met = ws.save(placed.join(mixed, "key").select("major", "doc_id", "comp").distinct(), "met")
    sizes = met.groupBy("major").agg(F.ceil(F.count_if(F.col("comp") != F.col("major")) / BLOCK).cast("int").alias("nm"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("no"))
    rest = met.join(sizes, "major").withColumnRenamed("major", "key")
    spot = F.xxhash64("doc_id")
    minor = rest.where("comp <> key").select("key", "doc_id", "comp", F.lit(True).alias("minor"), F.pmod(spot, "nm").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("ob"))
    other = rest.select("key", "doc_id", "comp", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"), F.pmod(spot, "no").cast("int").alias("ob"))
    blocks = minor.unionByName(other).join(sets.drop("digest"), "doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "key", "mb", "ob").sortWithinPartitions("key", "mb", "ob")
    second = ws.save(compare_blocks(dealt, percent), "more-links")
    final = known if second.isEmpty() else connected_components(ws, first.unionByName(second))

    of = classes.select("digest", "doc_id").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("of_text"))
    of = ws.save(of, "components-of-texts")
    out = sig.select("doc_id", "text_key", "n_shingles", "digest").join(of, "digest", "left")
    if several.isEmpty():
        component = F.coalesce("of_text", "doc_id")
    else:
        of_id = several.join(final.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", F.col("component").alias("of_id"))
        out = out.join(of_id, "doc_id", "left")
        component = F.coalesce("of_id", F.when(F.col("doc_id").isNotNull(), F.col("of_text")), "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "text_key", "n_shingles", "digest", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, others of any name) that stay when one document of each component does.

    That is the one of the smallest doc_id. Where that id stands for several texts, each
    text with a set of its own stays, and of equal sets the text of the least hash; rows
    that repeat it are one row, an arbitrary one if their other columns differ. Texts
    without words link with nothing and stay. Rows with a null id stay as they are. An
    empty table gives an empty one.
    """
    # a table, so that the copies of one text, which the join before deals by their set, can be dealt to several tasks
    kept = Workspace(docs.sparkSession, "kept").save(labelled(docs, width, percent, rows, miss).where("kept AND doc_id IS NOT NULL").select("doc_id", "digest", "text_key"), "kept")
    one = kept.groupBy("doc_id", "digest").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key").distinct()
    rows_ = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    known = rows_.where("doc_id IS NOT NULL").join(one, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return known.unionByName(rows_.where("doc_id IS NULL")).select("row.*")
