"""Best-fit packing: a configuration LP over the length histogram, rounded to sequences.

Lengths fall into at most ``capacity`` classes, so the histogram is all that the
driver needs, whatever the number of documents:

1. a configuration is a multiset of lengths that fits a sequence; the covering LP
   asks for the fewest configurations that hold all pieces of all lengths. It is
   solved by multiplicative weights: a knapsack dynamic program prices the best
   configuration under the current weights, the configuration is taken up to its
   bottleneck, and the weights of the lengths that it covers shrink. The weights
   start at the volume prices (a length's share of the capacity), which are an
   optimal dual wherever sequences can be filled, and they change so little that a
   fuller configuration always wins;
2. the amounts are rounded down;
3. the pieces that this leaves are less than one sequence for each configuration of
   the LP; they are packed by the same knapsack, a whole number of sequences a time.

The plan is a list of (lengths, how many sequences). Its size depends on the number
of length classes. Every piece then finds its sequence from its rank among the
pieces of its length, by binary search: no piece is gathered anywhere.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, salted_row_number
from .token_counts import byte_letters

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin, Greek, Cyrillic, punctuation, kana, unified Han and Hangul.
UNUSUAL = re.compile("[^\x00-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u045f\u2010-\u2027\u2030-\u203a\u20ac\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]").search
#: Most values that the first number of an order may have.
ORDERED = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- planning on the histogram ------------------------------------------------


def best_configuration(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming over the capacity, any number of copies: {place in ``lengths``: copies}."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        got = value[c - lengths[:k]] + worth[:k]
        best = int(got.argmax())
        if got[best] > value[c - 1]:
            value[c], took[c] = got[best], best
        else:
            value[c] = value[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        k = int(took[c])
        if k < 0:
            c -= 1
        else:
            out[k] = out.get(k, 0) + 1
            c -= int(lengths[k])
    return out


def exact_cover(counts: np.ndarray, capacity: int, price: np.ndarray, epsilon: float, longest: bool) -> list[tuple[dict[int, int], float]]:
    """One pass: the best configuration under the weights, up to its bottleneck, until every length is covered.

    longest: the longest length left, which is the hardest to place, weighs most; each
    configuration then holds it.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    left = need.copy()
    # among equal prices long pieces go first: short ones fill gaps later on
    worth = price[lengths] * (1 + epsilon * lengths / capacity)
    out = []
    while len(lengths):
        if longest:
            rest = capacity - int(lengths[-1])
            found = best_configuration(lengths, worth, rest) if rest >= lengths[0] else {}
            found[len(lengths) - 1] = found.get(len(lengths) - 1, 0) + 1
        else:
            found = best_configuration(lengths, worth, capacity)
        at = np.fromiter(found, np.int64, len(found))
        copies = np.fromiter(found.values(), float, len(found))
        step = float((left[at] / copies).min())
        out.append(({int(lengths[k]): n for k, n in found.items()}, step))
        left[at] -= step * copies
        worth[at] *= np.exp(-epsilon * step * copies / need[at])
        stays = left > 1e-7 * need
        lengths, need, left, worth = lengths[stays], need[stays], left[stays], worth[stays]
    return out


def configuration_lp(counts: np.ndarray, capacity: int, epsilon: float = 2e-5, near: float = 5e-4, passes: int = 5) -> list[tuple[dict[int, int], float]]:
    """[({length: copies}, amount)]: amounts that cover every length exactly, by multiplicative weights.

    A pass covers every length once. Where it ends more than ``near`` over the volume
    bound, another follows, which no longer puts the longest first, and then the prices of lengths that were held in sequences with room left grow by
    that room's share from pass to pass; the best of ``passes`` counts.
    """
    if not counts.any():
        return []
    price = np.arange(len(counts)) / capacity
    least = float(counts @ price)
    best: list = []
    value = float("inf")
    for k in range(passes):
        got = exact_cover(counts, capacity, price, epsilon, k == 0)
        total = sum(x for _, x in got)
        if total < value:
            best, value = got, total
        if value <= least * (1 + near):
            break
        if k == 0:
            continue
        room = np.zeros(len(counts))
        for config, x in got:
            held = sum(k * n for k, n in config.items())
            for k, n in config.items():
                room[k] += x * n * (capacity - held) / held
        price = price * (1 + room / np.maximum(counts, 1))
    return best


def best_fill(room: int, counts: np.ndarray, lengths: list[int]) -> list[int]:
    """Lengths, as many as ``counts`` has, whose sum comes closest to ``room`` from below; long ones first."""
    reach, trail, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(int(counts[length]), room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            trail.append((length, reach))
            reach = grown
            if reach & full:
                break
        if reach & full:
            break
    at, out = reach.bit_length() - 1, []
    for length, was in reversed(trail):
        if at and not was >> at & 1:
            out.append(length)
            at -= length
    return out


def rounded(lp: list[tuple[dict[int, int], float]], counts: np.ndarray, capacity: int) -> tuple[list[tuple[list[int], int]], int]:
    """Whole sequences from a fractional cover, rounded down, then of what is left; and how many are from the cover."""
    left = counts.copy()
    out: list[tuple[list[int], int]] = []
    for config, amount in lp:
        times = min([int(amount + 1e-6), *(int(left[k]) // n for k, n in config.items())])
        if times:
            out.append(([k for k, n in config.items() for _ in range(n)], times))
            for k, n in config.items():
                left[k] -= times * n
    whole = sum(n for _, n in out)
    lengths = [int(k) for k in np.flatnonzero(left)[::-1]]
    while lengths:
        top = lengths[0]
        left[top] -= 1
        base = [top, *best_fill(capacity - top, left, [k for k in lengths if left[k]])]
        left[top] += 1
        times = min(int(left[k]) // base.count(k) for k in set(base))
        for k in base:
            left[k] -= times
        out.append((base, times))
        lengths = [k for k in lengths if left[k]]
    return out, whole


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, number of sequences) that hold ``counts[length]`` pieces of each length exactly."""
    counts = counts.astype(np.int64).copy()
    full = int(counts[capacity])
    counts[capacity] = 0
    plan = [([capacity], full)] if full else []
    return plan + rounded(configuration_lp(counts, capacity), counts, capacity)[0]


# ---- Spark ---------------------------------------------------------------------


class PieceEncoder:
    """Token ids of whole texts as the library gives them.

    The vocabulary also runs as byte ranks in a faster encoder with the same word
    pattern. Texts with a special token's string, or with signs outside blocks that
    every Unicode version classifies alike, go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        vocab, back = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(made) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("ids must follow the merges, over byte-level words")
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if UNUSUAL(text) or "<|" in text and any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    """The encoder of a worker process: loaded by its first task, used by all."""
    return PieceEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False, order: tuple[Column, Column] | None = None) -> DataFrame:
    schema = PIECES + (", ids binary" if keep_ids else "") + (", major long, minor long" if order else "")
    ordered = bool(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        to = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())][: 5 + keep_ids] + [("major", pa.int64()), ("minor", pa.int64())] * ordered)
        for b in batches:
            rows = []
            for doc, text, *at in zip(*[c.to_pylist() for c in b.columns]):
                ids = np.append(encoder.ids(text or ""), end_id).astype("<u4").tobytes()
                n = len(ids) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * lo : 4 * hi]
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(part)) + ((part,) if keep_ids else ()) + tuple(at))
            columns = list(zip(*rows)) or [()] * len(to)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to)], schema=to)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.cast("long").alias(n) for c, n in zip(order or (), ("major", "minor"))))
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, order: tuple[Column, Column] | None = None) -> DataFrame:
    """Packs every document into as few sequences of at most ``capacity`` tokens as the plan finds.

    docs: doc_id, text (null text: empty; null and repeated ids stay rows of their
    own; other columns are ignored). A document is its token ids and ``end_id``; only
    longer ones are cut, into full pieces after a first that may be shorter. Returns
    doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in
    each sequence), and with keep_ids the ids as little-endian bytes. An empty table
    gives an empty one; very long texts are cut like others. Ids are never read as
    numbers. Pieces of equal length are told apart by rank; ties in it are repeated
    rows. Sent to the driver: one row per length.

    order: two whole numbers, none null, by which documents are in order, the first from
    0 to ORDERED - 1 and with no more rows to a value than a task can sort. Sequences are then
    numbered from 0 in the order of their earliest pieces, and of pieces of equal length
    earlier ones go to the plan's earlier sequences. Which lengths share a sequence stays the plan's.
    """
    ws = Workspace(docs.sparkSession, "pack")
    pieces = ws.save(token_pieces(docs, tokenizer, capacity, end_id, keep_ids, order), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    # intervals of ranks by length: first rank, first sequence, offset
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, n in plan_sequences(counts, capacity):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    table = {k: np.array(v, np.int64).T.copy() for k, v in slots.items()}

    if order:
        ranked = salted_row_number(pieces, ["length"], [F.col(c) for c in ("minor", "piece", "doc_id", "ids_crc32")], F.col("major"), "rank", ORDERED)
    else:
        ranked = salted_row_number(pieces, ["length"], [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")], F.xxhash64("doc_id", "piece", "ids_crc32"), "rank")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n, rows in length.groupby(length).indices.items():
            first, start, at = table[int(n)]
            r = rank.to_numpy()[rows]
            k = np.searchsorted(first, r, "right") - 1
            seq[rows], off[rows] = start[k] + r - first[k], at[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.withColumn("__p", place("length", "rank"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = ["ids"] if keep_ids else []
    if not order:
        return placed.select(*own, F.col("__p.sequence_id").alias("sequence_id"), F.col("__p.offset").alias("offset"), *end)
    placed = ws.save(placed.select(*own, "major", "minor", F.col("__p.sequence_id").alias("planned"), F.col("__p.offset").alias("offset"), *end), "placed")
    first = placed.groupBy("planned").agg(F.min(F.struct("major", "minor", "piece")).alias("f")).select("planned", "f.*")
    numbered = salted_row_number(first, [], [F.col(c) for c in ("minor", "piece", "planned")], F.col("major"), "sequence_id", ORDERED).select("planned", "sequence_id")
    return placed.join(numbered, "planned").select(*own, "sequence_id", "offset", *end)
