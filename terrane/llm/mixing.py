"""Mixing sources to target weights by Pfair scheduling.

A source of weight w is a task whose i-th block may not start before slot
floor((i - 1) / w) and must be placed before slot ceil(i / w). Earliest deadline
first over the released blocks meets every window, so after any t slots a source has
had less than one block more or less than w * t. Weights are whole shares of a
period, and the schedule of one period repeats: planning touches no data.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_row_number

OTHER = "(other)"


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Largest remainders: whole slots of a period; what the weights leave open is for OTHER."""
    if any(not w > 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be positive and add up to 1 at most")
    exact = {s: w * period for s, w in weights.items()}
    exact[OTHER] = max(0.0, period - sum(exact.values()))
    out = {s: int(x + 1e-9) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    if any(out[s] == 0 for s in weights):
        raise ValueError("a weight is less than one slot of the period")
    out[OTHER] = max(out[OTHER], 0)
    return out


def schedule(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period, earliest deadline first."""
    period = sum(shares.values())
    todo = [((i * period) // n, -(-(i + 1) * period // n), s, i) for s, n in shares.items() for i in range(n)]
    todo.sort()
    ready: list[tuple[int, str, int, int]] = []
    out, k = [], 0
    for slot in range(period):
        while k < len(todo) and todo[k][0] <= slot:
            release, deadline, s, i = todo[k]
            heapq.heappush(ready, (deadline, s, i, release))
            k += 1
        deadline, s, i, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        out.append((s, i, slot, release, deadline))
    return out


def mix(docs: DataFrame, weights: dict[str, float], period: int = 100, block: int = 8, seed: str = "mix", source: Column | None = None) -> DataFrame:
    """``docs`` and mix_block, mix_release, mix_deadline, mix_slot, mix_position (all long).

    Each row stays: position orders the mixture, and a source that has run dry leaves
    its slots idle. Blocks are ``block`` rows of a source in the order of a seeded
    digest of doc_id. Sources without a weight, null among them, share what the
    weights leave open; if that is nothing, they follow all others, in their order.
    Rows that repeat an id keep a place each; null ids come in the order of one key.
    Columns of ``docs`` that have these names are replaced; other columns may have any
    names. Null and empty texts count as rows. An empty table gives an empty one. Small
    tables only are broadcast: the schedule, of ``period`` rows.
    """
    shares = whole_shares(weights, period)
    rest = shares[OTHER] == 0
    plan = schedule({s: n for s, n in shares.items() if n})
    names = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position"]
    src = F.col("source").cast("string") if source is None else source
    cls = F.coalesce(F.when(src.isin(list(weights)), src), F.lit(OTHER))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    own = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), F.col("doc_id").alias("id"), cls.alias("cls"), digest.alias("key"))
    spread = F.conv(F.substring("key", 1, 2), 16, 10).cast("long")
    ranked = salted_row_number(rows, ["cls"], [F.col("key"), F.col("id")], spread, "rank")
    form = "array<struct<cls: string, turn: long, slot: long, release: long, deadline: long>>"
    data = json.dumps([dict(zip(("cls", "turn", "slot", "release", "deadline"), p)) for p in plan])
    slots = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(data), form)))
    per = F.create_map(*[F.lit(x) for s, n in shares.items() for x in (s, max(n, 1))])
    ranked = ranked.withColumns({"mix_block": F.floor(F.col("rank") / block).cast("long"), "per": per[F.col("cls")].cast("long")})
    ranked = ranked.withColumns({"round": F.floor(F.col("mix_block") / F.col("per")).cast("long"), "turn": F.col("mix_block") % F.col("per")})
    placed = ranked.join(F.broadcast(slots), ["cls", "turn"], "left")
    start = F.col("round") * period
    late = F.lit(1 << 60) + F.col("mix_block") if rest else F.lit(None).cast("long")
    placed = placed.withColumns({
        "mix_release": start + F.col("release"),
        "mix_deadline": start + F.col("deadline"),
        "mix_slot": F.coalesce(start + F.col("slot"), late),
    }).withColumn("mix_position", F.when(F.col("slot").isNull(), F.lit(1 << 60) + F.col("rank")).otherwise(F.col("mix_slot") * block + F.col("rank") % block))
    return placed.select("row.*", *names)
