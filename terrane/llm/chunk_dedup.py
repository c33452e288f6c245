"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash of the last 32 bytes decides on each byte whether a chunk ends there, so
a cut depends on nothing further away: an insertion moves the bytes behind it and
leaves their chunks as they are. Cuts closer than ``gap`` to the one before are
dropped. Where no cut falls for ``long`` bytes (periodic texts, such as one word again
and again), words start chunks of 64 bytes. Chunks are variable, without a largest
size.

A chunk of some words proves little: common phrases fill it. What is looked up is
therefore the block of whole chunks from each chunk on until it holds ``window``
words, by a 64-bit digest of its bytes. Which chunks a block has follows from its
content alone. A block that an earlier document has is repeated, whichever document
that is; overlapping repeated blocks are one passage. So phrases that other documents
hold do not break a passage up, and a passage of one document may repeat parts of
several earlier ones.

A digest that a third of all documents share is one row per task after the map side,
and the rows that look it up can be dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

BLOCKS = "doc_id long, row long, digest long, start int, stop int, before int, after int"
TO_BLOCKS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Blocks that a task holds at a time.
ROWS = 200_000


class Gear:
    def __init__(self, mean: int = 24, gap: int = 8, long: int = 128, seed: int = 11):
        self.table = np.random.default_rng(seed).integers(0, 2**32, 256, np.uint64).astype(np.uint32)
        self.below = np.uint32(2**32 // mean)
        self.gap, self.long = gap, long

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Ends of the chunks of the bytes ``data``, the last one its length."""
        n = len(data)
        if not n:
            return np.empty(0, np.int64)
        h = self.table[data]
        for k in (1, 2, 4, 8, 16):  # twice the window each time: h[i] + (h[i - k] << k)
            if n > k:
                h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        ends = np.flatnonzero(h < self.below) + 1
        ends = ends[np.diff(ends, prepend=-self.gap) >= self.gap]
        ends = ends if len(ends) and ends[-1] == n else np.append(ends, n)
        begins = np.concatenate([[0], ends[:-1]])
        for a, b in zip(begins[ends - begins > self.long].tolist(), ends[ends - begins > self.long].tolist()):
            ends = np.append(ends, self.word_starts(data[a:b]) + a)
        return np.unique(ends)

    @staticmethod
    def word_starts(data: np.ndarray) -> np.ndarray:
        """Places at which words start, at least 64 bytes apart."""
        blank = SPACES[data]
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        out, last = [], 0
        for s in starts.tolist():
            if s - last >= 64:
                out.append(s)
                last = s
        return np.array(out, np.int64)

    def blocks(self, raw: bytes, window: int) -> tuple[np.ndarray, ...]:
        """start, stop, words before the start and before the stop of each block of ``window`` words at least."""
        data = np.frombuffer(raw, np.uint8)
        stop = self.cuts(data)
        start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        blank = SPACES[data]
        words = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))]) if len(data) else np.zeros(1, np.int64)
        last = np.searchsorted(words[stop], words[start] + window)
        ok = last < len(stop)
        start, stop = start[ok], stop[last[ok]]
        return start, stop, words[start], words[stop]


def block_rows(docs: DataFrame, gear: Gear, window: int) -> DataFrame:
    """doc_id, row (the text's digest), digest, start, stop, before, after of all blocks of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        names = [c.split(" ")[0] for c in BLOCKS.split(", ")]
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, kind in zip(zip(*held), TO_BLOCKS)], names)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = text.encode()
                start, stop, before, after = gear.blocks(raw, window)
                n = len(start)
                if not n:
                    continue
                digests = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in zip(start.tolist(), stop.tolist())), np.uint64, n)
                row = np.full(n, xxh3_64_intdigest(raw), np.uint64).view(np.int64)
                held.append((np.full(n, doc, np.int64), row, digests.view(np.int64), start, stop, before, after))
                size += n
                if size > ROWS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, BLOCKS)


def repeated_passages(docs: DataFrame, least: int = 30, window: int = 15, mean: int = 24, gap: int = 8, seed: int = 11) -> DataFrame:
    """doc_id, first_doc_id, start_byte, end_byte, n_blocks, n_words: passages that earlier documents have.

    Documents (doc_id, text) are ordered by doc_id; a passage is a stretch of
    overlapping blocks of ``window`` words or more, each of which a document of a
    smaller id holds too, of ``least`` words together; first_doc_id is the smallest of
    the documents that first hold one of its blocks. Ends lie on chunk cuts, so up to
    some words at either end of a repeat are left out. Repeats within a document only,
    null ids, and null, empty or short texts give no rows. Rows that repeat a doc_id
    count as one document: equal texts give their passages once, another text under
    the id has passages of its own. Other columns are ignored, whatever their names; an
    empty table gives an empty one. Bytes are of the UTF-8 text; words start at a sign
    that follows white space. Equality is that of 64-bit digests; two or more must
    collide in a row to invent a passage.
    """
    ws = Workspace(docs.sparkSession, "chunks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    blocks = ws.save(block_rows(texts, Gear(mean, gap, seed=seed), window), "blocks")
    firsts = blocks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    # a table of its own, so that the join deals both sides anew and the rows of a common digest can be split
    firsts = ws.save(firsts, "firsts")
    again = blocks.join(firsts.hint("merge"), "digest").where("first_doc_id < doc_id").drop("digest").distinct()
    # a text is a row's digest: other texts of the document lie apart
    by = W.partitionBy("doc_id", "row").orderBy("start")
    reach = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = again.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    spans = runs.groupBy("doc_id", "row", "run").agg(
        F.min("first_doc_id").alias("first_doc_id"), F.min("start").cast("long").alias("start_byte"), F.max("stop").cast("long").alias("end_byte"),
        F.count(F.lit(1)).alias("n_blocks"), (F.max("after") - F.min("before")).cast("long").alias("n_words"),
    )
    return spans.where(F.col("n_words") >= least).select("doc_id", "first_doc_id", "start_byte", "end_byte", "n_blocks", "n_words")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, others of any name) with the passages cut out of their texts; documents stay, blank ones too.

    Passages of a document are gathered per document only; they may overlap. Bytes that
    a passage splits off a sign stay with the text. Rows without passages, null and
    empty texts and null ids stay as they are; rows that repeat an id lose the passages
    of all its texts, so ids with several texts should be told apart before. An empty
    table of either kind is fine.
    """
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("spans")).select(F.col("doc_id").alias("id"), "spans")
    text = F.col("row.text").cast("string")
    raw = text.cast("binary")
    # what lies between passages, joined again; a passage inside another one adds nothing
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept"))

    def step(s, x):
        more = F.when(x["start_byte"] > s["at"], F.substring(raw, s["at"].cast("int") + 1, (x["start_byte"] - s["at"]).cast("int"))).otherwise(F.lit(b""))
        return F.struct(F.greatest(s["at"], x["end_byte"]).alias("at"), F.concat(s["kept"], more).alias("kept"))

    left = F.aggregate("spans", empty, step, lambda s: F.concat(s["kept"], F.substring(raw, s["at"].cast("int") + 1, F.octet_length(text))))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id")).join(spans, "id", "left")
    new = F.when(F.col("spans").isNotNull() & text.isNotNull(), F.make_valid_utf8(left.cast("string"))).otherwise(text)
    return rows.select(*[(new if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
