"""A training corpus from raw documents: filtered, deduplicated, cleaned, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``, whatever other columns these hold. All stages accept empty tables,
null and empty texts, null and repeated ids and very long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import mixing, near_dup, packing, quality, registry, secrets
from terrane.llm.common import Workspace, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty ones among them; repeated rows are judged alike."""
    return quality.passed(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8): that of the smallest id.

    Null ids and texts without words stay; of rows that repeat an id one stays for each
    text that differs.
    """
    return near_dup.without_duplicates(docs, width=5, percent=80, rows=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are replaced in the texts; the documents stay, in any number of repeats.

    A null text, a null id or a null source is no reason to leave a row out.
    """
    return secrets.redacted(docs, "source", "doc_id")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: files and their rows follow its positions.

    Rows with a null source share the place of the sources without a weight; ties are
    repeated rows, which stand side by side. Packing, which comes after, numbers its
    sequences in this order.
    """
    mixed = mixing.mix(docs, registry.TARGETS, period=100, block=8)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position", "doc_id").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens, numbered in the order of the mixture.

    Lengths decide which pieces fit together; of equal lengths those earlier in the
    mixture come first, and sequences follow their earliest pieces. The mixture is read
    from the order of the files that the stage before wrote and of their rows. A null or empty text is one piece with the end token; long texts are cut; repeated
    rows and null ids are packed like others.
    """
    at = docs.metadataColumn("_metadata")
    part = F.coalesce(F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return packing.pack(docs, registry.tokenizer("byte_bpe_50k.json"), 1024, 2, order=(part, at["row_index"]))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Candidate search and tokenization have no SQL counterpart; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # a stage's own tables are not needed once its result is written
        with scratch(spark):
            docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
