"""Readers and writers: typed CSV, lists, tab-separated lists, metadata XML, manifests, chunks."""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Iterator
from io import StringIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AOI = "x INT, index INT, unique_id STRING, minLat DOUBLE, maxLat DOUBLE, minLon DOUBLE, maxLon DOUBLE, Set STRING, Treatment STRING"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever reads it, and free of lineage."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_df(spark: SparkSession, x: DataFrame | str, schema: str | None = None) -> DataFrame:
    """A DataFrame as it is, or a path of Parquet or CSV."""
    if isinstance(x, DataFrame):
        return x
    return spark.read.parquet(x) if x.rstrip("/").endswith(".parquet") else read_csv(spark, x, schema)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are strings, so that ids keep their zeros."""
    reader = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
    return (reader.schema(schema) if schema else reader).csv(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, after which aggregates skip it."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One column without a header."""
    return spark.read.schema("value STRING").csv(path).where("value IS NOT NULL")


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path).select("To_remove")


def read_series(spark: SparkSession, path: str, prefix: str = "AVG_") -> DataFrame:
    """Wide series (days by fields, each file with its own fields) as field_id, rel_day, value; the order of a file does not matter.

    Files are read whole and taken apart as text, so they may have any number of columns.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in (row for b in batches for row in zip(b.column(0).to_pylist())):
            lines = csv.reader(StringIO(text, newline=""))
            names = next(lines, [])[1:]
            for day, *values in lines:
                seen = [(n, v) for n, v in zip(names, values) if v not in ("", "NaN")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([n for n, _ in seen], [day] * len(seen), [v for _, v in seen])], ["name", "day", "text"])

    long = spark.read.text(path, wholetext=True).mapInArrow(cells, "name string, day string, text string")
    return long.select(F.regexp_replace("name", f"^{prefix}", "").alias("field_id"), F.col("day").cast("double").cast("int").alias("rel_day"), F.col("text").cast("double").alias("value"))


def write_series(long: DataFrame, path: str, field: str = "field_id", prefix: str = "AVG_", width: int = 1000) -> None:
    """field, rel_day, value as wide series: a column for each field, a row for each day in order, NaN where there is no value.

    One file for up to ``width`` fields; more are dealt to files by a hash of their id,
    about ``width`` to a file, which holds the days that its fields have. A file is one task's text.
    """
    named = long.select(F.concat(F.lit(prefix), F.col(field).cast("string")).alias("name"), F.col("rel_day").cast("string").alias("day"), F.col("value").cast("string").alias("text"))
    held = named.where("name IS NOT NULL AND day IS NOT NULL").groupBy("name").agg(F.collect_list("day").alias("days"), F.collect_list(F.coalesce("text", F.lit("NaN"))).alias("texts"))
    held = materialised(held, "series")
    files = max(1, -(-held.count() // width))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        by_day: dict[int, list[str]] = {}
        for k, (days, texts) in enumerate(zip(rows["days"], rows["texts"])):
            for day, text in zip(days, texts):
                by_day.setdefault(int(day), ["NaN"] * len(rows))[k] = text
        out = StringIO(newline="")
        lines = csv.writer(out, lineterminator="\n")
        lines.writerow(["rel_day", *rows["name"]])
        lines.writerows([day, *by_day[day]] for day in sorted(by_day))
        return pd.DataFrame({"value": [out.getvalue().removesuffix("\n")]})

    texts = held.withColumn("file", F.pmod(F.xxhash64("name"), F.lit(files))).groupBy("file").applyInPandas(one, "value string")
    # a row is a whole file
    texts.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def xml_number(body: Column, tag: str) -> Column:
    """The number in the first element of that local name."""
    return F.xpath_double(body, F.lit(f"(//*[local-name()='{tag}'])[1]"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Footprint and cloud share of image metadata files (whole XML texts)."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")
    corner = lambda c, k: F.xpath_double("value", F.lit(f"(//*[local-name()='{c}']/*[local-name()='{k}'])[1]"))
    return files.select(
        "file_name", corner("bottomLeft", "latitude").alias("minLat"), corner("topRight", "latitude").alias("maxLat"), corner("bottomLeft", "longitude").alias("minLon"),
        corner("topRight", "longitude").alias("maxLon"), xml_number(F.col("value"), "cloudCoverPercentage").alias("cloud_percent"),
    )


def manifest(spark: SparkSession, folder: str, suffix: str = "*", part: str = "") -> DataFrame:
    """File names below a folder, of a pattern and with ``part`` in them, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("_metadata.file_name").alias("file_name"), "length").where(F.contains("file_name", F.lit(part)))


def write_csv(df: DataFrame, path: str, null: str = "NaN") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", null).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.mode("overwrite").text(path)


def write_chunks(df: DataFrame, order: list[Column], size: int, path: str) -> None:
    """Chunks of ``size`` rows in an order, a folder each, numbered from 1."""
    from ..operators.rows import chunk_number

    chunk_number(df, order, size).write.mode("overwrite").option("header", True).partitionBy("chunk").csv(path)


def missing_only(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no output yet: makes a rerun skip finished work."""
    return wanted.join(done.select(key), key, "left_anti")


def consolidate(parts: DataFrame, key: str, part: str, value: str) -> DataFrame:
    """Long results of several runs, one column for each run: the runs are the ``part`` column of a partitioned folder."""
    return parts.groupBy(key).pivot(part).agg(F.first(value))
