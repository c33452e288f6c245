"""Shapefiles: rings and attributes of polygons, from the published layout of .shp and .dbf files."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def polygons(raw: bytes) -> list[tuple[int, list[np.ndarray]]]:
    """(record number, rings) of the polygons in a .shp file; other shapes have no rings."""
    if struct.unpack_from(">I", raw)[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 8 <= len(raw):
        number, words = struct.unpack_from(">II", raw, at)
        body = at + 8
        rings = []
        if struct.unpack_from("<I", raw, body)[0] in (5, 15, 25):
            parts, points = struct.unpack_from("<II", raw, body + 36)
            begins = [*struct.unpack_from(f"<{parts}I", raw, body + 44), points]
            xy = np.frombuffer(raw, "<f8", 2 * points, body + 44 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b] for a, b in zip(begins, begins[1:])]
        out.append((number, rings))
        at = body + 2 * words
    return out


def attributes(raw: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """The rows of a .dbf file, as texts; blank fields are null, and deleted rows are empty."""
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding), raw[at + 16]))
        at += 32
    out = []
    for k in range(n):
        row = raw[head + k * size : head + (k + 1) * size]
        place, values = 1, {}
        for name, wide in fields:
            values[name] = row[place : place + wide].decode(encoding, "replace").strip(" \0") or None
            place += wide
        out.append({} if row[:1] == b"*" else values)
    return out


def wkt(rings: list[np.ndarray]) -> str | None:
    """Outer rings run clockwise; each begins a polygon that the holes after it belong to."""
    if not rings:
        return None
    area = lambda r: float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())
    groups: list[list[str]] = []
    for r in rings:
        text = "(" + ", ".join(f"{x!r} {y!r}" for x, y in r.tolist()) + ")"
        if area(r) <= 0 or not groups:
            groups.append([text])
        else:
            groups[-1].append(text)
    bodies = ["(" + ", ".join(g) + ")" for g in groups]
    return f"POLYGON {bodies[0]}" if len(bodies) == 1 else f"MULTIPOLYGON ({', '.join(bodies)})"


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """stem, record, wkt, minX, minY, maxX, maxY and attributes (a map) of the shapefiles below ``path``: .shp and .dbf side by side."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(g["kind"], g["content"]))
        if "shp" not in by:
            return pd.DataFrame(columns=["stem", "record", "wkt", "minX", "minY", "maxX", "maxY", "attributes"])
        shapes = polygons(by["shp"])
        rows = attributes(by["dbf"]) if "dbf" in by else [{}] * len(shapes)
        out = []
        for (number, rings), values in zip(shapes, rows):
            box = [None] * 4
            if rings:
                xy = np.concatenate(rings)
                box = [*xy.min(0).tolist(), *xy.max(0).tolist()]
            out.append((g["stem"].iloc[0], number, wkt(rings), *box, values))
        return pd.DataFrame(out, columns=["stem", "record", "wkt", "minX", "minY", "maxX", "maxY", "attributes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").option("recursiveFileLookup", True).load(path)
    name = F.col("_metadata.file_path")
    parts = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("whole"), F.regexp_extract(name, r"([^/]*)\.[^.]*$", 1).alias("stem"), F.lower(F.regexp_extract(name, r"([^.]*)$", 1)).alias("kind"), "content")
    return parts.groupBy("whole").applyInPandas(one, "stem string, record long, wkt string, minX double, minY double, maxX double, maxY double, attributes map<string, string>")
