"""GeoTIFF images as tables of cells, and tables of cells as GeoTIFF images.

A small decoder of the format as it is published: either byte order, strips or tiles,
bands together or apart, whole numbers and floats, without compression or with
deflate, LZW or pack-bits, and with horizontal differences. Files are read through
Spark's own reader, block by block, so a task holds one file's bytes and one block of
its cells.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: sizes of field types, and the letters that unpack them.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113


def unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last = list(first), [], b""
    held, bits, size = 0, 0, 9
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & ((1 << size) - 1)
        if code == 257:
            break
        if code == 256:
            table, size, last = list(first), 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


class GeoTiff:
    """The fields of an image's first directory, and its blocks."""

    def __init__(self, raw: bytes):
        self.raw = raw
        order = {b"II": "<", b"MM": ">"}.get(raw[:2])
        if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
            raise ValueError("not a TIFF file, or one over 4 GB")
        self.order = order
        at = struct.unpack_from(order + "I", raw, 4)[0]
        self.tags: dict[int, tuple] = {}
        for k in range(struct.unpack_from(order + "H", raw, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            letters = f"{count}s" if kind == 2 else TYPES[kind] * count
            size = struct.calcsize(order + letters)
            place = at + 10 + 12 * k
            if size > 4:
                place = struct.unpack_from(order + "I", raw, place)[0]
            self.tags[tag] = struct.unpack_from(order + letters, raw, place)
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.compression, self.planar, self.predictor = one(COMPRESSION, 1), one(PLANAR, 1), one(PREDICTOR, 1)
        letter = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1), "u")
        self.dtype = np.dtype(f"{order}{letter}{one(BITS, 8) // 8}")
        if self.predictor == 3 or one(BITS, 8) % 8:
            raise ValueError("differences of floats and parts of bytes are not read")
        text = one(NODATA, b"").rstrip(b"\0 ")
        self.nodata = float(text) if text else None
        scale, tie = self.tags.get(SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIEPOINT, (0.0,) * 6)
        self.dx, self.dy = scale[0], -scale[1]
        self.x0, self.y0 = tie[3] - tie[0] * self.dx, tie[4] - tie[1] * self.dy
        keys = self.tags.get(GEOKEYS, ())
        self.epsg = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (3072, 2048) and keys[k + 1] == 0), None)

    def inflated(self, at: int, size: int) -> bytes:
        part = self.raw[at : at + size]
        if self.compression in (8, 32946):
            return zlib.decompress(part)
        if self.compression == 5:
            return unpack_lzw(part)
        if self.compression == 32773:
            return unpack_bits(part)
        if self.compression != 1:
            raise ValueError(f"compression {self.compression} is not read")
        return part

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, cells by row, column and band) of each strip or tile."""
        if TILES in self.tags:
            high, wide = self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]
            places, sizes = self.tags[TILES], self.tags[TILE_SIZES]
        else:
            high, wide = min(self.tags.get(ROWS, (self.height,))[0], self.height), self.width
            places, sizes = self.tags[STRIPS], self.tags[STRIP_SIZES]
        across = -(-self.width // wide)
        n = across * -(-self.height // high)
        deep = self.bands if self.planar == 1 else 1
        for k in range(n):
            row, col = k // across * high, k % across * wide
            parts = []
            for b in range(1 if self.planar == 1 else self.bands):
                flat = np.frombuffer(self.inflated(places[b * n + k], sizes[b * n + k]), self.dtype)
                tall = len(flat) // (wide * deep) if TILES not in self.tags else high
                cells = flat[: tall * wide * deep].reshape(tall, wide, deep)
                parts.append(np.cumsum(cells, 1, dtype=self.dtype.newbyteorder("=")) if self.predictor == 2 else cells)
            cells = parts[0] if self.planar == 1 else np.concatenate(parts, 2)
            yield row, col, cells[: self.height - row, : self.width - col]


def read_geotiff(spark: SparkSession, path: str, bands: list[str], nodata: float | None = None, pattern: str = "*.tif") -> DataFrame:
    """file_name, row, col, x, y (centres) and the bands, as doubles, of the images below ``path``.

    Cells of the value ``nodata`` (without one: the file's own) and NaN are null. A file
    with another number of bands is an error.
    """
    n = len(bands)
    names = ["file_name", "row", "col", "x", "y", *bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("file_name").to_pylist(), b.column("content")):
                tiff = GeoTiff(raw.as_py())
                if tiff.bands != n:
                    raise ValueError(f"{name} has {tiff.bands} bands, not {n}")
                fill = tiff.nodata if nodata is None else nodata
                for row, col, cells in tiff.blocks():
                    tall, wide = cells.shape[:2]
                    r, c = np.repeat(np.arange(row, row + tall), wide), np.tile(np.arange(col, col + wide), tall)
                    columns = [pa.array([name] * len(r)), pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(tiff.x0 + (c + 0.5) * tiff.dx), pa.array(tiff.y0 + (r + 0.5) * tiff.dy)]
                    for k in range(n):
                        v = cells[:, :, k].ravel().astype(np.float64)
                        columns.append(pa.array(v, mask=np.isnan(v) | (v == fill) if fill is not None else np.isnan(v)))
                    yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    schema = "file_name string, row long, col long, x double, y double, " + ", ".join(f"`{b}` double" for b in bands)
    return files.select(F.col("_metadata.file_name").alias("file_name"), "content").mapInArrow(run, schema)


def encode(cells: np.ndarray, x0: float, y0: float, dx: float, dy: float, epsg: int, nodata: float | None, rows: int = 64) -> bytes:
    """A little-endian file of deflated strips, from cells by row, column and band."""
    height, width, bands = cells.shape
    strips = [zlib.compress(np.ascontiguousarray(cells[k : k + rows]).tobytes()) for k in range(0, height, rows)]
    places = np.cumsum([8] + [len(s) for s in strips])
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    fields = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [cells.dtype.itemsize * 8] * bands), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [1]), (STRIPS, "I", places[:-1].tolist()), (SAMPLES, "H", [bands]),
        (ROWS, "I", [rows]), (STRIP_SIZES, "I", [len(s) for s in strips]), (PLANAR, "H", [1]), (FORMAT, "H", [kind] * bands), (SCALE, "d", [dx, -dy, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, x0, y0, 0.0]),
        (GEOKEYS, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg]),
    ]
    if nodata is not None:
        fields.append((NODATA, "s", [f"{nodata:g}".encode() + b"\0"]))
    start = int(places[-1]) + int(places[-1]) % 2
    beyond = start + 2 + 12 * len(fields) + 4
    table, extra = struct.pack("<H", len(fields)), b""
    code = {v: k for k, v in TYPES.items()}
    for tag, letter, values in fields:
        body = values[0] if letter == "s" else struct.pack("<" + letter * len(values), *values)
        count = len(body) if letter == "s" else len(values)
        if len(body) > 4:
            place, body = struct.pack("<I", beyond + len(extra)), body + b"\0" * (len(body) % 2)
            extra += body
            body = place
        table += struct.pack("<HHI", tag, code[letter], count) + body.ljust(4, b"\0")
    head = b"II" + struct.pack("<HI", 42, start) + b"".join(strips)
    return head.ljust(start, b"\0") + table + struct.pack("<I", 0) + extra


def write_geotiff(df: DataFrame, folder: str, image: str, bands: list[str], x0: float, y0: float, dx: float, dy: float, epsg: int = 32643, nodata: float = 0.0, dtype: str = "uint16") -> DataFrame:
    """Writes a file for each image of ``df`` (image, row, col, bands); one row per file: file_name, height, width.

    Cells that are missing or null hold ``nodata``. An image's cells are one task's work,
    as they become one file. Files appear under their name when they are whole.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        import uuid

        from pyarrow import fs

        height, width = int(g["row"].max()) + 1, int(g["col"].max()) + 1
        cells = np.full((height, width, len(bands)), nodata, np.dtype(dtype).newbyteorder("<"))
        cells[g["row"].to_numpy(int), g["col"].to_numpy(int)] = np.nan_to_num(g[bands].to_numpy(float), nan=nodata)
        name = str(g["__image"].iloc[0])
        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        own = f"{at}/.{name}.{uuid.uuid4().hex}"
        with where.open_output_stream(own) as f:
            f.write(encode(cells, x0, y0, dx, dy, epsg, nodata))
        where.move(own, f"{at}/{name}")
        return pd.DataFrame({"file_name": [name], "height": [height], "width": [width]})

    rows = df.select(F.col(image).alias("__image"), "row", "col", *bands)
    return rows.groupBy("__image").applyInPandas(one, "file_name string, height long, width long")
