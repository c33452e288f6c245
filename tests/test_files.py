"""Images and shapes: round trips, and files put together by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import cli
from terrane.sources import io, raster, shapes


def by_hand(cells, order="<", tile=None, compression=1, planar=1, predictor=1, nodata=None):
    """A file of tiles or one strip, put together field by field."""
    h, w, n = cells.shape
    th, tw = tile or (h, w)
    grid = [(r, c) for r in range(0, h, th) for c in range(0, w, tw)]
    blocks = []
    for b in [None] if planar == 1 else range(n):
        for r, c in grid:
            part = np.zeros((th, tw, n if planar == 1 else 1), cells.dtype)
            src = cells[r : r + th, c : c + tw] if planar == 1 else cells[r : r + th, c : c + tw, b : b + 1]
            part[: src.shape[0], : src.shape[1]] = src
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1)
            raw = part.astype(cells.dtype.newbyteorder(order)).tobytes()
            blocks.append(zlib.compress(raw) if compression == 8 else raw)
    places = np.cumsum([8] + [len(x) for x in blocks]).tolist()
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    fields = [(256, "I", [w]), (257, "I", [h]), (258, "H", [cells.dtype.itemsize * 8] * n), (259, "H", [compression]), (277, "H", [n]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [kind] * n), (33550, "d", [3.0, 3.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0])]
    fields += [(322, "I", [tw]), (323, "I", [th]), (324, "I", places[:-1]), (325, "I", [len(x) for x in blocks])] if tile else [(273, "I", places[:-1]), (278, "I", [h]), (279, "I", [len(x) for x in blocks])]
    if nodata is not None:
        fields.append((42113, "s", [nodata]))
    fields.sort()
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    start, table, extra = places[-1], struct.pack(order + "H", len(fields)), b""
    for tag, letter, values in fields:
        body = values[0] if letter == "s" else struct.pack(order + letter * len(values), *values)
        count = len(body) if letter == "s" else len(values)
        if len(body) > 4:
            extra, body = extra + body, struct.pack(order + "I", start + 6 + 12 * len(fields) + len(extra))
        table += struct.pack(order + "HHI", tag, code[letter], count) + body.ljust(4, b"\0")
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, start) + b"".join(blocks) + table + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("options", [{}, {"order": ">"}, {"tile": (16, 16), "compression": 8}, {"planar": 2, "compression": 8, "predictor": 2}, {"order": ">", "tile": (16, 32), "planar": 2}])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "float32"])
def test_layouts(options, dtype):
    if dtype == "float32" and options.get("predictor") == 2:
        pytest.skip("whole numbers only")
    cells = (np.random.default_rng(1).random((37, 41, 3)) * 200).astype(dtype)
    tiff = raster.GeoTiff(by_hand(cells, **options))
    got = np.zeros_like(cells)
    for r, c, part in tiff.blocks():
        got[r : r + part.shape[0], c : c + part.shape[1]] = part
    assert (got == cells).all() and (tiff.x0, tiff.y0, tiff.dx, tiff.dy) == (500.0, 900.0, 3.0, -3.0)


def lzw(raw):
    """Codes of the format, from its description."""
    table, out, held, bits, size, word = {bytes([k]): k for k in range(256)}, bytearray(), 0, 0, 9, b""
    nxt = 258

    def put(code):
        nonlocal held, bits
        held, bits = held << size | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    put(256)
    for k in raw:
        if word + bytes([k]) in table:
            word += bytes([k])
            continue
        put(table[word])
        table[word + bytes([k])] = nxt
        nxt += 1
        size = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        if nxt == 4094:
            put(256)
            table, nxt, size = {bytes([j]): j for j in range(256)}, 258, 9
        word = bytes([k])
    put(table[word])
    nxt += 1
    size = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def test_compressions():
    rng = np.random.default_rng(2)
    for n in (1, 300, 5000, 60000):
        raw = bytes(rng.integers(0, 7, n, np.uint8))
        assert raster.unpack_lzw(lzw(raw)) == raw
    assert raster.unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == bytes([1, 2, 3, 9, 9, 9, 5])
    with pytest.raises(ValueError):
        raster.GeoTiff(b"no image at all")


def test_images_as_tables(spark, tmp_path):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 4000, (70, 50, 4)).astype("uint16")
    cells[5, 7] = 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "12_20191101_3B.tif").write_bytes(by_hand(cells, nodata=b"0\0"))
    (tmp_path / "in" / "notes.txt").write_text("x")
    bands = ["blue", "green", "red", "nir"]
    df = raster.read_geotiff(spark, str(tmp_path / "in"), bands)
    assert df.count() == 3500
    r = df.where("row = 5 AND col = 7").first()
    assert (r.x, r.y, r.blue, r.nir) == (522.5, 883.5, None, None)
    done = raster.write_geotiff(df.withColumn("image", F.lit("out.tif")), f"file://{tmp_path}/out", "image", bands, 500.0, 900.0, 3.0, -3.0).collect()
    assert [tuple(x) for x in done] == [("out.tif", 70, 50)]
    back = raster.GeoTiff((tmp_path / "out" / "out.tif").read_bytes())
    assert (np.concatenate([p for _, _, p in back.blocks()]) == cells).all()
    assert (back.epsg, back.nodata, back.x0, back.dy) == (32643, 0.0, 500.0, -3.0)
    again = raster.read_geotiff(spark, str(tmp_path / "out"), bands).drop("file_name")
    assert again.exceptAll(df.drop("file_name")).count() == 0
    with pytest.raises(Exception, match="bands"):
        raster.read_geotiff(spark, str(tmp_path / "in"), ["only"]).count()
    cli.main(["read_images", "--images", str(tmp_path / "in"), "--bands", ",".join(bands), "--out", str(tmp_path / "cells.parquet")])
    assert spark.read.parquet(str(tmp_path / "cells.parquet")).count() == 3500


def shapefile(rings_of):
    body = b""
    for k, rings in enumerate(rings_of):
        if rings is None:
            rec = struct.pack("<I", 0)
        else:
            xy = [p for r in rings for p in r]
            begins = np.cumsum([0] + [len(r) for r in rings])[:-1].tolist()
            xs, ys = [p[0] for p in xy], [p[1] for p in xy]
            rec = struct.pack("<I4dII", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(xy)) + struct.pack(f"<{len(rings)}I", *begins) + b"".join(struct.pack("<2d", *p) for p in xy)
        body += struct.pack(">II", k + 1, len(rec) // 2) + rec
    return struct.pack(">I5xI", 9994, 0)[:24].ljust(24, b"\0") + struct.pack(">I", (100 + len(body)) // 2) + struct.pack("<II", 1000, 5) + b"\0" * 64 + body


def dbf(names, rows):
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 for n in names)
    head = struct.pack("<BBBBIHH", 3, 120, 1, 1, len(rows), 33 + len(fields), 1 + 10 * len(names)) + b"\0" * 20 + fields + b"\r"
    return head + b"".join(b" " + b"".join((v or "").encode().ljust(10) for v in r) for r in rows) + b"\x1a"


def test_shapes_as_tables(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # clockwise
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    far = [(x + 10, y) for x, y in square]
    (tmp_path / "f.shp").write_bytes(shapefile([[square, hole], [square, far], None]))
    (tmp_path / "f.dbf").write_bytes(dbf(["unique_id", "village"], [("0012", "u"), ("0013", None), ("0014", "w")]))
    got = {r.record: r for r in shapes.read_shapefile(spark, str(tmp_path)).collect()}
    assert got[1].wkt == "POLYGON ((0.0 0.0, 0.0 4.0, 4.0 4.0, 4.0 0.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 2.0, 1.0 1.0))"
    assert got[2].wkt.startswith("MULTIPOLYGON (((0.0 0.0") and (got[2].minX, got[2].maxX) == (0.0, 14.0)
    assert got[3].wkt is None and got[3].attributes["unique_id"] == "0014"
    assert got[1].attributes == {"unique_id": "0012", "village": "u"} and got[2].attributes["village"] is None and got[1].stem == "f"


def test_series_of_any_number_of_fields(spark, tmp_path):
    long = spark.range(10_500).selectExpr("CAST(id AS STRING) AS field_id", "CAST(id % 3 - 1 AS INT) AS rel_day", "IF(id % 7 = 0, NULL, id / 3) AS value")
    io.write_series(long, str(tmp_path / "s"))
    got = {r.field_id: (r.rel_day, r.value) for r in io.read_series(spark, str(tmp_path / "s")).collect()}
    assert got == {str(k): (k % 3 - 1, k / 3) for k in range(10_500) if k % 7}
    files = list((tmp_path / "s").glob("part-*"))
    assert len(files) == 11 and all([x.split(",")[0] for x in f.read_text().splitlines()] == ["rel_day", "-1", "0", "1"] for f in files)
    odd = spark.createDataFrame([('a,"b', 2, 1.5), ("c", -1, None), ("c", 3, 1e-9)], "field_id string, rel_day int, value double")
    io.write_series(odd, str(tmp_path / "t"))
    [f] = (tmp_path / "t").glob("part-*")
    assert f.read_text().splitlines() == ['rel_day,"AVG_a,""b",AVG_c', "-1,NaN,NaN", "2,1.5,NaN", "3,NaN,1.0E-9"]
    assert sorted(map(tuple, io.read_series(spark, str(tmp_path / "t")).collect())) == [('a,"b', 2, 1.5), ("c", 3, 1e-9)]
    io.write_series(odd.where("false"), str(tmp_path / "u"))
    assert io.read_series(spark, str(tmp_path / "u")).count() == 0
