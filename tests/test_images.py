"""Image formats, file sinks and stages, on images that the tests encode themselves."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.sources import folder, images, png, xlsx

PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def packed(values, depth):
    """Rows of samples as bytes."""
    if depth == 16:
        return [b"".join(int(v).to_bytes(2, "big") for v in row) for row in values]
    if depth == 8:
        return [bytes(map(int, row)) for row in values]
    out = []
    for row in values:
        bits = "".join(format(int(v), f"0{depth}b") for v in row)
        bits += "0" * (-len(bits) % 8)
        out.append(int(bits, 2).to_bytes(len(bits) // 8, "big"))
    return out


def filtered(rows, step, kinds):
    """PNG filters byte by byte."""
    out, above = b"", None
    for row, kind in zip(rows, kinds):
        above = above or bytes(len(row))
        line = bytearray([kind])
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out += bytes(line)
        above = row
    return out


def png_of(values, depth, colour, interlaced=False, palette=None, seed=0):
    """A PNG of samples (height, width, channels) with every filter."""
    rng = np.random.default_rng(seed)
    h, w, channels = values.shape
    step, raw = max(1, channels * depth // 8), b""
    for y, x, dy, dx in PASSES if interlaced else ((0, 0, 1, 1),):
        part = values[y::dy, x::dx]
        if part.size:
            raw += filtered(packed(part.reshape(len(part), -1), depth), step, rng.integers(0, 5, len(part)).tolist())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced)))
    extra = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    body = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + head + extra + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, ds in {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}.items() for d in ds])
def test_png_forms(colour, depth, interlaced):
    rng = np.random.default_rng(depth)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    for h, w in ((1, 1), (5, 3), (19, 23), (300, 9)):
        values = rng.integers(0, 1 << depth, (h, w, channels))
        palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
        got = png.decode(png_of(values, depth, colour, interlaced, palette))
        if colour == 3:
            expected = palette[values[:, :, 0]]
        else:
            eight = values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))
            expected = eight[:, :, 0] if channels < 3 else eight[:, :, :3]
        assert got.dtype == np.uint8 and (got == expected).all()


def bmp_of(image, depth, top_down=False):
    """image: palette indices (depth up to 8), or height x width x 3."""
    h, w = image.shape[:2]
    palette = bytes(v for k in range(1 << depth) for v in (k * 3 % 256, k * 5 % 256, k * 7 % 256, 0)) if depth <= 8 else b""
    rows = []
    for line in image:
        if depth <= 8:
            row = packed([line], depth)[0]
        elif depth == 16:
            row = b"".join(struct.pack("<H", int(r) >> 3 << 10 | int(g) >> 3 << 5 | int(b) >> 3) for r, g, b in line)
        else:
            row = b"".join(bytes([int(b), int(g), int(r)]) + b"\xff" * (depth == 32) for r, g, b in line)
        rows.append(row + bytes(-len(row) % 4))
    body = b"".join(rows if top_down else rows[::-1])
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, depth, 0, len(body), 0, 0, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 54 + len(palette) + len(body), 0, 0, 54 + len(palette)) + head + palette + body


@pytest.mark.parametrize("top_down", [False, True])
@pytest.mark.parametrize("depth", [1, 4, 8, 16, 24, 32])
def test_bmp_forms(depth, top_down):
    rng = np.random.default_rng(depth)
    if depth <= 8:
        index = rng.integers(0, 1 << depth, (6, 13))
        got = images.decode(bmp_of(index, depth, top_down))
        assert (got == np.stack([index * m % 256 for m in (7, 5, 3)], axis=2)).all()
    else:
        image = rng.integers(0, 256, (6, 13, 3))
        got = images.decode(bmp_of(image, depth, top_down))
        five = image >> 3
        assert (got == (image if depth > 16 else five << 3 | five >> 2)).all()


def tiff_of(values, depth, meaning, order="<", strips=2, planar=1, palette=None):
    h, w, channels = values.shape
    planes = [values[:, :, k : k + 1] for k in range(channels)] if planar == 2 else [values]
    rows = -(-h // strips)
    bodies = []
    for p in planes:
        for y in range(0, h, rows):
            lines = packed(p[y : y + rows].reshape(len(p[y : y + rows]), -1), depth)
            bodies.append(b"".join(np.frombuffer(x, ">u2").astype("<u2").tobytes() if depth == 16 and order == "<" else x for x in lines))
    data, offsets = b"", []
    for b in bodies:
        offsets.append(8 + len(data))
        data += b
    tags = {256: (4, [w]), 257: (3, [h]), 258: (3, [depth] * channels), 259: (3, [1]), 262: (3, [meaning]), 273: (4, offsets), 277: (3, [channels]), 278: (4, [rows]), 279: (4, [len(b) for b in bodies]), 284: (3, [planar])}
    if palette is not None:
        tags[320] = (3, palette)
    at = 8 + len(data)
    entries, extra = b"", b""
    extra_at = at + 2 + 12 * len(tags) + 4
    for tag, (kind, v) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(v)}{'H' if kind == 3 else 'I'}", *v)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place = struct.pack(order + "I", extra_at + len(extra))
            extra += raw
        entries += struct.pack(order + "HHI", tag, kind, len(v)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + data + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("depth", "meaning", "channels", "planar"), [(8, 1, 1, 1), (8, 0, 1, 1), (16, 1, 1, 1), (1, 1, 1, 1), (8, 2, 3, 1), (8, 2, 3, 2), (16, 2, 3, 1), (8, 2, 4, 1), (8, 3, 1, 1)])
def test_tiff_forms(depth, meaning, channels, planar, order):
    rng = np.random.default_rng(depth + meaning)
    values = rng.integers(0, 1 << depth, (7, 10, channels))
    colours = rng.integers(0, 1 << 16, 768).tolist() if meaning == 3 else None
    got = images.decode(tiff_of(values, depth, meaning, order, 3, planar, colours))
    eight = values >> 8 if depth == 16 else values * 255 if depth == 1 else values
    if meaning == 3:
        expected = np.array(colours).reshape(3, 256).T[values[:, :, 0]] >> 8
    elif channels == 1:
        expected = 255 - eight[:, :, 0] if meaning == 0 else eight[:, :, 0]
    else:
        expected = eight[:, :, :3]
    assert (got == expected).all()


@pytest.mark.parametrize("data", [b"", None, b"BM", b"II*\0", b"\xff\xd8\xff\xe0", b"RIFFxxxxWEBP", b"\x89PNG\r\n\x1a\n", png.encode(np.zeros((3, 3), np.uint8))[:-30]])
def test_what_cannot_be_decoded_is_an_error(data):
    with pytest.raises(ValueError):
        images.decode(data)


def test_scan_orders_and_reports(spark, tmp_path):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "b.PNG").write_bytes(png.encode(grey))
    (tmp_path / "a.bmp").write_bytes(bmp_of(np.zeros((2, 2, 3), int) + 7, 24))
    (tmp_path / "c.tiff").write_bytes(tiff_of(grey[:, :, None].astype(int), 8, 1))
    (tmp_path / "d.jpeg").write_bytes(b"\xff\xd8")
    (tmp_path / "e.txt").write_text("no image")
    rows = images.images(images.scan(spark, f"file://{tmp_path}"), ["name"]).collect()
    assert [r["name"] for r in rows] == ["a.bmp", "b.PNG", "c.tiff", "d.jpeg"]
    assert [(r.height, r.width, r.channels) for r in rows[:3]] == [(2, 2, 3), (3, 4, 1), (3, 4, 1)]
    assert rows[1].data == rows[2].data == grey.tobytes() and rows[3].error and rows[3].data is None


def test_a_stage_reports_each_file(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(4):
        (source / f"i{k}.png").write_bytes(png.encode(np.full((2, 3), k, np.uint8)))
    (source / "bad.png").write_bytes(b"no image")

    def change(image):
        if image[0, 0] == 2:
            raise RuntimeError("not this one")
        return image + 1

    got = {r["name"]: r.error for r in images.run_stage(spark, f"file://{source}", f"file://{target}", change).collect()}
    assert sorted(got) == ["bad.png", "i0.png", "i1.png", "i2.png", "i3.png"]
    assert got["i2.png"] == "RuntimeError: not this one" and "PNG" in got["bad.png"] and got["i0.png"] is None
    assert sorted(p.name for p in target.iterdir()) == ["i0.png", "i1.png", "i3.png"]
    assert (png.decode((target / "i3.png").read_bytes()) == 4).all()
    with pytest.raises(ValueError):
        images.run_stage(spark, str(source), f"file://{source}/", change)


# --- sinks


def files_of(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_whole_files_or_none(spark, tmp_path):
    df = spark.range(30).select("id", F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), "id").alias("path"), F.when(F.col("id") > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).cast("binary").alias("content"))
    folder.write_files(df.repartition(5), str(tmp_path / "a"))
    assert len(files_of(tmp_path / "a")) == 30 and (tmp_path / "a/d2/f29").read_bytes() == b"x" * 29 and (tmp_path / "a/d0/f0").read_bytes() == b""
    with pytest.raises(FileExistsError):
        folder.write_files(df, str(tmp_path / "a"))
    for broken in (df.withColumn("path", F.lit("same")), df.withColumn("path", F.when(F.col("id") == 7, "../out").otherwise(F.col("path"))), df.withColumn("content", F.when(F.col("id") == 9, F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("content")))):
        with pytest.raises(Exception):
            folder.write_files(broken.repartition(4), str(tmp_path / "b"))
        assert not (tmp_path / "b").exists() or files_of(tmp_path / "b") == []


def test_an_attempt_that_runs_twice_leaves_one_file(tmp_path):
    import pyarrow as pa

    writer = folder._Writer(str(tmp_path / "a"))
    batch = pa.RecordBatch.from_pydict({"path": ["x"], "content": [b"1"]})
    lost = writer.write(iter([batch]))  # its executor went away before it could report
    counts = writer.write(iter([batch]))
    assert lost.attempt != counts.attempt
    writer.commit([counts, None])
    assert files_of(tmp_path / "a") == ["x"]


def test_a_workbook_for_each_hole(spark, tmp_path):
    planes = spark.createDataFrame([("h1", 2.5, "a<b", True), ("h1", 1.5, None, None), ("h2", float("nan"), "é", False)], "hole string, depth double, note string, flag boolean")
    counts = spark.createDataFrame([("h1", 3)], "hole string, n long")
    books = xlsx.workbooks({"planes": (planes, ["depth"]), "counts": (counts, [])}, "hole")
    folder.write_files(books.select(F.concat("book", F.lit(".xlsx")).alias("path"), "content"), str(tmp_path / "out"))
    assert files_of(tmp_path / "out") == ["h1.xlsx", "h2.xlsx"]
    rows = {(r.path.rsplit("/", 1)[1], r.sheet, r.row): r.cells for r in xlsx.scan(spark, f"file://{tmp_path}/out").collect()}
    assert rows["h1.xlsx", "planes", 1] == ["depth", "note", "flag"] and rows["h1.xlsx", "planes", 2] == ["1.5"]
    assert rows["h1.xlsx", "planes", 3] == ["2.5", "a<b", "1"] and rows["h1.xlsx", "counts", 2] == ["3"]
    assert rows["h2.xlsx", "planes", 2] == [None, "é", "0"] and rows["h2.xlsx", "counts", 1] == ["n"] and ("h2.xlsx", "counts", 2) not in rows
    xlsx.write_report(str(tmp_path / "r" / "one.xlsx"), {"counts": counts, "planes": (planes.drop("hole"), ["depth"])})
    assert {r.sheet for r in xlsx.scan(spark, f"file://{tmp_path}/r").collect()} == {"counts", "planes"}
    with pytest.raises(ValueError):
        xlsx.write_report(str(tmp_path / "r" / "one.xls"), {"counts": counts})


def test_workbook_values_keep_their_types():
    assert [xlsx._value(*v) for v in (("n", "3"), ("n", "1.0E10"), ("s", "3"), ("b", "true"), ("n", None), ("n", "-0.5"))] == [3, 1e10, "3", True, None, -0.5]
    assert np.isnan(xlsx._value("n", "NaN")) and isinstance(pd.DataFrame([[1, None]], dtype=object).iloc[0, 0], int)
