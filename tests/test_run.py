"""A whole run: drawn frames to segments, masks, tables and a report that is read back."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions.shared import held, scratch
from strataspark.operators import logs, recognition
from strataspark.plans import borehole
from strataspark.sources import png, xlsx

WIDTH, LENGTH, DIAMETER = 120, 1.2, 76.0
ROWS = math.ceil(LENGTH * 1000 * WIDTH / (math.pi * DIAMETER))
RED, GREEN = (128, 0, 0), (0, 128, 0)


def wall():
    """The hole's wall from top to bottom, with a broken trace of a steep plane and a lower flat one."""
    image = np.full((ROWS, WIDTH, 3), 60, np.uint8)
    ratio = LENGTH * 1000 / ROWS
    for x in range(WIDTH):
        if not 50 <= x < 59:
            z = 150 + 38 / ratio * math.tan(math.radians(45)) * math.cos(2 * math.pi * x / WIDTH - math.radians(90))
            image[round(z) : round(z) + 10, x] = RED
        z = 420 + 38 / ratio * math.tan(math.radians(20)) * math.cos(2 * math.pi * x / WIDTH - math.radians(200))
        image[round(z) : round(z) + 3, x] = GREEN
    for y in (30, 31):
        image[y, 20:24] = RED  # too small
    return image


def by_colour():
    """Makes a model that knows classes by their colours."""
    red, green = RED, GREEN

    def load():
        def predict(tiles):
            return [np.select([(abs(t.astype(int) - c) < 20).all(2) for c in (red, green)], [1, 2], 0) for t in tiles]

        return predict

    return load


@pytest.fixture(scope="module")
def frames(spark):
    """Frames hold 100 rows each, the lowest first; the last is filled up with white rows."""
    image = wall()
    rows = []
    for k, y in enumerate(range(0, ROWS, 100)):
        part = image[y : y + 100]
        part = np.concatenate([part, np.full((100 - len(part), WIDTH, 3), 255, np.uint8)])
        rows.append((k, 100, WIDTH, part[::-1].tobytes()))
    return spark.createDataFrame(rows, "frame_idx long, height int, width int, data binary").repartition(3)


@pytest.fixture(scope="module")
def log_rows(spark):
    ratio = LENGTH * 1000 / ROWS
    cells = [["no", "深度(m)", "倾向(°)", "倾角(°)"], ["1", str(20 + 0.155 * ratio), "90", "45"], ["2", str(20 + 0.4215 * ratio), "200", "20"]]
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(cells)], "row int, cells array<string>")


def test_segments_of_frames(spark, frames):
    segments, rows = borehole.cut_segments(frames, LENGTH, DIAMETER, 0.5, 20.0)
    got = segments.orderBy("segment_id").collect()
    assert [(r.start_depth_m, r.end_depth_m) for r in got] == [pytest.approx(v) for v in ((20, 20.5), (20.5, 21), (21, 21.2))]
    assert sum(r.rows for r in got) == ROWS and got[0].name == "segment_20m_to_20.5m.png"
    image, width = wall(), got[0].width
    whole = {}
    for r in rows.collect():
        whole[sum(g.rows for g in got[: r.segment_id]) + r.y] = np.frombuffer(r.data, np.uint8).reshape(width, 3)
    assert sorted(whole) == list(range(ROWS)) and width == WIDTH
    assert all((whole[y] == image[y]).all() for y in whole)
    with pytest.raises(ValueError):
        borehole.cut_segments(frames, LENGTH, DIAMETER, 0.001)
    with pytest.raises(ValueError):
        borehole.cut_segments(frames, 10.0**6, DIAMETER, 10.0**6)


def test_from_frames_to_a_report(spark, frames, log_rows, tmp_path):
    out = str(tmp_path / "run")
    got = borehole.run_hole(frames, log_rows, by_colour(), {1: "filled", 2: "unfilled"}, out, length_m=LENGTH, start_depth_m=20.0, diameter_mm=DIAMETER, height_m=1.2, tile_rows=97, reference=10, steps=4, area=30, keep_intermediate=True)
    found = got["fractures"].collect()
    assert [r.fractype for r in found] == ["filled", "unfilled"]
    for r, (dip, azimuth) in zip(found, ((45, 90), (20, 200))):
        assert r.dip_angle_deg == pytest.approx(dip, abs=3) and r.dip_direction_deg == pytest.approx(azimuth, abs=5)
    m = got["metrics"].first()
    assert m.n_pred == m.n_ref == 2 and m.qpi > 0.99 and m.qai > 0.99 and m.cei > 0.98
    names = {f: sorted(p.name for p in (tmp_path / "run" / f).iterdir()) for f in ("borehole_segments", "recognize", "eliminate", "extension", "result")}
    stem = "segment_20m_to_21.2m"
    assert all(names[f] == [f"{stem}.png"] for f in ("borehole_segments", "recognize", "eliminate", "extension"))
    assert names["result"] == ["borehole_evaluation.xlsx", f"{stem}-binary.png", f"{stem}-branches.png", f"{stem}-fracture_parameters.xlsx"]
    read = {f: png.decode((tmp_path / "run" / f / f"{stem}.png").read_bytes()) for f in ("borehole_segments", "recognize", "eliminate", "extension")}
    assert (read["borehole_segments"] == wall()).all()
    small = read["recognize"].any(2).sum() - read["eliminate"].any(2).sum()
    assert small == 8 and read["extension"].any(2).sum() > read["eliminate"].any(2).sum()
    rows = {}
    for r in xlsx.scan(spark, f"file://{tmp_path}/run/result").collect():
        rows.setdefault((r.path.rsplit("/", 1)[1], r.sheet), {})[r.row] = r.cells
    book = "borehole_evaluation.xlsx"
    assert {s for b, s in rows if b == book} == {borehole.SHEETS[k] for k in ("metrics", "fractures", "log", "method")}
    assert rows[book, borehole.SHEETS["metrics"]][1] == list(borehole.METRICS.values())
    method = rows[book, borehole.SHEETS["method"]]
    assert len(method) == 12 and method[2][-2:] == ["标准来源", "log.xlsx"] and method[11][-1] == "0"
    assert rows[book, borehole.SHEETS["log"]][1] == ["源Excel行号", "深度(m)", "倾向(°)", "倾角(°)"] and len(rows[book, borehole.SHEETS["log"]]) == 3
    assert len(rows[book, borehole.SHEETS["fractures"]]) == 3 and rows[f"{stem}-fracture_parameters.xlsx", "裂隙参数"][2][:3] == ["1", "充填", "filled"]
    whole, kinds = borehole.summarise(f"file://{tmp_path}/run/result", f"file://{tmp_path}/csv", spark)
    united = whole.collect()
    assert [(r.source_workbook, r.segment_start_m, r.segment_end_m, r.fracture_id, r.fracture_type) for r in united] == [(f"{stem}-fracture_parameters.xlsx", 20.0, 21.2, k, t) for k, t in ((1, "filled"), (2, "unfilled"))]
    assert [r.depth_m for r in united] == [pytest.approx(r.depth_m) for r in found] and len(united[0]) == 16
    csv = spark.read.option("header", True).csv(f"file://{tmp_path}/csv/fracture_type_summary").collect()
    assert [(r.fracture_type, r.fracture_count) for r in csv] == [("filled", "1"), ("unfilled", "1")] and len(kinds.columns) == 4
    with pytest.raises(ValueError):
        logs.all_segments(xlsx.scan(spark, f"file://{tmp_path}/run/result").withColumn("path", F.lit("x/none.xlsx"))).count()
    with pytest.raises(FileNotFoundError):
        borehole.summarise(f"file://{tmp_path}/run/recognize", f"file://{tmp_path}/none", spark)
    with pytest.raises(FileExistsError):
        borehole.run_hole(frames, log_rows, by_colour(), {1: "filled", 2: "unfilled"}, out, length_m=LENGTH, start_depth_m=20.0)
    with pytest.raises(ValueError):
        borehole.run_hole(frames, log_rows, by_colour(), {1: "filled"}, str(tmp_path / "other"), length_m=LENGTH, start_depth_m=0.0)


def test_recogniser_tiles_and_sizes(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (25, 12)).astype(np.uint8)
    rows = spark.createDataFrame([(s, y, bytes(image[y])) for s in (1, 2) for y in range(25)], "segment_id int, y int, data binary").repartition(3)
    mark = tmp_path / "loads"
    mark.mkdir()

    def load():
        import os
        import uuid

        (mark / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda tiles: [np.repeat(np.repeat(t[::2, ::2] // 100, 1, 0), 1, 1) if len(t) == 10 else t // 100 for t in tiles]

    got = {}
    for r in recognition.recognised(rows, 12, load, 10, 1).collect():
        got.setdefault(r.segment_id, np.zeros((25, 12), int))[r.y, r.x] = r.class_id
    expected = np.concatenate([np.repeat(np.repeat(image[a : a + 10][::2, ::2] // 100, 2, 0), 2, 1) for a in (0, 10)] + [image[20:] // 100])
    assert (got[1] == expected).all() and (got[2] == expected).all()
    pids = [p.name.split("-")[0] for p in mark.iterdir()]
    assert len(pids) == len(set(pids))  # once in each worker
    assert recognition.recognised(rows.where("false"), 12, load, 10, 1).count() == 0


def test_squares_and_back():
    shares = lambda squares: np.stack([(squares[..., 0] < 100), (squares[..., 0] >= 100)], axis=-1).astype(float)
    image = np.zeros((30, 60, 3), np.uint8)
    image[:, 30:] = 200
    found = recognition.by_squares(shares, 64)([image, image[:20]])
    assert [f.shape for f in found] == [(30, 60), (20, 60)]
    assert (found[0][:, :27] == 0).all() and (found[0][:, 33:] == 1).all()


def test_scratch_goes_with_what_it_held(spark):
    with scratch(spark):
        inner = held(spark.range(5), "inner")
        kept = inner.count()
    outer = held(spark.range(3), "outer")
    assert kept == 5 and outer.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(*inner.inputFiles())
