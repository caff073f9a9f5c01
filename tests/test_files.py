"""Logs, parameter tables, mosaics and painting on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import logs, mosaic, raster, tables
from strataspark.sources import xlsx


def test_a_log_in_a_workbook(spark):
    import pandas as pd

    cells = [["log", None, None, None], ["no", "深 度(m)", "倾\n向(°)", "倾角(°)"], [1, 2.5, 360.0, 40.0], [2, None, None, None], [3, 3.5, None, 0.0], [4, "x", 1.0, 1.0], [5, 4.0, None, 3.0], [6, 4.5, "?", 0.0]]
    rows = [r for r in xlsx.rows_of(xlsx.workbook({"log": pd.DataFrame(cells[1:], columns=["log", "", " ", "  "], dtype=object)}))]
    df = spark.createDataFrame([("a", r, c) for _, r, c in rows] + [("b", 1, ["深度", "深度", "倾向", "倾角"])], "path string, row int, cells array<string>")
    got = {r.row: (r.depth, r.azimuth, r.dip, r.reason) for r in logs.log_planes(df, ["path"]).collect()}
    assert got == {3: (2.5, 0.0, 40.0, None), 5: (3.5, 0.0, 0.0, None), 6: (None, None, 1.0, "not finite"), 7: (4.0, None, 3.0, "not finite"), 8: (4.5, None, 0.0, "not finite")}
    assert [r.path for r in logs.without_header(df, ["path"], logs.log_planes(df, ["path"])).collect()] == ["b"]
    assert logs.log_planes(df.where("false"), ["path"]).count() == 0


@pytest.mark.parametrize("start", [0.0, 5.0, 46.3, 10.000000000001, 123456.789012345, 0.1 + 0.2, 12345678.5])
def test_names_of_intervals(spark, start):
    name = spark.range(1).select(logs.interval_name(F.lit(start), F.lit(start + 5))).first()[0]
    assert name == f"segment_{start:.12g}m_to_{start + 5:.12g}m.png"
    assert spark.range(1).select(*logs.interval_of(F.lit(name))).first()[0] == float(f"{start:.12g}")


@pytest.mark.parametrize("start", [1e-7, 2.5e-5, 3e15, 123456789012.3, 1234567890123.0])
def test_names_with_exponents(spark, start):
    name = spark.range(1).select(logs.interval_name(F.lit(start), F.lit(start * 2))).first()[0]
    assert name == f"segment_{start:.12g}m_to_{start * 2:.12g}m.png"


def test_parameter_table(spark):
    values = dict.fromkeys(logs.LABELS, 1.0) | {"fractype": "odd", "hole": 7, "segment_name": "s"}
    del values["number"], values["type_name"]
    got = logs.parameter_table(spark.createDataFrame([tuple(values.values())], list(values)), ["hole"], ["depth_m"])
    assert got.columns == ["hole", *logs.LABELS.values(), "来源孔段"] and got.first()["裂隙类型"] == "未知"


def test_frames_become_a_mosaic(spark):
    rng = np.random.default_rng(3)
    frames = [rng.integers(0, 200, (h, 5, 3)).astype(np.uint8) for h in (4, 1, 6)]
    frames[1][:] = 255  # white, but not the last
    frames[2][2:4] = 255
    flat = spark.createDataFrame([(i, len(f), 5, f.tobytes()) for i, f in enumerate(frames)], "frame_idx long, height int, width int, data binary")
    got = mosaic.mosaic(mosaic.frame_rows(flat)).orderBy("mosaic_row").collect()
    last = frames[2][::-1]
    want = np.concatenate([frames[0][::-1], frames[1], last[last.mean(axis=(1, 2)) <= 250]])
    assert [r.mosaic_row for r in got] == list(range(len(want))) and b"".join(r.data for r in got) == want.tobytes()


def test_rows_of_segments(spark):
    total, length, height = 997, 46.3, 5.0
    got = [r.s for r in spark.range(total).select(mosaic.segment_of(F.col("id"), F.lit(total), length, height).alias("s")).collect()]
    table = tables.depth_segments(spark.range(1), F.lit(total), length, 76.0, height).collect()
    assert got == [r.segment_idx for r in sorted(table, key=lambda r: r.pixel_start) for _ in range(r.pixel_start, r.pixel_end)]


def test_square_and_back(spark):
    """A map of classes that fills blocks comes back as it was, but for pixels at the edges of blocks."""
    classes = np.kron(np.array([[0, 1, 2], [3, 0, 1]]), np.ones((20, 20), int))
    image = np.repeat((classes * 60).astype(np.uint8)[:, :, None], 3, axis=2)
    square, nw, nh = mosaic.letterboxed(image, 96)
    assert square.shape == (96, 96, 3) and (nw, nh) == (96, 64) and (square[:16] == 128).all() and (square[80:] == 128).all()
    predict = lambda s: -np.abs(s[:, :, :1].astype(float) - 60 * np.arange(4))
    assert (mosaic.classes_from_square(predict(square), 60, 40, nw, nh) == classes).mean() > 0.9
    df = spark.createDataFrame([("a", 40, 60, image.tobytes())], "path string, height int, width int, data binary")
    got = mosaic.classified(df, predict, 96).first()
    assert (np.frombuffer(got.classes, np.uint8).reshape(40, 60) == mosaic.classes_from_square(predict(square), 60, 40, nw, nh)).all()
    flat = np.full((7, 3, 3), 200, np.uint8)
    assert (mosaic.letterboxed(flat, 14)[0][:, 4:10] == 200).all()


def test_painting(spark):
    points = [(1, p, p, (p * 17 + c // 3) % 70 - 5, c) for p in range(5) for c in range(0, 60, 1 + p)]
    df = spark.createDataFrame(points, "segment_id int, plane int, paint int, `row` int, `column` int")
    image = np.full((50 + 6, 60 + 6), -1)
    for _, p, _, r, c in points:
        if 0 <= r < 50:
            image[r : r + 30, c : c + 30] = p
    got = np.full((50, 60), -1)
    for r in mosaic.painted(df, ["segment_id"], "plane", "paint", 50, 60).collect():
        got[r.y, r.x] = r.paint
    assert (got == image[3:-3, 3:-3]).all()


def test_edges_and_masks(spark):
    one = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 0, 2)], "segment_id int, y int, x int")
    assert [r.segment_id for r in raster.with_edges(one, ["segment_id"]).collect()] == [1]
    two = one.where("x < 2")
    assert {tuple(r) for r in raster.masks_together(one, two).collect()} == {(1, 0, 0, True, True), (1, 1, 1, True, True), (2, 0, 0, True, True), (2, 0, 2, True, False)}


def test_parameters_of_segments(spark):
    got = logs.segment_parameters(spark.range(1), F.lit(1000), F.lit(477), 5.0).first()
    assert got.ratio_v == 5 and got.ratio_h == pytest.approx(math.pi * 76 / 477)
    with pytest.raises(ValueError, match="length_m"):
        logs.segment_parameters(spark.range(1), F.lit(1), F.lit(1), 0.0)


def test_workbooks_are_written_and_read_row_by_row():
    """What a task holds does not grow with a sheet's rows, but for the compressed bytes."""
    import tracemalloc

    from strataspark.sources import xlsx

    peaks = []
    for n in (2_000, 20_000):
        tracemalloc.start()
        book = xlsx._Book()
        book.sheet("a", ["k", "v"], ([k, f"row {k}"] for k in range(n)))
        data = book.done()
        last = None
        for last in xlsx.rows_of(data):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1] - 3 * len(data))
        tracemalloc.stop()
        assert last == ("a", n + 1, [str(n - 1), f"row {n - 1}"])
    assert peaks[1] < peaks[0] + 2_000_000
