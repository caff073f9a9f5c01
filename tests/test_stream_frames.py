"""Frames of a stream against the same frames as a table."""

import random

from pyspark.sql import functions as F

from strataspark.streaming import frames

SCHEMA = "hole string, frame_idx long, n_rows int, ends boolean"


def rows_of(df):
    return sorted((r.hole, r.frame_idx, r.n_rows, r.row_offset, r.is_last) for r in df.collect())


def run(spark, batches, tmp_path):
    """The stream's result; every batch is one file and one trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second run finds nothing new
        query = frames.start_into_folder(frames.placed_stream(stream, "hole"), f"{tmp_path}/out", f"{tmp_path}/check", availableNow=True)
        query.awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/out")


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(5)
    all_, batches = [], [[] for _ in range(4)]
    for hole in ("a", "b", "c", "d"):
        whole = [(hole, i, rng.randint(0, 9), False) for i in range(0, 40, rng.choice([1, 2, 3]))]
        all_ += whole
        cuts = sorted(rng.sample(range(len(whole)), 3))
        for batch, part in zip(batches, (whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)]))):
            batch += rng.sample(part, len(part))
    batches.append([(h, None, None, True) for h in "abc"])
    got = rows_of(run(spark, batches, tmp_path))
    table = rows_of(frames.placed_table(spark.createDataFrame(all_, SCHEMA), "hole"))
    held = {r for r in table if r[0] == "d" and r[4]}  # this hole has not been closed
    assert set(got) == set(table) - held and len(got) == len(table) - 1


def test_late_frames_and_a_new_hole(spark, tmp_path):
    batches = [[("a", 5, 10, False), ("a", 7, 1, False)], [("a", 6, 3, False), ("a", 9, 4, False)], [("a", None, None, True)], [("a", 1, 2, False), ("a", None, None, True)], [("z", None, None, True)]]
    got = run(spark, batches, tmp_path).collect()
    assert sorted(((r.frame_idx, r.n_rows, r.row_offset, r.is_last) for r in got), key=str) == sorted([(5, 10, 0, False), (6, 3, None, None), (7, 1, 10, False), (9, 4, 11, True), (1, 2, 0, True)], key=str)
    assert frames.placed_table(spark.createDataFrame([], SCHEMA).where(F.lit(True)), "hole").count() == 0
