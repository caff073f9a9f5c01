"""Checks of parameters, columns and files."""

import pytest

from strataspark.functions.shared import shared_dir
from strataspark.operators import audits


def test_parameters():
    audits.check_parameters(positive={"length": 1.5}, finite={"start": -3.0}, at_least={"shortest": (1, 1)})
    for bad in ({"positive": {"a": 0}}, {"positive": {"a": float("inf")}}, {"finite": {"a": float("nan")}}, {"finite": {"a": True}}, {"at_least": {"a": (0, 1)}}):
        with pytest.raises(ValueError, match="a must be"):
            audits.check_parameters(**bad)


def test_defaults():
    assert audits.with_defaults({"a": 1}, {"a": 0, "b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="unknown settings: c"):
        audits.with_defaults({"c": 1}, {"a": 0})


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert audits.required_columns(df, ["c", "a"], {"a": "x"}).columns == ["c", "x"]
    with pytest.raises(ValueError, match="missing columns: d"):
        audits.required_columns(df, ["a", "d"])


def test_a_folder_in_use_is_refused(spark):
    import uuid

    df = spark.createDataFrame([("é", 1)], "name string, n int")
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    audits.write_csv(df, folder)
    assert [tuple(r) for r in spark.read.option("header", True).csv(folder).collect()] == [("é", "1")]
    with pytest.raises(Exception, match="(?i)exists"):
        audits.write_csv(df, folder)
