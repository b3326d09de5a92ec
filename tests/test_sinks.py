"""Reports as one file: written by tasks, joined, and whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from clausewright.sources import loaders as L


def test_array_of_many_parts(spark, tmp_path):
    rows = [(i, None if i % 3 else f"é \"{i}\"\nnext", [i, i + 1], {"a": i}) for i in range(23)]
    df = spark.createDataFrame(rows, "i int, s string, l array<int>, m struct<a:int>").repartitionByRange(5, "i").sortWithinPartitions("i")
    path = str(tmp_path / "out.json")
    L.write_json_array(df, path)
    want = [{"i": i, "s": s, "l": x, "m": m} for i, s, x, m in rows]
    text = open(path, encoding="utf-8").read()
    assert json.loads(text) == want and text == json.dumps(want, indent=2, ensure_ascii=False)
    L.write_json_array(df.where("i < 3"), path)  # written over
    assert len(json.load(open(path))) == 3
    L.write_json_array(df.where("false"), path)
    assert open(path).read() == "[]" and [x for x in os.listdir(tmp_path) if "out.json" not in x] == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        L.write_json_array(bad, str(tmp_path / "out.json"))
    assert os.listdir(tmp_path) == []
