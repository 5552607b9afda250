"""Written tables in the shared folder, and their removal."""

import os

from pyspark.sql import functions as F

from tabflaw.llm import common


def test_written_tables_are_read_back_and_removed(prepared):
    df = prepared.range(10).select("id", F.lit(None).cast("string").alias("s"))
    t = common.written(df, "t")
    assert t.dtypes == df.dtypes and t.count() == 10
    folder = os.path.dirname(t.inputFiles()[0]).removeprefix("file://")
    assert os.path.isdir(folder) and common.written(df.filter("id < 0"), "t").count() == 0
    assert common.remove_written(prepared) >= 2
    assert not os.path.exists(folder) and common.remove_written(prepared) == 0
