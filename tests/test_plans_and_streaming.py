"""Physical-plan properties at scale-relevant points, and the streaming path."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabflaw.operators import cells as C
from tabflaw.operators import constraints as K
from tabflaw.plans import fixtures as fx
from tabflaw.sources.tables import read_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _no_cartesian(df):
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_no_cartesian_in_core_operators(spark):
    clean = fx.customer_clean(spark, SF_SMALL)
    dirty = fx.customer_dirty(clean)
    log = fx.annotation_log(spark, SF_SMALL)
    _no_cartesian(C.cell_diff(clean, dirty))
    _no_cartesian(C.apply_errors(clean, log, order_col=None))
    cust = read_table(spark, SF_SMALL, "customer").withColumnRenamed("c_custkey", "row_id")
    _no_cartesian(K.pair_groups(cust, "EQ(t1.c_nationkey,t2.c_nationkey)"))
    _no_cartesian(K.pick_pairs(cust, "EQ(t1.c_nationkey,t2.c_nationkey)"))


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = read_table(spark, SF_SMALL, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_pair_groups_aggregate_partially(spark):
    cust = read_table(spark, SF_SMALL, "customer").withColumnRenamed("c_custkey", "row_id")
    p = _plan(K.pair_groups(cust, "EQ(t1.c_nationkey,t2.c_nationkey)"))
    assert "partial_count" in p          # map-side combine before the shuffle


def test_stream_parse_and_validate(spark, scratch):
    from tabflaw.streaming.logs import completion_stream, validated_stream
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write('Assistant: {"row_id": "1", "column": "c_name", "error_type": "outliers", "error_value": "zz"}\n')
        f.write('Assistant: {"row_id": "1", "column": "nope", "error_type": "outliers", "error_value": "zz"}\n')
    clean = fx.customer_clean(spark, SF_SMALL)
    out = validated_stream(completion_stream(spark, src), clean)
    q = out.writeStream.format("memory").queryName("validated").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["column"], r["status"]) for r in spark.sql("select * from validated").collect())
    assert got == [("c_name", "ok"), ("nope", "undefined_column")]


def test_bucketed_tables_diff_without_shuffle(spark, scratch):
    from tabflaw.sources.files import save_bucketed
    clean = fx.customer_clean(spark, SF_SMALL)
    dirty = fx.customer_dirty(clean)
    c = save_bucketed(clean, "clean_b", os.path.join(scratch, "c"), buckets=8)
    d = save_bucketed(dirty, "dirty_b", os.path.join(scratch, "d"), buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the key join
    try:
        diff = C.cell_diff(c, d)
        assert "Exchange" not in _plan(diff)
        assert diff.count() == 47
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
