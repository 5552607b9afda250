"""A key holding a third of all rows: results stay exact and no single window holds the hot group."""

import itertools

from pyspark.sql import functions as F

from tabflaw.operators import annotations as A
from tabflaw.operators import constraints as C


def _hot(spark, n=3000):
    # key 'H' holds a third of the rows, the rest spread over 50 keys
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("H")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
        .alias("g"),
        (F.col("id") % 7).cast("string").alias("v"))


def test_hot_key_pairs_exact(spark):
    df = _hot(spark)
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append(r)
    want = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    got = sum(int(r["n_pairs"]) for r in C.pair_groups(df, "EQ(t1.g,t2.g)").collect())
    assert got == want
    want_v = sum(1 for g in groups.values() for a, b in itertools.combinations(g, 2) if a["v"] != b["v"])
    got_v = sum(int(r["n_pairs"]) for r in C.violation_counts(df, "EQ(t1.g,t2.g)&IQ(t1.v,t2.v)").collect())
    assert got_v == want_v


def test_hot_key_pick_pairs(spark):
    df = _hot(spark)
    pairs = C.pick_pairs(df, "EQ(t1.g,t2.g)", seed=5).collect()
    ids = [p["row_id_1"] for p in pairs] + [p["row_id_2"] for p in pairs]
    assert len(ids) == len(set(ids))
    hot = [p for p in pairs if p["row_id_1"] % 3 == 0]
    assert len(hot) == 500          # all 1000 hot rows
    assert all(p["row_id_2"] % 3 == 0 for p in hot)


def test_hot_group_cap_exact(spark):
    df = _hot(spark).withColumn("error_type", F.when(F.col("g") == "H", "outliers").otherwise("missing_value")) \
        .withColumn("dataset", F.lit("d"))
    capped = A.cap_per_type(df, cap=25, order_col="row_id", salts=16).collect()
    hot_ids = sorted(r["row_id"] for r in capped if r["error_type"] == "outliers")
    assert hot_ids == list(range(0, 75, 3))
    cold = sorted(r["row_id"] for r in capped if r["error_type"] == "missing_value")
    assert cold == sorted(i for i in range(3000) if i % 3)[:25]
