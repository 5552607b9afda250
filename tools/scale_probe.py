"""Scaling probe: replicate the sf0.1 customer table x1, x4, x16, x64 (new keys per copy),
time key operators and check the rows they give: exact splits, whole fragments, met quotas.

Usage: python tools/scale_probe.py [sf_dir] [copies,...]
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import functions as F

    from tabflaw.operators import cells, constraints as C, generate as G, prompts as P
    from tabflaw.plans import fixtures as fx
    from tabflaw.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]")
    base = fx.customer_clean(spark, sf_dir)
    rule = "EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)"
    out = {}
    sizes = [int(x) for x in sys.argv[2].split(",")] if len(sys.argv) > 2 else [1, 4, 16, 64]
    for copies in sizes:
        big = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_k"))
        big = big.select((F.col("_k") * 10_000_000 + F.col("row_id").cast("bigint")).cast("string").alias("row_id"),
                         "c_name", "c_nationkey", "c_mktsegment")
        big = big.checkpoint()
        dirty = fx.customer_dirty(big)
        n = big.count()
        entries = big.where(F.pmod(F.xxhash64("row_id"), F.lit(8)) == 0).select(
            F.concat(F.lit("e"), "row_id").alias("entry_id"), "row_id", F.lit("c_name").alias("column"),
            F.lit("outliers").alias("error_type"), F.lit("x").alias("error_value"), F.lit("").alias("tuple_pairs")).checkpoint()
        jobs = {
            "cell_diff": lambda: cells.cell_diff(big, dirty),
            "dc_pairs": lambda: C.pair_groups(big, "EQ(t1.c_nationkey,t2.c_nationkey)"),
            "dc_violations": lambda: C.violation_counts(big, rule),
            "pick_pairs": lambda: C.pick_pairs(big, "EQ(t1.c_nationkey,t2.c_nationkey)"),
            "generate_errors": lambda: G.generate_errors(big, 0.2, "1:2:4:3", seed=3),
            "split_rows": lambda: P.split_rows(big.select(F.col("row_id").alias("entry_id")), 0.9),
            "build_fragments": lambda: P.build_fragments(entries, big, k=5, index_order=F.col("row_id").cast("bigint")),
        }
        log = jobs["generate_errors"]()
        short = {r["error_type"]: r["missing"] for r in G.shortfall(log, G.error_budget(big, 0.2, "1:2:4:3")).collect()}
        split = {r["split"]: r["count"] for r in jobs["split_rows"]().groupBy("split").count().collect()}
        lines = jobs["build_fragments"]().select(F.size(F.split("input", "\n")).alias("n")).groupBy("n").count().collect()
        checks = {"split": split == {"train": int(n * 0.9), "test": n - int(n * 0.9)},
                  "fragments": {r["n"]: r["count"] for r in lines} == {8: entries.count()},
                  "pairs": jobs["pick_pairs"]().count() == big.groupBy("c_nationkey").agg(
                      F.floor(F.count("*") / 2).alias("p")).agg(F.sum("p")).first()[0],
                  "shortfall": {t: m for t, m in short.items() if m and t != "rule_violation"}}
        times = {}
        for name, job in jobs.items():
            job().write.format("noop").mode("overwrite").save()
            t0 = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 2)
        pairs = C.pair_totals(C.pair_groups(big, "EQ(t1.c_nationkey,t2.c_nationkey)")).first()["n_pairs"]
        out[f"x{copies}"] = {"rows": n, "pairs": str(pairs), "sec": times, "checks": checks}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
