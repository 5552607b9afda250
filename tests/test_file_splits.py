"""Scans that split files: CSV with quoted line breaks, JSON pair maps."""

import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tabflaw.sources import csv_split, files as S


@pytest.fixture()
def small_splits(spark):
    """Splits of 2 KB, so that a small file is many tasks."""
    names = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "0"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


def _values(rng):
    kinds = ["", "plain", 'a "quoted" word, and\nnext line', '"\n"\n' * rng.randrange(1, 30), "x" * rng.randrange(1, 900) + "\r\ny",
             '"', " blank ends \n", "\n\n\n", "NA", "ünïcode, ☃\n" * 40, "z" * 5000 + "\n" + "w" * 5000]
    return rng.choices(kinds, weights=[3, 9, 3, 1, 1, 1, 1, 1, 1, 1, 0.1])[0]


def _write_csv(path, header, rows, ending="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=ending)
        w.writerow(header)
        w.writerows(rows)


def _spark_own(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def test_one_file_in_many_tasks_equals_the_reader_of_whole_files(small_splits, scratch):
    rng = random.Random(1)
    rows = [[str(k), _values(rng), _values(rng)] for k in range(2000)]
    _write_csv(f"{scratch}/t.csv", ["row_id", "na,me", 'te"xt'], rows)
    ref = _spark_own(small_splits, f"{scratch}/t.csv")
    lines = csv_split._lines(small_splits, f"{scratch}/t.csv")
    states = csv_split.split_states(lines).collect()
    assert len(states) > 50 and sum(r["odd"] for r in states) > 10
    got = csv_split.scan_csv(small_splits, f"{scratch}/t.csv", ref.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, ref.collect())))
    table = S.read_csv_table(small_splits, f"{scratch}/t.csv", na_tokens=None)
    assert table.count() == 2000 and table.columns == ["row_id", "na,me", 'te"xt']
    # and the written text itself
    want = sorted((r[0], r[1] or None) for r in rows)
    assert sorted((r[0], r[1]) for r in table.collect()) == want


def test_a_record_over_many_splits(small_splits, scratch):
    long = "line of text\n" * 4000
    _write_csv(f"{scratch}/t.csv", ["row_id", "v"], [["1", "a"], ["2", long], ["3", "b"], ["4", long + '"'], ["5", "c"]])
    got = {r["row_id"]: r["v"] for r in S.read_csv_table(small_splits, f"{scratch}/t.csv").collect()}
    assert got == {"1": "a", "2": long, "3": "b", "4": long + '"', "5": "c"}


def test_folders_blank_lines_endings_and_other_widths(small_splits, scratch):
    os.mkdir(f"{scratch}/d")
    _write_csv(f"{scratch}/d/a.csv", ["row_id", "v"], [[str(k), f"x\n{k}"] for k in range(300)], ending="\r\n")
    _write_csv(f"{scratch}/d/b.csv", ["row_id", "v"], [])
    with open(f"{scratch}/d/c.csv", "w") as f:
        f.write("row_id,v\n\n300,short\n\n301\n302,a,b\n303,\"open")
    got = {r["row_id"]: r["v"] for r in S.read_csv_table(small_splits, f"{scratch}/d").collect()}
    ref = {r["row_id"]: r["v"] for r in S.read_csv_table(small_splits, f"{scratch}/d", multi_line="file").collect()}
    assert got == ref and len(got) == 304 and got["7"] == "x\n7" and got["301"] is None


def test_pair_maps_in_many_tasks(small_splits, scratch):
    rng = random.Random(2)
    rules = ["EQ(t1.a,t2.a)", 'IQ(t1.b,"x: [1, 2")', "leer", "ünï\\code\n", ""]
    maps = [{r: [[rng.randrange(10**12), -rng.randrange(9)] for _ in range(n)] for r, n in zip(rules, counts)}
            for counts in ([900, 0, 0, 40, 5], [0, 0, 0, 0, 0], [3, 1500, 0, 0, 0])]
    for k, m in enumerate(maps):
        with open(f"{scratch}/m{k}.json", "w", encoding="utf-8") as f:
            json.dump(m, f, indent=[None, 2, 1][k], ensure_ascii=k == 0)
    with open(f"{scratch}/empty.json", "w") as f:
        f.write("{}")
    got = S.read_pair_map(small_splits, f"{scratch}/*.json")
    want = sorted((r, a, b) for m in maps for r, ps in m.items() for a, b in ps)
    assert sorted(map(tuple, got.collect())) == want
    whole = S.read_pair_map(small_splits, f"{scratch}/*.json", whole=True)
    assert sorted(map(tuple, whole.collect())) == want
    S.write_pair_map(got.repartition(3), f"{scratch}/out")
    assert sorted(map(tuple, S.read_pair_map(small_splits, f"{scratch}/out").collect())) == want
    for name in os.listdir(f"{scratch}/out"):
        if name.startswith("part"):
            json.load(open(f"{scratch}/out/{name}", encoding="utf-8"))
    S.write_pair_map(got.where(F.lit(False)), f"{scratch}/none")
    assert S.read_pair_map(small_splits, f"{scratch}/none").count() == 0


def test_lines_are_not_shuffled(spark, scratch):
    """Only records that cross a border are exchanged, and the splits' sums."""
    _write_csv(f"{scratch}/t.csv", ["row_id", "v"], [["1", "a"]])
    plan = csv_split.csv_records(spark, f"{scratch}/t.csv")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" in plan
