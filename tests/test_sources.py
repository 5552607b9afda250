"""File sources and sinks: CSV traps, JSON-line logs, rules, pair maps, corpora, round trips."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tabflaw.sources import files as S


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_csv_nulls_bom_newlines_hyphens(spark, scratch):
    p = os.path.join(scratch, "clean.csv")
    _write(p, '﻿row_id,beer-name,Unnamed: 0\n1,"two\nlines",NA\n2,N/A,\n3,ok,x\n')
    df = S.read_csv_table(spark, p)
    assert df.columns == ["row_id", "beer-name", "Unnamed: 0"]
    rows = {r["row_id"]: (r["beer-name"], r["Unnamed: 0"]) for r in df.collect()}
    assert rows == {"1": ("two\nlines", None), "2": (None, None), "3": ("ok", "x")}
    raw = S.read_csv_table(spark, p, na_tokens=None)
    assert {r["row_id"]: r["beer-name"] for r in raw.collect()}["2"] == "N/A"
    with pytest.raises(KeyError):
        S.read_csv_table(spark, p, key="id")


def test_error_log_discovery_and_bad_lines(spark, scratch):
    rec = {"row_id": "1", "column": "a", "error_type": "outliers", "error_value": 5, "right_value": "1"}
    _write(os.path.join(scratch, "logs", "beers", "beers_annotation.jsonl"),
           json.dumps(rec) + "\n{broken\n\n" + json.dumps(dict(rec, row_id="2")) + "\n")
    _write(os.path.join(scratch, "logs", "flights", "deep", "flights_annotation.jsonl"), json.dumps(rec) + "\n")
    _write(os.path.join(scratch, "logs", "beers", "other.jsonl"), json.dumps(rec) + "\n")
    log = S.read_error_log(spark, os.path.join(scratch, "logs"), glob="*_annotation.jsonl", recursive=True)
    good = S.good_records(log).collect()
    assert sorted((r["dataset"], r["row_id"]) for r in good) == [("beers", "1"), ("beers", "2"), ("deep", "1")]
    assert S.bad_records(log).count() == 1
    assert good[0]["error_value"] == "5"
    with pytest.raises(FileNotFoundError):
        S.read_error_log(spark, os.path.join(scratch, "logs"), glob="*.nothing", recursive=True)


def test_rules_and_pair_map(spark, scratch):
    _write(os.path.join(scratch, "rules.txt"), "  EQ(t1.a,t2.a)&IQ(t1.b,t2.b)  \n\nEQ(t1.c,t2.c)\n")
    assert [r["rule"] for r in S.read_rules(spark, os.path.join(scratch, "rules.txt")).collect()] == \
        ["EQ(t1.a,t2.a)&IQ(t1.b,t2.b)", "EQ(t1.c,t2.c)"]
    _write(os.path.join(scratch, "pairs.json"), json.dumps({"EQ(t1.a,t2.a)": [[1, 2], [3, 9]], "EQ(t1.c,t2.c)": []},
                                                          indent=4))
    pm = S.read_pair_map(spark, os.path.join(scratch, "pairs.json")).collect()
    assert sorted((r["rule"], r["row_id_1"], r["row_id_2"]) for r in pm) == \
        [("EQ(t1.a,t2.a)", 1, 2), ("EQ(t1.a,t2.a)", 3, 9)]


def test_jsonl_sink_round_trip_and_corpus(spark, scratch):
    df = spark.createDataFrame([("train", "i1", "x", "ü", None), ("test", "i2", "y", "z", "v")],
                               "split string, instruction string, input string, a string, b string") \
        .withColumn("output", F.struct("a", "b")).drop("a", "b")
    out = os.path.join(scratch, "corpus")
    S.write_jsonl(df, out, partition_by=["split"])
    assert {"split=test", "split=train"} <= set(os.listdir(out))
    back = S.load_corpus(spark, out)
    got = {r["instruction"]: json.loads(r["output"]) for r in back.collect()}
    assert got["i1"] == {"a": "ü", "b": None}


def test_csv_tree_to_jsonl(spark, scratch):
    _write(os.path.join(scratch, "src", "a", "x.csv"), "row_id,v\n1,NA\n2,\n")
    _write(os.path.join(scratch, "src", "b", "y.csv"), "row_id,v\n3,q\n")
    S.convert_csv_tree(spark, os.path.join(scratch, "src"), os.path.join(scratch, "dst"))
    back = spark.read.text(os.path.join(scratch, "dst")).collect()
    vals = sorted((r["source"], r["value"]) for r in back)
    assert vals[0][0] == "a/x" and '"v":"NA"' in vals[0][1]
    assert len(vals) == 3


def test_csv_tree_keeps_each_files_header_and_path(spark, scratch):
    _write(os.path.join(scratch, "src", "a", "t_annotation.csv"), "row_id,src\n1,ale\n")
    _write(os.path.join(scratch, "src", "b", "t_annotation.csv"), "flight,extra,row_id\n7,\"two\nlines\",2\n")
    _write(os.path.join(scratch, "src", "c", "d", "t_annotation.csv"), "row_id,src\n3,\n")
    _write(os.path.join(scratch, "src", "c", "other.csv"), "x\n1\n")
    S.convert_csv_tree(spark, os.path.join(scratch, "src"), os.path.join(scratch, "dst"), glob="*_annotation.csv")
    got = {r["source"]: json.loads(r["value"]) for r in spark.read.text(os.path.join(scratch, "dst")).collect()}
    assert got == {"a/t_annotation": {"row_id": "1", "src": "ale"}, "c/d/t_annotation": {"row_id": "3", "src": ""},
                   "b/t_annotation": {"flight": "7", "extra": "two\nlines", "row_id": "2"}}


def test_csv_sink_round_trip(spark, scratch):
    df = spark.createDataFrame([("1", "a,b"), ("2", None)], "row_id string, v string")
    S.write_csv_table(df, os.path.join(scratch, "out"))
    back = S.read_csv_table(spark, os.path.join(scratch, "out"))
    assert sorted((r["row_id"], r["v"]) for r in back.collect()) == [("1", "a,b"), ("2", None)]


def test_typed_key_extra_fields_and_cache(spark, scratch):
    p = os.path.join(scratch, "t.csv")
    _write(p, "row_id,a\n1,x\n2,y,EXTRA\nz,w\n")
    df = S.read_csv_typed_key(spark, p)
    rows = sorted((r["row_id"], r["a"]) for r in df.collect() if r["row_id"] is not None)
    assert rows == [(1, "x"), (2, "y")]                       # extra field dropped, bad id -> null
    assert df.where(F.col("row_id").isNull()).count() == 1
    back = S.cache_table(df, os.path.join(scratch, "cache"))
    assert back.count() == 3


def test_corpus_from_reference_layout(spark, scratch):
    from tabflaw.plans.corpus import corpus_from_folder
    root = os.path.join(scratch, "data")
    for name, n in (("beers", 30), ("flights", 25)):
        rows = "\n".join(f"{i},v{i},w{i}" for i in range(n))
        _write(os.path.join(root, name, "clean.csv"), "row_id,a,b-c\n" + rows + "\n")
        _write(os.path.join(root, name, "dirty.csv"), "row_id,a,b-c\n" + rows.replace("v1,", "V1,") + "\n")
        recs = [{"row_id": str(i), "column": "a", "error_type": t, "error_value": f"x{i}", "right_value": f"v{i}"}
                for i, t in zip(range(0, n, 2), ["outliers", "pattern_violation"] * n)]
        recs.append({"row_id": "1", "column": "a", "error_type": "rule_violation", "error_value": "q",
                     "right_value": "v1", "constraint": "The a of Row 1 and The a of Row 3", "tuple_pairs": "(1, 3)"})
        _write(os.path.join(root, name, f"{name}_annotation.jsonl"),
               "\n".join(json.dumps(r) for r in recs) + "\nnot json\n")
    out = os.path.join(scratch, "corpus")
    res = corpus_from_folder(spark, root, "generation", out=out, k=3, cap=6)
    counts = {r["split"]: r["count"] for r in res.groupBy("split").count().collect()}
    total = 2 * (6 + 6 + 1)          # cap 6 per (file, type) + one rule record per file
    assert counts["train"] == int(total * 0.9)
    assert counts["test_zeroshot"] == counts["test_fewshot"] == total - int(total * 0.9)
    assert {"split=train", "split=test_zeroshot", "split=test_fewshot"} <= set(os.listdir(out))
    one = res.where("split = 'test_fewshot'").first()
    assert one["input"].startswith("| row_id | a | b-c |")
    assert json.loads(one["output"])["tuple_pairs"] is not None


def test_a_cluster_session_needs_a_shared_folder(monkeypatch, spark):
    from tabflaw import session

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.own

        def setCheckpointDir(self, d):
            raise AssertionError("the context has one")

    class Session:
        sparkContext = Context()

    Context.own = None
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
    Context.own = "hdfs:/shared/checkpoints"
    assert session.checkpoint_dir(Session()) == "hdfs:/shared/checkpoints"


def test_pair_groups_sink_partitioned_by_rule(spark, scratch):
    from tabflaw.operators.constraints import pair_groups
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "y")], "row_id long, a string")
    g = pair_groups(df, "EQ(t1.a,t2.a)")
    out = os.path.join(scratch, "pairs")
    S.write_pair_groups(g, out)
    assert any(d.startswith("rule_id=") for d in os.listdir(out))
    back = spark.read.parquet(out)
    assert sorted(int(r["n_pairs"]) for r in back.collect()) == [1, 3]


def test_raw_scan_keeps_empty_fields(spark, scratch):
    import json
    from tabflaw.sources import files as S
    with open(f"{scratch}/x.csv", "w", encoding="utf-8-sig") as f:
        f.write('id,v,"w x"\n1,,NA\n2,"",\n3,"a ""q""\nb",null\n4\n5,,x,extra\n,,\n')
    rows = [json.loads(r["value"]) for r in S.csv_to_json_rows(S.read_csv_raw(spark, f"{scratch}/x.csv")).collect()]
    assert rows == [{"id": "1", "v": "", "w x": "NA"}, {"id": "2", "v": "", "w x": ""}, {"id": "3", "v": 'a "q"\nb', "w x": "null"},
                    {"id": "4", "v": None, "w x": None}, {"id": "5", "v": "", "w x": "x"}, {"id": "", "v": "", "w x": ""}]
