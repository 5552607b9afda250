"""Markdown, completion parsing, instructions, split and few-shot invariants."""

from pyspark.sql import functions as F

from tabflaw.functions.templates import ERROR_TYPE_DESCRIPTIONS, SUFFIXES, TASK_DESCRIPTIONS
from tabflaw.operators import annotations as A
from tabflaw.operators import prompts as P


def test_markdown_table(spark):
    rows = spark.createDataFrame([("e", 2, "2", None), ("e", 1, "1", "x")], "g string, o int, row_id string, v string")
    md = P.markdown_tables(rows, "g", "o", ["row_id", "v"]).first()["markdown"]
    assert md == "| row_id | v |\n| --- | --- |\n| 1 | x |\n| 2 |  |"


def test_fragment_contains_involved_rows_and_fill(spark):
    table = spark.createDataFrame([(str(i), f"n{i}", None if i == 3 else "s") for i in range(40)],
                                  "row_id string, name string, seg string")
    entries = spark.createDataFrame([
        ("e1", "3", "seg", "missing_value", "N/A", ""),
        ("e2", "5", "name", "rule_violation", "zz", "(5, 9)")],
        "entry_id string, row_id string, column string, error_type string, error_value string, tuple_pairs string")
    frags = {r["entry_id"]: r["input"] for r in P.build_fragments(entries, table, k=5, seed=1).collect()}
    ids1 = [line.split("|")[1].strip() for line in frags["e1"].split("\n")[2:]]
    ids2 = [line.split("|")[1].strip() for line in frags["e2"].split("\n")[2:]]
    assert "3" in ids1 and len(ids1) == 6 and len(set(ids1)) == 6
    assert {"5", "9"} <= set(ids2) and len(ids2) == 7
    assert "| 3 | n3 | N/A |" in frags["e1"]


def test_completion_parsing(spark):
    good = 'blah\nAssistant:\nHere: {"row_id": 7, "column": "a",\n "error_type": "outliers", "error_value": "9"} thanks'
    df = spark.createDataFrame([(good,), ('Assistant: {"row_id": "1", "col',), ("no json",)], "completion string")
    out = A.parse_completion(df).select("record.row_id", "record.column", "parse_ok").collect()
    assert (out[0]["row_id"], out[0]["column"], out[0]["parse_ok"]) == ("7", "a", True)
    assert out[1]["parse_ok"] is False and out[2]["parse_ok"] is False


def test_instruction_parts(spark):
    df = spark.createDataFrame([("k1", "outliers", ""), ("k2", "bogus", ""),
                                ("k3", "rule_violation", "Constraint Violation: The a of Row 1 vs Row 12")],
                               "k string, t string, c string")
    rows = df.select("k", P.instruction_text("detection", F.col("t"), F.col("c"), F.col("k")).alias("i")).collect()
    i = {r["k"]: r["i"] for r in rows}
    assert any(i["k1"].startswith(t.replace("{error_type}", "outliers")) for t in TASK_DESCRIPTIONS["detection"])
    assert any(d in i["k1"] for d in ERROR_TYPE_DESCRIPTIONS["outliers"])
    assert any(i["k1"].endswith(s) for s in SUFFIXES["detection"])
    assert "Unknown error type." in i["k2"]
    assert "Denial Constraint is: The a of entity 1 vs entity 2" in i["k3"]


def test_split_exact(spark):
    df = spark.range(0, 1003).select(F.col("id").cast("string").alias("entry_id"))
    s = P.split_rows(df, 0.9, seed=4)
    assert s.where("split = 'train'").count() == int(1003 * 0.9)


def test_fewshot_rules(spark):
    rows = [(f"e{i}", "outliers" if i % 3 else "missing_value", "train" if i < 20 else "test") for i in range(26)]
    rows.append(("lonely", "rule_violation", "test"))
    df = spark.createDataFrame(rows, "entry_id string, error_type string, split string") \
        .withColumn("input", F.lit("t")).withColumn("output_json", F.col("entry_id"))
    pairs = P.fewshot_pairs(df, seed=9).collect()
    types = {r[0]: r[1] for r in rows}
    split = {r[0]: r[2] for r in rows}
    per = {}
    for p in pairs:
        per.setdefault(p["entry_id"], []).append(p["ex_id"])
        assert p["ex_id"] != p["entry_id"] and split[p["ex_id"]] == "train"
        assert types[p["ex_id"]] == types[p["entry_id"]]
    for e, ex in per.items():
        assert len(set(ex)) == len(ex) <= 2
        if split[e] == "test":
            assert len(ex) == 2
    assert "lonely" not in per


def test_fragment_drops_entries_with_unknown_rows(spark):
    table = spark.createDataFrame([(str(i), f"n{i}") for i in range(20)], "row_id string, name string")
    entries = spark.createDataFrame([
        ("ok", "3", "name", "outliers", "x", ""),
        ("gone", "999", "name", "outliers", "x", ""),
        ("badpair", "3", "name", "rule_violation", "x", "(3, x)")],
        "entry_id string, row_id string, column string, error_type string, error_value string, tuple_pairs string")
    got = {r["entry_id"] for r in P.build_fragments(entries, table, k=3, seed=2).collect()}
    assert got == {"ok"}
    assert {r["entry_id"] for r in P.missing_involved(entries, table).collect()} == {"gone", "badpair"}


def test_pool_context_mode(spark):
    table = spark.createDataFrame([(str(i), f"n{i}") for i in range(50)], "row_id string, name string")
    entries = spark.createDataFrame([("a", str(i), "name", "outliers", "x", "") for i in range(1)] +
                                    [("b", "7", "name", "outliers", "x", "")],
                                    "entry_id string, row_id string, column string, error_type string, "
                                    "error_value string, tuple_pairs string")
    frags = {r["entry_id"]: r["input"] for r in P.build_fragments(entries, table, k=4, seed=3, context="pool").collect()}
    rows = {e: {line.split("|")[1].strip() for line in md.split("\n")[2:]} for e, md in frags.items()}
    assert len(rows["a"]) == 5 and len(rows["b"]) == 5
    assert len((rows["a"] - {"0"}) & (rows["b"] - {"7"})) >= 3     # mostly the same pool rows
