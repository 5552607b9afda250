"""Denial constraints: text forms, id parsing, pair groups vs brute force, golden counts."""

import itertools

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabflaw.functions import constraints as CF
from tabflaw.operators import constraints as C
from tabflaw.operators.annotations import rule_cells
from tabflaw.sources.tables import read_table


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_dc_to_text_hyphen_and_unknown(spark):
    t = _one(spark, CF.dc_to_text, "EQ(t1.beer-name,t2.beer-name)&IQ(t1.abv,t2.abv)&XX(t1.a,t2.a)")
    assert t == ("The beer-name of entity 1 is equal to the beer-name of entity 2 and "
                 "The abv of entity 1 is different from the abv of entity 2.")
    assert _one(spark, CF.dc_to_text, "") == "."


def test_dc_parse(spark):
    p = _one(spark, CF.dc_parse, "EQ(t1.beer-name,t2.beer-name)&LTE(t1.a,t2.b)")
    assert [(x["op"], x["left"], x["right"]) for x in p] == [("EQ", "beer-name", "beer-name"), ("LTE", "a", "b")]


def test_constraint_entities_word_boundary(spark):
    t = _one(spark, CF.constraint_entities,
             "Constraint Violation: The city of Row 1 is different from the city of Row 12")
    assert t == "Denial Constraint is: The city of entity 1 is different from the city of entity 2"
    assert _one(spark, CF.constraint_entities, "The a of Row 3") == "Invalid constraint format."


def test_tuple_ids(spark):
    assert _one(spark, CF.tuple_ids, "(698, 704)") == [698, 704]
    assert _one(spark, CF.tuple_ids, "[5, 5, 7]") == [5, 7]
    assert _one(spark, CF.tuple_ids_strict, "(698, 704, 9)") == [698, 704]
    assert _one(spark, CF.tuple_ids_strict, "(698, x)") is None


def test_rule_cells(spark):
    log = spark.createDataFrame(
        [("3", "(3, 7)", "The city of Row 3 differs from The city of Row 7 and The zip of Row 3")],
        "row_id string, tuple_pairs string, constraint string")
    got = {(r["row_id"], r["column"]) for r in rule_cells(log).collect()}
    assert got == {("3", "city"), ("7", "city"), ("3", "zip"), ("7", "zip")}


def _brute_pairs(rows, eq):
    out = set()
    for a, b in itertools.combinations(rows, 2):
        if all(a[c] == b[c] for c in eq):          # None == None: null keys match
            out.add(tuple(sorted((a["row_id"], b["row_id"]))))
    return out


def test_pair_groups_vs_brute_force(spark):
    rows = [{"row_id": i, "a": a, "b": b} for i, (a, b) in enumerate(
        [("x", 1), ("x", 1), ("x", 2), (None, 1), (None, 1), ("y", None), ("y", None), ("y", 3)])]
    df = spark.createDataFrame([(r["row_id"], r["a"], r["b"]) for r in rows], "row_id long, a string, b int")
    rule = "EQ(t1.a,t2.a)&EQ(t1.b,t2.b)"
    groups = C.pair_groups(df, rule).collect()
    assert sum(int(g["n_pairs"]) for g in groups) == len(_brute_pairs(rows, ["a", "b"]))
    members = {r["row_id"] for r in C.pair_members(df, rule).collect()}
    assert members == {i for p in _brute_pairs(rows, ["a", "b"]) for i in p}
    strict = C.pair_groups(df, rule, null_keys_match=False).collect()
    assert sum(int(g["n_pairs"]) for g in strict) == 1


def test_violations_vs_brute_force(spark):
    rows = [(0, "x", "p"), (1, "x", "q"), (2, "x", "q"), (3, "x", None), (4, "y", "p"), (5, "y", "p")]
    df = spark.createDataFrame(rows, "row_id long, a string, s string")
    for op, pred in (("IQ", lambda u, v: u != v), ("LT", lambda u, v: u != v),
                     ("GTE", lambda u, v: True)):
        rule = f"EQ(t1.a,t2.a)&{op}(t1.s,t2.s)"
        want = sum(1 for r1, r2 in itertools.combinations(rows, 2)
                   if r1[1] == r2[1] and r1[2] is not None and r2[2] is not None and pred(r1[2], r2[2]))
        got = sum(int(r["n_pairs"]) for r in C.violation_counts(df, rule).collect())
        assert got == want, op
    vr = {r["row_id"] for r in C.violation_rows(df, "EQ(t1.a,t2.a)&IQ(t1.s,t2.s)").collect()}
    assert vr == {0, 1, 2}


def test_rule_without_eq_rejected():
    with pytest.raises(ValueError):
        C.eq_columns("IQ(t1.a,t2.a)")


def test_golden_pair_counts_sf0001(spark):
    cust = read_table(spark, SF_SMALL, "customer").withColumnRenamed("c_custkey", "row_id")
    docs = read_table(spark, SF_SMALL, "documents").withColumnRenamed("doc_id", "row_id")
    part = read_table(spark, SF_SMALL, "part").withColumnRenamed("p_partkey", "row_id")

    def total(df, rule):
        return sum(int(r["n_pairs"]) for r in C.pair_groups(df, rule).collect())

    assert total(cust, "EQ(t1.c_nationkey,t2.c_nationkey)") == 447
    assert total(cust, "EQ(t1.c_nationkey,t2.c_nationkey)&EQ(t1.c_mktsegment,t2.c_mktsegment)") == 88
    assert total(docs, "EQ(t1.text,t2.text)") == 12
    assert total(part, "EQ(t1.p_name,t2.p_name)") == 312
    v = sum(int(r["n_pairs"]) for r in C.violation_counts(docs, "EQ(t1.text,t2.text)&IQ(t1.source,t2.source)").collect())
    assert v == 10


def test_pick_pairs_disjoint_and_valid(spark):
    cust = read_table(spark, SF_SMALL, "customer").withColumnRenamed("c_custkey", "row_id")
    rule = "EQ(t1.c_nationkey,t2.c_nationkey)"
    pairs = C.pick_pairs(cust, rule, seed=3).collect()
    ids = [p["row_id_1"] for p in pairs] + [p["row_id_2"] for p in pairs]
    assert len(ids) == len(set(ids))
    sizes = [r["count"] for r in cust.groupBy("c_nationkey").count().collect()]
    assert len(pairs) == sum(n // 2 for n in sizes)      # only odd groups leave a row
    nation = {r["row_id"]: r["c_nationkey"] for r in cust.collect()}
    assert all(nation[p["row_id_1"]] == nation[p["row_id_2"]] and p["row_id_1"] < p["row_id_2"] for p in pairs)


def test_multi_predicate_violations_vs_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.choice("xy"), rnd.choice([None, "p", "q", "r"]), rnd.choice([1, 2, 3]), rnd.choice([None, 5, 6]))
            for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, g string, a string, b int, c int")
    cases = {
        "EQ(t1.g,t2.g)&IQ(t1.a,t2.a)&IQ(t1.b,t2.b)": lambda r, s: r[2] != s[2] and r[3] != s[3],
        "EQ(t1.g,t2.g)&IQ(t1.a,t2.a)&LT(t1.b,t2.b)": lambda r, s: r[2] != s[2] and r[3] != s[3],
        "EQ(t1.g,t2.g)&IQ(t1.a,t2.a)&GTE(t1.c,t2.c)": lambda r, s: r[2] != s[2],
        "EQ(t1.g,t2.g)&IQ(t1.a,t2.a)&IQ(t1.b,t2.b)&IQ(t1.c,t2.c)":
            lambda r, s: r[2] != s[2] and r[3] != s[3] and r[4] != s[4],
    }
    for rule, pred in cases.items():
        cols = {"IQ(t1.a": 2, "(t1.b": 3, "(t1.c": 4}
        used = [i for tag, i in cols.items() if tag in rule]

        def ok(r):
            return all(r[i] is not None for i in used)
        want_pairs = [(r, s) for r, s in itertools.combinations(rows, 2)
                      if r[1] == s[1] and ok(r) and ok(s) and pred(r, s)]
        got = sum(int(x["n_pairs"]) for x in C.violation_counts(df, rule).collect())
        assert got == len(want_pairs), rule
        want_rows = {r[0] for p in want_pairs for r in p}
        assert {x["row_id"] for x in C.violation_rows(df, rule).collect()} == want_rows, rule
    with pytest.raises(ValueError):
        C.violation_spec("EQ(t1.g,t2.g)&LT(t1.a,t2.a)&GT(t1.b,t2.b)")


def test_cross_column_pairs_vs_brute_force(spark):
    import random
    rnd = random.Random(11)
    rows = [(i, rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, 3, None]), rnd.choice(["u", "v"])) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, a int, b int, g string")
    for rule, cond in (
            ("EQ(t1.a,t2.b)", lambda x, y: x[1] == y[2]),
            ("EQ(t1.g,t2.g)&EQ(t1.a,t2.b)", lambda x, y: x[3] == y[3] and x[1] == y[2]),
            ("EQ(t1.a,t2.a)", lambda x, y: x[1] == y[1])):
        want = {tuple(sorted((x[0], y[0]))) for x in rows for y in rows if x[0] != y[0] and cond(x, y)}
        got = int(C.cross_pair_count(df, rule).first()["n_pairs"])
        assert got == len(want), rule
        members = {r["row_id"] for r in C.cross_pair_members(df, rule).collect()}
        assert members == {i for p in want for i in p}, rule


def test_values_with_separators_and_null_words_share_no_group(spark):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, "<null>", "x"), (4, None, "x"), (5, "1:a", ""), (6, "1:a", None),
            (7, "n", "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string")
    rule = "EQ(t1.a,t2.a)&EQ(t1.b,t2.b)"
    assert [tuple(sorted((r["row_id_1"], r["row_id_2"]))) for r in C.pick_pairs(df, rule).collect()] == [(4, 8)]
    assert {r["row_id"] for r in C.pair_members(df, rule).collect()} == {4, 8}
    assert sum(int(r["n_pairs"]) for r in C.pair_groups(df, rule).collect()) == 1


def test_ids_that_are_no_integers_take_no_part_in_pairs(spark):
    df = spark.createDataFrame([("1", "g"), ("x", "g"), ("2", "g"), (None, "g")], "row_id string, a string")
    assert [(r["row_id_1"], r["row_id_2"]) for r in C.pick_pairs(df, "EQ(t1.a,t2.a)").collect()] == [(1, 2)]
