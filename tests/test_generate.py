"""Budget arithmetic, greedy conflict rounds vs sequential greedy, exact quotas, generation invariants."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabflaw.operators import generate as G
from tabflaw.operators.cells import apply_errors, cell_diff
from tabflaw.plans import fixtures as fx


def test_budget_matches_python_arithmetic(spark):
    clean = fx.customer_clean(spark, SF_SMALL)
    rows = clean.count()
    for ratio, ratios in ((0.1, "1:1:1:1"), (0.2, "1:2:4:3"), (0.37, "3:0:5:1")):
        total = int(ratio * rows * len(clean.columns))
        w = [int(x) for x in ratios.split(":")]
        want = {t: int(total * (w[i] / sum(w))) for i, t in enumerate(G.ERROR_TYPES)}
        got = {r["error_type"]: r["quota"] for r in G.error_budget(clean, ratio, ratios).collect()}
        assert got == want


def test_bad_ratio_string():
    with pytest.raises(ValueError):
        G.parse_ratios("1:2:3")


def _greedy(cands):
    used, keep = set(), set()
    for c in sorted(cands, key=lambda c: c["priority"]):
        if not (c["cells"] & used):
            keep.add(c["id"])
            used |= c["cells"]
    return keep


def test_conflict_free_equals_sequential_greedy(spark):
    rnd = random.Random(5)
    cands, rows = [], []
    for i in range(80):
        rule = rnd.random() < 0.4
        a, b = rnd.randrange(15), rnd.randrange(15)
        col = rnd.choice(["x", "y"])
        prio = f"{rnd.random():.12f}"
        if rule:
            cells = {(str(a), col), (str(b), col), (str(a), G.ROW_RESOURCE), (str(b), G.ROW_RESOURCE)}
            tp, et = f"({a}, {b})", "rule_violation"
        else:
            cells = {(str(a), col)}
            tp, et = "", "outliers"
        cands.append({"id": f"{prio}#{a}#{col}", "priority": prio, "cells": cells})
        rows.append((str(a), col, et, tp, prio))
    df = spark.createDataFrame(rows, "row_id string, column string, error_type string, tuple_pairs string, priority string")
    got = {f"{r['priority']}#{r['row_id']}#{r['column']}" for r in G.conflict_free(df).collect()}
    assert got == _greedy(cands)


def test_quota_select_exact(spark):
    rows = [(f"r{i}", t, f"{random.Random(i).random():.10f}") for i in range(400)
            for t in ("outliers", "missing_value")]
    df = spark.createDataFrame(rows, "row_id string, error_type string, priority string")
    budget = spark.createDataFrame([("outliers", 37), ("missing_value", 500)], "error_type string, quota long")
    got = G.quota_select(df, budget, prefix=3)
    for t, q in (("outliers", 37), ("missing_value", 400)):
        want = sorted(p for _, tt, p in rows if tt == t)[:q]
        assert sorted(r["priority"] for r in got.where(F.col("error_type") == t).collect()) == want


def test_generation_invariants(spark):
    clean = fx.customer_clean(spark, SF_SMALL)
    rule = ["EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)",
            "EQ(t1.c_mktsegment,t2.c_mktsegment)&IQ(t1.c_nationkey,t2.c_nationkey)"]
    log = G.generate_errors(clean, 0.2, "1:2:4:3", rule=rule, seed=3).cache()
    budget = {r["error_type"]: r["quota"] for r in G.error_budget(clean, 0.2, "1:2:4:3").collect()}
    counts = {r["error_type"]: r["count"] for r in log.groupBy("error_type").count().collect()}
    short = {r["error_type"]: r["missing"] for r in G.shortfall(log, G.error_budget(clean, 0.2, "1:2:4:3")).collect()}
    assert all(counts.get(t, 0) == q for t, q in budget.items() if t != "rule_violation")
    assert all(short[t] == q - counts.get(t, 0) for t, q in budget.items())
    assert log.groupBy("row_id", "column").count().where("count > 1").count() == 0
    assert log.where(F.col("error_value").eqNullSafe(F.col("right_value"))).count() == 0
    rule_rows = [int(x) for r in log.where("error_type = 'rule_violation'").collect()
                 for x in r["tuple_pairs"].strip("()").split(", ")]
    assert len(rule_rows) == len(set(rule_rows))            # no row in two accepted pairs
    assert log.where("error_type = 'rule_violation'").select("constraint").distinct().count() >= 1
    dirty = apply_errors(clean, log, order_col=None)
    changed = {(r["row_id"], r["column"]) for r in cell_diff(clean, dirty).collect()}
    assert changed == {(r["row_id"], r["column"]) for r in log.collect()}


@pytest.mark.parametrize("ratio,ratios", [(0.2, "1:2:4:3"), (0.7, "1:1:1:0"), (0.7, "4:4:2:0")])
def test_every_type_gets_its_quota_or_all_eligible_cells(spark, ratio, ratios):
    clean = fx.orders_clean(spark, SF_SMALL)
    quota = {r["error_type"]: r["quota"] for r in G.error_budget(clean, ratio, ratios).collect()}
    log = G.generate_errors(clean, ratio, ratios, seed=5)
    got = {r["error_type"]: r["count"] for r in log.groupBy("error_type").count().collect()}
    rows = clean.collect()
    cells = [r[c] for r in rows for c in clean.columns if c != "row_id" and r[c] is not None]
    numeric = sum(1 for v in cells if _is_float(v) and float(v) != 0)
    outliers = min(quota["outliers"], numeric)
    pattern = min(quota["pattern_violation"], len(cells) - outliers)
    missing = min(quota["missing_value"], len(cells) - outliers - pattern)
    assert (got.get("outliers", 0), got.get("pattern_violation", 0), got.get("missing_value", 0)) == (outliers, pattern, missing)
    assert log.groupBy("row_id", "column").count().where("count > 1").count() == 0


def _is_float(v):
    try:
        float(v)
        return True
    except ValueError:
        return False


def test_radix_selection_is_exact(spark):
    import hashlib
    pri = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(3000))
    df = spark.createDataFrame([(p,) for p in pri], "priority string")
    for k in (1, 2, 77, 1500, 2999, 3000):
        assert G._kth(df, k, few=2) == pri[k - 1]
    assert G._kth(df, 3001, few=2) is None


def test_bad_values_do_not_end_the_job(spark):
    rows = [("1", "2023-13-45"), ("2", "99999999999999999999"), ("3", "9" * 60), ("4", "0"), ("x5", "2023-02-30"),
            ("6", ""), ("7", None), (None, "v"), ("8", "-12"), ("9", "nan")]
    df = spark.createDataFrame(rows, "row_id string, a string")
    for ratios in ("1:0:0:0", "0:0:1:0", "0:1:0:0"):
        assert G.generate_errors(df, 1.0, ratios, seed=1).count() > 0
    got = {r["right_value"]: r["error_value"] for r in G.generate_errors(df, 1.0, "1:0:0:0").collect()}
    assert got["99999999999999999999"] == "9999999999999999999900" and got["9" * 60] == "9" * 60 + "00" and got["-12"] == "-1200"
    assert "0" not in got                                       # scaling changes nothing
    rule = "EQ(t1.a,t2.a)&IQ(t1.b,t2.b)"
    t = spark.createDataFrame([("1", "g", "p"), ("bad", "g", "q"), ("3", "g", "q")], "row_id string, a string, b string")
    assert G.generate_errors(t, 1.0, "0:0:0:1", rule=rule).count() == 1


def test_conflicts_use_the_cells_that_a_constraint_names(spark):
    rows = [("1", "a", "rule_violation", "(1, 2)", "The b of Row 1 and the b of Row 2: The b of Row 1 is equal to The b of Row 2", "0a"),
            ("2", "b", "outliers", "", "", "0b"), ("2", "c", "outliers", "", "", "0c"), ("2", "c", "outliers", "", "", "0c"),
            ("2", "c", "pattern_violation", "", "", "0c")]
    df = spark.createDataFrame(rows, "row_id string, column string, error_type string, tuple_pairs string, constraint string, priority string")
    got = sorted((r["row_id"], r["column"]) for r in G.conflict_free(df).collect())
    assert got == [("1", "a"), ("2", "c")]                      # (2, b) is a cell of the rule; of the ties one stays
    singles = df.where("error_type <> 'rule_violation'")
    assert sorted((r["row_id"], r["column"]) for r in G.conflict_free(singles).collect()) == [("2", "b"), ("2", "c")]


def test_conflict_chains_are_resolved(spark):
    rows = [(str(i), "x", "rule_violation", f"({i}, {i + 1})", "", f"{i:06d}") for i in range(24)]
    df = spark.createDataFrame(rows, "row_id string, column string, error_type string, tuple_pairs string, constraint string, priority string")
    assert sorted(int(r["row_id"]) for r in G.conflict_free(df).collect()) == list(range(0, 24, 2))


def test_priorities_of_any_kind(spark):
    rows = [("1", "outliers", None), ("2", "outliers", "zz"), ("3", "outliers", "é"), ("4", "outliers", "0"), ("5", "outliers", None)]
    df = spark.createDataFrame(rows, "row_id string, error_type string, priority string")
    for quota, want in ((1, {"4"}), (2, {"4", "2"}), (9, {"1", "2", "3", "4", "5"})):
        b = spark.createDataFrame([("outliers", quota)], "error_type string, quota long")
        assert {r["row_id"] for r in G.quota_select(df, b).collect()} == want


def _toy_model(prompts):
    """Stands in for a language model: edits the first data row's second column."""
    import json
    out = []
    for p in prompts:
        lines = p.split("Input:\n", 1)[1].split("\n")
        head = [c.strip() for c in lines[0].strip("|").split("|")]
        first = [c.strip() for c in lines[2].strip("|").split("|")]
        et = "rule_violation" if "Denial Constraint is:" in p else \
            next(t for t in G.ERROR_TYPES if f"a {t} error" in p or f"{t} error" in p)
        rec = {"row_id": first[0], "column": head[1], "error_type": et, "error_value": first[1] + "!",
               "right_value": first[1]}
        out.append("Sure.\nAssistant: " + json.dumps(rec) + "\nDone")
    return out


def test_generation_prompts_and_model_loop(spark):
    import sys

    from pyspark import cloudpickle
    from tabflaw.plans.generation import generate_with_model, generation_prompts
    cloudpickle.register_pickle_by_value(sys.modules[__name__])   # ship the toy model by value
    clean = fx.customer_clean(spark, SF_SMALL)
    rule = "EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)"
    budget = G.error_budget(clean, 0.2, "1:2:4:3")
    prompts = generation_prompts(clean, budget, rule=rule, seed=1).cache()
    quotas = {r["error_type"]: r["quota"] for r in budget.collect()}
    counts = {r["error_type"]: r["count"] for r in prompts.groupBy("error_type").count().collect()}
    assert counts["missing_value"] == quotas["missing_value"]
    assert 0 < counts.get("rule_violation", 0) <= quotas["rule_violation"]
    p = prompts.where("error_type = 'rule_violation'").first()["prompt"]
    assert p.startswith("User:\n") and p.endswith("\nAssistant:\n")
    assert "Denial Constraint is: The c_nationkey of entity 1 is equal to" in p
    table_text = p.split("Input:\n", 1)[1].rsplit("\nAssistant:", 1)[0]
    assert len(table_text.split("\n")) == 2 + 5     # header, rule line, the pair + 3 rows
    log = generate_with_model(clean, _toy_model, 0.2, "1:2:4:3", rule=rule, seed=1).cache()
    assert log.count() > 0
    assert log.groupBy("row_id", "column").count().where("count > 1").count() == 0
    assert log.where(F.col("error_value").eqNullSafe(F.col("right_value"))).count() == 0


def test_completion_status(spark):
    comps = spark.createDataFrame([
        ("a", 'Assistant: {"row_id": "1", "column": "x", "error_type": "outliers"}'),
        ("b", 'Assistant: {"row_id": "1", "column": "x", "error_type": "missing_value"}'),
        ("c", "no answer")], "entry_id string, completion string")
    req = spark.createDataFrame([("a", "outliers"), ("b", "outliers"), ("c", "outliers")],
                                "entry_id string, error_type string")
    got = {r["entry_id"]: r["status"] for r in G.completion_status(comps, req).collect()}
    assert got == {"a": "ok", "b": "type_mismatch", "c": "parse_error"}
