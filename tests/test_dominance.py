"""Order rules and pairs across columns against all pairs of small tables."""

import itertools
import operator
import random

import numpy as np
import pytest

from conftest import SF_SMALL
from tabflaw.operators import constraints as C
from tabflaw.operators import dominance as D
from tabflaw.plans.q_constraints import CROSS_RULES
from tabflaw.sources.tables import read_table

OPS = {"LT": operator.lt, "GT": operator.gt, "LTE": operator.le, "GTE": operator.ge, "IQ": operator.ne}


def holds(rule, a, b):
    for p in C.parse_rule(rule):
        x, y = a[p.left], b[p.right]
        if p.op == "EQ":
            if x != y:
                return False
        elif x is None or y is None or not OPS[p.op](x, y):
            return False
    return True


def brute(rule, rows):
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if holds(rule, a, b) or holds(rule, b, a)]
    groups = {}
    for a, _ in pairs:
        groups[a["g"]] = groups.get(a["g"], 0) + 1
    return sorted(groups.values()), sorted({r["row_id"] for p in pairs for r in p})


def table(spark, n, hot, seed=1):
    rng = random.Random(seed)
    rows = [{"row_id": k, "g": "hot" if rng.random() < hot else rng.choice(["a", "b", None]), "a": rng.choice([None, *range(9)]),
             "b": rng.choice([None, *range(7)]), "s": rng.choice(["x", "Y", "z", "", "é"])} for k in range(n)]
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g string, a int, b int, s string").repartition(3)


RULES = ["EQ(t1.g,t2.g)&LT(t1.a,t2.a)&GT(t1.b,t2.b)", "EQ(t1.g,t2.g)&LTE(t1.a,t2.a)&GTE(t1.b,t2.b)", "EQ(t1.g,t2.g)&GTE(t1.s,t2.s)&LT(t1.a,t2.a)",
         "EQ(t1.g,t2.g)&LT(t1.a,t2.a)&GT(t1.a,t2.a)", "EQ(t1.g,t2.g)&LTE(t1.a,t2.a)&GTE(t1.a,t2.a)",
         "EQ(t1.g,t2.g)&LT(t1.a,t2.b)", "EQ(t1.g,t2.g)&GTE(t1.b,t2.a)", "EQ(t1.g,t2.g)&IQ(t1.a,t2.b)"]


@pytest.mark.parametrize("rule", RULES)
def test_counts_and_rows_like_all_pairs(spark, monkeypatch, rule):
    """Blocks of 4 and nodes of 3 children, so a hot group goes over four levels and all tasks."""
    monkeypatch.setattr(D, "BLOCK", 4)
    monkeypatch.setattr(D, "FAN", 3)
    rows, df = table(spark, 150, 0.6)
    counts, ids = brute(rule, rows)
    assert sorted(int(r["n_pairs"]) for r in C.violation_counts(df, rule).collect()) == counts
    assert sorted(r["row_id"] for r in C.violation_rows(df, rule).collect()) == ids


def test_large_hot_group(spark):
    """One group of 6,000 rows in the blocks of real use: counts as numpy finds them."""
    import numpy as np
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 500, 6000), rng.integers(0, 300, 6000)
    df = spark.createDataFrame([(i, "g", int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "row_id long, g string, a int, b int")
    want = int(((a[:, None] < a[None, :]) & (b[:, None] > b[None, :])).sum())
    r, = C.violation_counts(df, "EQ(t1.g,t2.g)&LT(t1.a,t2.a)&GT(t1.b,t2.b)").collect()
    assert int(r["n_pairs"]) == want and r["n_rows"] == 6000


def test_empty_tables_and_rejected_rules(spark):
    _, df = table(spark, 5, 0.5)
    empty = df.where("false")
    for rule in RULES:
        assert C.violation_counts(empty, rule).collect() == [] and C.violation_rows(empty, rule).collect() == []
    assert C.pick_pairs(empty, "EQ(t1.a,t2.b)").collect() == []
    for rule in ("EQ(t1.g,t2.g)&LT(t1.a,t2.b)&GT(t1.b,t2.a)", "LT(t1.a,t2.a)&GT(t1.b,t2.b)"):
        with pytest.raises(ValueError):
            C.violation_counts(df, rule)


def check_pairs(rows, key, rule, got):
    """Candidate pairs, no row twice, and none left between two unused rows."""
    by = {r[key]: r for r in rows}
    used = [x for p in got for x in p]
    assert len(used) == len(set(used))
    assert all(holds(rule, by[x], by[y]) or holds(rule, by[y], by[x]) for x, y in got)
    left, right = C._eq_sides(rule)
    free = [r for r in rows if r[key] not in set(used)]
    at = {}
    for r in free:
        at.setdefault(tuple(r[c] for c in right), []).append(r[key])
    assert not [r[key] for r in free for y in at.get(tuple(r[c] for c in left), []) if y != r[key]]


@pytest.mark.parametrize("rule", ["EQ(t1.a,t2.b)", "EQ(t1.a,t2.b)&EQ(t1.b,t2.a)", "EQ(t1.g,t2.g)&EQ(t1.a,t2.b)"])
def test_pick_pairs_across_columns(spark, rule):
    rows, df = table(spark, 120, 0.4, 3)
    got = [(r["row_id_1"], r["row_id_2"]) for r in C.pick_pairs(df, rule).collect()]
    assert got
    check_pairs(rows, "row_id", rule, got)
    assert sorted(got) == sorted((r["row_id_1"], r["row_id_2"]) for r in C.pick_pairs(df.repartition(7), rule).collect())


def test_one_hot_value_is_matched_at_once(spark):
    df = spark.range(1000).selectExpr("id as row_id", "1 as a", "if(id < 400, 1, 2) as b")
    got = C.pick_pairs(df, "EQ(t1.a,t2.b)").collect()
    used = {x for r in got for x in (r["row_id_1"], r["row_id_2"])}
    assert len(used) == 2 * len(got) and set(range(400)) <= used


def test_given_cross_rules(spark):
    for t, key, rule in CROSS_RULES:
        df = read_table(spark, SF_SMALL, t)
        got = [(r["row_id_1"], r["row_id_2"]) for r in C.pick_pairs(df, rule, key=key).collect()]
        check_pairs([r.asDict() for r in df.collect()], key, rule, got)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 300])
def test_larger_before_like_all_pairs(n):
    """A block is counted by halving, not by comparing all its points (with ties, and points that are no data)."""
    rng = random.Random(n)
    values, data = [rng.randrange(9) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
    want = [sum(data[j] and values[j] > values[i] for j in range(i)) for i in range(n)]
    assert D.larger_before(np.array(values, np.int64), np.array(data, bool)).tolist() == want


@pytest.mark.parametrize("op", ["LT", "GTE", "IQ"])
def test_rows_of_one_predicate_need_no_dominance_counts(spark, monkeypatch, op):
    """Aggregates of the other rows tell who has a partner; rows and keys repeat, ends are held once and more often."""
    monkeypatch.setattr(D, "dominance_counts", None)
    rows, _ = table(spark, 60, 0.5)
    rows += [dict(r) for r in rows[:9]] + [{"row_id": 900 + k, "g": g, "a": a, "b": b, "s": ""} for k, (g, a, b) in enumerate(
        [("one", 1, 2), ("two", 5, 9), ("two", 7, 3), ("same", 4, 4), ("same", 4, 4), ("nulls", None, 1), ("nulls", 1, None)])]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id long, g string, a int, b int, s string")
    for rule in (f"EQ(t1.g,t2.g)&{op}(t1.a,t2.b)", f"EQ(t1.g,t2.g)&{op}(t1.b,t2.a)"):
        _, ids = brute(rule, rows)
        assert sorted(r["row_id"] for r in D.order_violation_rows(df, rule).collect()) == ids
