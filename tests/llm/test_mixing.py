"""Targets by a plain loop, rounding near them, expectations kept."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from tabflaw.llm import mixing


def plain_targets(sizes):
    """sizes: source -> words. Shares by weight; the excess over the cap is shared again until none is above."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while free and left > 1e-6:
        w = sum(weight[s] for s in free)
        for s in free:
            goal[s] += left * weight[s] / w
        left = sum(max(0, goal[s] - 2 * sizes[s]) for s in free)
        for s in list(free):
            if goal[s] >= 2 * sizes[s]:
                goal[s] = 2.0 * sizes[s]
                free.discard(s)
    return goal


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, texts):
    """rows: of mix; texts: (doc_id, text, source)."""
    sizes, largest = {}, {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + n_words(t)
        largest[s] = max(largest.get(s, 0), n_words(t))
    goal = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s], abs=1e-6)
        assert r["taken"] <= 2 * r["size"] and (r["taken"] == 0 if not r["size"] else r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(repr, ((r["doc_id"], r["size"]) for r in rows))) == sorted(map(repr, ((d, n_words(t)) for d, t, _ in texts)))


@pytest.mark.parametrize("chunk", [1024, 4])
def test_documents(prepared, chunk):
    d = prepared.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = mixing.mix(d, chunk=chunk).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in d.collect()])
    assert sorted(map(tuple, mixing.mix(d.repartition(5), chunk=chunk).collect())) == sorted(map(tuple, rows))


def test_expectations_are_kept(docs, prepared):
    rows = [(k, "w " * (1 + k % 9), None, "ab"[k % 5 == 0]) for k in range(300)]
    d = docs(rows)
    got = []
    for seed in range(6):
        got += [(r["taken"] / r["size"], r["target"] / r["source_size"], r["source"]) for r in
                mixing.mix(d, key=F.xxhash64("text", F.lit(seed))).collect()]
    for s in "ab":
        mine = [(a, b) for a, b, x in got if x == s]
        assert np.mean([a for a, _ in mine]) == pytest.approx(mine[0][1], abs=0.1)


def test_edges(docs, prepared):
    rows = [(1, None, None, "a"), (2, "", None, None), (3, "x y", None, None), (3, "x y", None, None), (4, "x\x0by\x1fz", None, "é"),
            (None, "lone", None, "z"), (None, None, None, "z"), (5, "w " * 4000, None, "b")]
    d = docs(rows).withColumn("key", F.lit("clash")).withColumn("target", F.lit(0))
    check(mixing.mix(d).collect(), [(r[0], r[1], r[3]) for r in rows])
    out = mixing.apply_mix(d)
    assert out.columns == d.columns
    taken = {}
    for r in mixing.mix(d, key=F.xxhash64(*[F.col(c) for c in d.columns])).collect():
        if r["size"]:
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"] // r["size"]
    copies = {}
    for r in out.collect():
        if n_words(r["text"]):
            copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {k: v for k, v in taken.items() if v}
    assert mixing.mix(d.filter("doc_id < 0")).count() == 0
    assert mixing.apply_mix(d.filter("doc_id < 0")).count() == 0


def test_rows_that_differ_only_in_where_the_null_stands(docs, prepared):
    d = docs([(1, "a b c", "en", None), (1, "a b c", None, "en"), (2, "a b c", "en", None), (None, "2", "en", "x"), (2, None, "en", "x")])
    out = [tuple(r) for r in mixing.apply_mix(d).collect()]
    want = {}
    for r in mixing.mix(d, key=mixing.row_digest(d.columns)).collect():
        want[r["doc_id"], r["size"], r["source"]] = r["copies"]
    got = {}
    for r in out:
        k = (r[0], n_words(r[1]), r[3])
        got[k] = got.get(k, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert (1, "a b c", None, "en", 5) in out and out.count((1, "a b c", "en", None, 5)) <= 2


def test_equal_short_hashes_lose_no_row(docs, prepared, monkeypatch):
    """Rows are known by their digest; that the random numbers are equal does not matter."""
    monkeypatch.setattr(mixing, "_uniform", lambda *of: F.lit(0.5))
    d = docs([(k, "w " * (1 + k % 3), None, "s") for k in range(50)])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(d, key=mixing.row_digest(d.columns)).collect()}
    got = {}
    for r in mixing.apply_mix(d).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


def test_extra_columns_of_any_name_stay(docs, prepared):
    d = docs([(k, "a b", None, "s") for k in range(6)])
    for name in ("__n", "__key", "__k", "mix_key", "mix_n", "mix_copy", "MIX_KEY", "copies", "s", "a.b", "c`d"):
        out = mixing.apply_mix(d.withColumn(name, F.lit("mine")))
        assert out.columns == [*d.columns, name] and {tuple(r)[-1] for r in out.collect()} == {"mine"}
