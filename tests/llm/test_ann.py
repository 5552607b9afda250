"""Recall against brute force, exact scores and order, defined edges."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_CHECK
from tabflaw.llm import ann


def brute(rows, k=20):
    """rows: id -> vector; per query its k nearest (id, product)."""
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    out = {}
    for q in ids:
        if q % 20 == 0:
            s = [(-float((x[n] * np.array(rows[q], float)).sum()), i) for n, i in enumerate(ids) if i != q]
            out[q] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def asked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    return np.mean([len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_and_scores(prepared):
    e = prepared.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in e.collect()}
    want, got = brute(rows), asked(ann.search(e, F.col("vec_id") % 20 == 0))
    assert set(got) == set(want) and all([r for r, _, _ in v] == list(range(1, 21)) for v in got.values())
    assert recall(got, want) >= 0.9
    for q, v in got.items():
        assert [(-s, i) for _, i, s in v] == sorted((-s, i) for _, i, s in v)
        for _, i, s in v:
            assert abs(s - float(np.dot(np.array(rows[q], float), np.array(rows[i], float)))) < 1e-12


def test_many_parts_and_blocks_are_exact_when_all_are_probed(prepared, monkeypatch):
    monkeypatch.setattr(ann, "ASKED", 7)
    rng = np.random.default_rng(2)
    rows = {int(i): rng.standard_normal(8).round(1).tolist() for i in range(-300, 900)}
    rows.update({i: [1.0] * 8 for i in range(900, 1400)})            # one very common vector
    df = prepared.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    got = asked(ann.search(df, F.col("vec_id") % 20 == 0, parts=8, block=64, probes=8))
    want = brute(rows)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = asked(ann.search(df, F.col("vec_id") % 20 == 0, parts=8, block=64))
    assert all(len(v) == 20 for v in few.values()) and recall(few, want) > 0.7


def test_edges(prepared):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (40, []), (60, [0.0, 0.0]), (4, [nan, 1.0]),
            (80, [inf, 1.0]), (5, [None, 1.0]), (None, [3.0, 3.0]), (6, [1.0, 2.0, 3.0]), (2, [1.0, 1.0]), (0, [0.5, 0.0])]
    df = prepared.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("part", F.lit("clash"))
    got = {q: [(i, s) for _, i, s in v] for q, v in asked(ann.search(df, F.col("vec_id") % 20 == 0)).items()}
    assert got == {0: [(1, 1.0), (2, 1.0), (20, 0.0)], 20: [(1, 2.0), (2, 2.0), (0, 0.0)]}
    assert ann.search(df.filter("vec_id > 999"), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).standard_normal((1000, 16))
    _, a = ann.neighbour_graph(x, 8)
    sizes = np.bincount(ann.balanced_parts(a, 8), minlength=8)
    assert sizes.max() - sizes.min() <= 3
