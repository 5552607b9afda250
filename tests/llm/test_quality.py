"""Held-out accuracy of the quality classifier, its descent against the optimum, and its edges."""

import zlib

import numpy as np
import pytest

from conftest import SF_CHECK
from tabflaw.llm import quality as Q


def auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


@pytest.mark.parametrize("folder,least", [(SF_CHECK, 0.97), ("/root/testdata/sf0.1", 0.995)])
def test_held_out_rows(prepared, folder, least):
    d, lab = prepared.read.parquet(f"{folder}/documents.parquet"), prepared.read.parquet(f"{folder}/labels.parquet")
    got = Q.classify(d, lab)
    rows = got.join(lab, "doc_id", "left").collect()
    assert len(rows) == d.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    good = np.array([r["quality"] == 1 for r in held])
    assert auc(np.array([r["score"] for r in held]), good) > least
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.96


def test_labels_of_the_held_out_fold_teach_nothing(prepared):
    d, lab = prepared.read.parquet(f"{SF_CHECK}/documents.parquet"), prepared.read.parquet(f"{SF_CHECK}/labels.parquet")
    from pyspark.sql import functions as F
    turned = lab.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in Q.classify(d, lab).collect()}
    b = {r["doc_id"]: r["score"] for r in Q.classify(d.repartition(5), turned).collect()}
    assert a == b


def test_descent_reaches_the_optimum():
    """At the optimum the duality gap closes: primal objective = dual objective."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(60)]
    good = np.array([(r < 20).sum() + rng.integers(0, 4) > 7 for r in rows])
    ratios = Q.log_ratios(rows, good)
    w, b, dual = Q.descend(rows, good, ratios, cost=1.0, epochs=4000, tolerance=1e-10)
    x = np.zeros((60, Q.DIM + 1))
    for k, f in enumerate(rows):
        x[k, f], x[k, -1] = ratios[f], 1.0
    x /= np.linalg.norm(x, axis=1)[:, None]
    full = np.append(w, b)
    assert np.allclose(full, x.T @ (dual * np.where(good, 1, -1)))
    primal = full @ full / 2 + np.maximum(0, 1 - np.where(good, 1, -1) * (x @ full)).sum()
    assert abs(primal - (dual.sum() - full @ full / 2)) < 1e-6


def test_ratios_by_hand():
    rows = [np.array([0, 1], np.int32), np.array([1], np.int32), np.array([2], np.int32)]
    r = Q.log_ratios(rows, np.array([True, True, False]))
    n1, n0 = 3 + Q.DIM, 1 + Q.DIM
    assert np.allclose(r[:4], [np.log(2 / n1 * n0), np.log(3 / n1 * n0), np.log(1 / n1 / 2 * n0), np.log(n0 / n1)])


def test_pieces_have_the_features_of_the_whole(monkeypatch):
    text = "Ab  cd cd cd cd cd, ef\n cd \U0001F600é " * 40 + "x" * 50
    whole = Q.features(text)
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(Q, "PIECE", piece)
        assert (Q.features(text) == whole).all()


def test_edges(prepared, docs):
    spark = prepared
    d = docs([(k, "good text here" if k % 2 else "bad ### bad ###") for k in range(60)] + [(100, None), (101, ""), (102, "é" * 300_000), (None, "good"), (1, "zz")])
    lab = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(2, 0), (3, 0), (5, None), (7, 9), (None, 1), (200, 1)], "doc_id long, quality int")
    got = Q.classify(d.selectExpr("*", "1 as id", "true as good", "5 as score", "6 as f"), lab).collect()
    assert len(got) == 65
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 1}
    assert by[9]["predicted"] == 1 and by[8]["predicted"] == 0
    assert by[100]["score"] == by[101]["score"] and by[None]["held_out"] is False
    assert Q.classify(docs([]), lab).collect() == []
    assert {r["score"] for r in Q.classify(d, lab.filter("false")).collect()} == {0.5}
    assert {r["score"] for r in Q.classify(d, lab.filter("quality = 1")).collect()} == {1.0}


def test_sample_is_bounded(prepared):
    lab = prepared.range(500).selectExpr("id as doc_id", "cast(id % 5 > 0 as int) as quality")
    got = Q.labelled_sample(lab, "doc_id", "quality", 30).groupBy("good").count().collect()
    assert {r["good"]: r["count"] for r in got} == {True: 30, False: 30}
