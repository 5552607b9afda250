"""Metric identities, chi-square p-values, linear text similarity vs all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabflaw.functions.udfs import chi2_sf
from tabflaw.operators import metrics as M
from tabflaw.operators.patterns import text_similarity


def _dist(spark, d):
    return spark.createDataFrame(list(d.items()), "column string, n long")


def _val(df, col):
    return df.first()[col]


def test_identities(spark):
    p = _dist(spark, {"a": 3, "b": 1, "c": 6})
    q = _dist(spark, {"a": 1, "d": 4})
    assert _val(M.dist_js(p, p), "js") == pytest.approx(0.0, abs=1e-9)
    assert _val(M.dist_kl(p, p), "kl") == pytest.approx(0.0, abs=1e-12)
    assert _val(M.dist_js(p, q), "js") == pytest.approx(_val(M.dist_js(q, p), "js"))
    assert _val(M.dist_jaccard(p, p), "jaccard") == pytest.approx(1.0, abs=1e-9)
    assert math.isinf(_val(M.dist_kl(p, q), "kl"))
    # JS distance by hand (natural log)
    keys = ["a", "b", "c", "d"]
    pp = np.array([3, 1, 6, 0]) / 10
    qq = np.array([1, 0, 0, 4]) / 5
    m = (pp + qq) / 2
    kl = lambda x, y: sum(a * math.log(a / b) for a, b in zip(x, y) if a > 0)
    assert _val(M.dist_js(p, q), "js") == pytest.approx(math.sqrt((kl(pp, m) + kl(qq, m)) / 2))
    assert keys


def test_empty_distribution(spark):
    p = _dist(spark, {"a": 3})
    e = spark.createDataFrame([], "column string, n long")
    assert _val(M.dist_kl(p, e), "kl") == 0.0


def test_chi2_pvalues():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-6)
    assert chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-6)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-6)
    assert chi2_sf(0.0, 3) == 1.0


def test_chi_square_yates(spark):
    # 2 x 2 table [[10, 20], [30, 40]] with Yates correction
    p = _dist(spark, {"a": 10, "b": 20})
    q = _dist(spark, {"a": 30, "b": 40})
    r = M.chi_square(p, q).first()
    obs = np.array([[10, 20], [30, 40]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    stat = (((np.abs(obs - exp) - 0.5) ** 2) / exp).sum()
    assert r["chi2"] == pytest.approx(stat)
    assert r["dof"] == 1
    assert r["p_value"] == pytest.approx(chi2_sf(stat, 1))


def test_cell_scores_and_legacy_recall(spark):
    real = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "row_id string, column string")
    gen = spark.createDataFrame([("1", "a"), ("9", "b")], "row_id string, column string")
    r = M.cell_scores(real, gen).first()
    assert (r["tp"], r["n_gen"], r["n_real"]) == (1, 2, 3)
    assert r["precision"] == 0.5 and r["recall"] == pytest.approx(1 / 3)
    assert M.cell_scores(real, gen, legacy_recall=True).first()["recall"] == 1.0
    rj = M.rowcol_jaccard(real, gen, "row").first()["row_jaccard"]
    assert rj == pytest.approx(1 / 4)
    assert M.rowcol_jaccard(real, gen, "bogus").first()["row_jaccard"] == pytest.approx(1 / 4)


def test_text_similarity_linear_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(7, 5))
    b = rng.normal(size=(4, 5))
    a[2] = 0.0  # zero vector contributes 0
    da = spark.createDataFrame([(v.tolist(),) for v in a], "vec array<double>")
    db = spark.createDataFrame([(v.tolist(),) for v in b], "vec array<double>")
    got = text_similarity(da, db).first()["text_similarity"]

    def cos(x, y):
        nx, ny = np.linalg.norm(x), np.linalg.norm(y)
        return 0.0 if nx == 0 or ny == 0 else float(x @ y / (nx * ny))
    want = np.mean([cos(x, y) for x in a for y in b])
    assert got == pytest.approx(want)
    empty = spark.createDataFrame([], "vec array<double>")
    assert text_similarity(da, empty).first()["text_similarity"] == 0.0


def test_numeric_and_datetime_similarity(spark):
    pairs = spark.createDataFrame([("10", "12"), ("20", "20"), ("x", "1")], "right_value string, error_value string")
    v = np.array([10.0, 20.0])
    w = np.array([12.0, 20.0])
    want = 1 - np.mean(np.abs(v - w)) / v.std()
    assert M.numeric_similarity(pairs).first()["numeric_similarity"] == pytest.approx(want)
    d = spark.createDataFrame([("2020-01-01", "2020-01-03")], "right_value string, error_value string")
    assert M.datetime_similarity(d).first()["datetime_similarity"] == pytest.approx(-1.0)
    bad = spark.createDataFrame([("2020-01-01", "never")], "right_value string, error_value string")
    assert M.datetime_similarity(bad).first()["datetime_similarity"] == 0.0


def test_knn_exact_with_ties_and_blocks(spark):
    from tabflaw.operators.patterns import knn_cosine
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 4))
    vecs = np.vstack([base, base[:6]])            # exact duplicates -> tied cosines
    vecs[3] = 0.0                                   # a zero vector never matches
    diffs = rng.normal(size=vecs.shape)
    rows = [(i, vecs[i].tolist(), diffs[i].tolist()) for i in range(len(vecs))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, diff array<double>")
    got = knn_cosine(df, df, k=3, exclude_self=True, block_rows=5).collect()   # several blocks per side
    unit = lambda m: m / np.linalg.norm(m)
    for qi in range(len(vecs)):
        if not np.linalg.norm(vecs[qi]):
            assert not [g for g in got if g["q_id"] == qi]
            continue
        cand = [(-(unit(vecs[qi]) @ unit(vecs[j])), j) for j in range(len(vecs)) if j != qi and np.linalg.norm(vecs[j])]
        want = [j for _, j in sorted(cand, key=lambda t: (round(t[0], 12), t[1]))[:3]]
        mine = [g["r_id"] for g in sorted([g for g in got if g["q_id"] == qi], key=lambda g: g["rank"])]
        assert mine == want, qi


def test_method_cells_from_mixed_sources(spark):
    from tabflaw.plans.evaluation import method_cells
    log = spark.createDataFrame([("1", "a")], "row_id string, column string")
    clean = spark.createDataFrame([("1", "x", "y"), ("2", "p", "q")], "row_id string, a string, b string")
    dirty = spark.createDataFrame([("1", "x", "Y"), ("2", "p", "q")], "row_id string, a string, b string")
    changes = spark.createDataFrame([("2.a",)], "_c0 string")
    got = sorted(tuple(r) for r in method_cells({"llm": log, "bart": (clean, dirty), "raha": changes}).collect())
    assert got == [("bart", "1", "b"), ("llm", "1", "a"), ("raha", "2", "a")]


def test_embedding_cache_and_own_embedder(spark, scratch):
    from tabflaw.operators.patterns import cached_embeddings
    from tabflaw.plans.evaluation import pattern_report, semantic_similarity
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def model(x: pd.Series) -> pd.Series:
        calls.add(len(x))
        return x.map(lambda t: [float(len(t)), 1.0])

    d = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), ("",)], "v string")
    path = f"{scratch}/cache"
    first = {r["value"]: r["vec"] for r in cached_embeddings(d.limit(1), path, model, "v").collect()}
    assert first == {"a": [1.0, 1.0]} and calls.value == 1
    for _ in range(2):
        got = {r["value"]: r["vec"] for r in cached_embeddings(d, path, model, "v").collect()}
        assert got == {"a": [1.0, 1.0], "bb": [2.0, 1.0], "": [0.0, 1.0]} and calls.value == 3
    log = spark.createDataFrame([("1", "c", "red", "re"), ("2", "c", "blue", "bluee"), ("3", "c", "tan", "ta")],
                                "row_id string, column string, right_value string, error_value string")
    own = pattern_report(log, log, ks=(1, 3), embed=lambda x: F.array(F.length(x).cast("double"), F.lit(1.0)))
    assert [round(r["pattern_similarity"] if "pattern_similarity" in own.columns else r[1], 6) for r in own.collect()] == [1.0, 1.0]
    one = lambda x: F.array(F.lit(1.0), F.lit(0.0))
    assert semantic_similarity(log, log, embed=one).first()["semantic_similarity"] == 0.5


def test_knn_of_equal_vectors_in_parts(spark):
    """Parts of 16 vectors, few different ones: neighbours by (cosine, id), each record a query of its own, pairs of parts dealt one to a task."""
    from tabflaw.operators.patterns import knn_cosine
    vecs = [[1.0, 0.0, 2.0], [0.0, 3.0, 1.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]]
    refs = [(100 + (i * 37) % 90, vecs[i % 3], [float(i % 2), 1.0, 0.0]) for i in range(90)]
    queries = [(i, vecs[i % 4], [1.0, float(i % 3), 0.0]) for i in range(60)]
    schema = "id long, vec array<double>, diff array<double>"
    df = knn_cosine(spark.createDataFrame(queries, schema), spark.createDataFrame(refs, schema), k=4, block_rows=2)
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan and "MapInArrow" in plan

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = []
    for q, v, d in queries:
        if any(v):
            near = sorted((-round(cos(v, w), 9), r, round(cos(d, e), 9)) for r, w, e in refs)[:4]
            want += [(q, n, r, -c, p) for n, (c, r, p) in enumerate(near, 1)]
    got = sorted((r["q_id"], r["rank"], r["r_id"], round(r["cos"], 9), round(r["pcos"], 9)) for r in df.collect())
    assert got == sorted(want)
