"""Cell diff, apply, repair: golden counts, round trips, null modes, odd column names."""

from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from tabflaw.operators import cells as C
from tabflaw.plans import fixtures as fx


def _df(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_golden_diff_counts(spark):
    for sf, total in ((SF_SMALL, 47), (SF_CHECK, 404)):
        clean = fx.customer_clean(spark, sf)
        assert C.cell_diff(clean, fx.customer_dirty(clean)).count() == total
        by_col = {r["column"]: r["n"] for r in C.errors_by_column(clean, fx.customer_dirty(clean)).collect()}
        assert sum(by_col.values()) == total


def test_golden_by_column_sf001(spark):
    clean = fx.customer_clean(spark, SF_CHECK)
    got = {r["column"]: r["n"] for r in C.errors_by_column(clean, fx.customer_dirty(clean)).collect()}
    assert got == {"c_name": 93, "c_nationkey": 117, "c_mktsegment": 194}


def test_round_trips(spark):
    clean = fx.customer_clean(spark, SF_SMALL)
    dirty = fx.customer_dirty(clean)
    log = C.cell_diff(clean, dirty)
    applied = C.apply_errors(clean, log, order_col=None)
    assert applied.exceptAll(dirty).count() == 0 and dirty.exceptAll(applied).count() == 0
    repaired = C.repair_table(dirty, log, order_col=None)
    assert repaired.exceptAll(clean).count() == 0 and clean.exceptAll(repaired).count() == 0
    assert C.cell_diff(clean, clean).count() == 0


def test_null_modes(spark):
    cols = ["row_id", "a"]
    c = _df(spark, [("1", None), ("2", "x")], cols)
    d = _df(spark, [("1", None), ("2", None)], cols)
    assert C.cell_diff(c, d).count() == 1                         # null vs null is equal
    assert C.cell_diff(c, d, null_equals_null=False).count() == 2  # NaN != NaN behaviour


def test_hyphen_space_colon_columns(spark):
    cols = ["row_id", "beer-name", "Release Date", "Unnamed: 0"]
    c = _df(spark, [("1", "a", "2020", "0"), ("2", "b", "2021", "1")], cols)
    d = _df(spark, [("1", "A", "2020", "0"), ("2", "b", "21", "9")], cols)
    diff = {(r["row_id"], r["column"]) for r in C.cell_diff(c, d).collect()}
    assert diff == {("1", "beer-name"), ("2", "Release Date"), ("2", "Unnamed: 0")}
    back = C.apply_errors(c, C.cell_diff(c, d), order_col=None)
    assert back.exceptAll(d).count() == 0


def test_repair_ignores_unknown_rows_and_columns(spark):
    cols = ["row_id", "a"]
    d = _df(spark, [("1", "bad"), ("2", "ok")], cols)
    log = spark.createDataFrame([("1", "a", "good"), ("99", "a", "x"), ("2", "zzz", "y")],
                                "row_id string, column string, right_value string")
    out = {r["row_id"]: r["a"] for r in C.repair_table(d, log, order_col=None).collect()}
    assert out == {"1": "good", "2": "ok"}
    assert C.unknown_edit_rows(d, log).count() == 1


def test_first_and_last_write(spark):
    log = spark.createDataFrame([("1", "a", "v1", 1), ("1", "a", "v2", 2), ("1", "b", None, 3)],
                                "row_id string, column string, error_value string, seq int")
    first = {(r["row_id"], r["column"]): r["error_value"] for r in C.first_write(log).collect()}
    assert first == {("1", "a"): "v1", ("1", "b"): None}
    last = {(r["row_id"], r["column"]): r["error_value"] for r in C.last_write(log).collect()}
    assert last[("1", "a")] == "v2"
    used = spark.createDataFrame([("1", "a")], "row_id string, column string")
    assert C.dedupe_cells(log, used_cells=used).count() == 1


def test_row_index_dense_in_file_order(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("row_id"))
    idx = C.row_index(df)
    got = sorted((int(r["row_id"]), r["row_index"]) for r in idx.collect())
    assert [i for _, i in got] == list(range(1000))
    assert all(a == b for a, b in got)


def test_positional_diff_and_cellchange_cells(spark):
    from tabflaw.operators.metrics import cells_from_cellchanges
    c = _df(spark, [("1", "a"), ("2", "b"), ("3", "c")], ["row_id", "v"])
    d = _df(spark, [("1", "a"), ("9", "b"), ("3", "z")], ["row_id", "v"])
    got = {(r["position"], r["column"]) for r in C.cell_diff_positional(c, d).collect()}
    assert got == {(1, "row_id"), (2, "v")}
    ch = spark.createDataFrame([("12.a.b",), ("3.c",), ("bad",)], "_c0 string")
    assert sorted((r["row_id"], r["column"]) for r in cells_from_cellchanges(ch).collect()) == \
        [("12", "a.b"), ("3", "c")]


def test_differences_positions(spark):
    c = _df(spark, [("1", "a", None), ("2", "b", "x")], ["row_id", "v", "w"])
    d = _df(spark, [("1", "A", None), ("2", "b", "y")], ["row_id", "v", "w"])
    got = sorted((r["row"], r["column"], r["right_value"], r["error_value"]) for r in C.differences(c, d).collect())
    assert got == [(0, 1, "a", "A"), (0, 2, None, None), (1, 2, "x", "y")]     # NaN != NaN by default


def test_with_row_ids(spark):
    df = _df(spark, [("x", "1"), ("y", "2"), ("z", "3")], ["a", "b"])
    out = C.with_row_ids(df)
    assert out.columns == ["row_id", "a", "b"]
    assert sorted((r["row_id"], r["a"]) for r in out.collect()) == [("0", "x"), ("1", "y"), ("2", "z")]
    again = C.with_row_ids(_df(spark, [("9", "x"), ("7", "y")], ["row_id", "a"]))
    assert sorted((r["row_id"], r["a"]) for r in again.collect()) == [("0", "x"), ("1", "y")]


def test_api_namespace():
    from tabflaw import api as tf
    for name in ("cell_diff", "pair_groups", "generate_errors", "build_corpus", "method_report",
                 "pattern_report", "corpus_from_folder", "generate_with_model", "save_bucketed"):
        assert callable(getattr(tf, name))


def test_apply_without_dedupe_for_unique_logs(spark):
    clean = fx.customer_clean(spark, SF_SMALL)
    dirty = fx.customer_dirty(clean)
    log = C.cell_diff(clean, dirty)
    fast = C.apply_errors(clean, log, order_col=None, dedupe=False)
    assert fast.exceptAll(dirty).count() == 0 and dirty.exceptAll(fast).count() == 0
