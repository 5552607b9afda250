"""Positions, splits, fragments and exemplars when the sort has many partitions."""

import pytest
from pyspark.sql import functions as F

from tabflaw.operators import prompts as P
from tabflaw.operators.cells import cell_diff_positional, row_index

SETTINGS = [(8, True), (32, False), (200, True)]


@pytest.fixture(params=SETTINGS, ids=lambda p: f"{p[0]}-{'coalesced' if p[1] else 'whole'}")
def partitions(request, spark):
    n, coalesce = request.param
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(coalesce).lower())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    yield n
    for k, v in old.items():
        spark.conf.set(k, v)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


N = 40_000


def test_index_is_dense_and_in_order(spark, partitions):
    df = spark.range(N).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 50).alias("wide"), "id")
    idx = row_index(df, order_by="k")
    got = idx.agg(F.count("*"), F.count_distinct("row_index"), F.min("row_index"), F.max("row_index")).first()
    assert tuple(got) == (N, N, 0, N - 1)
    keys = [r["k"] for r in idx.orderBy("row_index").select("k").collect()]
    assert keys == sorted(keys)


def test_split_is_exact(spark, partitions):
    df = spark.range(N).select(F.col("id").cast("string").alias("entry_id"))
    got = P.split_rows(df, 0.9)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 36_000, "test": 4_000}
    assert got.select("entry_id").distinct().count() == N


def test_exemplars_are_unique(spark, partitions):
    df = spark.range(8_000).select(F.col("id").cast("string").alias("entry_id"),
                                   F.element_at(F.array(*[F.lit(t) for t in "abc"]), (F.col("id") % 3 + 1).cast("int")).alias("error_type"),
                                   F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"),
                                   F.lit("i").alias("input"), F.lit("o").alias("output_json"))
    got = P.fewshot_pairs(df)
    n, pairs, distinct = got.agg(F.count("*"), F.count_distinct("entry_id", "j"), F.count_distinct("entry_id", "ex_id")).first()
    assert n == pairs == distinct
    test = got.join(df.where("split = 'test'"), "entry_id")
    assert test.count() == 2 * 800
    assert got.where(F.col("entry_id") == F.col("ex_id")).count() == 0


def test_fragments_have_all_their_rows(spark, partitions):
    table = spark.range(6_000).select(F.col("id").cast("string").alias("row_id"), F.md5(F.col("id").cast("string")).alias("v"))
    entries = table.where("cast(row_id as bigint) % 2 = 0").select(
        F.concat(F.lit("e"), "row_id").alias("entry_id"), "row_id", F.lit("v").alias("column"), F.lit("outliers").alias("error_type"),
        F.lit("x").alias("error_value"), F.lit("").alias("tuple_pairs"))
    got = P.build_fragments(entries, table, k=5, index_order=F.col("row_id").cast("bigint"))
    lines = got.select(F.size(F.split("input", "\n")).alias("n"), F.size(F.array_distinct(F.split("input", "\n"))).alias("d"))
    assert got.count() == 3_000
    assert {tuple(r) for r in lines.distinct().collect()} == {(8, 8)}     # header, rule, 5 context rows and the own row


@pytest.mark.parametrize("n_rows,k", [(0, 5), (1, 5), (2, 5), (6, 5), (7, 5), (8, 5), (12, 5)])
def test_small_tables_give_what_there_is(spark, n_rows, k):
    table = spark.createDataFrame([(str(i), "v") for i in range(n_rows)], "row_id string, v string")
    entries = spark.createDataFrame([(f"e{j}", [j % max(n_rows, 1), (j + 1) % max(n_rows, 1)]) for j in range(60)],
                                    "entry_id string, involved array<bigint>")
    idx = row_index(table.select("row_id"), order_by="row_id")
    got = P.context_draws(entries, idx, n_rows, k)
    counts = {r["entry_id"]: r["n"] for r in got.groupBy("entry_id").agg(F.count_distinct("row_id").alias("n")).collect()}
    own = {f"e{j}": len({j % max(n_rows, 1), (j + 1) % max(n_rows, 1)}) for j in range(60)}
    assert all(counts.get(e, 0) == min(k, max(n_rows - own[e], 0)) for e in own)


def test_positional_diff_of_a_shuffled_table(spark, partitions):
    df = spark.range(3_000).select(F.col("id").cast("string").alias("row_id"), F.lit("a").alias("v")).repartition(16, "row_id")
    assert cell_diff_positional(df, df).count() == 0


def test_ids_that_are_no_integers_do_not_end_the_job(spark):
    table = spark.createDataFrame([("1", "a"), ("x", "b"), ("3", "c")], "row_id string, v string")
    entries = spark.createDataFrame([("e", "1", "v", "outliers", "q", ""), ("f", "x", "v", "outliers", "q", "")],
                                    "entry_id string, row_id string, column string, error_type string, error_value string, tuple_pairs string")
    got = {r["entry_id"] for r in P.build_fragments(entries, table, k=2).collect()}
    assert got == {"e"}                                                    # f names no row that can be found: no input
    assert [r["entry_id"] for r in P.missing_involved(entries, table).collect()] == ["f"]


def test_own_tasks(spark):
    task = P.Task(("Find the {error_type} cell.",), ("Answer in JSON.",), {"outliers": ["A value far off."]})
    df = spark.createDataFrame([("e", "outliers"), ("f", "other")], "entry_id string, error_type string")
    got = {r["entry_id"]: r["t"] for r in df.select("entry_id", P.instruction_text(
        task, F.col("error_type"), F.lit(""), F.col("entry_id")).alias("t")).collect()}
    assert got == {"e": "Find the outliers cell. A value far off. Answer in JSON.", "f": "Find the other cell. Unknown error type. Answer in JSON."}
    with pytest.raises(ValueError):
        P.task_of("translation")


def test_a_corpus_for_an_own_task(spark):
    import json

    from tabflaw.plans.corpus import build_corpus
    task = P.Task(("Name the row of the {error_type} cell.",), ("Answer in JSON.",), output_fields=("row_id",))
    table = spark.createDataFrame([(str(i), f"v{i}") for i in range(30)], "row_id string, v string")
    entries = spark.createDataFrame([(f"e{i}", str(i), "v", "outliers", "x", "", "") for i in range(0, 30, 3)],
                                    "entry_id string, row_id string, column string, error_type string, error_value string, "
                                    "tuple_pairs string, constraint string")
    rows = build_corpus(entries, table, task, k=2).collect()
    assert len(rows) == 10 and sum(r["split"] == "train" for r in rows) == 9
    assert all(json.loads(r["output_json"]) == {"row_id": r["entry_id"][1:]} for r in rows)
    assert all(r["instruction"].startswith("Name the row of the outliers cell.") for r in rows)
