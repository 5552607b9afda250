"""Clean / dirty table pairs and error logs derived from the driver tables.

The reference works on downloaded (clean.csv, dirty.csv, annotation log)
triples.  Here the same shapes are derived, deterministically and with a
plain-SQL twin, from the parquet tables: md5 digits decide which cells are
damaged, so every engine computes the same fixture.

Two datasets:

* ``customer`` -- c_name (missing_value), c_nationkey (pattern_violation),
  c_mktsegment (rule_violation under EQ(nationkey) & IQ(mktsegment)).
* ``orders``   -- o_totalprice in cents (outliers, x100), o_orderdate
  (pattern_violation, day-first format), o_orderpriority (missing_value).

``prefix`` selects an independent damage draw: "" is the real dirty table,
"g" a second, "generated" one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_digit
from ..sources.tables import read_table

# Which fixture column carries which error type.
COLUMN_ERROR_TYPE = {
    "customer": {"c_name": "missing_value", "c_nationkey": "pattern_violation",
                 "c_mktsegment": "rule_violation"},
    "orders": {"o_totalprice": "outliers", "o_orderdate": "pattern_violation",
               "o_orderpriority": "missing_value"},
}

CUSTOMER_RULE = "EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)"


def customer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("row_id"), "c_name",
                    F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")


def customer_dirty(clean: DataFrame, prefix: str = "") -> DataFrame:
    rid = F.col("row_id")
    return clean.select(
        rid,
        F.when(md5_digit(prefix + "n|", rid) == "0", F.lit(None).cast("string"))
         .otherwise(F.col("c_name")).alias("c_name"),
        F.when(md5_digit(prefix + "k|", rid) == "1", F.concat(F.col("c_nationkey"), F.lit("x")))
         .otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(md5_digit(prefix + "m|", rid).isin("2", "3"), F.upper(F.substring("c_mktsegment", 2, 1 << 30)))
         .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


def orders_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        F.col("o_orderstatus"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.col("o_orderpriority"),
    )


def orders_dirty(clean: DataFrame, prefix: str = "") -> DataFrame:
    rid = F.col("row_id")
    return clean.select(
        rid, "o_orderstatus",
        F.when(md5_digit(prefix + "o|", rid) == "4",
               (F.col("o_totalprice").cast("bigint") * 100).cast("string"))
         .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(md5_digit(prefix + "d|", rid) == "5",
               F.date_format(F.to_date("o_orderdate", "yyyy-MM-dd"), "dd/MM/yyyy"))
         .otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(md5_digit(prefix + "p|", rid) == "6", F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def clean_table(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    return {"customer": customer_clean, "orders": orders_clean}[dataset](spark, sf_dir)


def dirty_table(spark: SparkSession, sf_dir: str, dataset: str, prefix: str = "") -> DataFrame:
    clean = clean_table(spark, sf_dir, dataset)
    return {"customer": customer_dirty, "orders": orders_dirty}[dataset](clean, prefix)


def error_type_of(dataset: str, column: Column) -> Column:
    """Label a diff column with the fixture's error type."""
    m = COLUMN_ERROR_TYPE[dataset]
    expr = None
    for col_name, et in m.items():
        expr = (F.when(column == col_name, F.lit(et)) if expr is None
                else expr.when(column == col_name, F.lit(et)))
    return expr.otherwise(F.lit(None).cast("string"))


def annotation_log(spark: SparkSession, sf_dir: str, dataset: str = "customer",
                   prefix: str = "") -> DataFrame:
    """Error records (the 8 ERROR fields) for one dataset's damage draw.

    Rule violations on customer name a partner row of the same nation (the
    smallest other key; the largest when the row itself is the smallest)
    in ``tuple_pairs`` and describe the broken rule in ``constraint``.
    The partner lookup is one aggregate per nation joined back by key.
    """
    from ..operators.cells import cell_diff

    clean = clean_table(spark, sf_dir, dataset)
    dirty = dirty_table(spark, sf_dir, dataset, prefix)
    diff = cell_diff(clean, dirty, key="row_id")
    et = error_type_of(dataset, F.col("column"))
    log = diff.select(
        "row_id", "column", et.alias("error_type"), "error_value", "right_value",
        F.when(et == "missing_value", F.lit(1)).otherwise(F.lit(0)).alias("missing_value"),
    )
    if dataset != "customer":
        return log.select(*log.columns, F.lit("").alias("constraint"), F.lit("").alias("tuple_pairs"))
    bounds = (clean.groupBy("c_nationkey")
              .agg(F.min(F.col("row_id").cast("bigint")).alias("lo"),
                   F.max(F.col("row_id").cast("bigint")).alias("hi")))
    nation = clean.select(F.col("row_id").alias("_rid"), "c_nationkey").join(bounds, "c_nationkey")
    log = log.join(nation, log.row_id == nation._rid, "left")
    me = F.col("row_id").cast("bigint")
    partner = F.when(me == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    is_rule = F.col("error_type") == "rule_violation"
    constraint = F.concat(
        F.lit("Constraint Violation: The c_mktsegment of Row "), F.col("row_id"),
        F.lit(" is different from the c_mktsegment of Row "), partner.cast("string"),
        F.lit(" while both rows share c_nationkey"))
    pairs = F.concat(F.lit("("), F.least(me, partner).cast("string"), F.lit(", "),
                     F.greatest(me, partner).cast("string"), F.lit(")"))
    return log.select(
        "row_id", "column", "error_type", "error_value", "right_value", "missing_value",
        F.when(is_rule, constraint).otherwise(F.lit("")).alias("constraint"),
        F.when(is_rule, pairs).otherwise(F.lit("")).alias("tuple_pairs"),
    )


def all_logs(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """Both datasets' logs with a ``dataset`` column (one 'annotation file' each)."""
    parts = [annotation_log(spark, sf_dir, d, prefix).withColumn("dataset", F.lit(d))
             for d in ("customer", "orders")]
    return parts[0].unionByName(parts[1])
