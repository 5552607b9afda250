"""Canonical schemas of the error-benchmark data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The four error types, in the order used by ratio strings
# such as "1:2:4:3" (outliers:missing:pattern:rule).
ERROR_TYPES = ["outliers", "missing_value", "pattern_violation", "rule_violation"]

ERROR_FIELDS = ["row_id", "column", "error_type", "error_value", "right_value",
                "missing_value", "constraint", "tuple_pairs"]

ERROR = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_value", T.StringType()),
    T.StructField("right_value", T.StringType()),
    T.StructField("missing_value", T.IntegerType()),
    T.StructField("constraint", T.StringType()),
    T.StructField("tuple_pairs", T.StringType()),
])

DETECTION_FIELDS = ERROR_FIELDS[:4]

CELLDIFF = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("right_value", T.StringType()),
    T.StructField("error_value", T.StringType()),
])

PAIR_GROUP = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("group_key", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_pairs", T.LongType()),
])

DIST = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("n", T.LongType()),
])
