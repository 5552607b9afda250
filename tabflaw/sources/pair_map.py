"""Scans of pair maps, JSON objects {rule: [[id, id], ...]}, that split a file.

The file is cut at closing brackets, so a piece of text holds one pair, one
rule's name and the first of its pairs, or what closes a list.  A pair belongs
to the last rule named before it: one pass finds the last name of every split, a
running value over the splits (a row each) tells which rule each begins in, and
a second pass carries the name along within the split.  Nothing larger than a
piece is held.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NAME = r'"((?:[^"\\]|\\.)*)"\s*:\s*\['
_PAIR = r"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*$"
_ROWS = pa.schema([("rule", pa.string()), ("row_id_1", pa.int64()), ("row_id_2", pa.int64())])


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, name, a, b) of every piece, in file order within a split."""
    value = F.col("value")
    name = F.regexp_extract(value, _NAME, 1)
    text = F.from_json(F.concat(F.lit('["'), name, F.lit('"]')), "array<string>")[0]
    return spark.read.option("lineSep", "]").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.when(value.rlike(_NAME), text).alias("name"),
        F.when(value.rlike(_PAIR), F.regexp_extract(value, _PAIR, 1)).cast("bigint").alias("a"),
        F.when(value.rlike(_PAIR), F.regexp_extract(value, _PAIR, 2)).cast("bigint").alias("b"))


def split_rules(pieces: DataFrame) -> DataFrame:
    """(file, start, rule): the rule that a split begins in, of splits that begin in one.  At most one row per split."""
    last = pieces.withColumn("n", F.monotonically_increasing_id()) \
        .groupBy("file", "start").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("n"))).alias("name"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("file", "start", F.last("name", ignorenulls=True).over(before).alias("rule")).where("rule is not null")


def _carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, rule, name, a, b) pieces to (rule, row_id_1, row_id_2), batch by batch."""
    split = rule = None
    for batch in batches:
        out = []
        for f, s, begun, name, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if (f, s) != split:
                split, rule = (f, s), begun
            if name is not None:
                rule = name
            if a is not None and b is not None and rule is not None:
                out.append((rule, a, b))
        columns = list(zip(*out)) if out else [[]] * 3
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)


def scan_pair_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rule, row_id_1, row_id_2) of pair maps; rule names hold no closing bracket.  Rules without pairs give no rows."""
    pieces = _pieces(spark, path)
    begun = F.broadcast(split_rules(pieces))                 # at most a row per split
    return pieces.join(begun, ["file", "start"], "left").select("file", "start", "rule", "name", "a", "b") \
        .mapInArrow(_carry, "rule string, row_id_1 bigint, row_id_2 bigint")
