"""Structured Streaming use of the stateless log operators.

The reference has no streams.  Its per-record steps -- parse a model
completion, validate it against the table, type it -- are stateless or
stream-static joins, so the same functions run unchanged on ``readStream``:
completions arriving as JSON-line files are parsed and validated against
the static clean table, and each micro-batch lands in a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotations import parse_completion, validate_candidates
from ..schemas import ERROR_FIELDS


def completion_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Text stream of completion files (one completion per line)."""
    return (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
            .text(path).withColumnRenamed("value", "completion"))


def validated_stream(stream: DataFrame, table: DataFrame, key: str = "row_id") -> DataFrame:
    """Parse completions and validate them against a static table (stream-static join)."""
    p = parse_completion(stream, "completion").where("parse_ok")
    cands = p.select(*[F.col("record")[c].alias(c) for c in ERROR_FIELDS])
    return validate_candidates(cands, table, key=key)


def start_to_table(df: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append each micro-batch to parquet at ``path`` (exactly-once with the checkpoint)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
