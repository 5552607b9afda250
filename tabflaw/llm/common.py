"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, configure

#: Arrow batches handed to Python hold at most this many rows and bytes, so a
#: worker's memory does not depend on how long the texts are on average.
BATCH_ROWS = "512"
BATCH_BYTES = str(4 << 20)


_SHIPPED: set[str] = set()


def _ship_code(spark: SparkSession) -> None:
    """Give executors this package's code (their workers keep its caches between tasks)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tabflaw-code-"), "tabflaw"), "zip",
                                         os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Scale settings, the shared checkpoint folder, this package on the executors and bounded Arrow batches."""
    configure(spark)
    _ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def text_udf(fn: Callable[[list], list], returns: str, arrow_type: pa.DataType):
    """Arrow UDF over one column: ``fn`` maps a batch's values to as many results.

    Marked nondeterministic only to keep Catalyst from evaluating it twice when
    a filter and a projection both use its result.
    """
    def run(values: pa.Array) -> pa.Array:
        return pa.array(fn(values.to_pylist()), type=arrow_type)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns).asNondeterministic()


def struct_type(fields: list[tuple[str, pa.DataType]]) -> pa.DataType:
    return pa.struct([pa.field(n, t) for n, t in fields])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder, as a URI that every executor can open."""
    top = checkpoint_dir(spark).rstrip("/")
    if "://" not in top and not top.startswith("file:"):
        top = f"file://{top}"
    _MADE.append(path := f"{top}/{name}-{uuid.uuid4().hex[:12]}")
    return path


_MADE: list[str] = []


def remove_written(spark: SparkSession) -> int:
    """Delete the folders that this session's operators made in the shared folder; call it once their results are
    written elsewhere.  Returns how many there were."""
    conf = spark._jsc.hadoopConfiguration()
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut lineage through a Parquet table in the shared checkpoint folder (survives lost executors)."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """A column name near ``name`` that is not among ``taken`` (Spark compares names without case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_digest(columns: list[str]) -> Column:
    """SHA-256 (32 bytes) of whole rows: of their JSON with nulls named, so a null never stands for another value."""
    whole = F.to_json(F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(whole, 256))


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def one_long(df: DataFrame, expr: Column) -> int:
    """One aggregate as an int (0 for an empty table)."""
    return int(df.agg(expr.alias("v")).first()["v"] or 0)


LONG = T.LongType()
