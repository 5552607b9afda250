"""CSV scans that split a file although quoted fields hold line breaks.

A line break ends a record where the number of quotes before it in the file is
even.  So one pass counts the quotes of every split, running sums over the
splits (a row each) tell which of them begin inside a quoted field, and a second
pass joins lines to records, split by split and in parallel.  Only records that
cross a border between splits are shuffled: their pieces are put together by
file and position.

The rule needs quotes to be used as CSV writers use them: around a field, and
doubled within it.  Files with single quotes inside unquoted fields need
Spark's own reader (``read_csv_table(multi_line="file")``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES_SQL = "file string, start bigint, kind int, header boolean, value string"
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()), ("value", pa.string())])
# kinds of pieces: a whole record, and the end, the middle and the beginning of one that crosses a border
WHOLE, END, MIDDLE, BEGIN = range(4)
_ROWS = 4096                     # pieces of a batch that Python makes


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with their split (file, start) and quotes, in file order within a split."""
    value = F.col("value")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"), "value")


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, odd, ends_odd): whether a split begins and ends inside a quoted field.  One row per split."""
    sums = lines.groupBy("file", "start").agg((F.sum("quotes") % 2).alias("parity"))
    upto = F.sum("parity").over(Window.partitionBy("file").orderBy("start"))
    return sums.select("file", "start", ((upto - F.col("parity")) % 2 == 1).alias("odd"), (upto % 2 == 1).alias("ends_odd"))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, start, odd, quotes, value) to pieces, streaming: what is held is one record and one batch of pieces."""
    out: list[tuple] = []
    split, open_lines, begun_before, header = None, None, False, False

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 5
        made = pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)
        out.clear()
        return made

    def close(kind: int) -> None:
        nonlocal open_lines, header
        text = "\n".join(open_lines)
        blank = kind == WHOLE and not text.strip()
        if not blank:
            out.append((*split, kind, header and kind in (WHOLE, BEGIN), text))
            header = header and kind == END
        open_lines = None

    def leave() -> None:
        if open_lines is not None:
            close(MIDDLE if begun_before else BEGIN)

    for b in batches:
        files, starts, odds = b.column(0), b.column(1), b.column(2)
        quotes = b.column(3).to_pylist()
        n = len(b)
        same = n and (files[0].as_py(), starts[0].as_py()) == (files[n - 1].as_py(), starts[n - 1].as_py()) == split
        if same and open_lines is None and not header and not any(q & 1 for q in quotes):
            yield batch()
            yield pa.record_batch([files, starts, pa.array([WHOLE] * n, pa.int32()), pa.array([False] * n, pa.bool_()), b.column(4)],
                                  schema=_PIECES)
            continue
        for f, s, odd, q, line in zip(files.to_pylist(), starts.to_pylist(), odds.to_pylist(), quotes, b.column(4).to_pylist()):
            if (f, s) != split:
                leave()
                split, begun_before, header = (f, s), odd, s == 0
                open_lines = [] if odd else None
            if open_lines is None:
                open_lines, begun_before = [], False
                inside = False
            else:
                inside = True
            open_lines.append(line)
            if inside == bool(q & 1):            # the record ends with this line
                close(END if begun_before else WHOLE)
                begun_before = False
            if len(out) >= _ROWS:
                yield batch()
    leave()
    yield batch()


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that cross borders, from their pieces: a beginning, middles and an end, in file order."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    number = F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(order)
    part = F.struct("start", "kind", "value")
    return pieces.withColumn("record", number).groupBy("file", "record") \
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.bool_or("header").alias("header")) \
        .select("header", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(header, value) of every CSV record: its text, and whether it is its file's first.  Blank lines go."""
    lines = _lines(spark, path)
    states = split_states(lines)
    # a row per split, and only of those that begin or end inside a field
    crossing = F.broadcast(states.where("odd or ends_odd"))
    flagged = lines.join(crossing, ["file", "start"], "left") \
        .select("file", "start", F.coalesce("odd", F.lit(False)).alias("odd"), "quotes", "value", F.col("odd").isNotNull().alias("crosses"))
    names = ["file", "start", "odd", "quotes", "value"]
    whole = flagged.select(*names).mapInArrow(_pieces, PIECES_SQL).where(F.col("kind") == WHOLE).select("header", "value")
    across = flagged.where("crosses").select(*names).mapInArrow(_pieces, PIECES_SQL).where(F.col("kind") != WHOLE)
    records = whole.unionByName(_joined(across))
    return records.select("header", F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")


def scan_csv(spark: SparkSession, path: str | list[str], names: list[str], bad: str | None = None) -> DataFrame:
    """The records of CSV files with a header line as text columns ``names`` (``bad``: also the text of records of another
    width), read as Spark's reader reads them."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, *([bad] if bad else [])])
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true", **({"columnNameOfCorruptRecord": bad} if bad else {})}
    rows = csv_records(spark, path).where(~F.col("header"))
    return rows.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
