"""File sources and sinks: CSV tables, JSONL error logs, rule files, pair maps, corpora.

All reads use explicit schemas (no inference pass over the data); all
writes are plain DataFrame writers, partitioned where the reference
writes one file per group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import NA_TOKENS, na_to_null
from ..schemas import ERROR, ERROR_FIELDS
from .csv_split import scan_csv
from .pair_map import scan_pair_map


# ------------------------------------------------------------------ tables

def read_csv_table(spark: SparkSession, path: str, na_tokens: list[str] | None = NA_TOKENS,
                   key: str | None = "row_id", multi_line: bool | str = True) -> DataFrame:
    """All-string CSV scan with a header row.

    ``multi_line`` keeps quoted newlines inside a field, and the scan is still
    split by blocks (see ``csv_split``, also for what it asks of the quotes);
    "file" reads each file in one task with Spark's own reader, and False is
    for files whose fields hold no newline.  The UTF-8 BOM is dropped, and after
    the read the pandas null tokens are turned into nulls (``na_tokens=None``
    keeps raw text, as the CSV->JSONL converter does).  Checks that the key
    column exists.
    """
    df = (spark.read.option("header", True).option("multiLine", bool(multi_line)).option("escape", '"')
          .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))
    if multi_line and multi_line != "file" and df.columns:
        df = scan_csv(spark, path, df.columns)
    # a BOM that survives in the first header name is stripped
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if key is not None and key not in df.columns:
        raise KeyError(f"missing key column {key!r} in {path}")
    if na_tokens is None:
        return df
    return df.select(*[na_to_null(F.col(f"`{c}`"), na_tokens).alias(c) for c in df.columns])


def read_csv_typed_key(spark: SparkSession, path: str, key: str = "row_id", multi_line: bool | str = True) -> DataFrame:
    """The same scan with the key made numeric (try_cast; bad ids become null)."""
    df = read_csv_table(spark, path, key=key, multi_line=multi_line)
    return df.withColumn(key, F.col(key).try_cast("bigint"))


def read_cell_changes(spark: SparkSession, path: str) -> DataFrame:
    """S3: headerless CSV, column 0 = 'row.column' cell ids -> _c0."""
    return spark.read.option("header", False).schema("_c0 string").csv(path)


def write_csv_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, no BOM, nulls as empty fields; blanks and line breaks at a value's ends are kept."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


# ------------------------------------------------------------------ error logs

LOG_SCHEMA = T.StructType(ERROR.fields + [T.StructField("_corrupt_record", T.StringType())])


def parse_jsonl_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON lines -> ERROR columns + ``bad`` flag (unparsable or not an object).

    Non-string JSON values in string fields keep their JSON text; a line
    that fails to parse yields null fields and ``bad = true``.
    """
    rec = F.from_json(F.col(text_col), LOG_SCHEMA,
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    x = lines.withColumn("_r", rec)
    bad = x["_r"].isNull() | x["_r"]["_corrupt_record"].isNotNull() | \
        ~F.trim(F.col(text_col)).startswith("{")
    keep = [c for c in lines.columns if c != text_col]
    return x.select(*keep, *[F.when(~bad, F.col("_r")[f]).alias(f) for f in ERROR_FIELDS],
                    bad.alias("bad"))


def read_error_log(spark: SparkSession, path: str, glob: str | None = None,
                   recursive: bool = False) -> DataFrame:
    """One or many JSONL logs -> ERROR columns + dataset, file, seq, bad.

    ``dataset`` is the parent folder of each file; ``seq`` is file order.
    Raises when no file matches.
    """
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    lines = r.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.withColumn("seq", F.monotonically_increasing_id())
    lines = lines.withColumn("dataset", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)) \
                 .withColumn("folder", F.regexp_extract("file", r"^(.*)/[^/]+$", 1))
    out = parse_jsonl_lines(lines.where(F.trim("value") != ""))
    if out.limit(1).count() == 0:
        raise FileNotFoundError(f"no annotation records under {path} ({glob or '*'})")
    return out


def good_records(log: DataFrame) -> DataFrame:
    return log.where(~F.col("bad"))


def bad_records(log: DataFrame) -> DataFrame:
    return log.where(F.col("bad"))


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """JSON lines, nulls kept as null, non-ASCII kept as is."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


# ------------------------------------------------------------------ rules and pairs

def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One denial constraint per line, stripped; empty lines dropped."""
    return (spark.read.text(path).select(F.trim("value").alias("rule"))
            .where(F.col("rule") != ""))


PAIR_MAP = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.LongType())))


def read_pair_map(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """JSON object {rule: [[id1, id2], ...]} -> (rule, row_id_1, row_id_2).

    The scan is split by blocks (``pair_map``); ``whole`` parses each file as
    one row, for small files whose rules' names hold a closing bracket.
    """
    if not whole:
        return scan_pair_map(spark, path)
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.explode(F.from_json("value", PAIR_MAP)).alias("rule", "pairs"))
    p = m.select("rule", F.explode("pairs").alias("p"))
    return p.select("rule", F.col("p")[0].alias("row_id_1"), F.col("p")[1].alias("row_id_2"))


def write_pair_map(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S6 sink: (rule, row_id_1, row_id_2) as pair maps, a JSON object per part file.

    Pairs are sorted by rule within a task, so a rule stands in as many files
    as tasks hold pairs of it, once in each.  Nothing is shuffled or gathered.
    """
    def lines(batches):
        import json
        rule = None
        for b in batches:
            out = []
            for r, x, y in zip(*(c.to_pylist() for c in b.columns)):
                begin = ("{" if rule is None else "],\n") + json.dumps(r) + ": [" if r != rule else ", "
                out.append(f"{begin}[{x}, {y}]")
                rule = r
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])
        yield pa.record_batch([pa.array(["]}" if rule is not None else "{}"])], names=["value"])

    known = pairs.where("rule is not null and row_id_1 is not null and row_id_2 is not null")
    known.select("rule", F.col("row_id_1").cast("bigint"), F.col("row_id_2").cast("bigint")) \
        .sortWithinPartitions("rule").mapInArrow(lines, "value string").write.mode(mode).text(path)


def write_pair_groups(groups: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S6 sink: pair groups / members as parquet partitioned by rule id (md5 of the rule)."""
    groups.withColumn("rule_id", F.md5("rule")).write.mode(mode).partitionBy("rule_id").parquet(path)


# ------------------------------------------------------------------ conversions and corpora

def _any_present(cells: list[Column]) -> Column:
    return F.coalesce(*cells).isNotNull() if cells else F.lit(False)


def _raw_scan(spark: SparkSession, path: str | list[str], multi_line: bool) -> tuple[DataFrame, list[Column]]:
    """Scan of all fields as text, and its columns with empty fields as ""."""
    read = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    names = read.csv(path).columns
    bad = "_corrupt_record"
    while bad in names:
        bad += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    rows = read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)
    cells = [F.col(f"`{n}`") for n in names]
    whole = F.col(f"`{bad}`").isNull()
    return rows, [F.when(c.isNull() & (whole | _any_present(cells[k + 1:])), F.lit("")).otherwise(c).alias(names[k].lstrip("\ufeff"))
                  for k, c in enumerate(cells)]


def read_csv_raw(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """S10's scan: every field is the text that stands there.

    An empty field is "" (quoted or not) and no token means missing.  In a line
    with more or fewer fields than the header, fields beyond it are dropped and
    null stands for those it lacks (and for empty ones at its end, which look
    the same).  A byte order mark goes from the first column's name.
    """
    rows, cells = _raw_scan(spark, path, multi_line)
    return rows.select(*cells)


def csv_to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, every value a string, nulls kept (``read_csv_raw`` keeps empty fields as "")."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("value"))


def csv_headers(spark: SparkSession, src: str, glob: str = "*.csv") -> DataFrame:
    """(file, header) of every CSV under ``src``: the first line of each file.

    Splits of a file that do not start at its beginning contribute nothing, so
    the scan is a plain text scan and one row per file is shuffled.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(src) \
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                F.monotonically_increasing_id().alias("n"), "value").where("at = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "n").alias("header"))
    return first.select("file", F.regexp_replace("header", "^\ufeff", "").alias("header"))


def convert_csv_tree(spark: SparkSession, src: str, dst: str, glob: str = "*.csv", multi_line: bool = True,
                     files_per_job: int = 500) -> None:
    """S10 over a tree: every CSV under ``src`` -> JSON lines under ``dst``, one folder per source file.

    Empty fields are "", as in ``read_csv_raw``.  Files are grouped by their header, so each row has its own file's columns
    and no others; the output folder is ``source=<path below src>``, so files of
    equal name in different folders stay apart.  ``glob`` selects the files
    (for example ``*_annotation.csv``).  One write per header and
    ``files_per_job`` files, so the number of jobs follows the number of
    different headers, not of rows.
    """
    files = sorted((r["header"], r["file"]) for r in csv_headers(spark, src, glob).collect())    # one row per file
    by_header: dict[str, list[str]] = {}
    for header, file in files:
        by_header.setdefault(header, []).append(file)
    base = _common_folder([f for _, f in files])
    for paths in by_header.values():
        for k in range(0, len(paths), files_per_job):
            df, cols = _raw_scan(spark, paths[k:k + files_per_job], multi_line)
            below = F.substring(F.col("_metadata.file_path"), len(base) + 1, 1 << 20)
            out = df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"),
                            F.regexp_replace(below, r"\.csv$", "").alias("source"))
            out.write.mode("append").partitionBy("source").text(dst)


def _common_folder(files: list[str]) -> str:
    import os
    top = os.path.commonprefix([f.rpartition("/")[0] + "/" for f in files])
    return top[:top.rfind("/") + 1]


#: the columns of a corpus of triplets; outputs are read as the JSON text they are
CORPUS_SCHEMA = "instruction string, input string, output string, dataset string, split string"


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every triplet file of a folder as one corpus; object outputs become JSON text.

    The schema is given, so the data is read once; ``split`` and ``dataset``
    are null where neither the rows nor the folders name them.
    """
    df = spark.read.option("recursiveFileLookup", True).schema(CORPUS_SCHEMA).json(path)
    in_path = F.regexp_extract(F.col("_metadata.file_path"), r"/split=([^/]+)/", 1)
    return df.withColumn("split", F.coalesce("split", F.when(in_path != "", in_path)))


def cache_table(df: DataFrame, path: str) -> DataFrame:
    """Materialise to parquet (e.g. an embedding cache) and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


__all__ = ["read_csv_table", "read_csv_typed_key", "read_cell_changes", "write_csv_table",
           "parse_jsonl_lines", "read_error_log", "good_records", "bad_records", "write_jsonl",
           "read_rules", "read_pair_map", "write_pair_map", "write_pair_groups", "csv_to_json_rows", "convert_csv_tree",
           "load_corpus", "cache_table", "NA_TOKENS"]


def save_bucketed(df: DataFrame, name: str, path: str, key: str = "row_id", buckets: int = 64,
                  mode: str = "overwrite") -> DataFrame:
    """Store a table bucketed and sorted by its key (an external table at ``path``).

    Clean and dirty tables saved with the same key and bucket count join
    without a shuffle (cell diff, apply, repair, validation all join on the
    key), so a table that is diffed or repaired repeatedly is shuffled once,
    at write time.  Returns the table as read back.
    """
    (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)
