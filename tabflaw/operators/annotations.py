"""Error-log operators: parse, validate, cells touched, caps, involved rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constraints import constraint_columns, tuple_ids, tuple_ids_strict
from ..functions.values import float_value
from ..schemas import DETECTION_FIELDS, ERROR, ERROR_FIELDS


def completion_json(text) -> F.Column:
    """The JSON object in a model completion: the text after 'Assistant:' if
    present, then the greedy '{...}' span across lines; else the whole text."""
    t = F.col(text) if isinstance(text, str) else text
    after = F.when(F.instr(t, "Assistant:") > 0,
                   F.substring_index(t, "Assistant:", -1)).otherwise(t)
    obj = F.regexp_extract(after, r"(?s)(\{.*\})", 1)
    return F.when(obj != "", obj).otherwise(after)


def parse_completion(df: DataFrame, text_col: str = "completion") -> DataFrame:
    """Add ``record`` (ERROR struct, fields null when unparsable) and ``parse_ok``.

    ``from_json`` with the explicit ERROR schema never infers; numbers in
    string fields are kept as their text.
    """
    rec = F.from_json(completion_json(text_col), ERROR, {"mode": "PERMISSIVE"})
    ok = rec.isNotNull() & (rec["row_id"].isNotNull() | rec["column"].isNotNull() | rec["error_type"].isNotNull())
    return df.withColumn("record", rec).withColumn("parse_ok", F.coalesce(ok, F.lit(False)))


def render_completion(log: DataFrame) -> F.Column:
    """'Assistant:' + JSON of the 8 ERROR fields (nulls kept)."""
    rec = F.struct(*[F.col(c) for c in ERROR_FIELDS])
    return F.concat(F.lit("Assistant:\n"), F.to_json(rec, {"ignoreNullFields": "false"}))


def task_output(log: DataFrame, task: str) -> DataFrame:
    """The expected output struct of a task: detection -> 4 fields, generation /
    correction -> 8 fields with defaults (missing_value 0, constraint and
    tuple_pairs '')."""
    if task == "detection":
        fields = [F.col(c).cast("string").alias(c) for c in DETECTION_FIELDS]
    elif task in ("generation", "correction"):
        fields = [F.col(c).cast("string").alias(c) for c in ERROR_FIELDS[:5]] + [
            F.coalesce(F.col("missing_value").cast("int"), F.lit(0)).alias("missing_value"),
            F.coalesce(F.col("constraint"), F.lit("")).alias("constraint"),
            F.coalesce(F.col("tuple_pairs"), F.lit("")).alias("tuple_pairs")]
    else:
        raise ValueError(f"unknown task {task!r}")
    return log.withColumn("output", F.struct(*fields))


def rule_cells(log: DataFrame, key: str = "row_id") -> DataFrame:
    """(source_row, row_id, column): tuple ids x columns named 'The X of Row n'."""
    ids = tuple_ids("tuple_pairs")
    cols = constraint_columns("constraint")
    x = log.select(F.col(key).alias("source_row"), F.explode(ids).alias("_id"), cols.alias("_cols"))
    y = x.select("source_row", F.col("_id").cast("string").alias(key), F.explode("_cols").alias("column"))
    return y.distinct()


def involved_ids(log: DataFrame, key: str = "row_id") -> F.Column:
    """First two tuple ids of a rule violation, else the record's own id; [] when malformed."""
    own = F.when(F.col(key).rlike(r"^\d{1,18}$"), F.array(F.col(key).cast("string").try_cast("bigint")))
    ids = F.when(F.col("error_type") == "rule_violation", tuple_ids_strict("tuple_pairs")).otherwise(own)
    return F.coalesce(ids, F.array().cast("array<bigint>"))


def involved_rows(log: DataFrame, table: DataFrame, entry_col: str = "entry_id",
                  key: str = "row_id") -> DataFrame:
    """(entry_id, table row...) for the rows each record touches (equi join on the key)."""
    ex = log.select(entry_col, F.explode(involved_ids(log, key)).alias("_id"))
    t = table.withColumn("_tid", F.col(key).cast("string").try_cast("bigint"))
    return ex.join(t, ex._id == t._tid).drop("_id", "_tid")


def validate_candidates(cands: DataFrame, table: DataFrame, key: str = "row_id") -> DataFrame:
    """Check proposed errors against the table.

    status: undefined_column / undefined_row / no_change / ok.  Candidates are
    joined to the wide table on the row key (the table is shuffled as rows,
    not exploded into cells) and the true value is picked by column name;
    ``right_value`` is replaced by the true value; a candidate whose error
    value equals the true value (numerically when both parse as numbers) is
    a no-op.
    """
    cols = [c for c in table.columns if c != key]
    t = table.select(F.col(key).alias("_rid"), F.lit(True).alias("_hit"),
                     F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
                     .alias("_vals"))
    c = cands.withColumn("_ev", F.trim(F.col("error_value").cast("string")))
    j = c.join(t, c[key] == t._rid, "left")
    true_v = F.element_at(F.col("_vals"), F.col("column"))
    x = j.withColumn("_true", F.when(F.col("column").isin(cols), true_v))
    ev_num, tv_num = float_value(F.col("_ev")), float_value(F.col("_true"))
    same = F.when(ev_num.isNotNull() & tv_num.isNotNull(), ev_num == tv_num) \
            .otherwise(F.col("_ev").eqNullSafe(F.trim(F.col("_true"))))
    status = (F.when(~F.col("column").isin(cols) | F.col("column").isNull(), F.lit("undefined_column"))
              .when(F.col("_hit").isNull(), F.lit("undefined_row"))
              .when(same, F.lit("no_change"))
              .otherwise(F.lit("ok")))
    keep = [y for y in cands.columns if y != "right_value"]
    return x.select(*keep, F.col("_true").alias("right_value"), status.alias("status"))


def generated_cells(log: DataFrame, key: str = "row_id") -> DataFrame:
    """Distinct (row_id, column); records with a null part skipped."""
    return log.select(key, "column").dropna().distinct()


def top_per_group(df: DataFrame, group_cols: list[str], order_col: str, k: int, salt_col: str,
                  salts: int = 64) -> DataFrame:
    """The first ``k`` rows per group by ``order_col``, exactly, without one task per group.

    Stage 1 ranks inside (group, salt) partitions -- a hot group is spread
    over ``salts`` tasks -- and keeps k per partition; the global first k of
    a group are among those.  Stage 2 ranks the at most k x salts survivors.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(order_col)
    s1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(order_col)
    return s1.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= k).drop("_salt", "_r1", "_r2")


def cap_per_type(log: DataFrame, cap: int = 2500, file_col: str = "dataset",
                 order_col: str = "line_no", salts: int = 64) -> DataFrame:
    """First ``cap`` records per (file, error_type) in file order (salted two-stage rank)."""
    return top_per_group(log, [file_col, "error_type"], order_col, cap, order_col, salts)
