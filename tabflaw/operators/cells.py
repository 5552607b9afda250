"""Cell-level operators: diff, per-column counts, apply, repair, dedupe, row index.

A table is a DataFrame with a key column (``row_id`` by default) and
string value columns.  A cell is ``(row_id, column)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def value_columns(df: DataFrame, key: str = "row_id") -> list[str]:
    return [c for c in df.columns if c != key]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _differs(a: Column, b: Column, null_equals_null: bool) -> Column:
    # null_equals_null=False reproduces "NaN != NaN": two missing cells count as an error.
    if null_equals_null:
        return ~a.eqNullSafe(b)
    return ~a.eqNullSafe(b) | (a.isNull() & b.isNull())


def cell_diff(clean: DataFrame, dirty: DataFrame, key: str = "row_id",
              columns: list[str] | None = None, null_equals_null: bool = True) -> DataFrame:
    """(row_id, column, right_value, error_value) for every cell that differs.

    One key join of the two wide tables (shuffle on the key; AQE may
    broadcast a small side), then each joined row emits only its differing
    cells via ``inline`` over a filtered array -- no long-format explode
    before the comparison.
    """
    cols = columns or value_columns(clean, key)
    c = clean.select(F.col(key).alias("_k"), *[F.col(_q(x)).cast("string").alias(f"_c{i}") for i, x in enumerate(cols)])
    d = dirty.select(F.col(key).alias("_k"), *[F.col(_q(x)).cast("string").alias(f"_d{i}") for i, x in enumerate(cols)])
    j = c.join(d, "_k")
    cells = F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(f"_c{i}").alias("right_value"),
                 F.col(f"_d{i}").alias("error_value"),
                 _differs(F.col(f"_c{i}"), F.col(f"_d{i}"), null_equals_null).alias("_x"))
        for i, x in enumerate(cols)])
    out = j.select(F.col("_k").alias(key), F.inline(F.filter(cells, lambda s: s["_x"])))
    return out.select(key, "column", "right_value", "error_value")


def errors_by_column(clean: DataFrame, dirty: DataFrame, key: str = "row_id",
                     null_equals_null: bool = True) -> DataFrame:
    """(column, n): differing cells per column, zero columns dropped.

    One pass: a global aggregate of per-column 0/1 flags (partial
    aggregation on every task, a single tiny final merge), then unpivot.
    """
    cols = value_columns(clean, key)
    c = clean.select(F.col(key).alias("_k"), *[F.col(_q(x)).cast("string").alias(f"_c{i}") for i, x in enumerate(cols)])
    d = dirty.select(F.col(key).alias("_k"), *[F.col(_q(x)).cast("string").alias(f"_d{i}") for i, x in enumerate(cols)])
    j = c.join(d, "_k")
    sums = j.agg(*[F.sum(_differs(F.col(f"_c{i}"), F.col(f"_d{i}"), null_equals_null).cast("long"))
                   .alias(f"_n{i}") for i in range(len(cols))])
    stacked = sums.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), F.coalesce(F.col(f"_n{i}"), F.lit(0)).alias("n"))
        for i, x in enumerate(cols)])))
    return stacked.where(F.col("n") > 0)


def to_long(df: DataFrame, key: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """(row_id, column, value) -- the table as cells."""
    cols = columns or value_columns(df, key)
    return df.select(F.col(key), F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(_q(x)).cast("string").alias("value")) for x in cols])))


def first_write(log: DataFrame, order_col: str = "seq", value_cols=("error_value",),
                key: str = "row_id") -> DataFrame:
    """One record per cell: the earliest by ``order_col`` (first write wins).

    ``min_by`` is a hash aggregate with map-side partial merge, so a cell
    (or key) written millions of times does not become one giant window
    partition.  The struct keeps null values.
    """
    keep = [c for c in log.columns if c not in (key, "column")]
    agg = (log.groupBy(key, "column")
           .agg(F.min_by(F.struct(*[F.col(c) for c in keep]), F.col(order_col)).alias("_w")))
    return agg.select(key, "column", *[F.col("_w")[c].alias(c) for c in keep])


def last_write(log: DataFrame, order_col: str = "seq", key: str = "row_id") -> DataFrame:
    keep = [c for c in log.columns if c not in (key, "column")]
    agg = (log.groupBy(key, "column")
           .agg(F.max_by(F.struct(*[F.col(c) for c in keep]), F.col(order_col)).alias("_w")))
    return agg.select(key, "column", *[F.col("_w")[c].alias(c) for c in keep])


def dedupe_cells(log: DataFrame, used_cells: DataFrame | None = None, order_col: str = "seq",
                 key: str = "row_id") -> DataFrame:
    """First write wins per cell; cells already used are excluded (anti join)."""
    if used_cells is not None:
        log = log.join(used_cells.select(key, "column"), [key, "column"], "left_anti")
    return first_write(log, order_col=order_col, key=key)


def apply_edits(table: DataFrame, edits: DataFrame, value_col: str, key: str = "row_id",
                order_col: str | None = None, last_wins: bool = False, dedupe: bool = True) -> DataFrame:
    """Write ``value_col`` of each edit into its cell.

    Edits are reduced to one map per row (bounded by the number of
    columns) and left-joined on the key, so the table is scanned once and
    rows without edits pass through.  Unknown columns are ignored; edits
    for unknown row ids drop out of the left join.  A null edit value sets
    the cell to null.
    """
    cols = value_columns(table, key)
    e = edits.where(F.col("column").isin(cols))
    if not dedupe:
        # the caller guarantees one edit per cell (e.g. a log made by cell_diff)
        e = e.select(key, "column", value_col)
    elif order_col is None:
        # no write order given: one deterministic edit per cell (smallest value text)
        e = e.select(key, "column", value_col, F.coalesce(F.col(value_col).cast("string"), F.lit("")).alias("_o"))
        order_col = "_o"
    if dedupe:
        e = (last_write if last_wins else first_write)(
            e.select(key, "column", value_col, order_col), order_col=order_col, key=key)
    per_row = (e.groupBy(F.col(key).alias("_ek"))
               .agg(F.map_from_entries(F.collect_list(F.struct(F.col("column"), F.col(value_col).cast("string"))))
                    .alias("_m")))
    j = table.join(per_row, table[key] == per_row["_ek"], "left")
    out = [F.col(key)]
    for c in cols:
        hit = F.coalesce(F.map_contains_key(F.col("_m"), F.lit(c)), F.lit(False))
        out.append(F.when(hit, F.element_at(F.col("_m"), F.lit(c))).otherwise(F.col(_q(c)).cast("string")).alias(c))
    return j.select(*out)


def apply_errors(table: DataFrame, log: DataFrame, key: str = "row_id",
                 order_col: str | None = "seq", dedupe: bool = True) -> DataFrame:
    """Dirty table = clean table with each logged cell set to its error_value (first write wins).

    ``dedupe=False`` skips the per-cell reduction when the log is known to
    hold one record per cell.
    """
    if order_col is not None and order_col not in log.columns:
        order_col = None
    return apply_edits(table, log, "error_value", key=key, order_col=order_col, dedupe=dedupe)


def repair_table(dirty: DataFrame, log: DataFrame, key: str = "row_id",
                 order_col: str | None = "seq", dedupe: bool = True) -> DataFrame:
    """Clean table = dirty table with each logged cell set to its right_value (last write wins)."""
    if order_col is not None and order_col not in log.columns:
        order_col = None
    return apply_edits(dirty, log, "right_value", key=key, order_col=order_col, last_wins=True, dedupe=dedupe)


def unknown_edit_rows(table: DataFrame, log: DataFrame, key: str = "row_id") -> DataFrame:
    """Edits whose row id is not in the table (reported, never appended)."""
    return log.join(table.select(key), key, "left_anti")


def row_index(df: DataFrame, order_by=None, name: str = "row_index") -> DataFrame:
    """Dense 0..n-1 index, distributed.

    ``order_by`` is a column, a list of columns, or None for scan (file) order.
    The (sorted) rows are materialised once, and both the per-partition counts
    and the positions are taken from that one copy: evaluating the sort twice
    would give two different partitionings.  Sort ties get positions in
    whatever order that copy has.  The offsets table has one row per
    partition, so its broadcast is bounded by the partition count, not by the
    data.  Index keys rather than wide tables, and join the index back.
    """
    if order_by is not None:
        df = df.orderBy(*order_by) if isinstance(order_by, (list, tuple)) else df.orderBy(order_by)
    mid = F.monotonically_increasing_id()
    tagged = cut_lineage(df).select("*", F.spark_partition_id().alias("_pid"), mid.alias("_mid"))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    j = tagged.join(F.broadcast(offsets), "_pid")
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return j.select(*[F.col(_q(c)) for c in df.columns], (F.col("_off") + pos).alias(name))


def table_pair_check(clean: DataFrame, dirty: DataFrame, key: str = "row_id") -> DataFrame:
    """One-row shape check of a clean/dirty pair.

    Columns: rows on each side, keys present on one side only, duplicated
    keys on each side, and whether the value columns agree.
    """
    same_cols = int(value_columns(clean, key) == value_columns(dirty, key))
    ck = clean.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_cn"))
    dk = dirty.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_dn"))
    j = ck.join(dk, "_k", "full_outer")
    return j.agg(
        F.coalesce(F.sum("_cn"), F.lit(0)).cast("long").alias("clean_rows"),
        F.coalesce(F.sum("_dn"), F.lit(0)).cast("long").alias("dirty_rows"),
        F.count(F.when(F.col("_dn").isNull(), 1)).cast("long").alias("only_clean"),
        F.count(F.when(F.col("_cn").isNull(), 1)).cast("long").alias("only_dirty"),
        F.count(F.when(F.col("_cn") > 1, 1)).cast("long").alias("dup_clean"),
        F.count(F.when(F.col("_dn") > 1, 1)).cast("long").alias("dup_dirty"),
        F.lit(same_cols).alias("same_columns"),
    )


def cell_diff_positional(clean: DataFrame, dirty: DataFrame, key: str = "row_id",
                         null_equals_null: bool = True) -> DataFrame:
    """Cell diff aligned by row position (file order), not by key -- the reference's
    literal alignment.  Both sides get the dense row index; the key column is then
    compared like any other column."""
    c = row_index(clean, name="_pos")
    d = row_index(dirty, name="_pos")
    cols = [x for x in clean.columns]
    out = cell_diff(c.select("_pos", *[F.col(_q(x)) for x in cols]),
                    d.select("_pos", *[F.col(_q(x)) for x in cols]), key="_pos", columns=cols,
                    null_equals_null=null_equals_null)
    return out.withColumnRenamed("_pos", "position")


def differences(clean: DataFrame, dirty: DataFrame, null_equals_null: bool = False) -> DataFrame:
    """(row, column, right_value, error_value) with row = position in file order and
    column = index in the header, like the reference's difference list.

    Positional alignment and NaN != NaN (two missing cells differ) reproduce
    the literal behaviour by default.  Written as JSON lines (one object per
    difference) rather than one JSON array, so no task or driver holds it all.
    """
    cols = clean.columns
    pos = {c: i for i, c in enumerate(cols)}
    d = cell_diff_positional(clean, dirty, null_equals_null=null_equals_null)
    index = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    return d.select(F.col("position").alias("row"), F.element_at(index, F.col("column")).alias("column"),
                    "right_value", "error_value")


def with_row_ids(df: DataFrame, key: str = "row_id") -> DataFrame:
    """P1 as a table edit: the key column becomes 0..n-1 in file order (overwritten
    when present, inserted first otherwise), as text like every other cell."""
    idx = row_index(df, name="_rix")
    rest = [F.col(_q(c)) for c in df.columns if c != key]
    return idx.select(F.col("_rix").cast("string").alias(key), *rest)
