"""Registered queries: cell diff, counts, apply / repair, dedupe, row index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells
from ..sources.tables import read_table
from . import fixtures as fx
from .oracle_sql import fixture_sql
from .registry import query


@query("cell_diff", fixture_sql("select row_id, \"column\", right_value, error_value from cust_diff"))
def q_cell_diff(spark, sf_dir):
    clean = fx.customer_clean(spark, sf_dir)
    return cells.cell_diff(clean, fx.customer_dirty(clean), key="row_id")


@query("errors_by_column", fixture_sql(
    "select \"column\", count(*) as n from cust_diff group by \"column\""))
def q_errors_by_column(spark, sf_dir):
    clean = fx.customer_clean(spark, sf_dir)
    return cells.errors_by_column(clean, fx.customer_dirty(clean))


@query("cell_diff_orders", fixture_sql("select row_id, \"column\", right_value, error_value from ord_diff"))
def q_cell_diff_orders(spark, sf_dir):
    clean = fx.orders_clean(spark, sf_dir)
    return cells.cell_diff(clean, fx.orders_dirty(clean))


@query("apply_errors", fixture_sql("select * from cust_dirty"))
def q_apply_errors(spark, sf_dir):
    """Round trip: clean + real log == dirty."""
    clean = fx.customer_clean(spark, sf_dir)
    log = fx.annotation_log(spark, sf_dir, "customer")
    return cells.apply_errors(clean, log, order_col=None)


@query("repair_table", fixture_sql("select * from ord_clean"))
def q_repair_table(spark, sf_dir):
    """Round trip: dirty + real log (right values) == clean."""
    dirty = fx.dirty_table(spark, sf_dir, "orders")
    log = fx.annotation_log(spark, sf_dir, "orders")
    return cells.repair_table(dirty, log, order_col=None)


_DEDUPE_SQL = fixture_sql("""
select row_id, "column", error_type, error_value, right_value, src from (
  select *, row_number() over (partition by row_id, "column" order by src, cast(row_id as bigint)) rn
  from (select row_id, "column", error_type, error_value, right_value, 0 as src from cust_log
        union all
        select row_id, "column", error_type, error_value, right_value, 1 as src from cust_glog)
) where rn = 1""")


def _two_logs(spark, sf_dir, dataset="customer"):
    real = fx.annotation_log(spark, sf_dir, dataset).withColumn("src", F.lit(0))
    gen = fx.annotation_log(spark, sf_dir, dataset, prefix="g").withColumn("src", F.lit(1))
    both = real.unionByName(gen)
    return both.withColumn("seq", F.struct(F.col("src"), F.col("row_id").cast("bigint")))


@query("dedupe_cells", _DEDUPE_SQL)
def q_dedupe_cells(spark, sf_dir):
    both = _two_logs(spark, sf_dir).select("row_id", "column", "error_type", "error_value",
                                           "right_value", "src", "seq")
    out = cells.dedupe_cells(both, order_col="seq")
    return out.select("row_id", "column", "error_type", "error_value", "right_value", "src")


_APPLY_BOTH_SQL = fixture_sql("""
select c.row_id,
  case when e1.row_id is not null then e1.error_value else c.c_name end c_name,
  case when e2.row_id is not null then e2.error_value else c.c_nationkey end c_nationkey,
  case when e3.row_id is not null then e3.error_value else c.c_mktsegment end c_mktsegment
from cust_clean c
left join firsts e1 on e1.row_id = c.row_id and e1."column" = 'c_name'
left join firsts e2 on e2.row_id = c.row_id and e2."column" = 'c_nationkey'
left join firsts e3 on e3.row_id = c.row_id and e3."column" = 'c_mktsegment'""",
    extra_ctes="""firsts as (select row_id, "column", error_value from (
  select *, row_number() over (partition by row_id, "column" order by src) rn
  from (select row_id, "column", error_value, 0 src from cust_log union all
        select row_id, "column", error_value, 1 src from cust_glog)) where rn = 1)""")


@query("apply_errors_first_wins", _APPLY_BOTH_SQL)
def q_apply_errors_first_wins(spark, sf_dir):
    """Two overlapping logs applied to one table; the earlier write wins per cell."""
    clean = fx.customer_clean(spark, sf_dir)
    both = _two_logs(spark, sf_dir)
    return cells.apply_errors(clean, both, order_col="seq")


@query("row_index_orders", """select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) as row_index
  from orders""")
def q_row_index_orders(spark, sf_dir):
    """P1 over the larger table: only the key is sorted and indexed."""
    return cells.row_index(read_table(spark, sf_dir, "orders").select("o_orderkey"), order_by="o_orderkey")


@query("row_index", """select cast(c_custkey as varchar) row_id, c_name,
  cast(row_number() over (order by c_custkey) - 1 as bigint) as row_index from customer""")
def q_row_index(spark, sf_dir):
    c = fx.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("row_id"), "c_name", "c_custkey")
    out = cells.row_index(c, order_by="c_custkey")
    return out.select("row_id", "c_name", "row_index")


@query("table_pair_check", fixture_sql("""
select (select count(*) from ord_clean) as clean_rows,
       (select count(*) from ord_gdirty) as dirty_rows,
       cast(0 as bigint) as only_clean, cast(0 as bigint) as only_dirty,
       cast(0 as bigint) as dup_clean, cast(0 as bigint) as dup_dirty, 1 as same_columns"""))
def q_table_pair_check(spark, sf_dir):
    return cells.table_pair_check(fx.clean_table(spark, sf_dir, "orders"),
                                  fx.dirty_table(spark, sf_dir, "orders", "g"))


_PROFILE_SQL = fixture_sql("""
select dataset, n_rows, n_cols, error_cells,
       round(error_cells / (n_rows * n_cols), 6) as error_rate, error_types
from (
  select 'customer' as dataset, (select count(*) from cust_clean) as n_rows, 3 as n_cols,
         (select count(*) from cust_log) as error_cells,
         (select string_agg(distinct error_type, ',' order by error_type) from cust_log) as error_types
  union all
  select 'orders', (select count(*) from ord_clean), 4,
         (select count(*) from ord_log),
         (select string_agg(distinct error_type, ',' order by error_type) from ord_log)
)""")


@query("dataset_profile", _PROFILE_SQL)
def q_dataset_profile(spark, sf_dir):
    from ..operators.metrics import dataset_profile
    parts = []
    for d in ("customer", "orders"):
        clean = fx.clean_table(spark, sf_dir, d)
        parts.append(dataset_profile(clean, fx.annotation_log(spark, sf_dir, d), d))
    return parts[0].unionByName(parts[1])
