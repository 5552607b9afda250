"""Registered queries: completion parsing, task outputs, validation, caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import md5_digit
from ..operators import annotations as A
from ..schemas import ERROR_FIELDS
from . import fixtures as fx
from .oracle_sql import fixture_sql
from .registry import query


def _completions(spark, sf_dir):
    """Model-style completions rendered from the generated log; about 1 in 16 is cut
    short (closing brace lost) and must parse to nothing."""
    log = fx.all_logs(spark, sf_dir, prefix="g")
    text = A.render_completion(log)
    broken = md5_digit("c|", F.concat_ws("|", "dataset", "row_id", "column")) == "f"
    text = F.when(broken, F.regexp_replace(text, r"\}$", "")).otherwise(text)
    text = F.concat(F.lit("Sure, here is the error.\n"), text, F.lit("\nHope this helps."))
    return log.select("dataset", F.col("row_id").alias("src_row"), F.col("column").alias("src_column"),
                      text.alias("completion"))


_BROKEN = "substr(md5('c|' || dataset || '|' || row_id || '|' || \"column\"), 1, 1) = 'f'"


@query("parse_completion", fixture_sql(
    f"""select dataset, row_id as src_row, "column" as src_column,
      case when {_BROKEN} then null else row_id end as row_id,
      case when {_BROKEN} then null else "column" end as "column",
      case when {_BROKEN} then null else error_type end as error_type,
      case when {_BROKEN} then null else error_value end as error_value,
      case when {_BROKEN} then null else right_value end as right_value,
      case when {_BROKEN} then null else missing_value end as missing_value,
      case when {_BROKEN} then null else "constraint" end as "constraint",
      case when {_BROKEN} then null else tuple_pairs end as tuple_pairs,
      not ({_BROKEN}) as parse_ok
    from all_glog"""))
def q_parse_completion(spark, sf_dir):
    p = A.parse_completion(_completions(spark, sf_dir))
    return p.select("dataset", "src_row", "src_column", *[F.col("record")[c].alias(c) for c in ERROR_FIELDS],
                    "parse_ok")


@query("task_output", fixture_sql(
    """select dataset, row_id, "column", error_type, error_value, right_value,
         coalesce(missing_value, 0) as missing_value, coalesce("constraint", '') as "constraint",
         coalesce(tuple_pairs, '') as tuple_pairs from all_log"""))
def q_task_output(spark, sf_dir):
    out = A.task_output(fx.all_logs(spark, sf_dir), "correction")
    return out.select("dataset", *[F.col("output")[c].alias(c) for c in ERROR_FIELDS])


@query("task_output_detection", fixture_sql(
    """select dataset, row_id, "column", error_type, error_value from all_log"""))
def q_task_output_detection(spark, sf_dir):
    out = A.task_output(fx.all_logs(spark, sf_dir), "detection")
    return out.select("dataset", *[F.col("output")[c].alias(c) for c in ERROR_FIELDS[:4]])


@query("involved_rows", fixture_sql(
    """select l.row_id || '|' || l."column" as entry_id, c.row_id, c.c_name, c.c_nationkey, c.c_mktsegment
       from cust_log l, unnest(case when l.error_type = 'rule_violation' then
              [cast(split_part(trim(l.tuple_pairs, '()'), ', ', 1) as bigint),
               cast(split_part(trim(l.tuple_pairs, '()'), ', ', 2) as bigint)]
            else [cast(l.row_id as bigint)] end) as u(id)
       join cust_clean c on cast(c.row_id as bigint) = u.id"""))
def q_involved_rows(spark, sf_dir):
    log = fx.annotation_log(spark, sf_dir, "customer").withColumn(
        "entry_id", F.concat_ws("|", "row_id", "column"))
    return A.involved_rows(log, fx.customer_clean(spark, sf_dir))


def _candidates(spark, sf_dir):
    """Generated-log records perturbed into the four validation outcomes."""
    log = fx.annotation_log(spark, sf_dir, "customer", prefix="g")
    k = F.concat_ws("|", "row_id", "column")
    d = md5_digit("v|", k)
    return log.select(
        F.when(d == "b", F.concat(F.col("row_id"), F.lit("999999"))).otherwise(F.col("row_id")).alias("row_id"),
        F.when(d == "a", F.lit("no_such_column")).otherwise(F.col("column")).alias("column"),
        "error_type",
        F.when(d == "c", F.col("right_value")).otherwise(F.col("error_value")).alias("error_value"),
        F.lit("model guess").alias("right_value"))


_VD = "substr(md5('v|' || row_id || '|' || \"column\"), 1, 1)"


@query("validate_candidates", fixture_sql(
    f"""select x.row_id, x."column", x.error_type, x.error_value, c.value as right_value,
      case when x."column" not in ('c_name', 'c_nationkey', 'c_mktsegment') then 'undefined_column'
           when r.row_id is null then 'undefined_row'
           when x.error_value is not distinct from c.value then 'no_change'
           else 'ok' end as status
    from (select case when {_VD} = 'b' then row_id || '999999' else row_id end as row_id,
                 case when {_VD} = 'a' then 'no_such_column' else "column" end as "column",
                 error_type,
                 case when {_VD} = 'c' then right_value else error_value end as error_value
          from cust_glog) x
    left join (select row_id, 'c_name' as "column", c_name as value from cust_clean union all
               select row_id, 'c_nationkey', c_nationkey from cust_clean union all
               select row_id, 'c_mktsegment', c_mktsegment from cust_clean) c
      on c.row_id = x.row_id and c."column" = x."column"
    left join cust_clean r on r.row_id = x.row_id"""))
def q_validate_candidates(spark, sf_dir):
    return A.validate_candidates(_candidates(spark, sf_dir), fx.customer_clean(spark, sf_dir))


@query("generated_cells", fixture_sql(
    """select distinct row_id, "column" from (select row_id, "column" from cust_glog
       union all select row_id, "column" from cust_hlog) where row_id is not null and "column" is not null"""))
def q_generated_cells(spark, sf_dir):
    g = fx.annotation_log(spark, sf_dir, "customer", "g").unionByName(
        fx.annotation_log(spark, sf_dir, "customer", "h"))
    return A.generated_cells(g)


@query("cap_per_type", fixture_sql(
    """select dataset, row_id, "column", error_type from (
         select *, row_number() over (partition by dataset, error_type
                                      order by cast(row_id as bigint), "column") as rn from all_log)
       where rn <= 2500"""))
def q_cap_per_type(spark, sf_dir):
    """At most 2,500 records per (annotation file, error type), in file order."""
    log = fx.all_logs(spark, sf_dir).withColumn(
        "line_no", F.struct(F.col("row_id").cast("bigint"), F.col("column")))
    return A.cap_per_type(log, cap=2500).select("dataset", "row_id", "column", "error_type")
