"""Registered queries: null-token rule, JSON-line log parsing, and round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, md5_digit
from ..functions.values import NA_TOKENS, na_to_null
from ..operators.constraints import pair_groups
from ..schemas import ERROR_FIELDS
from ..session import scratch_path
from ..sources import files as S
from . import fixtures as fx
from .oracle_sql import fixture_sql
from .q_constraints import RULES, _groups_sql
from .registry import query

_TOKENS_SQL = "[" + ", ".join("'" + t + "'" for t in NA_TOKENS) + "]"


@query("scan_csv_na", f"""select row_id, c_name_raw,
    case when list_contains({_TOKENS_SQL}, c_name_raw) then null else c_name_raw end as c_name
  from (select cast(c_custkey as varchar) as row_id,
          case when substr(md5('na|' || cast(c_custkey as varchar)), 1, 1) = '0'
               then {_TOKENS_SQL}[cast('0x' || substr(md5('tok|' || cast(c_custkey as varchar)), 1, 8) as bigint)
                                  % {len(NA_TOKENS)} + 1]
               else c_name end as c_name_raw from customer)""")
def q_scan_csv_na(spark, sf_dir):
    """The CSV null-token rule on text cells: about 1 in 16 names replaced by a pandas null token."""
    c = fx.read_table(spark, sf_dir, "customer")
    rid = F.col("c_custkey").cast("string")
    tok = F.element_at(F.array(*[F.lit(t) for t in NA_TOKENS]),
                       (hash_bucket(F.concat(F.lit("tok|"), rid), len(NA_TOKENS)) + 1).cast("int"))
    raw = F.when(md5_digit("na|", rid) == "0", tok).otherwise(F.col("c_name"))
    x = c.select(rid.alias("row_id"), raw.alias("c_name_raw"))
    return x.select("row_id", "c_name_raw", na_to_null("c_name_raw").alias("c_name"))


_BAD = "substr(md5('j|' || dataset || '|' || row_id || '|' || \"column\"), 1, 1) = '7'"


@query("scan_error_log", fixture_sql(
    f"""select dataset, src_row, src_column,
      case when {_BAD} then null else row_id end as row_id,
      case when {_BAD} then null else "column" end as "column",
      case when {_BAD} then null else error_type end as error_type,
      case when {_BAD} then null else error_value end as error_value,
      case when {_BAD} then null else right_value end as right_value,
      case when {_BAD} then null else missing_value end as missing_value,
      case when {_BAD} then null else "constraint" end as "constraint",
      case when {_BAD} then null else tuple_pairs end as tuple_pairs,
      {_BAD} as bad
    from (select *, row_id as src_row, "column" as src_column from all_glog)"""))
def q_scan_error_log(spark, sf_dir):
    """JSON-lines log parsing (the file reader's parser) over log lines rendered from
    the generated log; about 1 in 16 lines is truncated and must come out as bad."""
    log = fx.all_logs(spark, sf_dir, prefix="g")
    broken = md5_digit("j|", F.concat_ws("|", "dataset", "row_id", "column")) == "7"
    lines = log.select("dataset", F.col("row_id").alias("src_row"), F.col("column").alias("src_column"),
                       F.to_json(F.struct(*[F.col(c) for c in ERROR_FIELDS]),
                                 {"ignoreNullFields": "false"}).alias("value_tmp"), broken.alias("_b"))
    lines = lines.select("dataset", "src_row", "src_column",
                         F.when(F.col("_b"), F.expr("substring(value_tmp, 1, length(value_tmp) - 3)"))
                         .otherwise(F.col("value_tmp")).alias("value"))
    return S.parse_jsonl_lines(lines)


@query("csv_to_json_rows", fixture_sql(
    "select to_json(struct_pack(row_id := row_id, c_name := coalesce(c_name, ''), c_nationkey := coalesce(c_nationkey, ''), "
    "c_mktsegment := coalesce(c_mktsegment, '')))::varchar as value from cust_dirty"))
def q_csv_to_json_rows(spark, sf_dir):
    """S10, one file: the dirty customer table written as CSV, its missing cells as empty fields, each row as one JSON object."""
    path = scratch_path(spark, "csv")
    S.write_csv_table(fx.dirty_table(spark, sf_dir, "customer"), path)
    return S.csv_to_json_rows(S.read_csv_raw(spark, path, multi_line=False))


# ------------------------------------------------------------ round trips through files

@query("csv_round_trip", fixture_sql("select row_id, c_name, c_nationkey, c_mktsegment from cust_dirty"))
def q_csv_round_trip(spark, sf_dir):
    """The dirty customer table written as CSV and scanned again (nulls come back as nulls)."""
    path = scratch_path(spark, "csv")
    S.write_csv_table(fx.dirty_table(spark, sf_dir, "customer"), path)
    return S.read_csv_table(spark, path, multi_line=False)


#: a name that a CSV must quote: with line breaks and quotes for about a quarter of the rows
_QUOTED_SQL = "case when c_name is null then null when substr(md5('nl|' || row_id), 1, 1) < '4' then c_name || chr(10) || '\"so-called\"' || chr(10) else c_name end"


@query("csv_quoted_lines", fixture_sql(f"select row_id, {_QUOTED_SQL} as c_name, c_nationkey, c_mktsegment from cust_dirty"))
def q_csv_quoted_lines(spark, sf_dir):
    """S1, quoted line breaks: the dirty customer table with names of several lines written as CSV, scanned split by split."""
    path = scratch_path(spark, "csv")
    lines = F.concat("c_name", F.lit('\n"so-called"\n'))
    name = F.when(md5_digit("nl|", F.col("row_id")) < "4", lines).otherwise(F.col("c_name"))
    S.write_csv_table(fx.dirty_table(spark, sf_dir, "customer").withColumn("c_name", name), path)
    return S.read_csv_table(spark, path)


@query("csv_typed_key", fixture_sql("select cast(row_id as bigint) as row_id, o_orderstatus, o_totalprice, o_orderdate, "
                                    "o_orderpriority from ord_dirty"))
def q_csv_typed_key(spark, sf_dir):
    """The dirty orders table written as CSV and scanned with a numeric key."""
    path = scratch_path(spark, "csv")
    S.write_csv_table(fx.dirty_table(spark, sf_dir, "orders"), path)
    return S.read_csv_typed_key(spark, path)


@query("cell_changes_scan", fixture_sql("""select row_id, "column" from cust_diff union all select row_id, "column" from ord_diff"""))
def q_cell_changes_scan(spark, sf_dir):
    """S3: changed cells written as a headerless CSV of 'row.column' ids, scanned and taken apart."""
    from ..operators.cells import cell_diff
    from ..operators.metrics import cells_from_cellchanges
    path = scratch_path(spark, "cells")
    for name in ("customer", "orders"):
        cells = cell_diff(fx.clean_table(spark, sf_dir, name), fx.dirty_table(spark, sf_dir, name))
        cells.select(F.concat_ws(".", "row_id", "column").alias("_c0")).write.mode("append").csv(path)
    return cells_from_cellchanges(S.read_cell_changes(spark, path))


@query("error_log_round_trip", fixture_sql(
    """select dataset, row_id, "column", error_type, error_value, right_value, missing_value, "constraint", tuple_pairs,
         false as bad from all_glog"""))
def q_error_log_round_trip(spark, sf_dir):
    """Error logs written as JSON lines in a folder per dataset, found and scanned recursively."""
    path = scratch_path(spark, "logs")
    log = fx.all_logs(spark, sf_dir, prefix="g")
    for name in ("customer", "orders"):
        S.write_jsonl(log.where(F.col("dataset") == name).select(*ERROR_FIELDS), f"{path}/{name}")
    return S.read_error_log(spark, path, glob="*.json", recursive=True).select("dataset", *ERROR_FIELDS, "bad")


@query("csv_tree_to_jsonl", fixture_sql(
    """select 'customer' as dataset, to_json(struct_pack(row_id := row_id, c_name := coalesce(c_name, ''),
         c_nationkey := coalesce(c_nationkey, ''), c_mktsegment := coalesce(c_mktsegment, '')))::varchar as value from cust_dirty
       union all select 'orders', to_json(struct_pack(row_id := row_id, o_orderstatus := coalesce(o_orderstatus, ''),
         o_totalprice := coalesce(o_totalprice, ''), o_orderdate := coalesce(o_orderdate, ''), o_orderpriority := coalesce(o_orderpriority, '')))::varchar from ord_dirty"""))
def q_csv_tree_to_jsonl(spark, sf_dir):
    """S10 over a tree: two tables of different headers below one folder, every row with its own table's columns."""
    path = scratch_path(spark, "tree")
    for name in ("customer", "orders"):
        S.write_csv_table(fx.dirty_table(spark, sf_dir, name), f"{path}/src/{name}")
    S.convert_csv_tree(spark, f"{path}/src", f"{path}/dst", multi_line=False)
    return spark.read.text(f"{path}/dst").select(F.regexp_extract("source", "^([^/]+)/", 1).alias("dataset"), "value")


@query("pair_groups_sink", _groups_sql(RULES[:2]))
def q_pair_groups_sink(spark, sf_dir):
    """S6 sink: pair groups written by rule and read back."""
    path = scratch_path(spark, "pairs")
    for table, key, rule in RULES[:2]:
        S.write_pair_groups(pair_groups(fx.read_table(spark, sf_dir, table).withColumnRenamed(key, "row_id"), rule), path, mode="append")
    return spark.read.parquet(path).select("rule", "group_key", "n_rows", "n_pairs")


@query("pair_map_round_trip", """with o as (select o_custkey, o_orderkey,
    lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders)
  select 'EQ(t1.o_custkey,t2.o_custkey)&IQ(t1.o_orderstatus,"' || cast(o_custkey % 7 as varchar) || '")' as rule,
    o_orderkey as row_id_1, nxt as row_id_2 from o where nxt is not null""")
def q_pair_map_round_trip(spark, sf_dir):
    """Each customer's consecutive orders as candidate pairs of seven rules, written as JSON pair maps and scanned by splits."""
    path = scratch_path(spark, "pair-map")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = fx.read_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("row_id_1"), nxt.alias("row_id_2"))
    rule = F.concat(F.lit('EQ(t1.o_custkey,t2.o_custkey)&IQ(t1.o_orderstatus,"'), (F.col("o_custkey") % 7).cast("string"), F.lit('")'))
    S.write_pair_map(pairs.where("row_id_2 is not null").select(rule.alias("rule"), "row_id_1", "row_id_2"), path)
    return S.read_pair_map(spark, path)


@query("rule_file_groups", f"select rule, group_key, n_rows, n_pairs from ({_groups_sql([(t, k, r) for t, k, r in RULES if t == 'customer'])})")
def q_rule_file_groups(spark, sf_dir):
    """The rules of a rule file, each mined over the customer table."""
    path = scratch_path(spark, "rules")
    mine = [(r,) for t, _, r in RULES if t == "customer"]
    spark.createDataFrame([(f"  {r} ",) for r, in mine] + [("",), ("   ",)], "value string").write.text(path)
    table = fx.read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row_id")
    out = None
    for r in S.read_rules(spark, path).collect():                # a rule file is a short list
        groups = pair_groups(table, r["rule"])
        out = groups if out is None else out.unionByName(groups)
    return out.select("rule", "group_key", "n_rows", "n_pairs")


@query("corpus_files", fixture_sql(
    """select 'Name the error in ' || "column" || '.' as instruction, coalesce(error_value, '') as input,
         to_json(struct_pack(error_type := error_type, right_value := right_value))::varchar as output, dataset,
         case when substr(md5('sp|' || dataset || '|' || row_id || '|' || "column"), 1, 1) = '0' then 'test' else 'train' end as split
       from all_glog"""))
def q_corpus_files(spark, sf_dir):
    """Triplets with object outputs written as JSON lines by dataset and split, and loaded as one corpus."""
    path = scratch_path(spark, "corpus")
    log = fx.all_logs(spark, sf_dir, prefix="g")
    split = F.when(md5_digit("sp|", F.concat_ws("|", "dataset", "row_id", "column")) == "0", "test").otherwise("train")
    triplets = log.select(F.concat(F.lit("Name the error in "), "column", F.lit(".")).alias("instruction"),
                          F.coalesce("error_value", F.lit("")).alias("input"), F.struct("error_type", "right_value").alias("output"),
                          "dataset", split.alias("split"))
    S.write_jsonl(triplets, path, partition_by=["split"])
    return S.load_corpus(spark, path).select("instruction", "input", "output", "dataset", "split")
