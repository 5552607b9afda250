"""Registered queries: denial-constraint text functions and pair-group mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constraints as CF
from ..functions.hashing import hash_bucket
from ..operators import constraints as C
from ..operators import dominance as D
from ..sources.tables import read_table
from . import fixtures as fx
from .oracle_sql import fixture_sql
from .registry import query

# Mining rules over the driver tables (table, key column, rule).
RULES = [
    ("customer", "c_custkey", "EQ(t1.c_nationkey,t2.c_nationkey)"),
    ("customer", "c_custkey", "EQ(t1.c_nationkey,t2.c_nationkey)&EQ(t1.c_mktsegment,t2.c_mktsegment)"),
    ("documents", "doc_id", "EQ(t1.text,t2.text)"),
    ("part", "p_partkey", "EQ(t1.p_brand,t2.p_brand)&EQ(t1.p_type,t2.p_type)&EQ(t1.p_size,t2.p_size)"),
    ("part", "p_partkey", "EQ(t1.p_name,t2.p_name)"),
    ("supplier", "s_suppkey", "EQ(t1.s_nationkey,t2.s_nationkey)"),
]

VIOLATION_RULES = [
    ("customer", "c_custkey", "EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)"),
    ("documents", "doc_id", "EQ(t1.text,t2.text)&IQ(t1.source,t2.source)"),
    ("part", "p_partkey", "EQ(t1.p_brand,t2.p_brand)&EQ(t1.p_type,t2.p_type)&EQ(t1.p_size,t2.p_size)"
                          "&IQ(t1.p_retailprice,t2.p_retailprice)"),
    ("orders", "o_orderkey", "EQ(t1.o_custkey,t2.o_custkey)&LT(t1.o_totalprice,t2.o_totalprice)"),
    ("orders", "o_orderkey", "EQ(t1.o_custkey,t2.o_custkey)&GTE(t1.o_orderdate,t2.o_orderdate)"),
]


def _table(spark, sf_dir, name, key):
    return read_table(spark, sf_dir, name).withColumnRenamed(key, "row_id")


def sql_group_key(cols):
    """SQL of ``constraints.group_key`` (for output; the twins group by the columns themselves)."""
    parts = ", ".join(f"coalesce(cast(length(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), 'n')"
                      for c in cols)
    return f"md5(concat_ws(',', {parts}))"


def _sql_gk(rule, prefix=""):
    return sql_group_key([prefix + c for c in C.eq_columns(rule)])


def _cols(rule):
    return ", ".join(C.eq_columns(rule))


def _groups_sql(rules):
    parts = []
    for t, key, rule in rules:
        parts.append(f"""select '{rule}' as rule, {_sql_gk(rule)} as group_key, count(*) as n_rows,
  cast(cast(count(*) as hugeint) * (count(*) - 1) // 2 as decimal(38,0)) as n_pairs
  from {t} group by {_cols(rule)} having count(*) >= 2""")
    return "\nunion all\n".join(parts)


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


@query("dc_candidate_pairs", _groups_sql(RULES))
def q_dc_candidate_pairs(spark, sf_dir):
    """Candidate pairs of each rule as pair groups (every two rows of a group are a pair)."""
    return _union([C.pair_groups(_table(spark, sf_dir, t, k), r) for t, k, r in RULES])


@query("dc_pair_count", f"""select rule, count(*) as n_groups, cast(sum(n_rows) as bigint) as n_rows,
  cast(sum(n_pairs) as decimal(38,0)) as n_pairs from ({_groups_sql(RULES)}) group by rule""")
def q_dc_pair_count(spark, sf_dir):
    return C.pair_totals(q_dc_candidate_pairs(spark, sf_dir))


def _viol_sql(t, rule):
    p = C._non_eq(rule)
    col = p.left
    if p.op in ("LTE", "GTE"):
        body = "nn * (nn - 1) // 2"
    else:
        body = "nn * (nn - 1) // 2 - same"
    return f"""select '{rule}' as rule, group_key, cast(nn as bigint) as n_rows,
  cast({body} as decimal(38,0)) as n_pairs from (
    select {_sql_gk(rule)} as group_key, sum(m) as nn, sum(m * (m - 1) // 2) as same from (
      select {_cols(rule)}, {col} as v, cast(count(*) as hugeint) as m
      from {t} where {col} is not null group by all) group by {_cols(rule)})
  where {body} > 0"""


@query("dc_violations", "\nunion all\n".join(_viol_sql(t, r) for t, _, r in VIOLATION_RULES))
def q_dc_violations(spark, sf_dir):
    """Pairs that satisfy every predicate of the rule (real violations), per group."""
    return _union([C.violation_counts(_table(spark, sf_dir, t, k), r) for t, k, r in VIOLATION_RULES])


def _viol_rows_sql(t, key, rule):
    p = C._non_eq(rule)
    col = p.left
    cond = "count(*) >= 2" if p.op in ("LTE", "GTE") else f"min({col}) <> max({col})"
    return f"""select '{rule}' as rule, {key} as row_id from {t}
  where {col} is not null and {_sql_gk(rule)} in (
    select {_sql_gk(rule)} from {t} where {col} is not null group by {_cols(rule)} having {cond})"""


@query("dc_violation_rows", "\nunion all\n".join(_viol_rows_sql(t, k, r) for t, k, r in VIOLATION_RULES))
def q_dc_violation_rows(spark, sf_dir):
    return _union([C.violation_rows(_table(spark, sf_dir, t, k), r) for t, k, r in VIOLATION_RULES])


_SCOPE_RULE = "EQ(t1.c_nationkey,t2.c_nationkey)"


@query("dc_pairs_scoped", fixture_sql(f"""select '{_SCOPE_RULE}' as rule, {_sql_gk(_SCOPE_RULE)} as group_key,
  count(*) as n_rows, cast(cast(count(*) as hugeint) * (count(*) - 1) // 2 as decimal(38,0)) as n_pairs
  from customer where cast(c_custkey as varchar) in (select row_id from cust_log)
  group by c_nationkey having count(*) >= 2"""))
def q_dc_pairs_scoped(spark, sf_dir):
    """Candidate pairs with both rows inside a scope (rows that carry a real error)."""
    t = _table(spark, sf_dir, "customer", "c_custkey")
    ids = fx.annotation_log(spark, sf_dir, "customer").select(F.col("row_id").cast("bigint").alias("row_id"))
    return C.pair_groups(C.scoped(t, ids), _SCOPE_RULE)


@query("subset_by_ids", fixture_sql(
    "select * from cust_clean where row_id in (select row_id from cust_glog)"))
def q_subset_by_ids(spark, sf_dir):
    clean = fx.customer_clean(spark, sf_dir)
    return C.scoped(clean, fx.annotation_log(spark, sf_dir, "customer", "g"))


_PART_RULE = RULES[3][2]


@query("subset_by_pairs", f"""select * from part where {_sql_gk(_PART_RULE)} in (
  select {_sql_gk(_PART_RULE)} from part group by {_cols(_PART_RULE)} having count(*) >= 2)""")
def q_subset_by_pairs(spark, sf_dir):
    """Rows of ``part`` that occur in any candidate pair of the brand/type/size rule."""
    part = read_table(spark, sf_dir, "part")
    members = C.pair_members(_table(spark, sf_dir, "part", "p_partkey"), _PART_RULE)
    return part.join(members.select(F.col("row_id").alias("p_partkey")), "p_partkey", "left_semi")


@query("pick_pairs", f"""select '{_SCOPE_RULE}' as rule, group_key, min(id) as row_id_1, max(id) as row_id_2 from (
  select *, (row_number() over (partition by nk order by h, id) - 1) // 2 as pr from (
    select c_nationkey as nk, {_sql_gk(_SCOPE_RULE)} as group_key, c_custkey as id,
      md5('42|' || cast(c_custkey as varchar)) as h from customer))
  group by group_key, nk, pr having count(*) = 2""")
def q_pick_pairs(spark, sf_dir):
    return C.pick_pairs(_table(spark, sf_dir, "customer", "c_custkey"), _SCOPE_RULE, seed=42)


# ------------------------------------------------------------ text functions

# Operator order used to draw demo rules per log record.
_OPS = ["EQ", "IQ", "LT", "GT", "LTE", "GTE"]


def _log_rules(spark, sf_dir):
    """One rule per generated error record: two predicates with hash-drawn operators."""
    log = fx.all_logs(spark, sf_dir, prefix="g")
    ops = F.array(*[F.lit(o) for o in _OPS])
    k = F.concat_ws("|", "dataset", "row_id", "column")
    op1 = F.element_at(ops, (hash_bucket(k, 6) + 1).cast("int"))
    op2 = F.element_at(ops, (hash_bucket(F.concat(k, F.lit("#")), 6) + 1).cast("int"))
    rule = F.concat(op1, F.lit("(t1."), F.col("column"), F.lit(",t2."), F.col("column"), F.lit(")&"),
                    op2, F.lit("(t1.row_id,t2.row_id)"))
    return log.select("dataset", "row_id", "column", rule.alias("rule"))


_RULES_SQL = """lr as (select dataset, row_id, "column",
  ['EQ','IQ','LT','GT','LTE','GTE'][cast('0x' || substr(md5(dataset || '|' || row_id || '|' || "column"), 1, 8) as bigint) % 6 + 1]
  || '(t1.' || "column" || ',t2.' || "column" || ')&' ||
  ['EQ','IQ','LT','GT','LTE','GTE'][cast('0x' || substr(md5(dataset || '|' || row_id || '|' || "column" || '#'), 1, 8) as bigint) % 6 + 1]
  || '(t1.row_id,t2.row_id)' as rule from all_glog)"""

_TEXT = {"EQ": "is equal to", "IQ": "is different from", "LT": "is less than", "GT": "is greater than",
         "LTE": "is less than or equal to", "GTE": "is greater than or equal to"}


def _op_case(x):
    return "case " + x + " " + " ".join(f"when '{k}' then '{v}'" for k, v in _TEXT.items()) + " end"


@query("dc_parse", fixture_sql(
    """select dataset, row_id, "column", split_part(rule, '(', 1) as op1,
         split_part(split_part(split_part(rule, '&', 1), '(t1.', 2), ',', 1) as left1,
         split_part(split_part(split_part(rule, '&', 2), '(', 1), '(', 1) as op2,
         cast(len(string_split(rule, '&')) as integer) as n_predicates from lr""", extra_ctes=_RULES_SQL))
def q_dc_parse(spark, sf_dir):
    r = _log_rules(spark, sf_dir).withColumn("_p", CF.dc_parse("rule"))
    return r.select("dataset", "row_id", "column", F.col("_p")[0]["op"].alias("op1"),
                    F.col("_p")[0]["left"].alias("left1"), F.col("_p")[1]["op"].alias("op2"),
                    F.size("_p").alias("n_predicates"))


@query("dc_to_text", fixture_sql(
    f"""select dataset, row_id, "column",
      'The ' || "column" || ' of entity 1 ' || {_op_case("split_part(rule, '(', 1)")} || ' the ' || "column"
      || ' of entity 2 and The row_id of entity 1 ' || {_op_case("split_part(split_part(rule, '&', 2), '(', 1)")}
      || ' the row_id of entity 2.' as text from lr""", extra_ctes=_RULES_SQL))
def q_dc_to_text(spark, sf_dir):
    r = _log_rules(spark, sf_dir)
    return r.select("dataset", "row_id", "column", CF.dc_to_text("rule").alias("text"))


@query("constraint_entities", fixture_sql(
    """select row_id, "column", case when "constraint" = '' then 'Invalid constraint format.' else
       'Denial Constraint is: The c_mktsegment of entity 1 is different from the c_mktsegment of '
       || case when tuple_pairs = '(' || row_id || ', ' || row_id || ')' then 'entity 1' else 'entity 2' end
       || ' while both rows share c_nationkey' end as text from cust_log"""))
def q_constraint_entities(spark, sf_dir):
    log = fx.annotation_log(spark, sf_dir, "customer")
    return log.select("row_id", "column", CF.constraint_entities("constraint").alias("text"))


@query("tuple_ids", fixture_sql(
    """select row_id, "column", case when tuple_pairs = '' then []::bigint[]
         when a = b then [a] else [a, b] end as ids from (
       select *, try_cast(split_part(trim(tuple_pairs, '()'), ', ', 1) as bigint) as a,
                 try_cast(split_part(trim(tuple_pairs, '()'), ', ', 2) as bigint) as b
       from cust_log)"""))
def q_tuple_ids(spark, sf_dir):
    log = fx.annotation_log(spark, sf_dir, "customer")
    return log.select("row_id", "column", CF.tuple_ids("tuple_pairs").alias("ids"))


@query("tuple_ids_strict", fixture_sql(
    """select row_id, "column", case when tuple_pairs = '' then null else
         [cast(split_part(trim(tuple_pairs, '()'), ', ', 1) as bigint),
          cast(split_part(trim(tuple_pairs, '()'), ', ', 2) as bigint)] end as ids from cust_log"""))
def q_tuple_ids_strict(spark, sf_dir):
    log = fx.annotation_log(spark, sf_dir, "customer")
    return log.select("row_id", "column", CF.tuple_ids_strict("tuple_pairs").alias("ids"))


@query("rule_cells", fixture_sql(
    """select distinct l.row_id as source_row, cast(u.id as varchar) as row_id, 'c_mktsegment' as "column"
       from cust_log l, unnest([cast(split_part(trim(tuple_pairs, '()'), ', ', 1) as bigint),
                                cast(split_part(trim(tuple_pairs, '()'), ', ', 2) as bigint)]) as u(id)
       where l.tuple_pairs <> ''"""))
def q_rule_cells(spark, sf_dir):
    """Cells touched by each rule error: tuple ids x columns named in the constraint."""
    from ..operators.annotations import rule_cells
    log = fx.annotation_log(spark, sf_dir, "customer")
    return rule_cells(log)


# Rules with several non-EQ predicates (counted by inclusion-exclusion).
MULTI_RULES = [
    ("part", "p_partkey", "EQ(t1.p_brand,t2.p_brand)&IQ(t1.p_type,t2.p_type)&IQ(t1.p_size,t2.p_size)"),
    ("orders", "o_orderkey", "EQ(t1.o_custkey,t2.o_custkey)&IQ(t1.o_orderstatus,t2.o_orderstatus)"
                             "&LT(t1.o_totalprice,t2.o_totalprice)"),
    ("customer", "c_custkey", "EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)"
                              "&GTE(t1.c_acctbal,t2.c_acctbal)"),
]


def _brute_viol_sql(t, key, rule):
    differ, present = C.violation_spec(rule)
    nn = " and ".join(f"{c} is not null" for c in differ + present)
    gk = _sql_gk(rule)
    cond = " and ".join(f"a.{c} <> b.{c}" for c in differ) or "true"
    return f"""select '{rule}' as rule, p.group_key, n.n_rows, cast(p.n_pairs as decimal(38,0)) as n_pairs from (
    select a.gk as group_key, count(*) as n_pairs
    from (select *, {gk} as gk from {t} where {nn}) a
    join (select *, {gk} as gk from {t} where {nn}) b on a.gk = b.gk and a.{key} < b.{key} and {cond}
    group by a.gk) p
  join (select {gk} as group_key, count(*) as n_rows from {t} where {nn} group by 1) n on n.group_key = p.group_key"""


def _brute_rows_sql(t, key, rule):
    differ, present = C.violation_spec(rule)
    nn = " and ".join(f"{c} is not null" for c in differ + present)
    gk = _sql_gk(rule)
    cond = " and ".join(f"a.{c} <> b.{c}" for c in differ) or "true"
    return f"""select distinct '{rule}' as rule, a.{key} as row_id
    from (select *, {gk} as gk from {t} where {nn}) a
    join (select *, {gk} as gk from {t} where {nn}) b on a.gk = b.gk and a.{key} <> b.{key} and {cond}"""


@query("dc_violations_multi", "\nunion all\n".join(_brute_viol_sql(t, k, r) for t, k, r in MULTI_RULES))
def q_dc_violations_multi(spark, sf_dir):
    """Real violations of rules with several non-EQ predicates (oracle: brute-force self-join)."""
    return _union([C.violation_counts(_table(spark, sf_dir, t, k), r) for t, k, r in MULTI_RULES])


@query("dc_violation_rows_multi", "\nunion all\n".join(_brute_rows_sql(t, k, r) for t, k, r in MULTI_RULES))
def q_dc_violation_rows_multi(spark, sf_dir):
    return _union([C.violation_rows(_table(spark, sf_dir, t, k), r) for t, k, r in MULTI_RULES])


# Rules whose EQ predicates compare different columns.
CROSS_RULES = [
    ("customer", "c_custkey", "EQ(t1.c_custkey,t2.c_nationkey)"),
    ("orders", "o_orderkey", "EQ(t1.o_custkey,t2.o_custkey)&EQ(t1.o_orderkey,t2.o_custkey)"),
    ("part", "p_partkey", "EQ(t1.p_size,t2.p_partkey)"),
]


def _cross_join_sql(t, key, rule):
    left, right = C._eq_sides(rule)
    on = " and ".join(f"a.{x} is not distinct from b.{y}" for x, y in zip(left, right))
    return f"from {t} a join {t} b on {on} and a.{key} <> b.{key}"


@query("dc_cross_pairs", "\nunion all\n".join(
    f"select '{r}' as rule, cast(count(*) as decimal(38,0)) as n_pairs from (select distinct "
    f"least(a.{k}, b.{k}) as x, greatest(a.{k}, b.{k}) as y {_cross_join_sql(t, k, r)})"
    for t, k, r in CROSS_RULES))
def q_dc_cross_pairs(spark, sf_dir):
    """Candidate pairs of EQ rules across different columns, counted without listing them
    (oracle: brute-force self-join with least/greatest de-duplication)."""
    return _union([C.cross_pair_count(read_table(spark, sf_dir, t), r, key=k) for t, k, r in CROSS_RULES])


@query("dc_cross_members", "\nunion all\n".join(
    f"select distinct '{r}' as rule, x as row_id from (select a.{k} as x {_cross_join_sql(t, k, r)} "
    f"union all select b.{k} {_cross_join_sql(t, k, r)})"
    for t, k, r in CROSS_RULES))
def q_dc_cross_members(spark, sf_dir):
    out = _union([C.cross_pair_members(read_table(spark, sf_dir, t), r, key=k).withColumnRenamed(k, "row_id")
                  for t, k, r in CROSS_RULES])
    return out


# Rules with two order predicates, and rules with a predicate across columns.
ORDER2_RULES = [
    ("orders", "o_orderkey", "EQ(t1.o_orderpriority,t2.o_orderpriority)&LT(t1.o_orderdate,t2.o_orderdate)&GT(t1.o_totalprice,t2.o_totalprice)"),
    ("customer", "c_custkey", "EQ(t1.c_nationkey,t2.c_nationkey)&LTE(t1.c_mktsegment,t2.c_mktsegment)&GTE(t1.c_acctbal,t2.c_acctbal)"),
    ("part", "p_partkey", "EQ(t1.p_brand,t2.p_brand)&GTE(t1.p_size,t2.p_size)&LTE(t1.p_type,t2.p_type)"),
]
ACROSS_RULES = [
    ("part", "p_partkey", "EQ(t1.p_brand,t2.p_brand)&LT(t1.p_size,t2.p_partkey)"),
    ("customer", "c_custkey", "EQ(t1.c_mktsegment,t2.c_mktsegment)&GTE(t1.c_nationkey,t2.c_custkey)"),
    ("orders", "o_orderkey", "EQ(t1.o_orderpriority,t2.o_orderpriority)&IQ(t1.o_orderkey,t2.o_custkey)"),
]


def _either_way(rule):
    sign = {"LT": "<", "GT": ">", "LTE": "<=", "GTE": ">=", "IQ": "<>"}
    preds = C.parse_rule(rule)
    eq = " and ".join(f"a.{p.left} is not distinct from b.{p.left}" for p in preds if p.op == "EQ")
    ways = [" and ".join(f"{x}.{p.left} {sign[p.op]} {y}.{p.right}" for p in preds if p.op != "EQ") for x, y in ("ab", "ba")]
    return f"{eq} and (({ways[0]}) or ({ways[1]}))"


def _order_counts_sql(t, key, rule):
    sides = [" and ".join(f"{getattr(p, s)} is not null" for p in C.parse_rule(rule) if p.op != "EQ") for s in ("left", "right")]
    return f"""select '{rule}' as rule, s.group_key, s.n_rows, cast(p.n as decimal(38,0)) as n_pairs
  from (select {_sql_gk(rule)} as group_key, count(*) as n_rows from {t} where ({sides[0]}) or ({sides[1]}) group by 1) s
  join (select group_key, count(*) as n from (select a.* from (select *, {_sql_gk(rule)} as group_key from {t}) a
    join {t} b on a.{key} < b.{key} and {_either_way(rule)}) group by 1) p using (group_key)"""


def _order_rows_sql(t, key, rule):
    return f"""select '{rule}' as rule, a.{key} as row_id from {t} a
  where exists (select 1 from {t} b where a.{key} <> b.{key} and {_either_way(rule)})"""


@query("dc_violations_order2", "\nunion all\n".join(_order_counts_sql(*r) for r in ORDER2_RULES))
def q_dc_violations_order2(spark, sf_dir):
    """Violations of rules with two order predicates, by dominance counts (oracle: brute-force self-join)."""
    return _union([D.order_violation_counts(read_table(spark, sf_dir, t), r, key=k) for t, k, r in ORDER2_RULES])


@query("dc_violation_rows_order2", "\nunion all\n".join(_order_rows_sql(*r) for r in ORDER2_RULES[1:]))
def q_dc_violation_rows_order2(spark, sf_dir):
    """Rows in some violation of a rule with two order predicates."""
    return _union([D.order_violation_rows(read_table(spark, sf_dir, t), r, key=k).withColumnRenamed(k, "row_id") for t, k, r in ORDER2_RULES[1:]])


@query("dc_violations_across", "\nunion all\n".join(_order_counts_sql(*r) for r in ACROSS_RULES))
def q_dc_violations_across(spark, sf_dir):
    """Violations of rules with an order or inequality predicate across columns (oracle: brute-force self-join)."""
    return _union([D.order_violation_counts(read_table(spark, sf_dir, t), r, key=k) for t, k, r in ACROSS_RULES])


@query("dc_violation_rows_across", "\nunion all\n".join(_order_rows_sql(*r) for r in ACROSS_RULES))
def q_dc_violation_rows_across(spark, sf_dir):
    """Rows in some violation of a rule with a predicate across columns."""
    return _union([D.order_violation_rows(read_table(spark, sf_dir, t), r, key=k).withColumnRenamed(k, "row_id") for t, k, r in ACROSS_RULES])


@query("pick_pairs_cross")
def q_pick_pairs_cross(spark, sf_dir):
    """Disjoint pairs of rules whose EQ predicates compare different columns (held against the definition in the tests)."""
    return _union([C.pick_pairs(read_table(spark, sf_dir, t), r, key=k) for t, k, r in CROSS_RULES])
