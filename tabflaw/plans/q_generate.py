"""Registered queries: error budget, quota selection, conflict resolution, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..operators import cells, generate as G
from . import fixtures as fx
from .oracle_sql import FIXTURE_CTES, fixture_sql
from .q_prompts import context_sql
from .registry import query

_RATIO, _RATIOS = 0.2, "1:2:4:3"
_W = [1, 2, 4, 3]
_TYPES = ["outliers", "missing_value", "pattern_violation", "rule_violation"]
CUSTOMER_RULE = "EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)"
# A second rule for multi-rule generation (pairs compete for rows).
CUSTOMER_RULES = [CUSTOMER_RULE, "EQ(t1.c_mktsegment,t2.c_mktsegment)&IQ(t1.c_nationkey,t2.c_nationkey)"]


def _budget_sql(table, ncols, ratio=_RATIO, weights=tuple(_W)):
    rows = " union all ".join(
        f"select '{t}' as error_type, {i} as i" for i, t in enumerate(_TYPES))
    shares = ", ".join(str(w / sum(weights)) for w in weights)
    return f"""select error_type, total_errors,
      cast(floor(cast(total_errors as double) * [{shares}][i + 1]) as bigint) as quota
    from (select cast(floor({ratio} * cast(count(*) * {ncols} as double)) as bigint) as total_errors
          from {table}) b, ({rows}) t"""


@query("error_budget", fixture_sql(
    f"select 'customer' as dataset, * from ({_budget_sql('cust_clean', 4)}) union all "
    f"select 'orders' as dataset, * from ({_budget_sql('ord_clean', 5)})"))
def q_error_budget(spark, sf_dir):
    parts = [G.error_budget(fx.clean_table(spark, sf_dir, d), _RATIO, _RATIOS).select(F.lit(d).alias("dataset"), "*")
             for d in ("customer", "orders")]
    return parts[0].unionByName(parts[1])


def _pool(spark, sf_dir):
    """Candidate pool: two generated logs with seeded priorities."""
    g = fx.annotation_log(spark, sf_dir, "customer", "g").withColumn("src", F.lit("g"))
    h = fx.annotation_log(spark, sf_dir, "customer", "h").withColumn("src", F.lit("h"))
    x = g.unionByName(h)
    return x.withColumn("priority", hash_key(42, F.col("src"), F.col("row_id"), F.col("column")))


@query("quota_select", fixture_sql(
    f"""select src, row_id, "column", error_type, priority from (
      select p.*, row_number() over (partition by p.error_type order by p.priority) as rn, b.quota
      from (select *, md5('42|' || src || '|' || row_id || '|' || "column") as priority
            from (select 'g' as src, * from cust_glog union all select 'h' as src, * from cust_hlog)) p
      join ({_budget_sql('cust_clean', 4)}) b on b.error_type = p.error_type)
    where rn <= quota"""))
def q_quota_select(spark, sf_dir):
    budget = G.error_budget(fx.customer_clean(spark, sf_dir), _RATIO, _RATIOS)
    out = G.quota_select(_pool(spark, sf_dir), budget)
    return out.select("src", "row_id", "column", "error_type", "priority")


def _cells_sql(table: str, cols: list[str], seed: int, used: str | None = None) -> str:
    """SQL twin of ``cell_errors`` (CTE body): all value cells in one seeded order; each type takes its first
    eligible ones of what the types before it left.  ``used``: a CTE of (row_id, "column") to leave out."""
    from ..functions.values import FLOAT_RE
    re_ = FLOAT_RE.replace("'", "''")

    def num(x):
        return f"(case when regexp_matches({x}, '{re_}') then try_cast(replace(trim({x}), '_', '') as double) end)"

    pattern = ("case when regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') and try_strptime(v, '%Y-%m-%d') is not null "
               "then strftime(try_strptime(v, '%Y-%m-%d'), '%d/%m/%Y') "
               "when regexp_matches(v, '^\\s*-?\\d+(\\.\\d+)?\\s*$') then v || 'x' "
               "when length(v) > 1 then upper(substr(v, 2)) else v || v end")
    outl = (f"coalesce(case when regexp_matches(v, '^\\s*-?\\d{{1,36}}\\s*$') then cast(cast(trim(v) as hugeint) * 100 as varchar) "
            f"when regexp_matches(v, '^\\s*-?\\d+\\s*$') then trim(v) || '00' end, printf('%.2f', {num('v')} * 100))")
    long = " union all ".join(f"select row_id, '{c}' as \"column\", {c} as v from {table}" for c in cols)
    drop = f' and (row_id, "column") not in (select row_id, "column" from {used})' if used else ""

    def changes(new):
        return (f"coalesce(case when {num(f'trim({new})')} is not null and {num('trim(v)')} is not null "
                f"then {num(f'trim({new})')} <> {num('trim(v)')} else trim({new}) <> trim(v) end, false)")

    def quota(t):
        return f"(select quota from bud where error_type = '{t}')"

    return f"""lg0 as (select *, md5('{seed}|cell|' || row_id || '|' || "column") as priority, {pattern} as pv,
    case when regexp_matches(v, '{re_}') then {outl} end as ov from ({long}) where v is not null{drop}),
lg1 as (select *, regexp_matches(v, '{re_}') and {changes('ov')} as eo, {changes('pv')} as ep from lg0),
lg2 as (select *, eo and row_number() over (partition by eo order by priority) <= {quota('outliers')} as io from lg1),
lg3 as (select *, ep and not io and row_number() over (partition by ep and not io order by priority)
    <= {quota('pattern_violation')} as ip from lg2),
lg4 as (select *, not io and not ip and row_number() over (partition by io or ip order by priority)
    <= {quota('missing_value')} as im from lg3),
props as (select row_id, "column", case when io then 'outliers' when ip then 'pattern_violation' else 'missing_value' end
      as error_type, case when io then ov when ip then pv end as error_value, v as right_value,
    case when im then 1 else 0 end as missing_value, '' as "constraint", '' as tuple_pairs, priority
  from lg4 where io or ip or im)"""


def _pairs_sql(name: str, eq_col: str, seed: int = 42) -> str:
    """Disjoint pairs of ``pick_pairs`` for a one-column EQ rule on cust_clean (CTE body)."""
    return f"""{name} as (select min(cast(row_id as bigint)) as r1, max(cast(row_id as bigint)) as r2 from (
    select row_id, {eq_col} as g, (row_number() over (partition by {eq_col}
      order by md5('{seed}|' || row_id), cast(row_id as bigint)) - 1) // 2 as pr from cust_clean)
  group by g, pr having count(*) = 2)"""


def _violations_sql(pairs: str, rule: str, iq: str, seed: int) -> str:
    """Rule violations of a CTE of pairs (r1, r2): the ERROR columns and the priority."""
    return f"""select cast(p.r1 as varchar) as row_id, '{iq}' as "column", 'rule_violation' as error_type,
    b.{iq} || '*' as error_value, a.{iq} as right_value, 0 as missing_value,
    'Constraint Violation: The {iq} of Row ' || cast(p.r1 as varchar) || ' is different from the {iq} of Row '
      || cast(p.r2 as varchar) as "constraint",
    '(' || cast(p.r1 as varchar) || ', ' || cast(p.r2 as varchar) || ')' as tuple_pairs,
    md5('{seed}|rule_violation|{rule}|' || cast(p.r1 as varchar) || '|{iq}') as priority
  from {pairs} p join cust_clean a on cast(a.row_id as bigint) = p.r1 join cust_clean b on cast(b.row_id as bigint) = p.r2
  where b.{iq} is not null and trim(b.{iq} || '*') is distinct from trim(a.{iq})"""


#: what a candidate uses: its cell; for a rule violation also (ids x edited and named columns) and its rows
_RESOURCES = """case when error_type = 'rule_violation' and len(regexp_extract_all(tuple_pairs, '\\d+')) > 0 then
    list_distinct(list_concat([row_id || '|' || "column"], list_concat(
      flatten(list_transform(list_transform(regexp_extract_all(tuple_pairs, '\\d+'), lambda x: cast(cast(x as bigint) as varchar)),
        lambda x: list_transform(list_concat(["column"], regexp_extract_all(coalesce("constraint", ''), 'The (\\w+) of Row \\d+', 1)),
          lambda c: x || '|' || c))),
      list_transform(regexp_extract_all(tuple_pairs, '\\d+'), lambda x: cast(cast(x as bigint) as varchar) || '|#row'))))
  else [row_id || '|' || "column"] end"""


def _walk_sql(cands: str) -> str:
    """Sequential greedy in priority order as a recursive CTE: one candidate per step, accepted when none of its
    resources is used yet (the reference's loop).  CTEs cand, walk, kept over a CTE ``cands``."""
    return f"""cand as (select row_number() over (order by priority) as i, *, {_RESOURCES} as res from {cands}),
walk(i, used, acc) as (
  select 0, []::varchar[], []::bigint[]
  union all
  select w.i + 1,
         case when list_has_any(w.used, c.res) then w.used else list_concat(w.used, c.res) end,
         case when list_has_any(w.used, c.res) then w.acc else list_append(w.acc, c.i) end
  from walk w join cand c on c.i = w.i + 1),
kept as (select * from cand where i in (select unnest(acc) from walk where i = (select count(*) from cand)))"""


def _propose_sql():
    return f"""with {FIXTURE_CTES},
bud as ({_budget_sql('cust_clean', 4)}),
{_cells_sql('cust_clean', ['c_name', 'c_nationkey', 'c_mktsegment'], 42)},
{_pairs_sql('pp', 'c_nationkey')}
select * from props union all {_violations_sql('pp', CUSTOMER_RULE, 'c_mktsegment', 42)}"""


_ORDER_COLS = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _generate_sql():
    return f"""with {FIXTURE_CTES},
bud as ({_budget_sql('ord_clean', 5)}),
{_cells_sql('ord_clean', _ORDER_COLS, 7)}
select * from props"""


def _shortfall_sql():
    return f"""with {FIXTURE_CTES},
bud as ({_budget_sql('ord_clean', 5, 0.7, (2, 2, 1, 0))}),
{_cells_sql('ord_clean', _ORDER_COLS, 7)}
select b.error_type, b.quota, coalesce(p.n, 0) as produced, greatest(b.quota - coalesce(p.n, 0), 0) as missing
from bud b left join (select error_type, count(*) as n from props group by 1) p using (error_type)"""


@query("generation_shortfall", _shortfall_sql())
def q_generation_shortfall(spark, sf_dir):
    """A budget beyond the numeric cells: every type gets min(quota, eligible cells), the rest is reported."""
    clean = fx.orders_clean(spark, sf_dir)
    return G.shortfall(G.generate_errors(clean, 0.7, "2:2:1:0", seed=7), G.error_budget(clean, 0.7, "2:2:1:0"))


@query("propose_errors", _propose_sql())
def q_propose_errors(spark, sf_dir):
    """Seeded candidate errors per type (default corruptors) plus rule-pair candidates."""
    clean = fx.customer_clean(spark, sf_dir)
    budget = G.error_budget(clean, _RATIO, _RATIOS)
    return G.propose_errors(clean, budget, seed=42, rule=CUSTOMER_RULE)


@query("generate_errors", _generate_sql())
def q_generate_errors(spark, sf_dir):
    """Budget -> propose -> validate -> conflict-free -> quota, on the orders table."""
    clean = fx.orders_clean(spark, sf_dir)
    return G.generate_errors(clean, _RATIO, _RATIOS, seed=7)


def _frag_sql(p: str, ent: str, table: str, k: int) -> str:
    """Fragment CTEs named with prefix ``p`` for entries ``ent`` (no missing-value fill)."""
    return f"""{p}inv as (select entry_id, coalesce(case when error_type = 'rule_violation' then
          [try_cast(split_part(trim(tuple_pairs, '()'), ', ', 1) as bigint),
           try_cast(split_part(trim(tuple_pairs, '()'), ', ', 2) as bigint)]
        when regexp_matches(row_id, '^\\d+$') then [cast(row_id as bigint)] end, []::bigint[]) as involved from {ent}),
{context_sql(table, p + "inv", "gidx", k, p)},
{p}rows as (select c.entry_id, cl.* from {p}ctx c join {table} cl on cl.row_id = c.row_id
          union all
          select v.entry_id, cl.* from (select entry_id, unnest(involved) as id from {p}inv) v
          join {table} cl on cast(cl.row_id as bigint) = v.id),
{p}frag as (select entry_id,
    '| row_id | c_name | c_nationkey | c_mktsegment |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
    string_agg('| ' || concat_ws(' | ', coalesce(row_id, ''), coalesce(c_name, ''), coalesce(c_nationkey, ''),
                                 coalesce(c_mktsegment, '')) || ' |', chr(10)
               order by md5('42|order|' || entry_id || '|' || row_id)) as input
  from {p}rows group by entry_id)"""


def _gen_prompts_sql() -> str:
    from ..functions.constraints import OPERATOR_TEXT
    from ..functions.templates import ERROR_TYPE_DESCRIPTIONS, SUFFIXES, TASK_DESCRIPTIONS

    def lst(opts):
        return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in opts) + "]"

    def idx(part, n):
        return f"(cast('0x' || substr(md5('42|{part}|' || entry_id), 1, 8) as bigint) % {n})"

    tasks, sufs = TASK_DESCRIPTIONS["generation"], SUFFIXES["generation"]
    pat = r"(\w+)\(t\d+\.([^,()]+),t\d+\.([^,()]+)\)"
    op_case = "case regexp_extract(m, '" + pat + "', 1) " + " ".join(
        f"when '{k}' then '{v}'" for k, v in OPERATOR_TEXT.items()) + " end"
    sentence = (f"array_to_string(list_transform(regexp_extract_all(rule, '{pat}'), lambda m: 'The ' || "
                f"regexp_extract(m, '{pat}', 2) || ' of entity 1 ' || {op_case} || ' the ' || "
                f"regexp_extract(m, '{pat}', 3) || ' of entity 2'), ' and ') || '.'")
    desc = "case error_type " + " ".join(
        f"when '{et}' then {lst(o)}[{idx('desc', len(o))} + 1]" for et, o in ERROR_TYPE_DESCRIPTIONS.items()) \
        + " else 'Unknown error type.' end"
    instr = (f"concat_ws(' ', replace({lst(tasks)}[{idx('task', len(tasks))} + 1], '{{error_type}}', error_type), "
             f"{desc}, case when rule <> '' then 'Denial Constraint is: ' || {sentence} || '.' end, "
             f"{lst(sufs)}[{idx('suffix', len(sufs))} + 1])")
    rule = CUSTOMER_RULE
    return f"""with {FIXTURE_CTES},
bud as ({_budget_sql('cust_clean', 4)}),
q as (select max(case when error_type = 'outliers' then quota end) as qo,
             max(case when error_type = 'missing_value' then quota end) as qm,
             max(case when error_type = 'pattern_violation' then quota end) as qp,
             max(case when error_type = 'rule_violation' then quota end) as qr from bud),
gidx as (select *, row_number() over (order by cast(row_id as bigint)) - 1 as row_index from cust_clean),
pent as (select 's' || cast(s.i as varchar) as entry_id,
           case when s.i < q.qo then 'outliers' when s.i < q.qo + q.qm then 'missing_value'
                else 'pattern_violation' end as error_type,
           null::varchar as row_id, '' as tuple_pairs, '' as rule
         from q, range(0, (select qo + qm + qp from q)) s(i)),
{_pairs_sql('pp', 'c_nationkey')},
rch as (select r1, r2 from (
          select *, row_number() over (order by md5('42|rs|{rule}|' || cast(r1 as varchar) || '|' || cast(r2 as varchar))) as rn
          from pp) where rn <= (select qr from q)),
rent as (select 'r' || substr(md5('{rule}'), 1, 8) || '_' || cast(r1 as varchar) || '_' || cast(r2 as varchar) as entry_id,
           'rule_violation' as error_type, cast(r1 as varchar) as row_id,
           '(' || cast(r1 as varchar) || ', ' || cast(r2 as varchar) || ')' as tuple_pairs, '{rule}' as rule from rch),
{_frag_sql('p', 'pent', 'cust_clean', 5)},
{_frag_sql('r', 'rent', 'cust_clean', 3)},
allent as (select entry_id, error_type, rule from pent union all select entry_id, error_type, rule from rent),
allfrag as (select entry_id as fid, input from pfrag union all select entry_id, input from rfrag)
select entry_id, error_type,
  'User:' || chr(10) || {instr} || chr(10) || 'Input:' || chr(10) || input || chr(10) || 'Assistant:' || chr(10) as prompt
from allent join allfrag on fid = entry_id"""


@query("generation_prompts", _gen_prompts_sql())
def q_generation_prompts(spark, sf_dir):
    """Model prompts for every budgeted error slot (rule slots carry a candidate pair)."""
    from .generation import generation_prompts
    clean = fx.customer_clean(spark, sf_dir)
    budget = G.error_budget(clean, _RATIO, _RATIOS)
    return generation_prompts(clean, budget, rule=CUSTOMER_RULE, seed=42,
                              index_order=F.col("row_id").cast("bigint"))


def _greedy_sql() -> str:
    cols = 'row_id, "column", error_type, "constraint", tuple_pairs, priority'
    logs = """select row_id, "column", error_type, "constraint", tuple_pairs,
        md5('42|' || src || '|' || row_id || '|' || "column") as priority
      from (select 'g' as src, * from cust_glog union all select 'h' as src, * from cust_hlog)"""
    return f"""with recursive {FIXTURE_CTES},
{_pairs_sql('p1', 'c_nationkey')},
{_pairs_sql('p2', 'c_mktsegment')},
v1 as ({_violations_sql('p1', CUSTOMER_RULES[0], 'c_mktsegment', 42)}),
v2 as ({_violations_sql('p2', CUSTOMER_RULES[1], 'c_nationkey', 42)}),
lgs as ({logs}),
pool as (select {cols} from lgs union all select {cols} from lgs where substr(priority, 1, 1) = 'a'
  union all select {cols} from v1 union all select {cols} from v2
  union all select row_id, "column", error_type, replace("constraint", 'The c_mktsegment of', 'The c_name of') as "constraint",
    tuple_pairs, md5('named|' || priority) as priority from v1 where substr(priority, 1, 1) < '4'),
{_walk_sql('pool')}
select row_id, "column", error_type, tuple_pairs, priority from kept"""


@query("conflict_free_cells", _greedy_sql())
def q_conflict_free_cells(spark, sf_dir):
    """No cell edited twice (greedy by priority), over two overlapping generated logs, some records of which come
    twice, the violations of two rules, and violations whose constraint names another column than they edit."""
    clean = fx.customer_clean(spark, sf_dir)
    names = ["row_id", "column", "error_type", "constraint", "tuple_pairs", "priority"]
    v1, v2 = (G._rule_candidates(clean, r, 42, "row_id").select(names) for r in CUSTOMER_RULES)
    logs = _pool(spark, sf_dir).select(names)
    first = F.substring("priority", 1, 1)
    named = v1.where(first < "4").withColumn("constraint", F.replace("constraint", F.lit("The c_mktsegment of"), F.lit("The c_name of"))) \
        .withColumn("priority", F.md5(F.concat(F.lit("named|"), "priority")))
    pool = logs.unionByName(logs.where(first == "a")).unionByName(v1).unionByName(v2).unionByName(named)
    return G.conflict_free(pool).select("row_id", "column", "error_type", "tuple_pairs", "priority")


def _apply_generated_sql() -> str:
    """generate_errors(customer, 0.2, 1:2:4:3, two rules, seed 11) applied to the clean table: violations by the
    sequential greedy, then single-cell errors outside the cells they use, then edits."""
    cols = ["c_name", "c_nationkey", "c_mktsegment"]
    seed = 11
    sets = ",\n  ".join(
        f"case when e_{c}.row_id is not null then e_{c}.error_value else c.{c} end as {c}" for c in cols)
    joins = "\n".join(f"left join chosen e_{c} on e_{c}.row_id = c.row_id and e_{c}.\"column\" = '{c}'" for c in cols)
    return f"""with recursive {FIXTURE_CTES},
bud as ({_budget_sql('cust_clean', 4)}),
{_pairs_sql('p1', 'c_nationkey', seed)},
{_pairs_sql('p2', 'c_mktsegment', seed)},
viol as ({_violations_sql('p1', CUSTOMER_RULES[0], 'c_mktsegment', seed)}
  union all {_violations_sql('p2', CUSTOMER_RULES[1], 'c_nationkey', seed)}),
{_walk_sql('viol')},
rv as (select * from (select *, row_number() over (order by priority) as rn from kept)
  where rn <= (select quota from bud where error_type = 'rule_violation')),
usedc as (select split_part(x, '|', 1) as row_id, split_part(x, '|', 2) as "column" from (select unnest(res) as x from rv)),
{_cells_sql('cust_clean', cols, seed, 'usedc')},
chosen as (select row_id, "column", error_value from props union all select row_id, "column", error_value from rv)
select c.row_id,
  {sets}
from cust_clean c
{joins}"""


@query("apply_generated", _apply_generated_sql())
def q_apply_generated(spark, sf_dir):
    """The generated log applied to the clean customer table (rule errors included)."""
    clean = fx.customer_clean(spark, sf_dir)
    log = G.generate_errors(clean, _RATIO, _RATIOS, rule=CUSTOMER_RULES, seed=11)
    return cells.apply_errors(clean, log, order_col=None)
