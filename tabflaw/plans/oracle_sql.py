"""Plain-SQL twins of the fixtures (DuckDB dialect) for the oracle checks.

``fixture_sql(body)`` prefixes a query with CTEs for the clean/dirty pairs
and error logs of ``plans.fixtures``: cust_clean, ord_clean and, for each
damage prefix p in ("", "g", "h"): cust_{p}dirty, ord_{p}dirty,
cust_{p}diff, ord_{p}diff, cust_{p}log, ord_{p}log, all_{p}log.
"""

from __future__ import annotations


def _cust_dirty(p: str) -> str:
    return f"""select row_id,
  case when substr(md5('{p}n|'||row_id),1,1)='0' then null else c_name end c_name,
  case when substr(md5('{p}k|'||row_id),1,1)='1' then c_nationkey||'x' else c_nationkey end c_nationkey,
  case when substr(md5('{p}m|'||row_id),1,1) in ('2','3') then upper(substr(c_mktsegment,2)) else c_mktsegment end c_mktsegment
from cust_clean"""


def _ord_dirty(p: str) -> str:
    return f"""select row_id, o_orderstatus,
  case when substr(md5('{p}o|'||row_id),1,1)='4' then cast(cast(o_totalprice as bigint)*100 as varchar) else o_totalprice end o_totalprice,
  case when substr(md5('{p}d|'||row_id),1,1)='5' then strftime(strptime(o_orderdate,'%Y-%m-%d'),'%d/%m/%Y') else o_orderdate end o_orderdate,
  case when substr(md5('{p}p|'||row_id),1,1)='6' then null else o_orderpriority end o_orderpriority
from ord_clean"""


def _diff(clean: str, dirty: str, cols: list[str]) -> str:
    parts = [f"""select c.row_id, '{x}' as "column", c.{x} as right_value, d.{x} as error_value
  from {clean} c join {dirty} d on c.row_id = d.row_id where c.{x} is distinct from d.{x}""" for x in cols]
    return "\nunion all\n".join(parts)


CUST_COLS = ["c_name", "c_nationkey", "c_mktsegment"]
ORD_COLS = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _cust_log(diff: str) -> str:
    return f"""select d.row_id, d."column",
  case d."column" when 'c_name' then 'missing_value' when 'c_nationkey' then 'pattern_violation'
       when 'c_mktsegment' then 'rule_violation' end as error_type,
  d.error_value, d.right_value,
  case when d."column"='c_name' then 1 else 0 end as missing_value,
  case when d."column"='c_mktsegment' then 'Constraint Violation: The c_mktsegment of Row '||d.row_id||
       ' is different from the c_mktsegment of Row '||
       cast(case when cast(d.row_id as bigint)=b.lo then b.hi else b.lo end as varchar)||
       ' while both rows share c_nationkey' else '' end as "constraint",
  case when d."column"='c_mktsegment' then '('||
       cast(least(cast(d.row_id as bigint), case when cast(d.row_id as bigint)=b.lo then b.hi else b.lo end) as varchar)||', '||
       cast(greatest(cast(d.row_id as bigint), case when cast(d.row_id as bigint)=b.lo then b.hi else b.lo end) as varchar)||')'
       else '' end as tuple_pairs
from {diff} d left join cust_clean cc on cc.row_id = d.row_id
left join cust_bounds b on b.c_nationkey = cc.c_nationkey"""


def _ord_log(diff: str) -> str:
    return f"""select row_id, "column",
  case "column" when 'o_totalprice' then 'outliers' when 'o_orderdate' then 'pattern_violation'
       when 'o_orderpriority' then 'missing_value' end as error_type,
  error_value, right_value,
  case when "column"='o_orderpriority' then 1 else 0 end as missing_value,
  '' as "constraint", '' as tuple_pairs
from {diff}"""


def _fixture_ctes() -> str:
    parts = ["""cust_clean as (select cast(c_custkey as varchar) row_id, c_name,
    cast(c_nationkey as varchar) c_nationkey, c_mktsegment from customer)""",
             """ord_clean as (select cast(o_orderkey as varchar) row_id, o_orderstatus,
    cast(cast(round(o_totalprice*100) as bigint) as varchar) o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') o_orderdate, o_orderpriority from orders)""",
             """cust_bounds as (select c_nationkey, min(cast(row_id as bigint)) lo, max(cast(row_id as bigint)) hi
    from cust_clean group by c_nationkey)"""]
    for p in PREFIXES:
        parts += [f"cust_{p}dirty as ({_cust_dirty(p)})",
                  f"ord_{p}dirty as ({_ord_dirty(p)})",
                  f"cust_{p}diff as ({_diff('cust_clean', f'cust_{p}dirty', CUST_COLS)})",
                  f"ord_{p}diff as ({_diff('ord_clean', f'ord_{p}dirty', ORD_COLS)})",
                  f"cust_{p}log as ({_cust_log(f'cust_{p}diff')})",
                  f"ord_{p}log as ({_ord_log(f'ord_{p}diff')})",
                  f"all_{p}log as (select *, 'customer' as dataset from cust_{p}log "
                  f"union all select *, 'orders' as dataset from ord_{p}log)"]
    return ",\n".join(parts)


# damage draws: "" = real dirty table, "g" / "h" = two generated ones
PREFIXES = ["", "g", "h"]
FIXTURE_CTES = _fixture_ctes()


def fixture_sql(body: str, extra_ctes: str = "") -> str:
    """``with <fixtures>[, <extra>] <body>``"""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"with {FIXTURE_CTES}{extra}\n{body}"
