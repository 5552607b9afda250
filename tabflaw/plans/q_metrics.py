"""Registered queries: distributions and distribution / cell-set metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, metrics as M
from . import fixtures as fx
from .oracle_sql import fixture_sql
from .registry import query

# ---------------------------------------------------------------- SQL pieces

_P = 'p as (select "column", count(*) as n from cust_diff group by "column")'
_Q = 'q as (select "column", count(*) as n from all_glog where "column" <> \'\' group by "column")'
_ALIGN = """a as (select coalesce(p."column", q."column") as "column",
    cast(coalesce(p.n, 0) as double) np, cast(coalesce(q.n, 0) as double) nq
  from p full outer join q on p."column" = q."column"),
t as (select *, np / sum(np) over () pp, nq / sum(nq) over () pq from a)"""


def _pq(spark, sf_dir):
    clean = fx.customer_clean(spark, sf_dir)
    p = cells.errors_by_column(clean, fx.customer_dirty(clean))
    q = M.log_distribution(fx.all_logs(spark, sf_dir, prefix="g"))
    return p, q


@query("errors_by_type", fixture_sql(
    "select dataset, error_type, count(*) as n from all_log group by dataset, error_type"))
def q_errors_by_type(spark, sf_dir):
    return fx.all_logs(spark, sf_dir).groupBy("dataset", "error_type").agg(F.count(F.lit(1)).alias("n"))


@query("log_errors_by_column", fixture_sql(
    "select \"column\", count(*) as n from all_glog where \"column\" <> '' group by \"column\""))
def q_log_errors_by_column(spark, sf_dir):
    return M.log_distribution(fx.all_logs(spark, sf_dir, prefix="g"))


@query("cellchange_counts", fixture_sql(
    "select split_part(_c0, '.', 2) as \"column\", count(*) as n "
    "from (select row_id || '.' || \"column\" as _c0 from cust_glog) group by 1"))
def q_cellchange_counts(spark, sf_dir):
    changes = fx.annotation_log(spark, sf_dir, prefix="g").select(
        F.concat_ws(".", "row_id", "column").alias("_c0"))
    return M.cellchange_distribution(changes)


@query("dist_jaccard", fixture_sql(
    "select avg(least(pp, pq) / (greatest(pp, pq) + 1e-10)) as jaccard from t",
    extra_ctes=f"{_P},\n{_Q},\n{_ALIGN}"), round_cols=('jaccard',))
def q_dist_jaccard(spark, sf_dir):
    return M.dist_jaccard(*_pq(spark, sf_dir))


@query("dist_js", fixture_sql(
    """select sqrt(greatest(0, sum(case when pp > 0 then pp * ln(pp / ((pp + pq) / 2)) else 0 end
                      + case when pq > 0 then pq * ln(pq / ((pp + pq) / 2)) else 0 end) / 2)) as js from t""",
    extra_ctes=f"{_P},\n{_Q},\n{_ALIGN}"), round_cols=('js',))
def q_dist_js(spark, sf_dir):
    return M.dist_js(*_pq(spark, sf_dir))


@query("dist_kl", fixture_sql(
    """select case when sum(np) <= 0 or sum(nq) <= 0 then 0.0 else
         sum(case when pp <= 0 then 0.0 when pq <= 0 then 'Infinity'::double
                  else pp * log2(pp / pq) end) end as kl
       from t""",
    extra_ctes=f"{_P.replace('cust_diff', 'all_glog where \"column\" <> \'\'')},\n"
               f"q as (select \"column\", count(*) as n from cust_diff group by \"column\"),\n{_ALIGN}"), round_cols=('kl',))
def q_dist_kl(spark, sf_dir):
    # KL(generated || real): the generated side has columns the real side lacks -> Infinity.
    p, q = _pq(spark, sf_dir)
    return M.dist_kl(q, p)


@query("dist_kl_finite", fixture_sql(
    """select case when sum(np) <= 0 or sum(nq) <= 0 then 0.0 else
         sum(case when pp <= 0 then 0.0 when pq <= 0 then 'Infinity'::double
                  else pp * log2(pp / pq) end) end as kl
       from t""",
    extra_ctes=f"{_P},\n{_Q},\n{_ALIGN}"), round_cols=('kl',))
def q_dist_kl_finite(spark, sf_dir):
    return M.dist_kl(*_pq(spark, sf_dir))


_CHI_SQL = """k as (select *, count(*) over () kk, sum(np) over () sp, sum(nq) over () sq from a
                    where np + nq > 0),
e as (select *, (np + nq) * sp / (sp + sq) ep, (np + nq) * sq / (sp + sq) eq,
             case when kk = 2 then 0.5 else 0.0 end y from k)"""


@query("chi_square", fixture_sql(
    """select case when max(sp) > 0 and max(sq) > 0 and max(kk) > 1 then
         sum(pow(greatest(abs(np - ep) - least(y, abs(np - ep)), 0), 2) / ep
           + pow(greatest(abs(nq - eq) - least(y, abs(nq - eq)), 0), 2) / eq) else 0.0 end as chi2,
       cast(case when max(sp) > 0 and max(sq) > 0 and max(kk) > 1 then max(kk) - 1 else 0 end as integer) as dof
       from e""",
    extra_ctes=f"{_P},\n{_Q},\n{_ALIGN},\n{_CHI_SQL}"), round_cols=('chi2',))
def q_chi_square(spark, sf_dir):
    return M.chi_square(*_pq(spark, sf_dir)).select("chi2", "dof")


_PVALUE_SQL = """select chi2, dof, case when dof = 0 then 1.0 else greatest(0.0, 1.0 - (
      select sum(exp((dof / 2.0 + n) * ln(chi2 / 2.0) - chi2 / 2.0 - lgamma(dof / 2.0 + n + 1)))
      from generate_series(0, 20000) s(n))) end as p_value
    from st"""


@query("chi_square_test", fixture_sql(
    _PVALUE_SQL,
    extra_ctes=f"""{_P},\n{_Q},\n{_ALIGN},\n{_CHI_SQL},
st as (select case when max(sp) > 0 and max(sq) > 0 and max(kk) > 1 then
         sum(pow(greatest(abs(np - ep) - least(y, abs(np - ep)), 0), 2) / ep
           + pow(greatest(abs(nq - eq) - least(y, abs(nq - eq)), 0), 2) / eq) else 0.0 end as chi2,
       cast(case when max(sp) > 0 and max(sq) > 0 and max(kk) > 1 then max(kk) - 1 else 0 end as integer) as dof
       from e)"""), round_cols=("chi2", "p_value"))
def q_chi_square_test(spark, sf_dir):
    """Statistic, dof and p-value (SQL twin: the incomplete-gamma series summed over a range)."""
    return M.chi_square(*_pq(spark, sf_dir))


_CELL_SQL = """r as (select distinct row_id, "column" from cust_log),
g as (select distinct method, row_id, "column" from (
        select 'g' as method, row_id, "column" from cust_glog union all
        select 'h' as method, row_id, "column" from cust_hlog)),
s as (select g.method, count(*) n_gen, count(r.row_id) tp from g left join r
        on g.row_id = r.row_id and g."column" = r."column" group by g.method)"""


def _methods(spark, sf_dir, dataset="customer"):
    return (fx.annotation_log(spark, sf_dir, dataset, "g").withColumn("method", F.lit("g"))
            .unionByName(fx.annotation_log(spark, sf_dir, dataset, "h").withColumn("method", F.lit("h"))))


@query("cell_f1", fixture_sql(
    """select method, (select count(*) from r) as n_real, n_gen, tp,
         tp / (select count(*) from r) as exact_match,
         tp / n_gen as "precision", tp / (select count(*) from r) as recall,
         case when tp > 0 then 2 * (tp / n_gen) * (tp / (select count(*) from r))
              / ((tp / n_gen) + (tp / (select count(*) from r))) else 0.0 end as f1
       from s""", extra_ctes=_CELL_SQL), round_cols=('exact_match', 'precision', 'recall', 'f1'))
def q_cell_f1(spark, sf_dir):
    real = fx.annotation_log(spark, sf_dir, "customer")
    return M.cell_scores(real, _methods(spark, sf_dir), group_cols=["method"])


@query("exact_match", fixture_sql(
    """select (select count(*) from r) as n_real, count(*) as n_gen,
         count(r.row_id) as tp, count(r.row_id) / (select count(*) from r) as exact_match
       from (select distinct row_id, "column" from cust_glog) g left join r
         on g.row_id = r.row_id and g."column" = r."column" """, extra_ctes=_CELL_SQL), round_cols=('exact_match',))
def q_exact_match(spark, sf_dir):
    real = fx.annotation_log(spark, sf_dir, "customer")
    gen = fx.annotation_log(spark, sf_dir, "customer", "g")
    return M.cell_scores(real, gen).select("n_real", "n_gen", "tp", "exact_match")


@query("rowcol_jaccard", fixture_sql(
    """select (select count(*) from (select row_id from cust_log intersect select row_id from cust_glog))
             / (select count(*) from (select row_id from cust_log union select row_id from cust_glog)) as row_jaccard,
              (select count(*) from (select "column" from cust_log intersect select "column" from cust_glog))
             / (select count(*) from (select "column" from cust_log union select "column" from cust_glog))
             as column_jaccard"""), round_cols=('row_jaccard', 'column_jaccard'))
def q_rowcol_jaccard(spark, sf_dir):
    real = fx.annotation_log(spark, sf_dir, "customer")
    gen = fx.annotation_log(spark, sf_dir, "customer", "g")
    r = M.rowcol_jaccard(real, gen, "row")
    c = M.rowcol_jaccard(real, gen, "column")
    return r.withColumn("column_jaccard", c.select("column_jaccard").scalar())


_REPORT_SQL = """rp as (select "column", count(*) as n from cust_log group by "column"),
gq as (select method, "column", count(*) as n from (
         select 'g' as method, "column" from cust_glog union all
         select 'h' as method, "column" from cust_hlog) group by method, "column"),
m as (select distinct method from gq),
al as (select m.method, rp."column", cast(rp.n as double) np from m join rp on true),
ua as (select coalesce(al.method, gq.method) method, coalesce(al."column", gq."column") "column",
              coalesce(al.np, 0.0) np, cast(coalesce(gq.n, 0) as double) nq
       from al full outer join gq on al.method = gq.method and al."column" = gq."column"),
t as (select *, np / sum(np) over (partition by method) pp, nq / sum(nq) over (partition by method) pq from ua),
dm as (select method,
    avg(least(pp, pq) / (greatest(pp, pq) + 1e-10)) jaccard,
    sqrt(greatest(0, sum(case when pp > 0 then pp * ln(pp / ((pp + pq) / 2)) else 0 end
                      + case when pq > 0 then pq * ln(pq / ((pp + pq) / 2)) else 0 end) / 2)) js
  from t group by method),
r as (select distinct row_id, "column" from cust_log),
gg as (select distinct method, row_id, "column" from (
        select 'g' as method, row_id, "column" from cust_glog union all
        select 'h' as method, row_id, "column" from cust_hlog)),
s as (select gg.method, count(*) n_gen, count(r.row_id) tp from gg left join r
        on gg.row_id = r.row_id and gg."column" = r."column" group by gg.method),
rr as (select distinct row_id from cust_log),
gr as (select distinct method, row_id from gg),
rj as (select gr.method, count(rr.row_id) ni, count(*) nb from gr left join rr on gr.row_id = rr.row_id
       group by gr.method)"""


@query("method_report", fixture_sql(
    """select dm.method, round(dm.jaccard, 9) as jaccard, round(dm.js, 9) as js,
         s.n_gen, s.tp, round(s.tp / (select count(*) from r), 9) as recall,
         round(s.tp / s.n_gen, 9) as "precision",
         round(rj.ni / ((select count(*) from rr) + rj.nb - rj.ni), 9) as row_jaccard
       from dm join s on dm.method = s.method join rj on rj.method = dm.method""",
    extra_ctes=_REPORT_SQL))
def q_method_report(spark, sf_dir):
    """Every generator scored against the same real errors, one job."""
    from .evaluation import method_report
    real = fx.annotation_log(spark, sf_dir, "customer")
    return method_report(real, _methods(spark, sf_dir), methods=["g", "h"])


_TYPED = """typed as (select *, case
  when regexp_matches(right_value, '{re}') then 'numeric'
  when contains(right_value, ':') or contains(right_value, '-') then 'datetime'
  else 'text' end as vtype from all_log where right_value is not null)"""


def _typed_sql():
    from ..functions.values import FLOAT_RE
    return _TYPED.replace("{re}", FLOAT_RE.replace("'", "''"))


@query("numeric_similarity", fixture_sql(
    r"""select dataset, case when count(*) > 0 then 1 - avg(abs(a - b)) /
          (case when stddev_pop(a) > 0 then stddev_pop(a) else 1 end) else 0.0 end as numeric_similarity
        from (select dataset, cast(right_value as double) a, cast(error_value as double) b from typed
              where vtype = 'numeric'
                and regexp_matches(right_value, '^(\d+\.?\d*|\.\d+)$')
                and regexp_matches(error_value, '^(\d+\.?\d*|\.\d+)$'))
        group by dataset""", extra_ctes=_typed_sql()), round_cols=('numeric_similarity',))
def q_numeric_similarity(spark, sf_dir):
    logs = fx.all_logs(spark, sf_dir).where(M.value_type("right_value") == "numeric")
    return M.numeric_similarity(logs, group_cols=["dataset"])


@query("datetime_similarity", fixture_sql(
    """select dataset, case when bool_or(a is null or b is null) then 0.0
                 else 1 - avg(abs(epoch(a) - epoch(b))) / 86400.0 end as datetime_similarity
       from (select dataset, coalesce(try_strptime(right_value, '%Y-%m-%d'), try_strptime(right_value, '%m/%d/%Y'), try_strptime(right_value, '%d/%m/%Y')) a,
                    coalesce(try_strptime(error_value, '%Y-%m-%d'), try_strptime(error_value, '%m/%d/%Y'), try_strptime(error_value, '%d/%m/%Y')) b
             from typed where vtype = 'datetime') group by dataset""", extra_ctes=_typed_sql()), round_cols=('datetime_similarity',))
def q_datetime_similarity(spark, sf_dir):
    logs = fx.all_logs(spark, sf_dir).where(M.value_type("right_value") == "datetime")
    return M.datetime_similarity(logs, group_cols=["dataset"])


# Written forms of a day (Spark pattern), and the seconds from its midnight, in UTC, that they mean.
_FORMS = [("yyyy-MM-dd'T10:00:00+02:00'", 28800), ("yyyy-MM-dd '10:00:00 UTC'", 36000), ("EEE, dd MMM yyyy '15:04:05 GMT'", 54245),
          ("yyyyMMdd'T101112'", 36672), ("yyyy-MM-dd'T10:11:12.345Z'", 36672), ("yyyy.MM.dd", 0), ("d-MMM-yyyy", 0), ("MMMM d, yyyy '3:05 p.m.'", 54300),
          ("M/d/yyyy '7:00 am'", 25200), ("yyyy-MM", None)]


@query("datetime_forms", f"""select {{f}} as form, count(*) as n, count(*) as n_parsed, cast(sum(case when {{f}} = {len(_FORMS) - 1}
    then epoch(date_trunc('month', d)) else epoch(d) + [{', '.join(str(s or 0) for _, s in _FORMS)}][{{f}} + 1] end) as bigint) as seconds
  from (select o_orderkey, date_trunc('day', cast(o_orderdate as timestamp)) as d from orders) group by 1""".format(f=f"(o_orderkey % {len(_FORMS)})"))
def q_datetime_forms(spark, sf_dir):
    """Order dates written in ten forms (offsets, zones, RFC dates, month names), parsed back to seconds."""
    form = F.col("o_orderkey") % len(_FORMS)
    written = None
    for k, (pattern, _) in enumerate(_FORMS):
        text = F.date_format(F.col("o_orderdate"), pattern)
        written = F.when(form == k, text) if written is None else written.when(form == k, text)
    rows = fx.read_table(spark, sf_dir, "orders").select(form.alias("form"), M.parse_datetime(written).alias("t"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count("t").alias("n_parsed"), F.sum(F.unix_timestamp("t")).alias("seconds"))


@query("value_type", fixture_sql(
    """select dataset, "column", vtype as value_type, count(*) as n from typed
       group by dataset, "column", vtype""", extra_ctes=_typed_sql()))
def q_value_type(spark, sf_dir):
    logs = fx.all_logs(spark, sf_dir).where(F.col("right_value").isNotNull())
    return (logs.groupBy("dataset", "column", M.value_type("right_value").alias("value_type"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("row_ids_by_dataset", fixture_sql(
    "select dataset, count(distinct row_id) as n_ids, min(cast(row_id as bigint)) as min_id, "
    "max(cast(row_id as bigint)) as max_id from all_log group by dataset"))
def q_row_ids_by_dataset(spark, sf_dir):
    """Distinct row ids per dataset, kept exploded (one row per id) and summarised."""
    ids = fx.all_logs(spark, sf_dir).select("dataset", "row_id").distinct()
    return ids.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_ids"),
                                      F.min(F.col("row_id").cast("bigint")).alias("min_id"),
                                      F.max(F.col("row_id").cast("bigint")).alias("max_id"))


def _vt_sql(expr):
    re = __import__("tabflaw.functions.values", fromlist=["FLOAT_RE"]).FLOAT_RE.replace("'", "''")
    return (f"case when {expr} is null then null when regexp_matches({expr}, '{re}') then 'numeric' "
            f"when contains({expr}, ':') or contains({expr}, '-') then 'datetime' else 'text' end")


@query("value_type_text", f"""select src, value_type, count(*) as n from (
    select 'documents.lang' as src, {_vt_sql('lang')} as value_type from documents
    union all select 'documents.source', {_vt_sql('source')} from documents
    union all select 'pages.url', {_vt_sql('url')} from pages
    union all select 'events.ts', {_vt_sql("strftime(ts, '%Y-%m-%d %H:%M:%S')")} from events
    union all select 'events.event_type', {_vt_sql('event_type')} from events
    union all select 'orders.o_orderpriority', {_vt_sql('o_orderpriority')} from orders
    union all select 'labels.quality', {_vt_sql('cast(quality as varchar)')} from labels)
  where value_type is not null group by src, value_type""")
def q_value_type_text(spark, sf_dir):
    """Value class (numeric / datetime / text) of raw text cells across the driver tables."""
    from ..sources.tables import read_table
    parts = [
        ("documents.lang", read_table(spark, sf_dir, "documents"), F.col("lang")),
        ("documents.source", read_table(spark, sf_dir, "documents"), F.col("source")),
        ("pages.url", read_table(spark, sf_dir, "pages"), F.col("url")),
        ("events.ts", read_table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        ("events.event_type", read_table(spark, sf_dir, "events"), F.col("event_type")),
        ("orders.o_orderpriority", read_table(spark, sf_dir, "orders"), F.col("o_orderpriority")),
        ("labels.quality", read_table(spark, sf_dir, "labels"), F.col("quality").cast("string")),
    ]
    out = None
    for name, df, col in parts:
        x = df.select(F.lit(name).alias("src"), M.value_type(col).alias("value_type"))
        out = x if out is None else out.unionByName(x)
    return out.where(F.col("value_type").isNotNull()).groupBy("src", "value_type").agg(F.count(F.lit(1)).alias("n"))
