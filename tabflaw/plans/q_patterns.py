"""Registered queries: hashed embeddings, exact kNN, pattern and value similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import FLOAT_RE, value_type
from ..functions.vectors import diff, hash_embed
from ..operators import patterns as PT
from ..sources.tables import read_table
from . import fixtures as fx
from .oracle_sql import fixture_sql
from .registry import query

DIM, NGRAM = 64, 3
KS = (1, 2, 3, 4, 5, 10, 15, 20)   # reference k sweep


def _embed_sql(s):
    grams = f"list_transform(range(1, greatest(length({s}) - {NGRAM} + 1, 1) + 1), lambda i: substr({s}, i, {NGRAM}))"
    buckets = f"list_transform({grams}, lambda g: cast('0x' || substr(md5(g), 1, 8) as bigint) % {DIM})"
    vec = f"list_transform(range({DIM}), lambda d: cast(len(list_filter({buckets}, lambda b: b = d)) as double))"
    return f"case when {s} is null or length({s}) = 0 then list_transform(range({DIM}), lambda d: 0.0) else {vec} end"


@query("hash_embed", f"select page_id, {_embed_sql('url')} as vec from pages")
def q_hash_embed(spark, sf_dir):
    """Hashed character-trigram vectors (64 buckets) of every page URL, whole text."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", hash_embed(F.col("url"), DIM, NGRAM).alias("vec"))


_KNN_CTES = """e as (select vec_id as id, label, cast(embedding as double[]) as vec from embeddings),
nx as (select id, vec, lead(id) over (partition by label order by id) as next_id from e),
pp as (select a.id, a.vec as rv, list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] - b.vec[i]) as dv
       from nx a join e b on b.id = a.next_id),
sc as (select q.id as q_id, r.id as r_id, list_cosine_similarity(q.rv, r.rv) as cos,
         case when list_dot_product(q.dv, q.dv) > 0 and list_dot_product(r.dv, r.dv) > 0
              then list_cosine_similarity(q.dv, r.dv) end as pcos
       from pp q join pp r on q.id <> r.id),
rk as (select *, row_number() over (partition by q_id order by cos desc, r_id) as rank from sc)"""


def _knn(spark, sf_dir, k):
    pairs = PT.pattern_pairs(read_table(spark, sf_dir, "embeddings"))
    v = pairs.select("id", F.col("right_emb").alias("vec"), diff("right_emb", "error_emb").alias("diff"))
    return PT.knn_cosine(v, v, k=k, exclude_self=True)


@query("knn_cosine", f"""with {_KNN_CTES}
select q_id, rank, r_id, round(cos, 9) as cos, round(pcos, 9) as pcos from rk where rank <= 5""")
def q_knn_cosine(spark, sf_dir):
    """Exact 5 nearest other transformations by cosine of the right-value embedding."""
    k = _knn(spark, sf_dir, 5)
    return k.select("q_id", F.col("rank").cast("long").alias("rank"), "r_id",
                    F.round("cos", 9).alias("cos"), F.round("pcos", 9).alias("pcos"))


@query("pattern_similarity", f"""with {_KNN_CTES},
ks as (select unnest({list(KS)}) as k),
per as (select ks.k, rk.q_id, max(rk.pcos) as m from rk join ks on rk.rank <= ks.k group by ks.k, rk.q_id)
select k, round(coalesce(avg(m), 0.0), 9) as score from per group by k""")
def q_pattern_similarity(spark, sf_dir):
    """Pattern score for each k of the sweep, from one kNN run at k = 20."""
    s = PT.pattern_scores(_knn(spark, sf_dir, max(KS)), KS)
    return s.select(F.col("k").cast("integer").alias("k"), F.round("score", 9).alias("score"))


def _typed_sql(src):
    re = FLOAT_RE.replace("'", "''")
    return f"""(select *, case when right_value is null then null
      when regexp_matches(right_value, '{re}') then 'numeric'
      when contains(right_value, ':') or contains(right_value, '-') then 'datetime'
      else 'text' end as vtype from {src})"""


_TEXT_SQL = f"""tv as (select dataset, 'real' as side, error_value as v from {_typed_sql('all_log')}
                      where vtype = 'text' and error_value is not null and error_value <> ''
                      union all
                      select dataset, 'gen', error_value from {_typed_sql('all_glog')}
                      where vtype = 'text' and error_value is not null and error_value <> ''),
hv as (select dataset, side, {_embed_sql('v')} as vec from tv)"""


@query("text_similarity", fixture_sql(
    """select a.dataset, avg(coalesce(case when list_dot_product(a.vec, a.vec) > 0 and list_dot_product(b.vec, b.vec) > 0
                                   then list_cosine_similarity(a.vec, b.vec) end, 0.0)) as text_similarity
       from hv a join hv b on a.dataset = b.dataset and a.side = 'real' and b.side = 'gen'
       group by a.dataset""", extra_ctes=_TEXT_SQL), round_cols=('text_similarity',))
def q_text_similarity(spark, sf_dir):
    """Mean all-pairs cosine of real vs generated text error values (hashed embeddings)."""
    def side(prefix):
        log = fx.all_logs(spark, sf_dir, prefix=prefix)
        t = log.where((value_type("right_value") == "text") & F.col("error_value").isNotNull()
                      & (F.col("error_value") != ""))
        return t.select("dataset", hash_embed(F.col("error_value"), DIM, NGRAM).alias("vec"))
    return PT.text_similarity(side(""), side("g"), group_cols=["dataset"])


_SEM_SQL = f"""pr as (select r.dataset, r.error_value as tv, g.error_value as gv from all_log r join all_glog g
         on r.dataset = g.dataset and r.row_id = g.row_id and r."column" = g."column"),
ty as (select *, case when tv is null then null
      when regexp_matches(tv, '{FLOAT_RE.replace("'", "''")}') then 'numeric'
      when contains(tv, ':') or contains(tv, '-') then 'datetime' else 'text' end as vtype from pr),
ds as (select distinct dataset from pr),
tx as (select dataset, 't' as side, {_embed_sql('tv')} as vec from ty where vtype = 'text'
       union all select dataset, 'g', {_embed_sql('gv')} from ty where vtype = 'text'),
ts as (select a.dataset, avg(coalesce(case when list_dot_product(a.vec, a.vec) > 0 and list_dot_product(b.vec, b.vec) > 0
                                   then list_cosine_similarity(a.vec, b.vec) end, 0.0)) as s
       from tx a join tx b on a.dataset = b.dataset and a.side = 't' and b.side = 'g' group by a.dataset),
ns as (select dataset, case when count(*) > 0 then 1 - avg(abs(a - b)) /
          (case when stddev_pop(a) > 0 then stddev_pop(a) else 1 end) else 0.0 end as s
       from (select dataset, cast(tv as double) a, cast(gv as double) b from ty where vtype = 'numeric'
             and regexp_matches(tv, '^(\\d+\\.?\\d*|\\.\\d+)$') and regexp_matches(gv, '^(\\d+\\.?\\d*|\\.\\d+)$'))
       group by dataset),
dts as (select dataset, case when bool_or(a is null or b is null) then 0.0
           else 1 - avg(abs(epoch(a) - epoch(b))) / 86400.0 end as s
        from (select dataset, coalesce(try_strptime(tv, '%Y-%m-%d'), try_strptime(tv, '%m/%d/%Y'), try_strptime(tv, '%d/%m/%Y')) a,
                     coalesce(try_strptime(gv, '%Y-%m-%d'), try_strptime(gv, '%m/%d/%Y'), try_strptime(gv, '%d/%m/%Y')) b
              from ty where vtype = 'datetime') group by dataset)"""


@query("semantic_similarity", fixture_sql(
    """select ds.dataset, round(0.5 * coalesce(ts.s, 0) + 0.3 * coalesce(ns.s, 0) + 0.2 * coalesce(dts.s, 0), 9)
         as semantic_similarity
       from ds left join ts on ts.dataset = ds.dataset left join ns on ns.dataset = ds.dataset
       left join dts on dts.dataset = ds.dataset""", extra_ctes=_SEM_SQL))
def q_semantic_similarity(spark, sf_dir):
    """0.5 text + 0.3 numeric + 0.2 datetime similarity of generated vs real values,
    paired by cell and typed by the real value."""
    from .evaluation import semantic_similarity
    return semantic_similarity(fx.all_logs(spark, sf_dir), fx.all_logs(spark, sf_dir, prefix="g"),
                               group_cols=["dataset"], dim=DIM, ngram=NGRAM)


def _hid(cols):
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(cols)})), 1, 15) as bigint)"


_PREP = """select id, rv, list_transform(range(1, {dim} + 1), lambda i: rv[i] - ev[i]) as dv from (
  select {hid} as id, {er} as rv, {ee} as ev
  from (select *, row_number() over (partition by row_id, "column", right_value, error_value) as nth from {src})
  where right_value is not null and error_value is not null and right_value <> ''
    and error_value <> '' and right_value <> error_value)"""


def _pattern_report_sql():
    def prep(src):
        return _PREP.format(hid=_hid(["row_id", '"column"', "right_value", "error_value", "cast(nth as varchar)"]), er=_embed_sql("right_value"),
                            ee=_embed_sql("error_value"), dim=DIM, src=src)
    return fixture_sql(f"""select k, round(coalesce(avg(m), 0.0), 9) as score from (
    select ks.k, rk.q_id, max(rk.pcos) as m from rk join (select unnest({list(KS)}) as k) ks on rk.rank <= ks.k
    group by ks.k, rk.q_id) group by k""", extra_ctes=f"""gq as ({prep('cust_glog')}),
rq as ({prep('cust_log')}),
sc as (select q.id as q_id, r.id as r_id, list_cosine_similarity(q.rv, r.rv) as cos,
         case when list_dot_product(q.dv, q.dv) > 0 and list_dot_product(r.dv, r.dv) > 0
              then list_cosine_similarity(q.dv, r.dv) end as pcos
       from gq q join rq r on true),
rk as (select *, row_number() over (partition by q_id order by cos desc, r_id) as rank from sc)""")


@query("pattern_report", _pattern_report_sql())
def q_pattern_report(spark, sf_dir):
    """C6 on text: generated vs real (right -> error) transformations of the customer logs."""
    from .evaluation import pattern_report
    s = pattern_report(fx.annotation_log(spark, sf_dir, "customer"),
                       fx.annotation_log(spark, sf_dir, "customer", "g"), KS, DIM, NGRAM)
    return s.select(F.col("k").cast("integer").alias("k"), F.round("score", 9).alias("score"))


@query("embedding_cache", """with u as (select distinct url as value, min(page_id % 2) over (partition by url) as odd from pages where url is not null),
  c as (select count(*) as n, count(*) filter (where odd = 0) as first from u)
  select 1 as run, first as n_values, first as n_embedded from c union all select 2, n, n - first from c union all select 3, n, 0 from c""")
def q_embedding_cache(spark, sf_dir):
    """Page urls embedded through the cache in three runs: those of even pages, all, all again."""
    from ..operators.patterns import cached_embeddings
    from ..session import cut_lineage, scratch_path
    path, out, before = scratch_path(spark, "embeddings"), None, 0
    pages = fx.read_table(spark, sf_dir, "pages")
    for run, rows in ((1, pages.where("page_id % 2 = 0")), (2, pages), (3, pages)):
        got = cached_embeddings(rows, path, hash_embed, "url")
        cached = spark.read.parquet(path).count()
        # each run's line is a table of its own: in one plan Spark would take the scans of the growing folder for one scan
        line = cut_lineage(got.agg(F.lit(run).alias("run"), F.count("*").alias("n_values"), F.lit(cached - before).cast("bigint").alias("n_embedded")))
        out, before = line if out is None else out.unionByName(line), cached
    return out
