"""Registered queries: prompt corpus pieces (Markdown, instructions, split, few-shot)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import cut_lineage
from ..functions.templates import ERROR_TYPE_DESCRIPTIONS, SUFFIXES, TASK_DESCRIPTIONS
from ..operators import prompts as P
from . import fixtures as fx
from .oracle_sql import fixture_sql
from .registry import query

K = 5          # context rows per entry (reference sample size)
SPLIT = 0.9    # train share (reference default)


# ------------------------------------------------------------------ Spark side

def _entries(spark, sf_dir):
    log = fx.annotation_log(spark, sf_dir, "customer")
    return log.withColumn("entry_id", F.concat_ws("|", "row_id", "column"))


def _fragments(spark, sf_dir):
    clean = fx.customer_clean(spark, sf_dir)
    return P.build_fragments(_entries(spark, sf_dir), clean, k=K, seed=42,
                             index_order=F.col("row_id").cast("bigint"))


def _instructions(spark, sf_dir, task="generation"):
    e = _entries(spark, sf_dir)
    return e.select("entry_id", "error_type", "row_id", "column", "error_value", "right_value",
                    "missing_value", "constraint", "tuple_pairs",
                    P.instruction_text(task, F.col("error_type"), F.col("constraint"), F.col("entry_id"))
                    .alias("instruction"))


# ------------------------------------------------------------------ SQL side

def _lst(opts):
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in opts) + "]"


def _idx(part, key, n):
    return f"(cast('0x' || substr(md5('42|{part}|' || {key}), 1, 8) as bigint) % {n})"


def _instr_sql(task="generation"):
    t = f"replace({_lst(TASK_DESCRIPTIONS[task])}[{_idx('task', 'entry_id', len(TASK_DESCRIPTIONS[task]))} + 1], " \
        "'{error_type}', coalesce(error_type, 'None'))"
    d = "case error_type " + " ".join(
        f"when '{et}' then {_lst(o)}[{_idx('desc', 'entry_id', len(o))} + 1]"
        for et, o in ERROR_TYPE_DESCRIPTIONS.items()) + " else 'Unknown error type.' end"
    c0 = "replace(\"constraint\", 'Constraint Violation: ', '')"
    rows = f"regexp_extract_all({c0}, 'Row (\\d+)', 1)"
    c = (f"case when coalesce(\"constraint\", '') <> '' then case when len({rows}) < 2 then "
         f"'Invalid constraint format.' else 'Denial Constraint is: ' || regexp_replace(regexp_replace({c0}, "
         f"'Row ' || {rows}[1] || '\\b', 'entity 1', 'g'), 'Row ' || {rows}[2] || '\\b', 'entity 2', 'g') end end")
    s = f"{_lst(SUFFIXES[task])}[{_idx('suffix', 'entry_id', len(SUFFIXES[task]))} + 1]"
    return f"concat_ws(' ', {t}, {d}, {c}, {s})"


def context_sql(table: str, inv: str, idx: str, k: int, p: str = "") -> str:
    """CTEs {p}st, {p}dr, {p}ctx: the seeded steps, draws and chosen context rows of the entries in ``inv``."""
    h = "cast('0x' || substr(md5('42|{}|' || entry_id), 1, 15) as bigint)"
    return f"""{p}st as (select n, coalesce((select list(c order by i) from (select c, min(i) as i from (
      select i, 1 + cast('0x' || substr(md5('42|stride|' || cast(i as varchar)), 1, 15) as bigint) % nn.n as c
      from range(0, 256) r(i), (select count(*) as n from {table}) nn where nn.n > 0) x
      where gcd(c, (select count(*) from {table})) = 1 group by c order by i limit 64)), [1]) as cs
  from (select count(*) as n from {table})),
{p}dr as (select entry_id, involved, draw, ({h.format('ctx')} % n + draw * cs[{h.format('step')} % len(cs) + 1]) % n as pos
  from {inv}, {p}st, lateral (select unnest(range(0, least(n, {k} + len(involved)))) as draw) where n > 0),
{p}ctx as (select entry_id, row_id, draw from (
    select dr.entry_id, x.row_id, dr.draw, row_number() over (partition by dr.entry_id order by dr.draw) as r
    from {p}dr dr join {idx} x on x.row_index = dr.pos
    where not list_contains(dr.involved, try_cast(x.row_id as bigint))) where r <= {k})"""


def _frag_ctes(table: str = "cust_clean", task: str = "generation") -> str:
    """SQL twin of the fragment / instruction CTEs for one task (its source table)."""
    return f"""ent as (select row_id || '|' || "column" as entry_id, * from cust_log),
inv as (select entry_id, coalesce(case when error_type = 'rule_violation' then
          [try_cast(split_part(trim(tuple_pairs, '()'), ', ', 1) as bigint),
           try_cast(split_part(trim(tuple_pairs, '()'), ', ', 2) as bigint)]
        else [cast(row_id as bigint)] end, []::bigint[]) as involved from ent),
idx as (select *, row_number() over (order by cast(row_id as bigint)) - 1 as row_index from {table}),
{context_sql(table, "inv", "idx", K)},
frows as (select c.entry_id, cl.* from ctx c join {table} cl on cl.row_id = c.row_id
          union all
          select v.entry_id, cl.* from (select entry_id, unnest(involved) as id from inv) v
          join {table} cl on cast(cl.row_id as bigint) = v.id),
filled as (select f.entry_id, f.row_id,
    case when e.error_type = 'missing_value' and f.row_id = e.row_id and e."column" = 'c_name'
         then coalesce(e.error_value, '') else f.c_name end as c_name,
    case when e.error_type = 'missing_value' and f.row_id = e.row_id and e."column" = 'c_nationkey'
         then coalesce(e.error_value, '') else f.c_nationkey end as c_nationkey,
    case when e.error_type = 'missing_value' and f.row_id = e.row_id and e."column" = 'c_mktsegment'
         then coalesce(e.error_value, '') else f.c_mktsegment end as c_mktsegment
  from frows f left join ent e on e.entry_id = f.entry_id),
frag as (select entry_id,
    '| row_id | c_name | c_nationkey | c_mktsegment |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
    string_agg('| ' || concat_ws(' | ', coalesce(row_id, ''), coalesce(c_name, ''), coalesce(c_nationkey, ''),
                                 coalesce(c_mktsegment, '')) || ' |', chr(10)
               order by md5('42|order|' || entry_id || '|' || row_id),
                        '| ' || concat_ws(' | ', coalesce(row_id, ''), coalesce(c_name, ''), coalesce(c_nationkey, ''),
                                 coalesce(c_mktsegment, '')) || ' |') as input
  from filled group by entry_id),
ins as (select entry_id, error_type, {_instr_sql(task)} as instruction from ent)"""


_FRAG_CTES = _frag_ctes()


@query("markdown_fragment", fixture_sql("select entry_id, input from frag", extra_ctes=_FRAG_CTES))
def q_markdown_fragment(spark, sf_dir):
    """Generation-task input per entry: involved rows + 5 context rows as Markdown."""
    return _fragments(spark, sf_dir)


@query("context_rows", fixture_sql("select entry_id, row_id, draw from ctx", extra_ctes=_FRAG_CTES))
def q_context_rows(spark, sf_dir):
    from ..operators.annotations import involved_ids
    from ..operators.cells import row_index
    e = _entries(spark, sf_dir)
    e = e.withColumn("involved", involved_ids(e))
    clean = fx.customer_clean(spark, sf_dir)
    idx = row_index(clean.select("row_id"), order_by=F.col("row_id").cast("bigint"))
    return P.context_draws(e, idx, idx.count(), K, 42).select("entry_id", "row_id", F.col("_draw").alias("draw"))


@query("markdown_row_ids", fixture_sql(
    """select 'customer' as dataset, entry_id, list_transform(string_split(input, chr(10))[3:],
                                       lambda l: trim(string_split(l, '|')[2])) as row_ids from frag""",
    extra_ctes=_FRAG_CTES))
def q_markdown_row_ids(spark, sf_dir):
    """Parse Markdown back: dataset by header line, first cell of each data line."""
    headers = P.header_table(spark, {d: fx.clean_table(spark, sf_dir, d) for d in ("customer", "orders")})
    out = P.markdown_row_ids(_fragments(spark, sf_dir), headers)
    return out.select("dataset", "entry_id", "row_ids")


@query("markdown_missing", fixture_sql(
    """select entry_id, input from frag where entry_id in (select entry_id from ent where error_type = 'missing_value')""",
    extra_ctes=_FRAG_CTES))
def q_markdown_missing(spark, sf_dir):
    """Fragments of missing-value entries: the annotated cell shows the logged error value."""
    ids = _entries(spark, sf_dir).where(F.col("error_type") == "missing_value").select("entry_id")
    return _fragments(spark, sf_dir).join(ids, "entry_id", "left_semi")


@query("instruction_text", fixture_sql("select entry_id, instruction from ins", extra_ctes=_FRAG_CTES))
def q_instruction_text(spark, sf_dir):
    return _instructions(spark, sf_dir).select("entry_id", "instruction")


@query("prompt_text", fixture_sql(
    """select i.entry_id, 'User:' || chr(10) || i.instruction || chr(10) || 'Input:' || chr(10) || f.input
         || chr(10) || 'Assistant:' || chr(10) as prompt
       from ins i join frag f on f.entry_id = i.entry_id""", extra_ctes=_FRAG_CTES))
def q_prompt_text(spark, sf_dir):
    i = _instructions(spark, sf_dir)
    f = _fragments(spark, sf_dir)
    return i.join(f, "entry_id").select("entry_id", P.prompt_text(F.col("instruction"), F.col("input")).alias("prompt"))


@query("prompt_length_stats", fixture_sql(
    """select quantile_cont(n, 0.1) as p10, quantile_cont(n, 0.7) as p70, quantile_cont(n, 0.8) as p80,
         quantile_cont(n, 0.9) as p90, max(n) as max_len, round(avg(n), 6) as mean_len,
         cast(sum(n) as bigint) as total_len
       from (select length('User:' || chr(10) || i.instruction || chr(10) || 'Input:' || chr(10) || f.input
         || chr(10) || 'Assistant:' || chr(10)) as n from ins i join frag f on f.entry_id = i.entry_id)""",
    extra_ctes=_FRAG_CTES), round_cols=('p10', 'p70', 'p80', 'p90'))
def q_prompt_length_stats(spark, sf_dir):
    p = q_prompt_text(spark, sf_dir).select(F.length("prompt").alias("n"))
    return p.agg(F.percentile("n", 0.1).alias("p10"), F.percentile("n", 0.7).alias("p70"),
                 F.percentile("n", 0.8).alias("p80"), F.percentile("n", 0.9).alias("p90"),
                 F.max("n").cast("long").alias("max_len"), F.round(F.avg("n"), 6).alias("mean_len"),
                 F.sum("n").alias("total_len"))


_SPLIT_CTES = f"""sp as (select entry_id, error_type,
    case when row_number() over (order by md5('42|split|' || entry_id)) - 1
              < floor((select count(*) from ent) * {SPLIT}) then 'train' else 'test' end as split from ent)"""


@query("split_rows", fixture_sql("select entry_id, split from sp", extra_ctes=_FRAG_CTES + ",\n" + _SPLIT_CTES))
def q_split_rows(spark, sf_dir):
    return P.split_rows(_entries(spark, sf_dir).select("entry_id"), SPLIT, seed=42)


def _H(part):
    return f"cast('0x' || substr(md5('42|{part}|' || sp.entry_id), 1, 15) as bigint)"


_FEW_CTES = f"""tr as (select entry_id, error_type,
    row_number() over (partition by error_type order by md5('42|fs|' || entry_id)) - 1 as tpos
    from sp where split = 'train'),
tn as (select error_type, count(*) as n from tr group by 1),
fc as (select sp.entry_id, sp.error_type, sp.split, coalesce(tn.n, 0) as n, tr.tpos,
         {_H('fs0')} as h0, {_H('fs1')} as h1, {_H('fsm')} as hm
       from sp left join tn on tn.error_type = sp.error_type left join tr on tr.entry_id = sp.entry_id),
fm as (select *,
    case when split = 'test' then (case when n > 1 then least(2, n) else 0 end)
         else (case when n > 1 then hm % (least(2, n - 1) + 1) else 0 end) end as m,
    case when split = 'test' then h0 % greatest(n, 1)
         else (case when h0 % greatest(n - 1, 1) >= tpos then h0 % greatest(n - 1, 1) + 1
                    else h0 % greatest(n - 1, 1) end) end as p0,
    case when split = 'test' then (h0 % greatest(n, 1) + 1 + h1 % greatest(n - 1, 1)) % greatest(n, 1)
         else (case when (h0 % greatest(n - 1, 1) + 1 + h1 % greatest(n - 2, 1)) % greatest(n - 1, 1) >= tpos
                    then (h0 % greatest(n - 1, 1) + 1 + h1 % greatest(n - 2, 1)) % greatest(n - 1, 1) + 1
                    else (h0 % greatest(n - 1, 1) + 1 + h1 % greatest(n - 2, 1)) % greatest(n - 1, 1) end) end as p1
  from fc),
fp as (select entry_id, error_type, 0 as j, p0 as ex_pos from fm where m >= 1
       union all select entry_id, error_type, 1 as j, p1 as ex_pos from fm where m >= 2)"""


def _corpus(spark, sf_dir, fewshot=True, checkpoint=True):
    from .corpus import build_corpus
    return build_corpus(_entries(spark, sf_dir), fx.customer_clean(spark, sf_dir), "generation", k=K, seed=42,
                        ratio=SPLIT, fewshot=fewshot, index_order=F.col("row_id").cast("bigint"),
                        checkpoint=checkpoint)


@query("fewshot_rank", fixture_sql(
    "select fp.entry_id, fp.j, tr.entry_id as ex_id from fp join tr on tr.error_type = fp.error_type "
    "and tr.tpos = fp.ex_pos", extra_ctes=_FRAG_CTES + ",\n" + _SPLIT_CTES + ",\n" + _FEW_CTES))
def q_fewshot_rank(spark, sf_dir):
    """Exemplars per entry: test -> 2 of its type's train entries; train -> 0-2 others."""
    c = _corpus(spark, sf_dir, fewshot=False)
    return P.fewshot_pairs(c, seed=42).select("entry_id", "j", "ex_id")


@query("fewshot_join", fixture_sql(
    """select sp.entry_id, sp.split, coalesce(x.shots, '') as shots from sp left join (
         select fp.entry_id, string_agg(chr(10) || 'Input:' || chr(10) || f.input || chr(10) || 'Output:' || chr(10)
                || '#' || chr(10), '' order by fp.j) as shots
         from fp join tr on tr.error_type = fp.error_type and tr.tpos = fp.ex_pos
         join frag f on f.entry_id = tr.entry_id group by fp.entry_id) x on x.entry_id = sp.entry_id""",
    extra_ctes=_FRAG_CTES + ",\n" + _SPLIT_CTES + ",\n" + _FEW_CTES))
def q_fewshot_join(spark, sf_dir):
    """Few-shot text appended to each instruction (the output JSON masked as '#':
    JSON layout differs between engines, the exemplar choice and inputs do not)."""
    c = _corpus(spark, sf_dir, fewshot=False, checkpoint=False).withColumn("output_json", F.lit("#"))
    c = cut_lineage(c)
    shots = P.add_fewshot(c, seed=42).select("entry_id", "split", "instruction")
    base = c.select("entry_id", F.length("instruction").alias("_n"))
    return shots.join(base, "entry_id").select(
        "entry_id", "split", F.expr("substring(instruction, _n + 1)").alias("shots"))


@query("sample_fragment", fixture_sql(
    """select '| row_id | c_name | c_nationkey | c_mktsegment |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
         string_agg('| ' || concat_ws(' | ', coalesce(row_id, ''), coalesce(c_name, ''), coalesce(c_nationkey, ''),
                    coalesce(c_mktsegment, '')) || ' |', chr(10) order by h) as input
       from (select *, md5('42|sample|' || row_id) as h from cust_clean order by h limit 5)"""))
def q_sample_fragment(spark, sf_dir):
    """A 5-row random fragment of the table (top-5 by seeded hash, a distributed top-k)."""
    clean = fx.customer_clean(spark, sf_dir)
    s = clean.withColumn("_o", hash_key(42, F.lit("sample"), F.col("row_id"))).orderBy("_o").limit(5)
    md = P.markdown_tables(s.withColumn("_g", F.lit(1)), "_g", "_o", clean.columns)
    return md.select(F.col("markdown").alias("input"))


_OUT_JSON = """oj as (select entry_id, to_json(struct_pack(row_id := row_id, "column" := "column",
    error_type := error_type, error_value := error_value, right_value := right_value,
    missing_value := coalesce(missing_value, 0), "constraint" := coalesce("constraint", ''),
    tuple_pairs := coalesce(tuple_pairs, '')))::varchar as output_json from ent)"""


_CORPUS_SQL = """select sp.split, sp.entry_id,
         i.instruction || coalesce(x.shots, '') as instruction, f.input, o.output_json
       from sp join ins i on i.entry_id = sp.entry_id join frag f on f.entry_id = sp.entry_id
       join oj o on o.entry_id = sp.entry_id
       left join (select fp.entry_id, string_agg(chr(10) || 'Input:' || chr(10) || ef.input || chr(10) || 'Output:'
                  || chr(10) || eo.output_json || chr(10), '' order by fp.j) as shots
                  from fp join tr on tr.error_type = fp.error_type and tr.tpos = fp.ex_pos
                  join frag ef on ef.entry_id = tr.entry_id join oj eo on eo.entry_id = tr.entry_id
                  group by fp.entry_id) x on x.entry_id = sp.entry_id"""


@query("prompt_corpus", fixture_sql(
    _CORPUS_SQL, extra_ctes=_FRAG_CTES + ",\n" + _SPLIT_CTES + ",\n" + _FEW_CTES + ",\n" + _OUT_JSON))
def q_prompt_corpus(spark, sf_dir):
    """(split, entry_id, instruction with few-shot, input, output JSON) for the generation task."""
    return _corpus(spark, sf_dir).select("split", "entry_id", "instruction", "input", "output_json")


def _order_entries(spark, sf_dir):
    log = fx.annotation_log(spark, sf_dir, "orders")
    return log.withColumn("entry_id", F.concat_ws("|", "row_id", "column"))


@query("split_rows_orders", fixture_sql(f"""select row_id || '|' || "column" as entry_id,
    case when row_number() over (order by md5('42|split|' || row_id || '|' || "column")) - 1
              < floor((select count(*) from ord_log) * {SPLIT}) then 'train' else 'test' end as split from ord_log"""))
def q_split_rows_orders(spark, sf_dir):
    """The exact split over the larger log (several sort partitions at scale)."""
    return P.split_rows(_order_entries(spark, sf_dir).select("entry_id"), SPLIT, seed=42)


@query("markdown_fragment_orders", fixture_sql(f"""select entry_id,
    '| row_id | o_orderstatus | o_totalprice | o_orderdate | o_orderpriority |' || chr(10) ||
    '| --- | --- | --- | --- | --- |' || chr(10) ||
    string_agg('| ' || concat_ws(' | ', coalesce(row_id, ''), coalesce(o_orderstatus, ''), coalesce(o_totalprice, ''),
               coalesce(o_orderdate, ''), coalesce(o_orderpriority, '')) || ' |', chr(10)
               order by md5('42|order|' || entry_id || '|' || row_id)) as input
  from ofrows group by entry_id""", extra_ctes=f"""oinv as (select row_id || '|' || "column" as entry_id,
    [cast(row_id as bigint)] as involved from ord_log),
oidx as (select row_id, row_number() over (order by cast(row_id as bigint)) - 1 as row_index from ord_clean),
{context_sql("ord_clean", "oinv", "oidx", K, "o")},
ofrows as (select c.entry_id, t.* from octx c join ord_clean t on t.row_id = c.row_id
  union all select i.entry_id, t.* from oinv i join ord_clean t on cast(t.row_id as bigint) = i.involved[1])"""))
def q_markdown_fragment_orders(spark, sf_dir):
    """Fragments over the larger table: every entry has its own row and 5 others."""
    return P.build_fragments(_order_entries(spark, sf_dir), fx.orders_clean(spark, sf_dir), k=K, seed=42,
                             missing_fill=False, index_order=F.col("row_id").cast("bigint"))


for _task in ("detection", "correction"):
    def _make(task):
        @query(f"instruction_text_{task}", fixture_sql(
            f"select entry_id, {_instr_sql(task)} as instruction from ent", extra_ctes=_FRAG_CTES))
        def q_instr(spark, sf_dir):
            return _instructions(spark, sf_dir, task).select("entry_id", "instruction")

        fields = (["row_id", "column", "error_type", "error_value"] if task == "detection" else None)
        oj = _OUT_JSON if fields is None else """oj as (select entry_id, to_json(struct_pack(row_id := row_id,
    "column" := "column", error_type := error_type, error_value := error_value))::varchar as output_json from ent)"""
        ctes = _frag_ctes("cust_dirty", task) + ",\n" + _SPLIT_CTES + ",\n" + _FEW_CTES + ",\n" + oj

        @query(f"prompt_corpus_{task}", fixture_sql(_CORPUS_SQL, extra_ctes=ctes))
        def q_corpus(spark, sf_dir):
            """C1 for a detection / correction task: inputs show the dirty table."""
            from .corpus import build_corpus
            return build_corpus(_entries(spark, sf_dir), fx.dirty_table(spark, sf_dir, "customer"), task,
                                k=K, seed=42, ratio=SPLIT, index_order=F.col("row_id").cast("bigint")) \
                .select("split", "entry_id", "instruction", "input", "output_json")
        return q_instr, q_corpus
    _make(_task)


@query("context_pool", fixture_sql(
    f"""select entry_id, row_id, draw from (
      select i.entry_id, p.row_id, p.draw, row_number() over (partition by i.entry_id order by p.draw) as r
      from inv i join (select row_id, row_number() over (order by md5('42|pool|' || row_id)) - 1 as draw
                       from cust_clean order by md5('42|pool|' || row_id) limit {K + 2}) p
        on not list_contains(i.involved, cast(p.row_id as bigint)))
    where r <= {K}""", extra_ctes=_FRAG_CTES))
def q_context_pool(spark, sf_dir):
    """Pool-mode context rows: one seeded pool of k + 2 rows, minus each entry's own rows."""
    from ..operators.annotations import involved_ids
    e = _entries(spark, sf_dir)
    e = e.withColumn("involved", involved_ids(e))
    out = P.context_pool(e, fx.customer_clean(spark, sf_dir), K, 42)
    return out.select("entry_id", "row_id", F.col("_draw").cast("long").alias("draw"))
