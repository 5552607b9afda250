"""Prompt-corpus operators: Markdown fragments, instructions, splits, few-shot.

Every random choice of the reference (template, context rows, row
order, split, exemplars) is a seeded md5 of the entry key, so a corpus is
reproducible and every step is a plain DataFrame plan:

* fragments: k context rows drawn at seeded positions of a dense index of
  the keys (equi join, never entries x table), fetched together with the
  involved rows by one join on the key, ordered by a per-entry hash, folded
  into Markdown by a bounded per-entry aggregate (k + 2 rows);
* instructions: literal template arrays indexed by hash (no join);
* split: exact ``floor(n * ratio)`` by a distributed sort on the hash;
* few-shot: exemplar positions drawn per entry inside its error type's
  dense index of training entries (equi join on (type, position)).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constraints import constraint_entities
from ..functions.hashing import coprime_strides, hash_int, hash_key, hash_long
from ..functions.templates import (ERROR_TYPE_DESCRIPTIONS, SUFFIXES, TASK_DESCRIPTIONS,
                                   UNKNOWN_ERROR_TYPE)
from ..schemas import ERROR_FIELDS
from .cells import row_index


#: error types up to which their counts are broadcast
BROADCAST_TYPES = 10_000


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def seeded_index(seed, part: str, key: Column, n) -> Column:
    """0-based index in [0, n) from md5(seed|part|key)."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(hash_int(F.concat_ws("|", F.lit(str(seed)), F.lit(part), key)), n)


def _pick(options: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx + 1).cast("int"))


@dataclass(frozen=True)
class Task:
    """The wording of a task: opening sentences (with {error_type}), closing sentences, a description or
    several of each error type, and the fields of a record that make up the answer.  Built-in tasks are known
    by name; own ones are passed as they are, here and to ``plans.corpus.build_corpus``."""
    openings: tuple[str, ...]
    closings: tuple[str, ...]
    descriptions: dict[str, list[str]] = field(default_factory=lambda: ERROR_TYPE_DESCRIPTIONS)
    output_fields: tuple[str, ...] = tuple(ERROR_FIELDS)


def task_of(task) -> Task:
    if isinstance(task, Task):
        return task
    if task not in TASK_DESCRIPTIONS:
        raise ValueError(f"unknown task {task!r}: pass one of {sorted(TASK_DESCRIPTIONS)} or a Task")
    return Task(tuple(TASK_DESCRIPTIONS[task]), tuple(SUFFIXES[task]))


def _instruction(task, error_type: Column, middle: Column | None, key: Column, seed) -> Column:
    """opening + error-type description [+ middle] + closing, each chosen by a seeded hash of the key."""
    t = task_of(task)
    opening = F.replace(_pick(list(t.openings), seeded_index(seed, "task", key, len(t.openings))),
                        F.lit("{error_type}"), error_type)
    known = F.create_map(*[x for et, opts in t.descriptions.items()
                           for x in (F.lit(et), F.array(*[F.lit(o) for o in opts]))])
    opts = F.element_at(known, F.coalesce(error_type, F.lit("")))
    about = F.when(opts.isNull(), F.lit(UNKNOWN_ERROR_TYPE)).otherwise(
        F.element_at(opts, (seeded_index(seed, "desc", key, F.size(opts)) + 1).cast("int")))
    closing = _pick(list(t.closings), seeded_index(seed, "suffix", key, len(t.closings)))
    return F.concat_ws(" ", opening, about, *([middle] if middle is not None else []), closing)


def instruction_text(task, error_type: Column, constraint: Column, key: Column,
                     seed=42, with_constraint: bool = True) -> Column:
    """task sentence + error-type description [+ entity-form constraint] + suffix; ``task``: a name or a Task."""
    c = F.when(F.coalesce(constraint, F.lit("")) != "", constraint_entities(constraint))
    return _instruction(task, F.coalesce(error_type, F.lit("None")), c if with_constraint else None, key, seed)


def generator_instruction(error_type: Column, rule_text: Column, key: Column, seed=42, task="generation") -> Column:
    """Error-generator form: '... Denial Constraint is: <rule sentence>. ...' for rule errors."""
    c = F.when(F.coalesce(rule_text, F.lit("")) != "", F.concat(F.lit("Denial Constraint is: "), rule_text, F.lit(".")))
    return _instruction(task, error_type, c, key, seed)


def prompt_text(instruction: Column, input_text: Column) -> Column:
    return F.concat(F.lit("User:\n"), instruction, F.lit("\nInput:\n"), input_text, F.lit("\nAssistant:\n"))


def markdown_header(cols: list[str]) -> str:
    return "| " + " | ".join(cols) + " |\n" + "| " + " | ".join(["---"] * len(cols)) + " |"


def markdown_line(cols: list[str], null_text: str = "") -> Column:
    cells = [F.coalesce(F.col(_q(c)).cast("string"), F.lit(null_text)) for c in cols]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_tables(rows: DataFrame, group_col: str, order_col: str, cols: list[str],
                    null_text: str = "", extra: tuple = ()) -> DataFrame:
    """(group, markdown) -- one Markdown table per group, rows in ``order_col`` order; and ``extra`` aggregates.

    The per-group list is bounded by the fragment size (a handful of rows).
    """
    line = F.struct(F.col(order_col).alias("o"), markdown_line(cols, null_text).alias("l"))
    agg = rows.groupBy(group_col).agg(F.array_sort(F.collect_list(line)).alias("_xs"), *extra)
    body = F.array_join(F.transform("_xs", lambda x: x["l"]), "\n")
    names = [c for c in agg.columns if c not in (group_col, "_xs")]
    return agg.select(group_col, F.concat(F.lit(markdown_header(cols) + "\n"), body).alias("markdown"), *names)


def integer_id(col) -> Column:
    """A row id as an integer; null if it is none."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").try_cast("bigint")


def context_draws(entries: DataFrame, indexed: DataFrame, n_rows: int, k: int, seed=42,
                  entry_col: str = "entry_id", key: str = "row_id", exclude_col: str = "involved",
                  carry: tuple = ()) -> DataFrame:
    """Per entry, min(k, available) context rows at seeded positions of a dense index, excluding the
    entry's involved row ids; (entry_id, key, _draw, carried entry columns).

    ``indexed`` has the key and its ``row_index`` (0..n_rows-1).  An entry steps
    through the positions by a seeded width that shares no factor with n_rows,
    so its draws never repeat, and as many as k and its involved rows together
    always leave k others if there are so many.
    """
    if n_rows == 0:
        return entries.select(entry_col, *carry).join(indexed.select(key), F.lit(False)) \
            .select(entry_col, key, F.lit(0).alias("_draw"), *carry)
    steps = coprime_strides(n_rows, seed)
    start = F.pmod(hash_long(F.concat_ws("|", F.lit(str(seed)), F.lit("ctx"), F.col(entry_col))), F.lit(n_rows))
    step = F.get(F.array(*[F.lit(x).cast("bigint") for x in steps]), F.pmod(
        hash_long(F.concat_ws("|", F.lit(str(seed)), F.lit("step"), F.col(entry_col))), F.lit(len(steps))).cast("int"))
    last = F.least(F.lit(n_rows), (F.lit(k) + F.size(exclude_col)).cast("bigint")) - 1
    draws = entries.select(entry_col, exclude_col, *carry, start.alias("_start"), step.alias("_step"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_draw"))
    draws = draws.withColumn("_pos", F.pmod(F.col("_start") + F.col("_draw") * F.col("_step"), F.lit(n_rows)))
    j = draws.join(indexed.select(F.col("row_index").alias("_pos"), key), "_pos")
    j = j.where(~F.coalesce(F.array_contains(F.col(exclude_col), integer_id(key)), F.lit(False)))
    w = Window.partitionBy(entry_col).orderBy("_draw")
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(entry_col, key, "_draw", *carry)


def context_pool(entries: DataFrame, table: DataFrame, k: int, seed=42, extra: int = 2,
                 entry_col: str = "entry_id", key: str = "row_id", exclude_col: str = "involved") -> DataFrame:
    """Pool mode (the reference's fixed sample): the same k + extra rows, first by a
    seeded hash (a distributed top-k, so the pool is bounded), minus each entry's
    involved rows, first k kept.  Entries meet the pool by an equi join on the pool
    rank (k + extra rows per entry), not a cross join."""
    pool = (table.withColumn("_h", hash_key(seed, F.lit("pool"), F.col(key))).orderBy("_h").limit(k + extra)
            .withColumn("_draw", F.row_number().over(Window.orderBy("_h")) - 1).drop("_h"))
    ranks = entries.select(entry_col, exclude_col, F.explode(F.sequence(F.lit(0), F.lit(k + extra - 1))).alias("_draw"))
    j = ranks.join(F.broadcast(pool.select(key, "_draw")), "_draw")
    j = j.where(~F.coalesce(F.array_contains(F.col(exclude_col), integer_id(key)), F.lit(False)))
    w = Window.partitionBy(entry_col).orderBy("_draw")
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(entry_col, key, "_draw")


def build_fragments(entries: DataFrame, table: DataFrame, k: int = 5, seed=42,
                    entry_col: str = "entry_id", key: str = "row_id", null_text: str = "",
                    missing_fill: bool = True, index_order=None, context: str = "draw",
                    indexed: DataFrame | None = None) -> DataFrame:
    """(entry_id, input): involved rows + k context rows as Markdown, in a seeded order.

    ``entries`` needs entry_id, row_id, column, error_type, error_value,
    tuple_pairs.  With ``missing_fill`` an entry's own cell shows its
    error_value for missing_value entries.  The entry's annotation travels
    with its drawn rows (no join back to the entries), and an entry whose
    involved rows are not all in the table gets no input (see
    ``missing_involved``).
    """
    from .annotations import involved_ids
    cols = table.columns
    carry = ("_ar", "_ac", "_at", "_av")
    e = entries.select(entry_col, involved_ids(entries, key).alias("involved"),
                       F.col(key).cast("string").alias("_ar"), F.col("column").alias("_ac"),
                       F.col("error_type").alias("_at"), F.col("error_value").cast("string").alias("_av"))
    if context == "pool":
        ctx = context_pool(e, table, k, seed, entry_col=entry_col, key=key).join(e.select(entry_col, *carry), entry_col)
    elif context == "draw":
        if indexed is None:
            indexed = row_index(table.select(key), order_by=index_order)      # keys only
        ctx = context_draws(e, indexed, indexed.count(), k, seed, entry_col=entry_col, key=key, carry=carry)
    else:
        raise ValueError(f"context must be 'draw' or 'pool', got {context!r}")

    def same(x):          # ids as text; integers in their plain form
        return F.coalesce(integer_id(x).cast("string"), x.cast("string")).alias("_k")

    inv = e.select(entry_col, F.explode("involved").alias("_id"), *carry)
    need = ctx.select(entry_col, same(F.col(key)), *carry, F.lit(0).alias("_inv")).unionByName(
        inv.select(entry_col, same(F.col("_id")), *carry, F.lit(1).alias("_inv")))
    rows = need.join(table.select("*", same(F.col(key))), "_k")
    if missing_fill:
        vals = []
        for c in cols:
            hit = (F.col("_at") == "missing_value") & (F.col(key) == F.col("_ar")) & (F.col("_ac") == c)
            vals.append(F.when(hit, F.coalesce(F.col("_av"), F.lit(null_text))).otherwise(F.col(_q(c))).alias(c))
        rows = rows.select(entry_col, "_inv", *vals)
    rows = rows.withColumn("_o", hash_key(seed, F.lit("order"), F.col(entry_col), F.col(key)))
    md = markdown_tables(rows, entry_col, "_o", cols, null_text, extra=(F.sum("_inv").alias("_found"),))
    # entries whose involved rows were not all found get no input
    want = e.select(entry_col, F.size("involved").alias("_want"),
                    (F.col("_ar").isNotNull() | (F.col("_at") == "rule_violation")).alias("_needs"))
    bad = (F.col("_found") < F.col("_want")) | ((F.col("_want") == 0) & F.coalesce(F.col("_needs"), F.lit(False)))
    return md.join(want, entry_col).where(~bad).select(entry_col, F.col("markdown").alias("input"))


def missing_involved(entries: DataFrame, table: DataFrame, entry_col: str = "entry_id",
                     key: str = "row_id") -> DataFrame:
    """(entry_id) of entries that name a row id absent from the table (or a malformed one)."""
    from .annotations import involved_ids
    e = entries.select(entry_col, F.explode_outer(involved_ids(entries, key)).alias("_id"),
                       F.col("error_type"), F.col(key).alias("_own"))
    t = table.select(integer_id(key).alias("_tid")).distinct()
    j = e.join(t, e._id == t._tid, "left")
    bad = (F.col("_tid").isNull() & (F.col("_id").isNotNull() | F.col("_own").isNotNull()
                                      | (F.col("error_type") == "rule_violation")))
    return j.where(bad).select(entry_col).distinct()


def split_rows(df: DataFrame, ratio: float = 0.9, seed=42, id_col: str = "entry_id") -> DataFrame:
    """Add ``split`` = train for the first floor(n * ratio) rows in seeded order, else test.

    Exact and distributed: a range-partitioned sort on the hash plus the
    dense row index (per-partition offsets), no single-partition window.
    Only (id, hash) go through the sort; the split joins back by id.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n.cast("double") * F.lit(float(ratio)))
    keys = df.select(F.col(id_col).alias("_sid"), hash_key(seed, F.lit("split"), F.col(id_col)).alias("_h"))
    idx = row_index(keys, order_by="_h", name="_i")
    flags = idx.select("_sid", F.when(F.col("_i") < cut, F.lit("train")).otherwise(F.lit("test")).alias("split"))
    return df.join(flags, df[id_col] == flags._sid).drop("_sid")


def fewshot_positions(df: DataFrame, seed=42, id_col: str = "entry_id", type_col: str = "error_type"
                      ) -> DataFrame:
    """Exemplar choices per entry: (entry_id, j, ex_pos) positions in its type's train index.

    test entries: min(2, n) distinct exemplars when the type has > 1 train entry;
    train entries: 0..min(2, n-1) distinct exemplars, never itself.
    ``df`` needs split, type, id and (for train) ``_tpos`` = own position.
    """
    n = F.col("_n")
    h0 = hash_long(F.concat_ws("|", F.lit(str(seed)), F.lit("fs0"), F.col(id_col)))
    h1 = hash_long(F.concat_ws("|", F.lit(str(seed)), F.lit("fs1"), F.col(id_col)))
    hm = hash_long(F.concat_ws("|", F.lit(str(seed)), F.lit("fsm"), F.col(id_col)))
    is_test = F.col("split") == "test"
    # test: 2 distinct of n
    m_test = F.when(n > 1, F.least(F.lit(2), n)).otherwise(F.lit(0))
    n1 = F.greatest(n, F.lit(1))
    t0 = F.pmod(h0, n1)
    t1 = F.pmod(t0 + 1 + F.pmod(h1, F.greatest(n - 1, F.lit(1))), n1)
    # train: draw among the n-1 others, shift past own position
    m_train = F.when(n > 1, F.pmod(hm, F.least(F.lit(2), n - 1) + 1)).otherwise(F.lit(0))
    r0 = F.pmod(h0, F.greatest(n - 1, F.lit(1)))
    r1 = F.pmod(r0 + 1 + F.pmod(h1, F.greatest(n - 2, F.lit(1))), F.greatest(n - 1, F.lit(1)))

    def skip_self(r):
        return F.when(r >= F.col("_tpos"), r + 1).otherwise(r)

    m = F.when(is_test, m_test).otherwise(m_train)
    p0 = F.when(is_test, t0).otherwise(skip_self(r0))
    p1 = F.when(is_test, t1).otherwise(skip_self(r1))
    picks = F.array(F.struct(F.lit(0).alias("j"), p0.alias("ex_pos")),
                    F.struct(F.lit(1).alias("j"), p1.alias("ex_pos")))
    return df.select(id_col, type_col, F.inline(F.slice(picks, 1, m.cast("int"))))


def fewshot_pairs(corpus: DataFrame, seed=42, id_col: str = "entry_id",
                  type_col: str = "error_type") -> DataFrame:
    """(entry_id, j, ex_id, ex_text): the exemplars chosen for every entry.

    Train entries get their type's dense position by a distributed sort on
    (type, hash); exemplar lookups are an equi join on (type, position).
    """
    train = corpus.where(F.col("split") == "train")
    # only (id, type, hash) go through the distributed sort; the texts join back
    # for the chosen exemplars alone
    keys = train.select(id_col, type_col, hash_key(seed, F.lit("fs"), F.col(id_col)).alias("_h"))
    idx = row_index(keys, order_by=[type_col, "_h"], name="_g")
    first = idx.groupBy(type_col).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_n"))
    if first.count() <= BROADCAST_TYPES:     # a handful of types: no shuffle of the corpus by type
        first = F.broadcast(first)
    pos = idx.join(first, type_col).withColumn("_tpos", F.col("_g") - F.col("_g0"))
    own = pos.select(id_col, "_tpos")
    c = corpus.select(id_col, type_col, "split").join(first.select(type_col, "_n"), type_col, "left") \
              .na.fill(0, ["_n"]).join(own, id_col, "left")
    picks = fewshot_positions(c, seed, id_col, type_col)
    ex = pos.select(F.col(type_col).alias("_et"), F.col("_tpos").alias("_ep"), F.col(id_col).alias("ex_id"))
    got = picks.join(ex, (picks[type_col] == ex._et) & (picks.ex_pos == ex._ep))
    texts = train.select(F.col(id_col).alias("ex_id"),
                         F.concat(F.lit("\nInput:\n"), F.col("input"), F.lit("\nOutput:\n"), F.col("output_json"),
                                  F.lit("\n")).alias("ex_text"))
    got = got.join(texts, "ex_id")
    return got.select(id_col, "j", "ex_id", "ex_text")


def add_fewshot(corpus: DataFrame, seed=42, id_col: str = "entry_id", type_col: str = "error_type") -> DataFrame:
    """Append exemplars to ``instruction`` as '\\nInput:\\n<input>\\nOutput:\\n<output json>\\n'
    (at most two per entry, so the per-entry list is bounded)."""
    got = fewshot_pairs(corpus, seed, id_col, type_col)
    shots = got.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("j", "ex_text"))).alias("_s"))
    shots = shots.select(id_col, F.array_join(F.transform("_s", lambda x: x["ex_text"]), "").alias("_shots"))
    out = corpus.join(shots, id_col, "left")
    return out.withColumn("instruction", F.concat(F.col("instruction"), F.coalesce(F.col("_shots"), F.lit("")))) \
              .drop("_shots")


def header_table(spark, tables: dict) -> DataFrame:
    """(dataset, header): the Markdown header line of each known dataset's columns."""
    rows = [(name, markdown_header(df.columns).split("\n")[0]) for name, df in tables.items()]
    return spark.createDataFrame(rows, "dataset string, header string")


def markdown_row_ids(md: DataFrame, headers: DataFrame, text_col: str = "input") -> DataFrame:
    """Parse Markdown inputs back: dataset from the header line, row ids from the first
    cell of every line after the header and rule lines.  ``headers`` has one row per
    dataset (a handful), so it is broadcast."""
    lines = F.split(F.col(text_col), "\n")
    x = md.withColumn("_h", F.get(lines, 0)).withColumn(
        "row_ids", F.transform(F.slice(lines, 3, F.size(lines)), lambda l: F.trim(F.get(F.split(l, r"\|"), 1))))
    j = x.join(F.broadcast(headers.withColumnRenamed("header", "_h")), "_h", "left")
    return j.drop("_h")
