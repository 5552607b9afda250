"""Error generation under a budget: propose -> validate -> resolve conflicts -> quota.

The reference loops: pick a type, ask a model for one error in a sampled
fragment, validate, skip conflicts, stop when every type's quota is met.
Here the same contract is a few distributed passes:

1. ``error_budget``   -- quota per type: int(ratio * rows * cols) split by
                         integer ratios with truncation (key column counted).
2. ``rule_errors``    -- rule violations: the greedy choice among disjoint
                         pairs, thinned by priority until the quota is met.
3. ``cell_errors``    -- the other types, with a default column-expression
                         corruptor: of the cells in one seeded order each type
                         takes its first eligible ones, exactly its quota.
4. ``validate_candidates`` (annotations), ``conflict_free`` and
   ``quota_select``   -- the same checks for candidates of any proposer.
5. ``shortfall``      -- what a type lacks when its eligible cells run out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..functions.values import float_value
from ..functions.vectors import let
from ..schemas import ERROR_TYPES
from ..session import cut_lineage
from . import constraints as C
from .cells import value_columns


def parse_ratios(ratios: str) -> list[int]:
    parts = ratios.split(":")
    if len(parts) != 4 or not all(p.strip().isdigit() for p in parts):
        raise ValueError(f"ratio string must be four integers a:b:c:d, got {ratios!r}")
    vals = [int(p) for p in parts]
    if sum(vals) <= 0:
        raise ValueError("ratios must not all be zero")
    return vals


def error_budget(table: DataFrame, error_ratio: float = 0.1, ratios: str = "1:1:1:1",
                 include_key: bool = True, key: str = "row_id") -> DataFrame:
    """(error_type, total_errors, quota); counts rows with one aggregate."""
    w = parse_ratios(ratios)
    n_cols = len(table.columns) if include_key else len(value_columns(table, key))
    rows = table.agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.floor(F.lit(float(error_ratio)) * (F.col("n_rows") * F.lit(n_cols)).cast("double")).cast("long")
    quotas = F.array(*[F.struct(F.lit(t).alias("error_type"), F.lit(i).alias("_i")) for i, t in enumerate(ERROR_TYPES)])
    x = rows.select(total.alias("total_errors"), F.inline(quotas))
    share = F.element_at(F.array(*[F.lit(v / sum(w)) for v in w]), F.col("_i") + 1)
    return x.select("error_type", "total_errors",
                    F.floor(F.col("total_errors").cast("double") * share).cast("long").alias("quota"))


def _corrupt(error_type: str, v):
    """Default corruptors (Column expressions) for one error type; null where a value cannot be corrupted."""
    if error_type == "missing_value":
        return F.lit(None).cast("string")
    if error_type == "outliers":
        # integers of any length are scaled as decimals; longer ones than a decimal holds by two more digits
        whole = F.trim(v)
        as_int = F.when(v.rlike(r"^\s*-?\d{1,36}\s*$"), (whole.try_cast("decimal(36,0)") * 100).cast("string")) \
                  .when(v.rlike(r"^\s*-?\d+\s*$"), F.concat(whole, F.lit("00")))
        return F.coalesce(as_int, F.format_string("%.2f", float_value(v) * 100))
    if error_type == "pattern_violation":
        iso = F.try_to_date(v, "yyyy-MM-dd")
        return (F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & iso.isNotNull(), F.date_format(iso, "dd/MM/yyyy"))
                .when(v.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.concat(v, F.lit("x")))
                .when(F.length(v) > 1, F.upper(F.substring(v, 2, 1 << 30)))
                .otherwise(F.concat(v, v)))
    raise ValueError(error_type)


#: the order in which types take cells: the one with the fewest eligible cells first
CELL_TYPES = ("outliers", "pattern_violation", "missing_value")


def _eligible(error_type: str, v):
    """Whether the default corruptor of a type changes a cell, by the rule of ``validate_candidates`` (numbers are
    compared as numbers, other text without outer blanks), worked out without making the corrupted value."""
    if error_type == "missing_value":
        return v.isNotNull()
    if error_type == "outliers":         # a hundredfold of a finite number other than 0 is another number
        num = float_value(v)
        return F.coalesce((num != 0) & ~F.isnan(num) & (F.abs(num) < float("inf")), F.lit(False))
    # a date in another order or a number with a letter is always another text
    tail = F.upper(F.substring(v, 2, 1 << 30))
    cut = (F.trim(tail) != F.trim(v)) & ~F.coalesce(float_value(tail) == float_value(v), F.lit(False))
    other = F.when(F.length(v) > 1, cut).otherwise(F.trim(v) != "")
    plain = v.rlike(r"^\s*-?\d+(\.\d+)?\s*$|^\d{4}-\d{2}-\d{2}$")
    known = v.rlike(r"^\s*-?\d+(\.\d+)?\s*$") | F.try_to_date(v, "yyyy-MM-dd").isNotNull()
    return F.coalesce(F.when(plain, known | other).otherwise(other), F.lit(False))


def _kth(cells: DataFrame, k: int, digits: int = 3, few: int = 4096) -> str | None:
    """The k-th smallest ``priority`` (md5 hex) of ``cells``, or None if there are fewer than k.

    Radix selection: a histogram over the next hex digits finds the prefix that
    holds it; when few rows share the prefix they are fetched in order.  What
    comes to the driver is bounded by 16^digits counts and ``few`` priorities.
    """
    prefix, left = "", k
    while True:
        at = F.substring("priority", len(prefix) + 1, digits)
        hist = {r["d"]: r["n"] for r in cells.where(F.col("priority").startswith(prefix))
                .groupBy(at.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for d in sorted(hist):
            if left <= hist[d]:
                break
            left -= hist[d]
        else:
            return None
        prefix += d
        if hist[d] <= few or len(prefix) >= 32:
            rows = cells.where(F.col("priority").startswith(prefix)).select("priority").orderBy("priority").limit(left).collect()
            return rows[-1]["priority"]


def cell_errors(table: DataFrame, quotas: dict[str, int], seed: int = 42, key: str = "row_id",
                used: DataFrame | None = None) -> DataFrame:
    """Error records of the single-cell types: exactly min(quota, eligible cells) of each.

    All value cells are in one seeded order (md5).  Outliers take the first
    eligible cells, then pattern violations the first that are left, then
    missing values.  Each type's last cell is found by radix selection over a
    slim copy, so the choice itself is one scan with a condition per type;
    nothing is sorted or shuffled.  ``used`` (key, column) cells are left out.
    """
    cols = value_columns(table, key)
    taken = F.lit(False)
    t = table
    if used is not None:
        mine = used.groupBy(F.col(key).alias("_uk")).agg(F.collect_set("column").alias("_used"))     # at most one per column
        t = table.join(mine, F.col(key) == F.col("_uk"), "left").drop("_uk")
        taken = F.coalesce(F.array_contains("_used", F.col("column")), F.lit(False))
    long = t.select(F.col(key), *(["_used"] if used is not None else []), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(C._q(c)).cast("string").alias("value")) for c in cols])))
    v = F.col("value")
    long = long.where(v.isNotNull() & ~taken & F.col(key).isNotNull()) \
        .withColumn("priority", hash_key(seed, F.lit("cell"), F.col(key), F.col("column")))
    eligible = {t: _eligible(t, v) for t in CELL_TYPES}
    # what the selection reads several times: 32 characters and three flags per cell, made once
    slim = cut_lineage(long.select("priority", *[e.alias(t) for t, e in eligible.items()]))
    limits: dict[str, str | None] = {}

    def choose(flag):
        """The chosen type of a cell, given its flags by type."""
        choice, free = F.lit(None).cast("string"), F.lit(True)
        for kind, last in limits.items():
            mine = free & flag(kind)
            mine = mine if last is None else mine & (F.col("priority") <= last)
            choice = F.coalesce(choice, F.when(mine, F.lit(kind)))
            free = free & ~mine
        return choice, free

    for kind in CELL_TYPES:
        quota = int(quotas.get(kind) or 0)
        if quota > 0:
            _, free = choose(F.col)
            limits[kind] = _kth(slim.where(free & F.col(kind)).select("priority"), quota)
    if limits and all(limits.values()):          # most cells are beyond every limit: their flags are not needed again
        long = long.where(F.col("priority") <= max(limits.values()))
    flags = F.struct(*[eligible[t].alias(t) for t in CELL_TYPES])
    out = long.withColumn("error_type", let(flags, lambda f: choose(lambda t: f[t])[0])).where(F.col("error_type").isNotNull())
    value = F.when(F.col("error_type") == "outliers", _corrupt("outliers", v)) \
             .when(F.col("error_type") == "pattern_violation", _corrupt("pattern_violation", v))
    return out.select(F.col(key).cast("string").alias(key), "column", "error_type", value.alias("error_value"),
                      v.alias("right_value"), (F.col("error_type") == "missing_value").cast("int").alias("missing_value"),
                      F.lit("").alias("constraint"), F.lit("").alias("tuple_pairs"), "priority")


def propose_errors(table: DataFrame, budget: DataFrame, seed: int = 42, rule: str | None = None,
                   key: str = "row_id") -> DataFrame:
    """Candidate error records (ERROR columns + ``priority``): the chosen single-cell errors of each type
    and, for each rule, one violation for every disjoint pair whose edit changes the cell."""
    out = cell_errors(table, budget_quotas(budget), seed, key)
    for r in _rules(rule):
        out = out.unionByName(_rule_candidates(table, r, seed, key))
    return out


def budget_quotas(budget: DataFrame) -> dict[str, int]:
    """error_type -> quota (four numbers)."""
    return {r["error_type"]: int(r["quota"] or 0) for r in budget.select("error_type", "quota").collect()}


def _rules(rule) -> list[str]:
    """None, one rule or a list of rules -> list."""
    if rule is None:
        return []
    return [rule] if isinstance(rule, str) else list(rule)


def _rule_candidates(table: DataFrame, rule: str, seed: int, key: str, pairs: DataFrame | None = None) -> DataFrame:
    """Rule violations from disjoint pairs: the first row's non-EQ cell gets a value that differs from its partner's."""
    col = C._non_eq(rule).left
    pairs = _prioritised_pairs(table, rule, seed, key) if pairs is None else pairs
    t = table.select(F.col(key).cast("string").try_cast("bigint").alias("_id"), F.col(C._q(col)).cast("string").alias("_v"))
    a = pairs.join(t.withColumnRenamed("_id", "row_id_1").withColumnRenamed("_v", "_v1"), "row_id_1")
    b = a.join(t.withColumnRenamed("_id", "row_id_2").withColumnRenamed("_v", "_v2"), "row_id_2")
    rid = F.col("row_id_1").cast("string")
    other = F.col("row_id_2").cast("string")
    constraint = F.concat(F.lit("Constraint Violation: The "), F.lit(col), F.lit(" of Row "), rid,
                          F.lit(" is different from the "), F.lit(col), F.lit(" of Row "), other)
    new = F.concat(F.col("_v2"), F.lit("*"))
    return b.where(F.col("_v2").isNotNull() & ~F.trim(new).eqNullSafe(F.trim("_v1"))).select(
        rid.alias(key), F.lit(col).alias("column"), F.lit("rule_violation").alias("error_type"),
        new.alias("error_value"), F.col("_v1").alias("right_value"),
        F.lit(0).alias("missing_value"), constraint.alias("constraint"),
        F.concat(F.lit("("), rid, F.lit(", "), other, F.lit(")")).alias("tuple_pairs"), "priority")


def _prioritised_pairs(table: DataFrame, rule: str, seed: int, key: str) -> DataFrame:
    col = C._non_eq(rule).left
    return C.pick_pairs(table, rule, seed=seed, key=key).withColumn("priority", hash_key(
        seed, F.lit("rule_violation"), F.lit(rule), F.col("row_id_1").cast("string"), F.lit(col)))


def rule_errors(table: DataFrame, rule, quota: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """The first ``quota`` rule violations of the greedy choice over all rules' pairs in priority order.

    Pairs are thinned by priority before their values are fetched; the greedy
    over a prefix of the order is a prefix of the greedy, so if the thinned
    pairs do not meet the quota, more of them are tried until they do or all
    pairs are in.
    """
    rules = _rules(rule)
    pairs = {r: cut_lineage(_prioritised_pairs(table, r, seed, key)) for r in rules}
    total = sum(p.count() for p in pairs.values())
    share = min(1.0, 3 * quota / max(total, 1) + 0.001)
    while True:
        below = None if share >= 1 else f"{int(share * (1 << 32)):08x}"
        cands = None
        for r, p in pairs.items():
            some = p if below is None else p.where(F.col("priority") < below)
            c = _rule_candidates(table, r, seed, key, some)
            cands = c if cands is None else cands.unionByName(c)
        free = cut_lineage(cands if len(rules) == 1 else conflict_free(cands, key=key, single_cell=False))
        if below is None or free.count() >= quota:
            return quota_select(free, table.sparkSession.createDataFrame(
                [("rule_violation", int(quota))], "error_type string, quota long"))
        share *= 2


def shortfall(log: DataFrame, budget: DataFrame) -> DataFrame:
    """(error_type, quota, produced, missing): how far each type stays below its quota."""
    made = log.groupBy("error_type").agg(F.count(F.lit(1)).alias("produced"))
    j = budget.select("error_type", "quota").join(made, "error_type", "left").na.fill(0, ["produced"])
    return j.withColumn("missing", F.greatest(F.col("quota") - F.col("produced"), F.lit(0).cast("long")))


ROW_RESOURCE = "\u0000row"


def candidate_cells(cands: DataFrame, key: str = "row_id") -> DataFrame:
    """(cand_id, cell_row, cell_col): the resources a candidate uses.

    Every candidate uses its cell.  A rule violation also uses, in each of its
    rows, the edited column and the columns that its constraint names, and the
    rows themselves (a row in an accepted pair is not offered to another rule
    pair), so two rule candidates sharing a row conflict even on different
    columns.
    """
    from ..functions.constraints import constraint_columns, tuple_ids
    rule_ids = F.transform(tuple_ids("tuple_pairs"), lambda x: x.cast("string"))
    is_rule = (F.col("error_type") == "rule_violation") & (F.size(rule_ids) > 0)
    named = constraint_columns("constraint") if "constraint" in cands.columns else F.array().cast("array<string>")
    columns = F.array_distinct(F.concat(F.array("column"), named))
    own = F.array(F.struct(F.col(key).cast("string").alias("cell_row"), F.col("column").alias("cell_col")))
    cells = F.flatten(F.transform(rule_ids, lambda r: F.transform(
        columns, lambda c: F.struct(r.alias("cell_row"), c.alias("cell_col")))))
    row_res = F.transform(rule_ids, lambda r: F.struct(r.alias("cell_row"), F.lit(ROW_RESOURCE).alias("cell_col")))
    res = F.when(is_rule, F.array_distinct(F.concat(own, cells, row_res))).otherwise(own)
    return cands.select("cand_id", F.inline(res))


def conflict_free(cands: DataFrame, key: str = "row_id", single_cell: bool | None = None) -> DataFrame:
    """Keep candidates so that no cell is edited twice; equals the sequential
    greedy over candidates in ``priority`` order (then by the record's content;
    of equal records one is kept).

    When every candidate edits one cell, the greedy keeps the best candidate
    per cell: one hash aggregate, no rounds.  Otherwise rounds: a remaining
    candidate that comes first on every one of its cells is accepted (every
    better candidate touching those cells is already rejected, so the greedy
    accepts it too); remaining candidates touching an accepted cell are
    dropped.  Rounds repeat until nothing remains; every round accepts at least
    the first candidate, so they end.  Each round's state is checkpointed to the
    shared checkpoint folder, so a lost executor recomputes one round.
    """
    names = cands.columns
    content = F.md5(F.to_json(F.struct(*[F.col(C._q(c)) for c in names])))
    c = cands.withColumn("_ord", F.struct(F.col("priority").alias("p"), content.alias("h")))
    if single_cell is None:   # unknown proposer: one check (callers that know pass the hint)
        multi = candidate_cells(c.withColumn("cand_id", F.col("_ord.h")), key).groupBy("cand_id") \
            .agg(F.count_distinct("cell_row", "cell_col").alias("n")).where("n > 1")
        single_cell = multi.limit(1).count() == 0
    if single_cell:
        best = c.groupBy(key, "column").agg(F.min(F.struct("_ord", F.struct(*[F.col(C._q(x)) for x in names]).alias("r"))).alias("b"))
        return best.select("b.r.*")
    c = cut_lineage(c.withColumn("cand_id", F.monotonically_increasing_id()))
    order = c.select("cand_id", F.struct("_ord", "cand_id").alias("_ord"))
    state = cut_lineage(candidate_cells(c, key).join(order, "cand_id"))
    accepted = None
    while not state.isEmpty():
        best = state.groupBy("cell_row", "cell_col").agg(F.min("_ord").alias("_best"))
        ranked = state.join(best, ["cell_row", "cell_col"])
        wins = ranked.groupBy("cand_id").agg(F.bool_and(F.col("_ord") == F.col("_best")).alias("_win")).where("_win")
        won = state.join(wins, "cand_id").select("cell_row", "cell_col", "_win")
        fate = state.join(won, ["cell_row", "cell_col"], "left").groupBy("cand_id").agg(F.bool_or("_win").alias("_hit"))
        told = cut_lineage(state.join(fate, "cand_id").join(wins, "cand_id", "left"))   # the round, with each candidate's fate
        winners = told.where("_win").select("cand_id")
        state = told.where("_hit is null").select(state.columns)
        accepted = winners if accepted is None else accepted.unionByName(winners)
    if accepted is None:
        return cands
    return c.join(accepted, "cand_id", "left_semi").select(names)


def quota_select(cands: DataFrame, budget: DataFrame, prefix: int = 4, materialize: bool = True) -> DataFrame:
    """The ``quota`` best candidates (smallest ``priority``) of each error type, exactly.

    A per-type window over all candidates would put a type in one task.
    Instead a histogram over the first ``prefix`` characters of the priority
    (65,536 values for md5 hex) locates where each quota is crossed; rows below
    are taken, and only the boundary prefix of each type is ranked with a
    window.  Any text serves as a priority, in the order of its bytes;
    candidates without one come last, in a seeded order of their own.
    """
    content = F.md5(F.to_json(F.struct(*[F.col(C._q(c)) for c in cands.columns])))
    x = cands.withColumn("_p", F.coalesce("priority", F.concat(F.lit("~"), content))).withColumn("_h", content) \
        .withColumn("_b", F.substring("_p", 1, prefix))
    if materialize:   # read twice below (histogram, selection): compute the candidates once
        x = cut_lineage(x)
    hist = x.groupBy("error_type", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("error_type").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_cum", F.sum("_n").over(w)).join(budget.select("error_type", "quota"), "error_type")
    take = cum.select("error_type", "_b",
                      F.when(F.col("_cum") <= F.col("quota"), F.lit(-1))            # whole prefix
                       .when(F.col("_cum") - F.col("_n") < F.col("quota"),
                             F.col("quota") - (F.col("_cum") - F.col("_n")))         # boundary: take k
                       .otherwise(F.lit(0)).alias("_k"))                             # beyond quota
    j = x.join(take.where(F.col("_k") != 0), ["error_type", "_b"])
    whole = j.where(F.col("_k") == -1)
    edge = j.where(F.col("_k") > 0)
    wr = Window.partitionBy("error_type", "_b").orderBy("_p", "_h")
    edge = edge.withColumn("_r", F.row_number().over(wr)).where(F.col("_r") <= F.col("_k")).drop("_r")
    return whole.unionByName(edge).select(cands.columns)


def generate_errors(table: DataFrame, error_ratio: float = 0.1, ratios: str = "1:1:1:1",
                    rule: str | None = None, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Composite: budget -> rule violations -> single-cell errors elsewhere -> error log.

    Every type gets exactly min(quota, eligible cells or pairs); ``shortfall``
    compares the log with the budget.  The default corruptors' records need no
    validation against the table: the true value is at hand when they are made.
    """
    quotas = budget_quotas(error_budget(table, error_ratio, ratios, key=key))
    names = [key, "column", "error_type", "error_value", "right_value", "missing_value", "constraint", "tuple_pairs", "priority"]
    if not _rules(rule) or not quotas["rule_violation"]:
        return cell_errors(table, quotas, seed, key).select(names)
    violations = cut_lineage(rule_errors(table, rule, quotas["rule_violation"], seed, key).select(names))
    used = candidate_cells(violations.withColumn("cand_id", F.lit(0)), key).where(F.col("cell_col") != ROW_RESOURCE) \
        .select(F.col("cell_row").alias(key), F.col("cell_col").alias("column"))
    return cell_errors(table, quotas, seed, key, used=used).select(names).unionByName(violations)


def model_completions(prompts: DataFrame, predict, id_col: str = "entry_id", text_col: str = "prompt",
                      batch_rows: int = 64) -> DataFrame:
    """(id, completion) from a user batch-inference function (the reference calls a model per prompt).

    ``predict(list[str]) -> list[str]`` runs inside ``mapInPandas`` on Arrow
    batches of at most ``batch_rows`` prompts, so a model is loaded once per
    task and fed in batches; Spark partitions and retries the work.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            for i in range(0, len(b), batch_rows):
                chunk = b.iloc[i:i + batch_rows]
                yield pd.DataFrame({id_col: chunk[id_col].to_numpy(),
                                    "completion": list(predict(chunk[text_col].tolist()))})

    return prompts.select(id_col, text_col).mapInPandas(run, f"{id_col} string, completion string")


def candidates_from_completions(completions: DataFrame, seed: int = 42, id_col: str = "entry_id",
                                requested_type: DataFrame | None = None) -> DataFrame:
    """Parsed completions as candidate error records with a seeded priority.

    Unparsable answers are dropped; when ``requested_type`` (id, error_type)
    is given, an answer of another type is dropped too (the quota counts the
    requested type).
    """
    from .annotations import parse_completion
    from ..schemas import ERROR_FIELDS
    p = parse_completion(completions, "completion").where("parse_ok")
    c = p.select(id_col, *[F.col("record")[f].alias(f) for f in ERROR_FIELDS])
    if requested_type is not None:
        c = c.join(requested_type.select(id_col, F.col("error_type").alias("_req")), id_col) \
             .where(F.col("error_type") == F.col("_req")).drop("_req")
    c = c.withColumn("missing_value", F.coalesce(F.col("missing_value"), F.lit(0))) \
         .withColumn("constraint", F.coalesce(F.col("constraint"), F.lit(""))) \
         .withColumn("tuple_pairs", F.coalesce(F.col("tuple_pairs"), F.lit("")))
    return c.withColumn("priority", hash_key(seed, F.col(id_col))).drop(id_col)


def select_errors(table: DataFrame, cands: DataFrame, budget: DataFrame, key: str = "row_id",
                  single_cell: bool | None = None) -> DataFrame:
    """validate -> conflict-free -> quota for candidates from any proposer (see ``shortfall`` for what is lacking)."""
    from .annotations import validate_candidates
    valid = validate_candidates(cands, table, key=key).where(F.col("status") == "ok").drop("status")
    return quota_select(conflict_free(valid, key=key, single_cell=single_cell), budget)


def completion_status(completions: DataFrame, requested_type: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """(id, requested_type, answered_type, status) for every model answer:
    parse_error (no JSON record), type_mismatch (the answer names another error
    type than the slot asked for; the quota counts the requested one) or ok."""
    from .annotations import parse_completion
    p = parse_completion(completions, "completion")
    j = p.join(requested_type.select(id_col, F.col("error_type").alias("requested_type")), id_col, "left")
    answered = F.col("record")["error_type"]
    status = (F.when(~F.col("parse_ok"), F.lit("parse_error"))
              .when(~answered.eqNullSafe(F.col("requested_type")), F.lit("type_mismatch"))
              .otherwise(F.lit("ok")))
    return j.select(id_col, "requested_type", answered.alias("answered_type"), status.alias("status"))
