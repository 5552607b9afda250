"""C2 with a model in the loop: generation prompts -> batch completions -> selected errors.

The reference asks a model for one error per loop turn.  Here every turn
is a *slot* built up front: a seeded table fragment (5 random rows; for a
rule violation a disjoint candidate pair plus 3 other rows), a generator
instruction (with the rule as a sentence for rule slots) and the prompt
text.  Slots come from ``spark.range`` (distributed, one per budgeted
error times ``oversample``), fragments from hash positions of the dense
row index, so nothing is built on the driver or in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constraints import dc_to_text
from ..functions.hashing import hash_key
from ..operators import constraints as C
from ..operators import generate as G
from ..operators import prompts as P
from ..operators.cells import row_index
from ..schemas import ERROR_TYPES
from ..session import cut_lineage


def generation_prompts(table: DataFrame, budget: DataFrame, rule: str | None = None, seed=42,
                       k: int = 5, rule_k: int = 3, oversample: float = 1.0, key: str = "row_id",
                       index_order=None) -> DataFrame:
    """(entry_id, error_type, prompt) -- one prompt per generation slot."""
    spark: SparkSession = table.sparkSession
    quotas = {r["error_type"]: int(r["quota"]) for r in budget.collect()}   # four numbers
    plain = [t for t in ERROR_TYPES if t != "rule_violation"]
    n = {t: int(quotas.get(t, 0) * oversample) for t in plain}
    bounds, acc = [], 0
    for t in plain:
        bounds.append((t, acc, acc + n[t]))
        acc += n[t]
    slots = spark.range(acc).select(F.col("id").alias("_s"))
    etype = None
    for t, lo, hi in bounds:
        cond = (F.col("_s") >= lo) & (F.col("_s") < hi)
        etype = F.when(cond, F.lit(t)) if etype is None else etype.when(cond, F.lit(t))
    plain_slots = slots.select(F.concat(F.lit("s"), F.col("_s").cast("string")).alias("entry_id"),
                               (etype if etype is not None else F.lit(None).cast("string")).alias("error_type"),
                               F.lit(None).cast("string").alias(key), F.lit("").alias("column"),
                               F.lit(None).cast("string").alias("error_value"), F.lit("").alias("tuple_pairs"),
                               F.lit("").alias("rule"))
    entries = plain_slots
    rules = G._rules(rule)
    if rules and quotas.get("rule_violation", 0) > 0:
        pairs = None
        for r in rules:   # every rule's disjoint pairs compete for the rule quota by seeded priority
            pr = C.pick_pairs(table, r, seed=seed, key=key).withColumn("rule", F.lit(r))
            pairs = pr if pairs is None else pairs.unionByName(pr)
        pairs = pairs.withColumn("error_type", F.lit("rule_violation")) \
            .withColumn("priority", hash_key(seed, F.lit("rs"), F.col("rule"), F.col("row_id_1"), F.col("row_id_2")))
        want = budget.where(F.col("error_type") == "rule_violation").select(
            "error_type", (F.floor(F.col("quota") * F.lit(oversample))).cast("long").alias("quota"))
        chosen = G.quota_select(pairs, want)
        rule_slots = chosen.select(
            F.concat(F.lit("r"), F.substring(F.md5("rule"), 1, 8), F.lit("_"), F.col("row_id_1").cast("string"),
                     F.lit("_"), F.col("row_id_2").cast("string")).alias("entry_id"), "error_type", F.col("row_id_1").cast("string").alias(key), F.lit("").alias("column"),
            F.lit(None).cast("string").alias("error_value"),
            F.concat(F.lit("("), F.col("row_id_1").cast("string"), F.lit(", "), F.col("row_id_2").cast("string"),
                     F.lit(")")).alias("tuple_pairs"), "rule")
        entries = entries.unionByName(rule_slots)
    indexed = row_index(table.select(key), order_by=index_order)          # once for both kinds of slots
    frags_plain = P.build_fragments(entries.where(F.col("error_type") != "rule_violation"), table, k=k,
                                    seed=seed, key=key, missing_fill=False, indexed=indexed)
    frags = frags_plain
    if rules:
        frags_rule = P.build_fragments(entries.where(F.col("error_type") == "rule_violation"), table, k=rule_k,
                                       seed=seed, key=key, missing_fill=False, indexed=indexed)
        frags = frags.unionByName(frags_rule)
    # as in the reference, the sentence keeps its own final period before ". "
    rule_text = F.when(F.col("rule") != "", dc_to_text(F.col("rule")))
    instr = P.generator_instruction(F.col("error_type"), rule_text, F.col("entry_id"), seed)
    e = entries.select("entry_id", "error_type", instr.alias("instruction"))
    return e.join(frags, "entry_id").select("entry_id", "error_type",
                                            P.prompt_text(F.col("instruction"), F.col("input")).alias("prompt"))


def generate_with_model(table: DataFrame, predict, error_ratio: float = 0.1, ratios: str = "1:1:1:1",
                        rule: str | None = None, seed=42, oversample: float = 1.5, key: str = "row_id",
                        batch_rows: int = 64, with_status: bool = False):
    """Budget -> prompts -> ``predict`` in batches -> parse -> validate -> conflict-free -> quota.

    With ``with_status`` the result is (log, status): ``status`` has a row per
    answer (parse_error, type_mismatch, ok), so no answer vanishes unseen, and
    ``generate.shortfall`` tells what the log lacks.
    """
    budget = G.error_budget(table, error_ratio, ratios, key=key)
    # model answers are expensive and may be sampled: prompts and answers are computed
    # once and kept in the checkpoint folder, so later actions and retries never re-ask
    prompts = cut_lineage(generation_prompts(table, budget, rule=rule, seed=seed, oversample=oversample, key=key))
    comps = cut_lineage(G.model_completions(prompts, predict, batch_rows=batch_rows))
    asked = prompts.select("entry_id", "error_type")
    cands = G.candidates_from_completions(comps, seed=seed, requested_type=asked)
    log = G.select_errors(table, cands, budget, key=key)
    return (log, G.completion_status(comps, asked)) if with_status else log
