"""Instruction / input / output corpus for one task, split and with few-shot exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prompts as P
from ..operators.annotations import task_output
from ..session import cut_lineage


def corpus_base(entries: DataFrame, table: DataFrame, task: str = "generation", k: int = 5, seed=42,
                key: str = "row_id", index_order=None) -> DataFrame:
    """(entry_id, error_type, instruction, input, output_json) for one table's entries."""
    answers = task_output(entries, task) if isinstance(task, str) else \
        entries.withColumn("output", F.struct(*[F.col(f) for f in task.output_fields]))
    out = answers.select("entry_id", F.to_json("output", {"ignoreNullFields": "false"})
                                            .alias("output_json"))
    instr = entries.select("entry_id", "error_type",
                           P.instruction_text(task, F.col("error_type"), F.col("constraint"), F.col("entry_id"),
                                              seed).alias("instruction"))
    frags = P.build_fragments(entries, table, k=k, seed=seed, key=key, index_order=index_order)
    return instr.join(frags, "entry_id").join(out, "entry_id")


def finish_corpus(base: DataFrame, seed=42, ratio: float = 0.9, fewshot: bool = True,
                  checkpoint: bool = True) -> DataFrame:
    """Split (exact) and append few-shot exemplars; adds ``split``."""
    if checkpoint:
        base = cut_lineage(base)
    split = P.split_rows(base, ratio, seed=seed)
    if checkpoint:
        split = cut_lineage(split)
    return P.add_fewshot(split, seed=seed) if fewshot else split


def build_corpus(entries: DataFrame, table: DataFrame, task: str = "generation", k: int = 5,
                 seed=42, ratio: float = 0.9, fewshot: bool = True, key: str = "row_id",
                 index_order=None, checkpoint: bool = True) -> DataFrame:
    """(entry_id, error_type, split, instruction, input, output_json).

    ``entries`` = error records with ``entry_id``; ``table`` = the clean table
    for generation, the dirty one for detection / correction.  The joined
    base and the split are checkpointed to the shared checkpoint folder: the
    split and the few-shot step each read the corpus several times (counts,
    distributed sorts, joins), and re-running the fragment plan for every
    read would repeat the heaviest work.
    """
    base = corpus_base(entries, table, task, k, seed, key, index_order)
    return finish_corpus(base, seed, ratio, fewshot, checkpoint)


def corpus_from_folder(spark, root: str, task: str = "generation", out: str | None = None, k: int = 5,
                       seed=42, ratio: float = 0.9, cap: int | None = None) -> DataFrame:
    """C1 over the reference's folder layout: every ``*_annotation.jsonl`` under
    ``root`` next to its ``clean.csv`` / ``dirty.csv``.

    All records are used; with ``cap`` only the first so many per (file, type)
    in file order.  The logs are read once, each folder's table
    is read once (one Spark job per dataset folder; the folder list is a
    handful of names), all datasets are split together, and with ``out``
    three JSON-line sets are written: split=train, test_zeroshot,
    test_fewshot.  Bad log lines are skipped.
    """
    from ..operators.annotations import cap_per_type
    from ..sources.files import good_records, read_csv_table, read_error_log, write_jsonl
    from ..functions.templates import TASK_SOURCE
    log = good_records(read_error_log(spark, root, glob="*_annotation.jsonl", recursive=True))
    if cap is not None:
        log = cap_per_type(log.withColumn("line_no", F.col("seq")), cap, file_col="file", order_col="line_no")
    log = cut_lineage(log)
    folders = [r[0] for r in log.select("folder").distinct().collect()]
    parts = []
    for folder in sorted(folders):
        table = read_csv_table(spark, f"{folder}/{TASK_SOURCE[task]}.csv")
        ent = log.where(F.col("folder") == folder).withColumn(
            "entry_id", F.concat_ws("|", F.col("dataset"), F.col("seq").cast("string")))
        parts.append(corpus_base(ent, table, task, k, seed).withColumn("dataset", F.lit(folder.rsplit("/", 1)[-1])))
    base = parts[0]
    for p_ in parts[1:]:
        base = base.unionByName(p_)
    zero = finish_corpus(base, seed, ratio, fewshot=False)
    few = P.add_fewshot(zero, seed=seed)
    result = (few.where("split = 'train'")
              .unionByName(zero.where("split = 'test'").withColumn("split", F.lit("test_zeroshot")))
              .unionByName(few.where("split = 'test'").withColumn("split", F.lit("test_fewshot"))))
    result = result.select("split", "dataset", "instruction", "input", F.col("output_json").alias("output"))
    if out is not None:
        write_jsonl(result, out, partition_by=["split"])
    return result
