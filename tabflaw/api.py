"""The main entry points in one namespace: ``from tabflaw import api as tf``."""

from .operators.cells import (apply_errors, cell_diff, cell_diff_positional, dedupe_cells, differences,  # noqa: F401
                              errors_by_column, repair_table, row_index, table_pair_check, with_row_ids)
from .operators.constraints import (cross_pair_count, cross_pair_members, pair_groups, pair_members,  # noqa: F401
                                    pair_totals, pick_pairs, scoped, violation_counts, violation_rows)
from .operators.annotations import (cap_per_type, generated_cells, involved_rows, parse_completion,  # noqa: F401
                                    rule_cells, task_output, validate_candidates)
from .operators.generate import (completion_status, conflict_free, error_budget, generate_errors,  # noqa: F401
                                 model_completions, propose_errors, quota_select, select_errors, shortfall)
from .operators.metrics import (cell_scores, chi_square, dataset_profile, datetime_similarity,  # noqa: F401
                                dist_jaccard, dist_js, dist_kl, log_distribution, numeric_similarity,
                                rowcol_jaccard)
from .operators.patterns import knn_cosine, pattern_pairs, pattern_scores, text_similarity  # noqa: F401
from .operators.prompts import (Task, add_fewshot, build_fragments, instruction_text, markdown_row_ids,  # noqa: F401
                                prompt_text, split_rows)
from .plans.corpus import build_corpus, corpus_from_folder  # noqa: F401
from .plans.evaluation import method_cells, method_report, pattern_report, semantic_similarity  # noqa: F401
from .plans.generation import generate_with_model, generation_prompts  # noqa: F401
from .sources.files import (convert_csv_tree, read_csv_table, read_error_log, read_pair_map,  # noqa: F401
                            read_rules, save_bucketed, write_csv_table, write_jsonl)
from .functions.vectors import hash_embed  # noqa: F401
from .session import build_session, configure, cut_lineage  # noqa: F401
