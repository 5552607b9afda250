"""Composite evaluation jobs: distribution report per generator method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M


def per_method(dist: DataFrame, methods: list[str]) -> DataFrame:
    """Repeat the ground-truth distribution once per method (literal list, no join)."""
    return dist.select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), "*")


def method_report(real_log: DataFrame, gen_logs: DataFrame, methods: list[str] | None = None,
                  key: str = "row_id") -> DataFrame:
    """Score every generator (``method`` column of ``gen_logs``) against one real log.

    Distribution metrics (probability Jaccard, JS distance) on errors per
    column, cell precision / recall, and row-level Jaccard -- all grouped
    by method in one plan.  ``methods`` defaults to the distinct method
    names (a handful of labels, fetched once).
    """
    from ..session import cut_lineage
    # every metric below reads the two cell sets; materialise them once (only
    # the three columns needed) instead of recomputing the logs per metric
    real_log = cut_lineage(real_log.select(key, "column"))
    gen_logs = cut_lineage(gen_logs.select("method", key, "column"))
    if methods is None:
        methods = sorted(r[0] for r in gen_logs.select("method").distinct().collect())
    g = ["method"]
    p = per_method(M.log_distribution(real_log), methods)
    q = M.log_distribution(gen_logs, g)
    dist = M.dist_jaccard(p, q, g).join(M.dist_js(p, q, g), g)
    cells = M.cell_scores(real_log, gen_logs, g, key=key)
    rows = M.rowcol_jaccard(real_log, gen_logs, "row", g, key=key)
    out = dist.join(cells, g).join(rows, g)
    return out.select("method", F.round("jaccard", 9).alias("jaccard"), F.round("js", 9).alias("js"),
                      "n_gen", "tp", F.round("recall", 9).alias("recall"),
                      F.round("precision", 9).alias("precision"),
                      F.round("row_jaccard", 9).alias("row_jaccard"))


def semantic_similarity(real_log: DataFrame, gen_log: DataFrame, group_cols=None, key: str = "row_id",
                        dim: int = 64, ngram: int = 3, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """0.5 * text + 0.3 * numeric + 0.2 * datetime similarity.

    Real and generated errors are paired by cell (key join on group, row,
    column); each pair is typed by the real value; a class with no pairs
    contributes 0.  ``embed`` maps a text column to its vectors (a pandas UDF
    of a model, or an expression); hashed n-gram embeddings by default.
    """
    from ..functions.values import value_type
    from ..functions.vectors import hash_embed
    from ..operators.patterns import text_similarity

    from ..session import cut_lineage
    g = list(group_cols or [])
    if not g:                                  # all pairs are one group
        one = [log.withColumn("_all", F.lit(1)) for log in (real_log, gen_log)]
        return semantic_similarity(*one, ["_all"], key, dim, ngram, embed).drop("_all")
    r = real_log.select(*g, key, "column", F.col("error_value").alias("tv"))
    q = gen_log.select(*g, key, "column", F.col("error_value").alias("gv"))
    # the paired values feed four aggregates: join once, read four times
    pairs = cut_lineage(r.join(q, g + [key, "column"]).withColumn("_t", value_type(F.col("tv"))))
    groups = pairs.select(*g).distinct()
    embed = embed or (lambda x: hash_embed(x, dim, ngram))
    txt = pairs.where(F.col("_t") == "text")
    ts = text_similarity(txt.select(*g, embed(F.col("tv")).alias("vec")),
                         txt.select(*g, embed(F.col("gv")).alias("vec")), group_cols=g)
    ns = M.numeric_similarity(pairs.where(F.col("_t") == "numeric"), "tv", "gv", g)
    ds = M.datetime_similarity(pairs.where(F.col("_t") == "datetime"), "tv", "gv", g)
    out = groups.join(ts, g, "left").join(ns, g, "left").join(ds, g, "left")
    score = (0.5 * F.coalesce(F.col("text_similarity"), F.lit(0.0))
             + 0.3 * F.coalesce(F.col("numeric_similarity"), F.lit(0.0))
             + 0.2 * F.coalesce(F.col("datetime_similarity"), F.lit(0.0)))
    return out.select(*g, F.round(score, 9).alias("semantic_similarity"))


def method_cells(sources: dict, key: str = "row_id") -> DataFrame:
    """Generated errors from different kinds of sources as (method, row_id, column).

    ``sources``: method -> an error log (has ``column``), a (clean, dirty) pair
    (differences are the errors), or a cell-change list (``_c0`` = 'row.column').
    """
    from ..operators.cells import cell_diff
    from ..operators.metrics import cells_from_cellchanges
    parts = []
    for method, src in sources.items():
        if isinstance(src, tuple):
            cells = cell_diff(src[0], src[1], key=key).select(key, "column")
        elif "_c0" in src.columns:
            cells = cells_from_cellchanges(src, key=key)
        else:
            cells = src.select(key, "column")
        parts.append(cells.select(F.lit(method).alias("method"), key, "column"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern_report(real_log: DataFrame, gen_log: DataFrame, ks=(1, 2, 3, 4, 5, 10, 15, 20),
                   dim: int = 64, ngram: int = 3, agg: str = "max", block_rows: int = 4096,
                   id_cols=("row_id", "column"), embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """How much generated (right -> error) transformations resemble real ones.

    Both logs keep non-empty string pairs with error != right; values are
    embedded (``embed``, hashed n-grams by default), every generated error finds its k nearest real
    errors by the right-value embedding (exact blocked kNN, one run at the
    largest k), and the score per k is the mean over generated errors of the
    max cosine between transformation vectors.  Every record is a query or a
    reference of its own: its id is a hash of the dataset (if there is one),
    ``id_cols``, both values and the number of the record among equal ones.
    """
    from pyspark.sql import Window

    from ..functions.hashing import hash_id
    from ..functions.vectors import diff, hash_embed
    from ..operators.patterns import knn_cosine, pattern_scores

    def prep(log):
        ok = (F.col("right_value").isNotNull() & F.col("error_value").isNotNull()
              & (F.col("right_value") != "") & (F.col("error_value") != "")
              & (F.col("right_value") != F.col("error_value")))
        key = [F.col(c) for c in ("dataset", *id_cols, "right_value", "error_value") if c in log.columns]
        x = log.where(ok).withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
        r, e = (embed(F.col(c)) if embed else hash_embed(F.col(c), dim, ngram) for c in ("right_value", "error_value"))
        return x.select(hash_id(*key, F.col("_nth")).alias("id"), r.alias("vec"), diff(r, e).alias("diff"))

    # knn_cosine materialises both embedded sets once (they are counted, then joined)
    knn = knn_cosine(prep(gen_log), prep(real_log), k=max(ks), block_rows=block_rows)
    return pattern_scores(knn, ks, agg=agg)
