"""Error-pattern evaluation: embeddings of (right, error) value pairs, k nearest
real errors, and how similar generated transformations are to real ones.

* ``hash_embed`` (functions.vectors) is the default text embedder; a user
  may bring any ARRAY<DOUBLE> embedding column instead.
* ``knn_cosine`` is exact: both sides are cut into parts of at most PART_BLOCKS
  x ``block_rows`` vectors, and every (query part, reference part) pair is one
  task that multiplies small matrices and keeps its top-k per query; a final
  rank over <= k x parts candidates per query gives the global top-k.  What a
  task reads and holds is bounded by the part size, never by the data, and no
  all-pairs list is materialised.  Equal queries are searched once, and of
  equal references only the k first ids can be among the nearest.
* ``pattern_scores`` sweeps k from one kNN run at the largest k.
* ``text_similarity`` uses mean(cos(a_i, b_j)) = mean(a_i/|a_i|) . mean(b_j/|b_j|):
  linear, not n x m.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, diff, unit


def next_in_group(df: DataFrame, group_col: str, order_col: str, out_col: str = "next_id",
                  block: int = 100_000) -> DataFrame:
    """Add the next ``order_col`` value inside ``group_col`` (null for the last).

    Ordered windows run per (group, order_col div block) so a hot group is
    split across tasks; the last row of each block takes the first value
    of the group's next non-empty block (a small per-block aggregate).
    """
    blk = F.floor(F.col(order_col) / F.lit(block))
    x = df.withColumn("_blk", blk)
    w = Window.partitionBy(group_col, "_blk").orderBy(order_col)
    x = x.withColumn("_nx", F.lead(order_col).over(w))
    firsts = x.groupBy(group_col, "_blk").agg(F.min(order_col).alias("_first"))
    wb = Window.partitionBy(group_col).orderBy("_blk")
    # one row per (group, block): bounded by rows / block
    nxt_blk = firsts.withColumn("_nb_first", F.lead("_first").over(wb)).select(group_col, "_blk", "_nb_first")
    x = x.join(nxt_blk, [group_col, "_blk"], "left")
    return x.withColumn(out_col, F.coalesce(F.col("_nx"), F.col("_nb_first"))).drop("_blk", "_nx", "_nb_first")


def pattern_pairs(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  group_col: str = "label") -> DataFrame:
    """(id, label, right_emb, error_emb): vector i paired with the next id of its label."""
    e = emb.select(F.col(id_col).alias("id"), F.col(group_col).alias("label"),
                   F.col(vec_col).cast("array<double>").alias("vec"))
    nx = next_in_group(e, "label", "id", "next_id")
    partner = e.select(F.col("id").alias("next_id"), F.col("vec").alias("error_emb"))
    return nx.join(partner, "next_id").select("id", "label", F.col("vec").alias("right_emb"), "error_emb")


#: Blocks of ``block_rows`` vectors that a task of ``knn_cosine`` has of either side.
PART_BLOCKS = 8
#: Similarities that a task holds at once.
TILE = 1 << 22


def _part_topk(k: int, exclude_self: bool, block_rows: int):
    """mapInArrow function over rows (side, id, vec, diff) of one pair of parts, queries (side 0) first."""
    import numpy as np
    import pyarrow as pa

    def matrix(column) -> np.ndarray:
        """Unit rows; NaN where a vector is null, zero or not finite."""
        lists = column.combine_chunks()
        lengths = lists.value_lengths()
        sizes = np.unique(lengths.drop_null().to_numpy())
        if len(sizes) > 1:
            raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
        m = np.full((len(lists), int(sizes[0]) if len(sizes) else 0), np.nan)
        m[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, m.shape[1])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, m / n, np.nan)

    def best(order_by: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the k best of every ``order_by`` number, by cosine, ties by id."""
        order = np.lexsort((ids, -cos, order_by))
        sorted_by = order_by[order]
        return order[np.arange(len(order)) - np.searchsorted(sorted_by, sorted_by) < k]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        held.clear()
        nq = len(t) - int(np.count_nonzero(t.column("side").to_numpy()))
        if nq in (0, len(t)):
            return
        ids = t.column("id").to_numpy()
        qi, ri = ids[:nq], ids[nq:]
        (qv, rv), (qd, rd) = ((matrix(c.slice(0, nq)), matrix(c.slice(nq))) for c in (t.column("vec"), t.column("diff")))
        del t
        step = max(1, TILE // block_rows)
        for a in range(0, nq, step):
            found = []
            for b in range(0, len(ri), block_rows):
                s = np.nan_to_num(qv[a:a + step] @ rv[b:b + block_rows].T, nan=-np.inf)
                if exclude_self:
                    s[qi[a:a + step, None] == ri[None, b:b + block_rows]] = -np.inf
                kk = min(k, s.shape[1])
                # the k-th best per row in linear time, then an exact order of only the entries at or above it (ties kept)
                least = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
                rows, at = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                cos = s[rows, at]
                keep = best(rows, cos, ri[b + at])
                found.append((rows[keep], b + at[keep], cos[keep]))
            rows, at, cos = (np.concatenate(c) for c in zip(*found))
            keep = best(rows, cos, ri[at])
            rows, at, cos = a + rows[keep], at[keep], cos[keep]
            pcos = np.einsum("ij,ij->i", qd[rows], rd[at])
            yield pa.RecordBatch.from_arrays([pa.array(qi[rows]), pa.array(ri[at]), pa.array(cos), pa.array(
                pcos, mask=~np.isfinite(pcos))], names=["q_id", "r_id", "cos", "pcos"])
    return run


def knn_cosine(queries: DataFrame, refs: DataFrame, k: int = 20, exclude_self: bool = False,
               block_rows: int = 4096, materialize: bool = True) -> DataFrame:
    """Exact k nearest references per query by cosine of ``vec``.

    queries: (id, vec, diff), refs: (id, vec, diff) -- ``diff`` is the
    transformation vector (right - error) scored for the chosen neighbours.
    Output: (q_id, rank, r_id, cos, pcos) with rank 1..k, ties by r_id.
    """
    from ..session import cut_lineage
    if materialize:   # counted for the part sizes, then read again: compute once
        same = queries is refs
        queries = cut_lineage(queries.select("id", "vec", "diff"))
        refs = queries if same else cut_lineage(refs.select("id", "vec", "diff"))
    searched = queries
    if not exclude_self:           # else equal queries have other neighbours: not themselves
        first = Window.partitionBy("vec").orderBy("id")
        refs = cut_lineage(refs.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k).drop("_nth"))
        different = cut_lineage(queries.select("vec", "diff").distinct()).withColumn("_q", F.monotonically_increasing_id())
        members = queries.select(F.col("id").cast("long").alias("_id"), "vec", "diff").join(different, ["vec", "diff"]).select("_q", "_id")
        searched = different.withColumnRenamed("_q", "id")
    part = PART_BLOCKS * block_rows
    q_parts, r_parts = (max(1, -(-x.count() // part)) for x in (searched, refs))

    def side(df: DataFrame, number: int, own: int, others: int, place) -> DataFrame:
        """Rows dealt to the parts of their side by their place in the frame, one copy per part of the other side."""
        at = df.select(F.col("id").cast("long").alias("id"), "vec", "diff", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(own)).alias("_own"))
        return at.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(
            place(F.col("_own"), F.col("_other")).cast("int").alias("task"), F.lit(number).alias("side"), "id", "vec", "diff")

    both = side(searched, 0, q_parts, r_parts, lambda q, r: q * r_parts + r) \
        .unionByName(side(refs, 1, r_parts, q_parts, lambda r, q: q * r_parts + r))
    cand = both.repartitionById(q_parts * r_parts, F.col("task")).sortWithinPartitions("side").select("side", "id", "vec", "diff") \
        .mapInArrow(_part_topk(k, exclude_self, block_rows), "q_id long, r_id long, cos double, pcos double")

    def ranked(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("q_id").orderBy(F.col("cos").desc(), F.col("r_id"))
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    if not exclude_self:           # each query has at most k x (reference parts) candidates here
        cand = ranked(cand).join(members, F.col("q_id") == F.col("_q")).select(F.col("_id").alias("q_id"), "r_id", "cos", "pcos")
    return ranked(cand).select("q_id", "rank", "r_id", "cos", "pcos")


def pattern_scores(knn: DataFrame, ks=(1, 2, 3, 4, 5, 10, 15, 20), agg: str = "max") -> DataFrame:
    """(k, score): per query the max (or mean) pattern cosine over its k nearest,
    then the mean over queries; zero-length transformations are skipped; none -> 0.

    One pass over the kNN rows: a neighbour of rank r counts for every k >= r
    (an explode of the sweep values), then two aggregations.
    """
    sweep = F.array(*[F.lit(int(k)) for k in ks])
    x = knn.select("q_id", "pcos", F.explode(F.filter(sweep, lambda k: k >= F.col("rank"))).alias("k"))
    f = F.max("pcos") if agg == "max" else F.avg("pcos")
    per = x.groupBy("k", "q_id").agg(f.alias("_s"))
    return per.groupBy("k").agg(F.coalesce(F.avg("_s"), F.lit(0.0)).alias("score"))


def text_similarity(a: DataFrame, b: DataFrame, vec_col: str = "vec", group_cols=None) -> DataFrame:
    """Mean of all-pairs cosine between two vector sets = dot of their mean unit vectors.

    Empty side -> 0.  Linear: one vector mean per side (a single aggregate
    buffer per group; rows are not multiplied by the dimension).  Vectors of a
    side have one length.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    g = list(group_cols or [])

    def mean_unit(df, name):
        x = df.where(F.col(vec_col).isNotNull()).select(*g, array_to_vector(unit(F.col(vec_col))).alias("_u"))
        keys = g or [F.lit(0).alias("_all")]                    # a group even then: an empty side has none
        return x.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_u"))).alias(name))

    ma, mb = mean_unit(a, "_a"), mean_unit(b, "_b")
    score = F.aggregate(F.zip_with("_a", "_b", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    if not g:  # a global aggregate always yields one row
        return ma.join(mb, "_all").agg(F.coalesce(F.max(score), F.lit(0.0)).alias("text_similarity"))
    return ma.join(mb, g).select(*g, score.alias("text_similarity"))


__all__ = ["next_in_group", "pattern_pairs", "knn_cosine", "pattern_scores", "text_similarity",
           "cosine", "diff"]


def cached_embeddings(values: DataFrame, path: str, embed: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """(value, vec) of every distinct non-null value, from the cache table at ``path`` where it is known.

    What the cache lacks (an anti join on the value) is embedded -- ``embed``
    maps a text column to ARRAY<DOUBLE>, for example a pandas UDF of a model --
    and appended, so a second run embeds nothing.  The append is one committed
    write; values that two runs added at once are read as one.
    """
    spark = values.sparkSession
    schema = "value string, vec array<double>"
    wanted = values.select(F.col(f"`{value}`").cast("string").alias("value")).where("value is not null").distinct()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.createDataFrame([], schema)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.schema(schema).parquet(path)
    new = wanted.join(known.select("value"), "value", "left_anti")
    new.select("value", embed(F.col("value")).cast("array<double>").alias("vec")).write.mode("append").parquet(path)
    return wanted.join(spark.read.schema(schema).parquet(path).dropDuplicates(["value"]), "value")
