"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources, ordered by code point (null last), weigh 5, 2, 1 and again
from the start, and share 150 % of all words; no target exceeds twice its
source, and what is cut off is shared by weight among the others until none is
above.  That is water-filling: every target is the smaller of twice the source
and weight times one common level, and the level is found by aggregates over
the table of sources (sources never pass through the driver, only two sums).

Rounding: each row of a source should be taken target / size times, a whole
number and a fraction.  The pivotal method takes two rows with fractions and
moves words from one to the other, in a random direction with the odds that
keep both expectations, until one fraction becomes 0 or 1; that row is decided,
the other goes on to the next.  The words taken so far never change.  Rows are
dealt by a hash into chunks of about CHUNK rows of a source, sorted by falling
size; a chunk streams through one task and leaves at most one undecided row.
What is left is dealt and paired again, level after level (a reduction tree),
until each source has at most one; that one is rounded to the nearest.  So a
source misses its target by less than the size of one row (half, in fact).

Randomness comes from hashes of the rows, so a second run agrees.

Defined results: a null text has 0 words; rows without words take nothing, and
are taken a whole number of times by their own hash.  Null sources are one
source.  Equal rows are decided one by one (they only share their random
numbers).  Extra columns are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cells import row_index
from .common import free_name, one_long, quoted, row_digest, written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST = 2
CHUNK = 1024
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows, weight, target) from rows (source, size)."""
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sources")
    named = row_index(sums.filter("source is not null"), order_by="source", name="rank") \
        .unionByName(sums.filter("source is null").withColumn("rank", F.lit(sums.count() - 1).cast("bigint")))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = written(named.withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int"))), "mix-weights")
    cap = F.col("source_size") * most
    budget = one_long(weighed, F.sum("source_size")) * share_percent / 100
    level = None
    while True:                                    # the level only rises, and each round caps another source
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        got = weighed.agg(F.sum(F.when(capped, cap).otherwise(0)).alias("c"),
                          F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("w")).first()
        if not got["w"] or (new := (budget - got["c"]) / got["w"]) == level:
            break
        level = new
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return weighed.select("source", "source_size", "n_rows", "weight", target.alias("target"))


def _uniform(*of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / float(1 << 53)


_ROW = "doc_id bigint, source string, size bigint, source_size bigint, target double, key {key}, base int, part double"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivotal rounding of rows sorted by (source, chunk) and falling size; one undecided row is held."""
    held, where = None, None
    for batch in batches:
        rows, u = batch.to_pylist(), None
        names = [f.name for f in batch.schema if f.name not in ("chunk", "u")]
        out = []
        for r in rows:
            at, u = (r["source"], r["chunk"]), r["u"]
            if at != where:
                if held is not None:
                    out.append(held)
                held, where = None, at
            if held is None:
                held = r
                continue
            a, b = held, r
            up = min(a["size"] * (1 - a["part"]), b["size"] * b["part"])       # words that a can gain and b lose
            down = min(a["size"] * a["part"], b["size"] * (1 - b["part"]))
            moved = up if u * (up + down) < down else -down
            held = None
            for x, gain in ((a, moved), (b, -moved)):
                p = x["part"] + gain / x["size"]
                x["part"] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
                if 0.0 < x["part"] < 1.0 and held is None:
                    held = x
                else:
                    x["part"] = float(round(x["part"]))
                    out.append(x)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], batch.schema.field(n).type) for n in names], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[n]], batch.schema.field(n).type) for n in names], names=names)


def decide(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Whole ``copies`` for rows (doc_id, source, size, source_size, target, key)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    begun = rows.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + EPS).cast("int")) \
        .withColumn("part", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).drop("rate")
    tiny = (F.col("size") == 0) | (F.col("part") < EPS)
    done = begun.filter(tiny).withColumn("part", F.when((F.col("size") == 0) & (F.col("part") >= EPS) & (
        _uniform(F.lit(0), "key", "doc_id") < F.col("part")), 1.0).otherwise(0.0))
    left, level = begun.filter(~tiny), 0
    order = [F.col("source"), F.col("chunk"), F.col("size").desc(), F.col("doc_id"), F.col("key")]
    while True:
        counts = left.groupBy("source").agg(F.count("*").alias("n"))
        if level and one_long(counts, F.max("n")) <= 1:
            break
        level += 1
        chunks = counts.select(F.col("source").alias("s"), F.ceil(F.col("n") / chunk).alias("n_chunks"))
        dealt = left.join(chunks, F.col("source").eqNullSafe(F.col("s"))).drop("s") \
            .withColumn("chunk", F.pmod(F.xxhash64(F.lit(level), "key", "doc_id"), F.col("n_chunks"))).drop("n_chunks") \
            .withColumn("u", _uniform(F.lit(1000 + level), "key", "doc_id"))
        paired = dealt.repartition("source", "chunk").sortWithinPartitions(*order)
        went = written(paired.mapInArrow(_pair, _ROW.format(key=rows.schema["key"].dataType.simpleString())), f"mix-level{level}")
        done = done.unionByName(went.filter("part in (0, 1)"))
        left = went.filter("part not in (0, 1)")
    done = done.unionByName(left.withColumn("part", F.round("part")))
    return done.withColumn("copies", F.col("base") + F.col("part").cast("int")).drop("base", "part")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", chunk: int = CHUNK,
        key: Column | None = None, **targets) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and its source, copies and key."""
    key = F.xxhash64(F.col(text)) if key is None else key
    sized = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
                                word_count(F.col(text)).alias("size"), key.alias("key")), "mix-sizes")
    goals = source_targets(sized, **targets).select(F.col("source").alias("s"), "source_size", "target")
    rows = sized.join(goals, F.col("source").eqNullSafe(F.col("s"))) \
        .select("doc_id", "source", "size", "source_size", "target", "key")
    return decide(rows, chunk).select("doc_id", "size", "source_size", "target",
                                      (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "key")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it.

    Rows are known by the SHA-256 of all their columns, nulls told apart; equal
    rows are one row with the sum of their copies.  Repeats are removed before
    the shuffle as well as behind it, so a row that stands very often meets
    there once a task.
    """
    key, n, copy = (free_name(docs.columns, name) for name in ("mix_key", "mix_n", "mix_copy"))
    whole = row_digest(docs.columns)
    copies = mix(docs, id_col, source, text, key=whole, **options) \
        .groupBy(F.col("key").alias(key)).agg(F.sum("copies").cast("int").alias(n)).filter(F.col(n) > 0)
    rows = docs.withColumn(key, whole).dropDuplicates([key])
    return rows.join(copies, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))) \
        .select(*[F.col(quoted(c)) for c in docs.columns])
