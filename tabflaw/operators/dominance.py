"""Violations of rules with two order predicates, or with a predicate across columns.

Counts of pairs are counts of points that lie beyond other points: row i breaks
``LT(t1.A,t2.A)&GT(t1.B,t2.B)`` with every row j of its group whose A is
larger and whose B is smaller.  ``dominance_counts`` finds, for every query
point, how many data points of its group come later in one order (x) and
earlier in another (y), without listing pairs and without a task per group:

1. A distributed sort by group and y gives every point a place in y, a second
   one by group and x its place in x; ties are ordered so that strict and
   non-strict comparisons both become "later" and "earlier".  As both orders
   begin with the group, a point later in x and earlier in y is of the same
   group, and groups need no further care.
2. Blocks are BLOCK successive positions in x.  Inside a block points are
   counted by halving it again and again, in arrays.
3. Points go back to the tasks that had them in the order of y.  A task passes
   through its points in that order and keeps how many data points it has seen
   per block; a query adds those of later blocks.  What it must know of the
   tasks before it is a count per block.

A group of any size is spread over all tasks.  The driver holds a number per
block and task of the sort: of 10^8 rows, 800 per task.

Whether a row has any partner needs less where there is one predicate: the
largest and the smallest value of the other rows of its group (``with_others``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import constraints as C

#: Successive positions in x that a task counts at once (some 100 bytes each).
BLOCK = 1 << 17
#: Batches that a block is given out in.
FAN = 16
FLIPPED = {"LT": "GT", "GT": "LT", "LTE": "GTE", "GTE": "LTE"}


def larger_before(values: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For every point, the data points before it with a larger value.

    Points in descending order are dealt to the two halves of the positions, again and
    again; where a half is split, its later points count the data points of its earlier
    ones that stand before them.
    """
    n = len(values)
    bits = max(n - 1, 0).bit_length()
    size = 1 << bits
    order = np.arange(size, dtype=np.int32)                              # places without a point come last
    order[:n] = np.argsort(values, kind="stable")[::-1]                  # descending; of equal values the later position first
    is_data = np.zeros(size, np.int32)
    is_data[:n] = data
    is_data, found = is_data[order], np.zeros(size, np.int32)
    for bit in range(bits - 1, -1, -1):                                  # nodes of 2 << bit positions, each in descending order
        second = (order >> bit) & 1
        seen = np.cumsum(is_data * (1 - second), dtype=np.int32).reshape(-1, 2 << bit)
        seen[1:] -= seen[:-1, -1:].copy()
        found += seen.reshape(-1) * second
        halves = np.concatenate([np.flatnonzero(second == 0).reshape(-1, 1 << bit), np.flatnonzero(second).reshape(-1, 1 << bit)], axis=1).reshape(-1)
        order, is_data, found = order[halves], is_data[halves], found[halves]
    return found[:n].astype(np.int64)                                    # now in the order of the positions


def _numbers(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return t.column(name).to_numpy() if isinstance(t, pa.Table) else t.column(name).to_numpy(zero_copy_only=False)


def _in_blocks(placed: DataFrame, size: int) -> DataFrame:
    """(block, py, data, id, n) of rows (block, py, data, id) in the order of x: the points of their own block are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = _numbers(batch, "block")
            borders = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(borders, borders[1:]):
                if held and a < b and held[0].column("block")[0].as_py() != block[a]:
                    yield from counted(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from counted(held)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        n = larger_before(-_numbers(t, "py")[::-1], _numbers(t, "data")[::-1])[::-1]
        yield from t.append_column("n", pa.array(np.ascontiguousarray(n))).combine_chunks().to_batches(max_chunksize=size)

    return placed.mapInArrow(run, "block bigint, py bigint, data boolean, id bigint, n bigint")


def _chunk() -> Column:
    """The task of the sort by y."""
    return F.shiftright("py", 33)


def _in_later_blocks(points: DataFrame, counts: DataFrame, chunks: int, blocks: int) -> DataFrame:
    """(id, n) of the query points of (block, py, data, id, n), with the data points of later blocks.

    ``counts``: (chunk, block, n) of data points.
    """
    table = np.zeros((chunks + 1, blocks + 1), np.int64)
    t = counts.toArrow()                                  # at most chunks x blocks rows
    table[_numbers(t, "chunk") + 1, _numbers(t, "block")] = _numbers(t, "n")
    known = points.sparkSession.sparkContext.broadcast(np.cumsum(table, axis=0))       # per chunk, those of the chunks before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, counts = None, None
        for batch in batches:
            py, block, data = _numbers(batch, "py"), _numbers(batch, "block"), _numbers(batch, "data")
            borders = [0, *(np.flatnonzero(np.diff(py >> 33)) + 1).tolist(), len(py)]
            n = _numbers(batch, "n").copy()
            for a, b in zip(borders, borders[1:]):
                if a == b:
                    continue
                if (now := int(py[a]) >> 33) != chunk:
                    chunk, counts = now, known.value[now].copy()
                own, d = block[a:b], data[a:b]
                later = np.cumsum(counts[::-1])[::-1]
                n[a:b] += later[own + 1] + larger_before(own, d)
                counts += np.bincount(own[d], minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(_numbers(batch, "id")[~data]), pa.array(n[~data])], names=["id", "n"])

    return points.repartitionById(chunks, _chunk().cast("int")).sortWithinPartitions("py").mapInArrow(run, "id bigint, n bigint")


def dominance_counts(points: DataFrame, x: list[Column], y: list[Column]) -> DataFrame:
    """(id, n) of every query point of (g, x.., y.., data, id): data points of its group later in ``x`` and earlier in ``y``.

    ``x`` and ``y`` are sort columns that order all points of a group, ties
    included.  A row is returned per query point, also where ids repeat.
    """
    ranked = cut_lineage(points.orderBy(F.col("g"), *y)).withColumn("py", F.monotonically_increasing_id())
    mid = F.monotonically_increasing_id()                 # the task of the sort by x, and the place in it
    placed = cut_lineage(ranked.orderBy(F.col("g"), *x).select("py", "data", "id")).withColumn("px", mid)
    ends = placed.groupBy(F.shiftright("px", 33).alias("part")).agg(F.max("px").alias("last")).orderBy("part").collect()
    first, blocks = {}, 0                                 # per task its first block
    for r in ends:
        first[r["part"]] = blocks
        blocks += ((r["last"] & ((1 << 33) - 1)) // BLOCK) + 1
    if not blocks:
        return placed.select("id", F.lit(0).cast("bigint").alias("n"))
    start = F.create_map(*[F.lit(int(v)) for kv in first.items() for v in kv])
    in_task = F.col("px").bitwiseAND((1 << 33) - 1)
    block = (F.element_at(start, F.shiftright("px", 33).cast("int")) + F.floor(in_task / BLOCK)).cast("bigint")
    placed = placed.select(block.alias("block"), "py", "data", "id")
    counts = placed.filter("data").groupBy(_chunk().alias("chunk"), "block").agg(F.count("*").alias("n"))
    chunks = ranked.agg(F.max(_chunk())).first()[0] + 1
    return _in_later_blocks(_in_blocks(placed, -(-BLOCK // FAN)), counts, chunks, blocks)


def _sides(rows: DataFrame, left: list[str], right: list[str], ops: list[str]) -> DataFrame:
    """(id, n): for every row as the first of a pair, the rows that hold as the second (itself among them, if it does).

    Rows with a null on the left are left out.
    """
    def points(columns: list[str], data: bool) -> DataFrame:
        out = rows.select("g", "id", F.lit(data).alias("data"), *[F.col(C._q(c)).alias(f"v{k}") for k, c in enumerate(columns)])
        return out.dropna(subset=[f"v{k}" for k in range(len(columns))])

    both = points(left, False).unionByName(points(right, True))
    # x: data behind the query must hold; y: data before it must hold.  At equal values data is on the holding side unless strict.
    def order(k: int, op: str, behind: bool) -> list[Column]:
        up = (op in ("LT", "LTE")) == behind
        value = F.col(f"v{k}").asc() if up else F.col(f"v{k}").desc()
        data_first = (op in ("LT", "GT")) == behind
        return [value, F.col("data").desc() if data_first else F.col("data").asc()]

    if len(ops) == 1:                                     # any order of y with all data first
        return dominance_counts(both, order(0, ops[0], True), [F.col("data").desc()])
    return dominance_counts(both, order(0, ops[0], True), order(1, ops[1], False))


def _holds(a: Column, op: str, b: Column) -> Column:
    return {"LT": a < b, "GT": a > b, "LTE": a <= b, "GTE": a >= b}[op]


def order_spec(rule: str) -> tuple[list[str], list[str], list[str]]:
    """(left columns, right columns, operators) of a rule with two order predicates or one across columns."""
    preds = [p for p in C.parse_rule(rule) if p.op != "EQ"]
    known = all(p.op in ("IQ", *FLIPPED) for p in preds)
    two = len(preds) == 2 and all(p.op != "IQ" and p.left == p.right for p in preds)
    one = len(preds) == 1 and preds[0].left != preds[0].right
    if not known or not (two or one):
        raise ValueError(f"rule {rule!r}: besides EQ, expected two order predicates that compare a column with itself, "
                         "or one predicate across columns")
    return [p.left for p in preds], [p.right for p in preds], [p.op for p in preds]


def _rows_of(table: DataFrame, rule: str, key: str, null_keys_match: bool) -> tuple[DataFrame, list[str], list[str], list[str]]:
    left, right, ops = order_spec(rule)
    columns = list(dict.fromkeys(left + right))
    k = C._keyed(table, rule, key, null_keys_match).select("group_key", F.col(C._q(key)).alias("row_key"), *[F.col(C._q(c)) for c in columns])
    some = F.lit(False)
    for side in (left, right):
        whole = F.lit(True)
        for c in side:
            whole = whole & F.col(C._q(c)).isNotNull()
        some = some | whole
    rows = cut_lineage(k.where(some).withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("group_key", "g"))
    return rows, left, right, ops


def _self(left: list[str], right: list[str], ops: list[str]) -> Column:
    """1 if a row holds with itself."""
    out = F.lit(True)
    for a, op, b in zip(left, ops, right):
        out = out & F.coalesce(_holds(F.col(C._q(a)), op, F.col(C._q(b))), F.lit(False))
    return out.cast("bigint")


def _other_rows(rows: DataFrame, left: list[str], right: list[str], ops: list[str]) -> DataFrame:
    """``rows`` with ``n``: the other rows that hold as second of a pair with the row as first."""
    return rows.join(_sides(rows, left, right, ops), "id", "left") \
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)) - _self(left, right, ops))


def _other_rows_of_groups(rows: DataFrame, left: list[str], right: list[str], ops: list[str], name: str) -> DataFrame:
    """(id, name): ``n`` of _other_rows added up over the rows of a group, where ``id`` is the group's."""
    both = _sides(rows, left, right, ops).unionByName(rows.select("id", (-_self(left, right, ops)).alias("n")))
    return both.groupBy("id").agg(F.sum("n").cast(C.PAIR_COUNT).alias(name))


def with_others(rows: DataFrame) -> DataFrame:
    """``rows`` (g, a, b, ..) with ``most`` and ``least``: of ``b`` over the other rows of the group (null: there is no value).

    Two aggregates: the ends of a group, then how many rows are there and the next
    value inside, which is what a row alone at an end sees.
    """
    ends = rows.groupBy("g").agg(F.max("b").alias("top"), F.min("b").alias("low"))
    inner = rows.join(ends, "g").groupBy("g").agg(
        F.count(F.expr("case when b = top then 1 end")).alias("at_top"), F.max(F.expr("case when b < top then b end")).alias("below"),
        F.count(F.expr("case when b = low then 1 end")).alias("at_low"), F.min(F.expr("case when b > low then b end")).alias("above"))
    return rows.join(ends.join(inner, "g"), "g").select(
        *[rows[c] for c in rows.columns], F.expr("case when b = top and at_top = 1 then below else top end").alias("most"),
        F.expr("case when b = low and at_low = 1 then above else low end").alias("least"))


def _has_partner(rows: DataFrame, left: str, right: str, op: str) -> DataFrame:
    """``row_key`` of the rows that hold as the first of a pair for one predicate across columns."""
    a, b = F.col(C._q(left)), F.col(C._q(right))
    kind = rows.select(a.alias("v")).unionByName(rows.select(b.alias("v"))).schema["v"].dataType
    pairs = with_others(rows.select("g", "row_key", a.cast(kind).alias("a"), b.cast(kind).alias("b")))
    a, most, least = F.col("a"), F.col("most"), F.col("least")
    found = (a < most) | (a > least) if op == "IQ" else _holds(a, op, most if op in ("LT", "LTE") else least)
    return pairs.where(found).select("row_key")


def _unequal_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(g, n_pairs) of unordered pairs with a_i <> b_j one way or the other, by counts of values."""
    A, B = F.col(C._q(a)), F.col(C._q(b))
    one = lambda c: F.count(F.when(c, 1)).cast(C.PAIR_COUNT)
    base = rows.groupBy("g").agg(one(A.isNotNull()).alias("na"), one(B.isNotNull()).alias("nb"), one(A.isNotNull() & B.isNotNull()).alias("m"),
                                 one(A == B).alias("e"))
    by_a = rows.where(A.isNotNull()).groupBy("g", A.alias("v")).agg(one(F.lit(True)).alias("ca"), one(B.isNotNull()).alias("fa"))
    by_b = rows.where(B.isNotNull()).groupBy("g", B.alias("v")).agg(one(F.lit(True)).alias("cb"), one(A.isNotNull()).alias("fb"))
    same = by_a.join(by_b, ["g", "v"]).groupBy("g").agg(F.sum(F.col("ca") * F.col("cb")).alias("eq"), F.sum(F.col("fa") * F.col("fb")).alias("eqm"))
    ab = rows.where(A.isNotNull() & B.isNotNull()).groupBy("g", A.alias("p"), B.alias("q")).agg(one(F.lit(True)).alias("n"))
    back = ab.join(ab.select("g", F.col("p").alias("q"), F.col("q").alias("p"), F.col("n").alias("k")), ["g", "p", "q"]) \
        .groupBy("g").agg(F.sum(F.col("n") * F.col("k")).alias("swap"))
    j = base.join(same, "g", "left").join(back, "g", "left").na.fill(0, ["eq", "eqm", "swap"])
    ordered = F.col("na") * F.col("nb") - F.col("m") - (F.col("eq") - F.col("e"))
    both = F.col("m") * (F.col("m") - 1) - (F.col("eqm") - F.col("e")) * 2 + (F.col("swap") - F.col("e"))
    return j.select("g", (ordered - both / 2).cast(C.PAIR_COUNT).alias("n_pairs"))


def order_violation_counts(table: DataFrame, rule: str, key: str = "row_id", null_keys_match: bool = True) -> DataFrame:
    """(rule, group_key, n_rows, n_pairs) of unordered pairs for which the rule holds one way or the other.

    Rows with a null count where the predicates don't read it.  Pairs that hold
    both ways are counted once: for two predicates on their own columns those
    are equal rows (if none is strict), for one across columns a second count.
    """
    rows, left, right, ops = _rows_of(table, rule, key, null_keys_match)
    sizes = rows.groupBy("g").agg(F.count("*").alias("n_rows"))
    if ops == ["IQ"]:
        pairs = _unequal_counts(rows, left[0], right[0])
    else:
        groups = cut_lineage(sizes).withColumn("id", F.monotonically_increasing_id())
        sizes = groups.select("g", "n_rows")
        of = rows.drop("id", "row_key").join(groups.select("g", "id"), "g").withColumn("g", F.col("id"))     # numbers sort faster
        pairs = _other_rows_of_groups(of, left, right, ops, "n_pairs")
        if len(ops) == 1:
            both = _other_rows_of_groups(of, left + right, right + left, [ops[0], FLIPPED[ops[0]]], "b")
            pairs = pairs.join(both, "id").select("id", (F.col("n_pairs") - F.col("b") / 2).cast(C.PAIR_COUNT).alias("n_pairs"))
        elif all(op in ("LTE", "GTE") for op in ops):
            equal = of.groupBy("id", *[F.col(C._q(c)) for c in dict.fromkeys(left)]).agg(F.count("*").alias("m")) \
                .groupBy("id").agg(F.sum(C._pairs(F.col("m"))).alias("b"))
            pairs = pairs.join(equal, "id").select("id", (F.col("n_pairs") - F.col("b")).cast(C.PAIR_COUNT).alias("n_pairs"))
        pairs = pairs.join(groups.select("g", "id"), "id").select("g", "n_pairs")
    return sizes.join(pairs, "g").where("n_pairs > 0") \
        .select(F.lit(rule).alias("rule"), F.col("g").alias("group_key"), "n_rows", "n_pairs")


def order_violation_rows(table: DataFrame, rule: str, key: str = "row_id", null_keys_match: bool = True) -> DataFrame:
    """(rule, row_id) of the rows of at least one such pair, as its first or its second."""
    rows, left, right, ops = _rows_of(table, rule, key, null_keys_match)
    if len(ops) == 1:
        found = _has_partner(rows, left[0], right[0], ops[0]).unionByName(_has_partner(rows, right[0], left[0], FLIPPED.get(ops[0], "IQ")))
    else:
        found = _other_rows(rows, left, right, ops).where("n > 0").select("row_key") \
            .unionByName(_other_rows(rows, right, left, [FLIPPED[o] for o in ops]).where("n > 0").select("row_key"))
    return found.distinct().select(F.lit(rule).alias("rule"), F.col("row_key").alias(key))
