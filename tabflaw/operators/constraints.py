"""Denial-constraint mining without materialising quadratic pair lists.

The reference self-joins a table on the EQ columns of a rule and writes
every pair.  Pair counts are quadratic in the group size (4.5 M pairs for
one customer rule at sf0.1; a hot key holding a third of 100 TB would
give ~10^20), so here a rule's candidate pairs are represented exactly
and compactly as **pair groups**: all rows whose EQ columns are equal
(null-safe, like a pandas merge) form one group, and every two rows of a
group are a candidate pair.  Everything a caller needs is an aggregate
or a per-row membership over those groups:

* ``pair_groups``     -- (rule, group_key, n_rows, n_pairs), groups of >= 2 rows
* ``pair_members``    -- (rule, group_key, row_id) for rows that are in some pair
* ``violation_counts``-- pairs that also satisfy the rule's non-EQ predicates
                         (two order predicates or one across columns: see dominance)
* ``violation_rows``  -- rows that take part in at least one violating pair
* ``pick_pairs``      -- disjoint pairs drawn inside groups (by a distributed
                         sort, so a hot group is split over many tasks)

Group keys are the md5 of the EQ values, each written with its length and
nulls apart (so different values never share a key, and a shuffle moves 32
bytes per row, not a 20 kB document), and all counting is hash aggregation
with map-side partial merge -- a hot key never lands in one task as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import cut_lineage
from .cells import row_index


@dataclass(frozen=True)
class Predicate:
    op: str
    left: str
    right: str


def parse_rule(rule: str) -> list[Predicate]:
    """Driver-side parse of one rule string (rules are parameters, not data)."""
    import re
    preds = []
    for part in rule.strip().split("&"):
        m = re.match(r"^\s*(\w+)\(t\d+\.([^,]+),\s*t\d+\.([^)]+)\)\s*$", part)
        if not m:
            raise ValueError(f"cannot parse predicate {part!r} of rule {rule!r}")
        preds.append(Predicate(m.group(1), m.group(2), m.group(3)))
    return preds


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def eq_columns(rule: str) -> list[str]:
    preds = parse_rule(rule)
    eq = [p for p in preds if p.op == "EQ"]
    if not eq:
        raise ValueError(f"rule {rule!r} has no EQ predicate: no join key, pairs would be all pairs")
    cross = [p for p in eq if p.left != p.right]
    if cross:
        raise ValueError(f"rule {rule!r}: EQ across different columns forms no groups; "
                         "use cross_pair_count / cross_pair_members")
    return [p.left for p in eq]


def group_key(cols: list[str]) -> Column:
    """md5 of the EQ values, each as 'length:value' and null as 'n': equal keys mean equal values, null equals null."""
    texts = [F.col(_q(c)).cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("n")) for v in texts]
    return F.md5(F.concat_ws(",", *parts))


def _keyed(table: DataFrame, rule: str, key: str, null_keys_match: bool) -> DataFrame:
    cols = eq_columns(rule)
    t = table
    if not null_keys_match:
        for c in cols:
            t = t.where(F.col(_q(c)).isNotNull())
    return t.select(F.lit(rule).alias("rule"), group_key(cols).alias("group_key"), F.col(key).alias(key),
                    *[F.col(_q(c)) for c in table.columns if c != key])


PAIR_COUNT = "decimal(38,0)"


def _pairs(n: Column) -> Column:
    """C(n, 2) as DECIMAL(38,0): a hot group of 10^11 rows has ~5*10^21 pairs (beyond BIGINT)."""
    n = n.cast(PAIR_COUNT)
    return (n * (n - 1) / 2).cast(PAIR_COUNT)


def pair_groups(table: DataFrame, rule: str, key: str = "row_id",
                null_keys_match: bool = True) -> DataFrame:
    """(rule, group_key, n_rows, n_pairs) for every group with at least two rows."""
    k = _keyed(table, rule, key, null_keys_match)
    g = k.groupBy("rule", "group_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return g.where(F.col("n_rows") >= 2).select("rule", "group_key", "n_rows", _pairs(F.col("n_rows")).alias("n_pairs"))


def pair_totals(groups: DataFrame) -> DataFrame:
    """(rule, n_groups, n_rows, n_pairs) from pair groups."""
    return groups.groupBy("rule").agg(F.count(F.lit(1)).alias("n_groups"),
                                      F.sum("n_rows").cast("long").alias("n_rows"),
                                      F.sum("n_pairs").cast(PAIR_COUNT).alias("n_pairs"))


def pair_members(table: DataFrame, rule: str, key: str = "row_id",
                 null_keys_match: bool = True) -> DataFrame:
    """(rule, group_key, row_id, n_rows) for rows that occur in at least one candidate pair.

    Group sizes are one aggregate; the join back is a plain shuffle join
    on the 32-byte key (AQE splits a hot key's partition).
    """
    k = _keyed(table, rule, key, null_keys_match)
    sizes = (k.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_rows"))
             .where(F.col("n_rows") >= 2))
    return k.select("rule", "group_key", key).join(sizes, "group_key").select("rule", "group_key", key, "n_rows")


def _non_eq(rule: str) -> Predicate:
    """The single non-EQ predicate of a rule (used where exactly one is expected)."""
    preds = [p for p in parse_rule(rule) if p.op != "EQ"]
    if len(preds) != 1 or preds[0].left != preds[0].right:
        raise ValueError(f"rule {rule!r}: expected exactly one non-EQ predicate comparing a column with itself")
    if preds[0].op not in ("IQ", "LT", "GT", "LTE", "GTE"):
        raise ValueError(f"unknown operator {preds[0].op!r}")
    return preds[0]


def violation_spec(rule: str) -> tuple[list[str], list[str]]:
    """(differ, present): columns that must differ between the two rows, and
    columns that only must be non-null, for a pair to satisfy the non-EQ part.

    Any number of IQ predicates plus at most one order predicate: LT / GT
    hold for some orientation of the pair iff the values differ; LTE / GTE
    hold for every non-null pair.  Two order predicates need the same
    orientation for both, a dominance count (see ``dominance``).
    """
    preds = [p for p in parse_rule(rule) if p.op != "EQ"]
    if not preds:
        raise ValueError(f"rule {rule!r} has no predicate besides EQ")
    for p in preds:
        if p.left != p.right:
            raise ValueError(f"rule {rule!r}: {p.op} across different columns is not supported")
        if p.op not in ("IQ", "LT", "GT", "LTE", "GTE"):
            raise ValueError(f"unknown operator {p.op!r} in {rule!r}")
    order = [p for p in preds if p.op != "IQ"]
    if len(order) > 1:
        raise ValueError(f"rule {rule!r}: at most one order predicate (LT/GT/LTE/GTE) is supported")
    differ = sorted({p.left for p in preds if p.op in ("IQ", "LT", "GT")})
    present = sorted({p.left for p in preds if p.op in ("LTE", "GTE")} - set(differ))
    return differ, present


def _by_order(rule: str) -> bool:
    """Whether a rule's violations are found by dominance counts: two order predicates, or one predicate across columns."""
    preds = [p for p in parse_rule(rule) if p.op != "EQ"]
    return (len(preds) == 2 and all(p.op in ("LT", "GT", "LTE", "GTE") and p.left == p.right for p in preds)) \
        or (len(preds) == 1 and preds[0].left != preds[0].right and preds[0].op in ("IQ", "LT", "GT", "LTE", "GTE"))


def _subsets(cols: list[str]):
    from itertools import combinations
    for r in range(len(cols) + 1):
        for t in combinations(cols, r):
            yield list(t)


def violation_counts(table: DataFrame, rule: str, key: str = "row_id",
                     null_keys_match: bool = True) -> DataFrame:
    """(rule, group_key, n_rows, n_pairs) of unordered pairs for which all predicates hold.

    SQL semantics: a null value satisfies no predicate, so rows with a null
    in a non-EQ column are left out.  Pairs of an EQ group whose values
    differ on every column of D = differ-columns, by inclusion-exclusion:

        sum over subsets T of D of (-1)^|T| * sum over (group, T-values) C(m, 2)

    i.e. 2^|D| hash aggregations (one for a single IQ / LT / GT), never a
    pair list.  With no differ column (LTE / GTE only) every pair counts.
    """
    if _by_order(rule):
        from .dominance import order_violation_counts
        return order_violation_counts(table, rule, key, null_keys_match)
    differ, present = violation_spec(rule)
    k = _keyed(table, rule, key, null_keys_match)
    for c in differ + present:
        k = k.where(F.col(_q(c)).isNotNull())
    terms = None
    for t in _subsets(differ):
        sign = -1 if len(t) % 2 else 1
        if not t:
            g = k.groupBy("rule", "group_key").agg(F.count(F.lit(1)).alias("n_rows"))
            part = g.select("rule", "group_key", "n_rows", (_pairs(F.col("n_rows"))).alias("_t"))
        else:
            m = k.groupBy("rule", "group_key", *[F.col(_q(c)) for c in t]).agg(F.count(F.lit(1)).alias("_m"))
            part = m.groupBy("rule", "group_key").agg(F.sum(_pairs(F.col("_m"))).alias("_t")) \
                    .select("rule", "group_key", F.lit(None).cast("long").alias("n_rows"),
                            (F.col("_t") * F.lit(sign)).alias("_t"))
        terms = part if terms is None else terms.unionByName(part)
    agg = terms.groupBy("rule", "group_key").agg(F.max("n_rows").alias("n_rows"), F.sum("_t").alias("n_pairs"))
    return (agg.select("rule", "group_key", F.col("n_rows").cast("long").alias("n_rows"),
                       F.col("n_pairs").cast(PAIR_COUNT).alias("n_pairs")).where(F.col("n_pairs") > 0))


def violation_rows(table: DataFrame, rule: str, key: str = "row_id",
                   null_keys_match: bool = True) -> DataFrame:
    """(rule, row_id) of rows in at least one violating pair.

    A row takes part when some other row of its group differs from it on
    every differ-column: that number is, by inclusion-exclusion, the sum
    over subsets T of (-1)^|T| * (rows of the group agreeing with it on T),
    one aggregate + key join per subset (a single column needs only the
    group's min and max).
    """
    if _by_order(rule):
        from .dominance import order_violation_rows
        return order_violation_rows(table, rule, key, null_keys_match)
    differ, present = violation_spec(rule)
    k = _keyed(table, rule, key, null_keys_match)
    for c in differ + present:
        k = k.where(F.col(_q(c)).isNotNull())
    if len(differ) == 0:
        ok = k.groupBy("group_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
        return k.join(ok.select("group_key"), "group_key", "left_semi").select("rule", key)
    if len(differ) == 1:
        c = F.col(_q(differ[0]))
        ok = k.groupBy("group_key").agg(F.min(c).alias("_lo"), F.max(c).alias("_hi")) \
              .where(F.col("_lo") != F.col("_hi"))
        return k.join(ok.select("group_key"), "group_key", "left_semi").select("rule", key)
    x = k.select("rule", "group_key", key, *[F.col(_q(c)) for c in differ])
    total = None
    for i, t in enumerate(_subsets(differ)):
        sign = -1 if len(t) % 2 else 1
        keys = ["group_key"] + t
        cnt = x.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_c{i}"))
        x = x.join(cnt, keys)
        term = F.col(f"_c{i}") * F.lit(sign)
        total = term if total is None else total + term
    return x.where(total > 0).select("rule", key)


def scoped(table: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is in ``ids`` (semi join) -- pairs with both rows in scope."""
    return table.join(ids.select(F.col(key)).distinct(), key, "left_semi")


def pick_pairs(table: DataFrame, rule: str, seed: int = 42, key: str = "row_id",
               null_keys_match: bool = True) -> DataFrame:
    """Disjoint random pairs inside every group: (rule, group_key, row_id_1, row_id_2).

    The rows of a group are put in a seeded order and consecutive rows are
    paired (1-2, 3-4, ...): every pair is a candidate pair of the rule, no row
    is used twice, and only an odd group's last row stays alone.  The order is
    one distributed sort of (group, hash, id) with a dense index, so a hot
    group is spread over many tasks and its size changes nothing.  Ids that
    are no integers take no part.  For EQ predicates across columns see
    ``pick_cross_pairs``.
    """
    if any(p.op == "EQ" and p.left != p.right for p in parse_rule(rule)):
        return pick_cross_pairs(table, rule, seed, key, null_keys_match)
    k = _keyed(table, rule, key, null_keys_match)
    ids = k.select("group_key", F.col(key).cast("string").try_cast("bigint").alias("_id"),
                   hash_key(seed, F.col(key)).alias("_h")).where(F.col("_id").isNotNull())
    idx = row_index(ids, order_by=["group_key", "_h", "_id"], name="_i").drop("_h")
    first = idx.groupBy("group_key").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    ranked = idx.join(first.drop("_n"), "group_key").withColumn("_pair", F.floor((F.col("_i") - F.col("_first")) / 2))
    pairs = ranked.groupBy("group_key", "_pair").agg(
        F.min("_id").alias("row_id_1"), F.max("_id").alias("row_id_2"), F.count(F.lit(1)).alias("_n"))
    return pairs.where(F.col("_n") == 2).select(F.lit(rule).alias("rule"), "group_key", "row_id_1", "row_id_2")


# ---------------------------------------------------------------- cross-column EQ

def _eq_sides(rule: str) -> tuple[list[str], list[str]]:
    preds = [p for p in parse_rule(rule) if p.op == "EQ"]
    if not preds:
        raise ValueError(f"rule {rule!r} has no EQ predicate: no join key, pairs would be all pairs")
    return [p.left for p in preds], [p.right for p in preds]


def cross_pair_count(table: DataFrame, rule: str, key: str = "row_id") -> DataFrame:
    """(rule, n_pairs): unordered candidate pairs {x, y}, x != y, with x.L = y.R in
    either orientation, for EQ predicates t1.L_i = t2.R_i over any columns.

    Without listing pairs: ordered pairs = sum_v cntL(v) * cntR(v) - rows with
    L = R (themselves); a pair matching in both orientations (x.L = y.R and
    y.L = x.R) was counted twice, so subtract those once.  Both-way pairs pair
    a row of (L, R) key (l, r) with a row of key (r, l): cnt(l, r) * cnt(r, l)
    for l < r, C(cnt, 2) for l = r.  All counts are hash aggregations and one
    join of aggregated keys.  Nulls match nulls (as a pandas merge does).
    """
    left, right = _eq_sides(rule)
    x = table.select(group_key(left).alias("_l"), group_key(right).alias("_r"))
    cl = x.groupBy(F.col("_l").alias("_v")).agg(F.count(F.lit(1)).cast(PAIR_COUNT).alias("_cl"))
    cr = x.groupBy(F.col("_r").alias("_v")).agg(F.count(F.lit(1)).cast(PAIR_COUNT).alias("_cr"))
    ordered = cl.join(cr, "_v").agg(F.sum(F.col("_cl") * F.col("_cr")).alias("_o"))
    selfs = x.where(F.col("_l") == F.col("_r")).agg(F.count(F.lit(1)).cast(PAIR_COUNT).alias("_s"))
    lr = x.groupBy("_l", "_r").agg(F.count(F.lit(1)).cast(PAIR_COUNT).alias("_n"))
    rev = lr.select(F.col("_l").alias("_r"), F.col("_r").alias("_l"), F.col("_n").alias("_m"))
    both = (lr.join(rev, ["_l", "_r"])
            .where(F.col("_l") <= F.col("_r"))
            .agg(F.sum(F.when(F.col("_l") == F.col("_r"), _pairs(F.col("_n")))
                       .otherwise(F.col("_n") * F.col("_m"))).alias("_b")))
    total = (F.coalesce(ordered.select("_o").scalar(), F.lit(0)) - F.coalesce(selfs.select("_s").scalar(), F.lit(0))
             - F.coalesce(both.select("_b").scalar(), F.lit(0)))
    return table.sparkSession.range(1).select(F.lit(rule).alias("rule"), total.cast(PAIR_COUNT).alias("n_pairs"))


def cross_pair_members(table: DataFrame, rule: str, key: str = "row_id") -> DataFrame:
    """(rule, row_id) of rows in some candidate pair of a (cross-column) EQ rule:
    x pairs with another row when another row's R equals x.L or another row's L
    equals x.R (self matches discounted by counting)."""
    left, right = _eq_sides(rule)
    x = table.select(F.col(key), group_key(left).alias("_l"), group_key(right).alias("_r"))
    cr = x.groupBy(F.col("_r").alias("_l")).agg(F.count(F.lit(1)).alias("_nr"))
    cl = x.groupBy(F.col("_l").alias("_r")).agg(F.count(F.lit(1)).alias("_nl"))
    j = x.join(cr, "_l", "left").join(cl, "_r", "left").na.fill(0, ["_nr", "_nl"])
    me = F.when(F.col("_l") == F.col("_r"), 1).otherwise(0)   # a row whose L = R matches itself
    ok = ((F.col("_nr") - me) > 0) | ((F.col("_nl") - me) > 0)
    return j.where(ok).select(F.lit(rule).alias("rule"), F.col(key))


def _ranked(rows: DataFrame, value: str, salt: str) -> DataFrame:
    """(_v, _id, _k): rank of every row among those of its value, in a salted order; a hot value is spread by the sort."""
    salted = rows.select(F.col(value).alias("_v"), "_id", F.md5(F.concat(F.lit(salt), F.col("_id").cast("string"))).alias("_h"))
    idx = row_index(salted, order_by=["_v", "_h", "_id"], name="_i")
    first = idx.groupBy("_v").agg(F.min("_i").alias("_first"))
    return idx.join(first, "_v").select("_v", "_id", (F.col("_i") - F.col("_first")).alias("_k"))


def pick_cross_pairs(table: DataFrame, rule: str, seed: int = 42, key: str = "row_id",
                     null_keys_match: bool = True) -> DataFrame:
    """Disjoint pairs of a rule whose EQ predicates compare different columns: (rule, group_key, row_id_1, row_id_2).

    x and y are a candidate pair if x's left columns equal y's right columns.
    Every round ranks the unused rows of each value twice, as left and as right
    rows, and pairs equal ranks, so a value of any size is matched at once.  A
    row may so stand in two pairs (left in one value, right in another); a pair
    stays if it comes first, by its hash, in both its rows.  Rounds go on with
    new orders until no two unused rows are a candidate pair, so the choice is
    maximal; each round's pairs are a checkpoint.  ``group_key`` is the value
    that joined them; row_id_1 is the smaller id.  Ids that are no integers and
    rows that share an id with another take no part.
    """
    left, right = _eq_sides(rule)
    def side(cols: list[str]) -> Column:
        got = group_key(cols)
        if null_keys_match:
            return got
        present = F.lit(True)
        for c in cols:
            present = present & F.col(_q(c)).isNotNull()
        return F.when(present, got)
    unused = cut_lineage(table.select(F.col(_q(key)).cast("string").try_cast("bigint").alias("_id"), side(left).alias("_l"), side(right).alias("_r"))
                         .where("_id is not null").groupBy("_id").agg(F.count("*").alias("_n"), F.min("_l").alias("_l"), F.min("_r").alias("_r"))
                         .where("_n = 1").drop("_n"))
    chosen, level = None, 0
    while True:
        lefts = unused.where("_l is not null").groupBy(F.col("_l").alias("_v")).agg(F.count("*").alias("_nl"), F.min("_id").alias("_x"))
        rights = unused.where("_r is not null").groupBy(F.col("_r").alias("_v")).agg(F.count("*").alias("_nr"), F.min("_id").alias("_y"))
        open_ = cut_lineage(lefts.join(rights, "_v").where("_nl > 1 or _nr > 1 or _x <> _y").select("_v"))     # values that still have a pair
        if open_.isEmpty():
            break
        level += 1
        as_left = _ranked(unused.join(open_, unused["_l"] == open_["_v"], "left_semi"), "_l", f"{seed}|{level}|l|")
        as_right = _ranked(unused.join(open_, unused["_r"] == open_["_v"], "left_semi"), "_r", f"{seed}|{level}|r|")
        edges = cut_lineage(as_left.withColumnRenamed("_id", "_a").join(as_right.withColumnRenamed("_id", "_b"), ["_v", "_k"])
                            .where("_a <> _b").select("_v", "_a", "_b", F.md5(F.concat_ws("|", F.lit(f"{seed}|{level}"), "_a", "_b")).alias("_h")))
        order = F.struct("_h", "_a", "_b")
        least = edges.select(F.explode(F.array("_a", "_b")).alias("_id"), order.alias("_o")).groupBy("_id").agg(F.min("_o").alias("_o"))
        won = cut_lineage(edges.select("*", order.alias("_o"))
                          .join(least.select(F.col("_id").alias("_a"), F.col("_o").alias("_oa")), "_a")
                          .join(least.select(F.col("_id").alias("_b"), F.col("_o").alias("_ob")), "_b")
                          .where("_o = _oa and _o = _ob").select("_v", "_a", "_b"))
        chosen = won if chosen is None else chosen.unionByName(won)
        unused = cut_lineage(unused.join(won.select(F.explode(F.array("_a", "_b")).alias("_id")), "_id", "left_anti"))
    if chosen is None:
        chosen = unused.limit(0).select(F.col("_l").alias("_v"), F.col("_id").alias("_a"), F.col("_id").alias("_b"))
    return chosen.select(F.lit(rule).alias("rule"), F.col("_v").alias("group_key"), F.least("_a", "_b").alias("row_id_1"),
                         F.greatest("_a", "_b").alias("row_id_2"))
