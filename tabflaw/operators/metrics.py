"""Error-distribution and cell-set metrics.

A distribution is a DataFrame ``(column, n)`` -- errors per column.
A cell set is a DataFrame ``(row_id, column)``.  Metrics are small
aggregates; the only shuffles are the full outer join of two
distributions (one row per column name) and the cell-set joins.

Every metric has a ``by`` variant: pass ``group_cols`` (for example a
``method`` column) and one job scores all groups at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import float_value, is_nonneg_decimal, value_type
from ..functions.vectors import let


def _g(group_cols):
    return list(group_cols or [])


def align(p: DataFrame, q: DataFrame, group_cols=None, key: str = "column") -> DataFrame:
    """Full outer join of two distributions on the key union, missing = 0.

    Output: group cols, key, np, nq, pp, pq (probabilities per side).
    """
    g = _g(group_cols)
    a = p.select(*g, key, F.col("n").cast("double").alias("np"))
    b = q.select(*g, key, F.col("n").cast("double").alias("nq"))
    j = a.join(b, g + [key], "full_outer").na.fill(0.0, ["np", "nq"])
    from pyspark.sql import Window
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    # distributions are per-column counts (one row per column name), so the
    # per-group window holds at most the number of columns of a table.
    # an empty side has no probabilities: null, not a division error
    return j.select(*g, key, "np", "nq",
                    F.try_divide(F.col("np"), F.sum("np").over(w)).alias("pp"),
                    F.try_divide(F.col("nq"), F.sum("nq").over(w)).alias("pq"))


def dist_jaccard(p: DataFrame, q: DataFrame, group_cols=None) -> DataFrame:
    """Mean over the key union of min(p,q) / (max(p,q) + 1e-10)."""
    g = _g(group_cols)
    a = align(p, q, g)
    return a.groupBy(*g).agg(
        F.avg(F.least("pp", "pq") / (F.greatest("pp", "pq") + F.lit(1e-10))).alias("jaccard"))


def dist_js(p: DataFrame, q: DataFrame, group_cols=None) -> DataFrame:
    """Jensen-Shannon distance (square root of the divergence, natural log)."""
    g = _g(group_cols)
    a = align(p, q, g)
    m = (F.col("pp") + F.col("pq")) / 2

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))

    return a.groupBy(*g).agg(
        F.sqrt(F.greatest(F.lit(0.0), F.sum(term(F.col("pp")) + term(F.col("pq"))) / 2)).alias("js"))


def dist_kl(p: DataFrame, q: DataFrame, group_cols=None) -> DataFrame:
    """KL(p || q), base 2, over the key union; Infinity where q = 0 < p; empty side -> 0."""
    g = _g(group_cols)
    a = align(p, q, g)
    term = (F.when(F.col("pp") <= 0, F.lit(0.0))
            .when(F.col("pq") <= 0, F.lit(float("inf")))
            .otherwise(F.col("pp") * F.log2(F.col("pp") / F.col("pq"))))
    agg = a.groupBy(*g).agg(F.sum(term).alias("_kl"), F.sum("np").alias("_sp"), F.sum("nq").alias("_sq"))
    kl = F.when((F.col("_sp") <= 0) | (F.col("_sq") <= 0), F.lit(0.0)).otherwise(F.col("_kl"))
    return agg.select(*g, kl.alias("kl"))


def chi_square(p: DataFrame, q: DataFrame, group_cols=None) -> DataFrame:
    """Chi-square test of the 2 x k contingency table [p counts; q counts].

    Statistic in SQL (expected = row total x column total / grand total),
    Yates continuity correction when k == 2 (one degree of freedom).
    The p-value is a scalar function of (statistic, dof) evaluated on the
    single aggregated row per group by a vectorised pandas UDF.
    Empty side -> (0, 1).
    """
    from ..functions.udfs import chi2_pvalue

    g = _g(group_cols)
    a = align(p, q, g).where((F.col("np") + F.col("nq")) > 0)
    from pyspark.sql import Window
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    tot_p, tot_q = F.sum("np").over(w), F.sum("nq").over(w)
    k = F.count(F.lit(1)).over(w)
    tot = tot_p + tot_q
    colsum = F.col("np") + F.col("nq")
    e_p, e_q = colsum * tot_p / tot, colsum * tot_q / tot
    yates = F.when(k == 2, F.lit(0.5)).otherwise(F.lit(0.0))

    def cell(o, e):
        dev = F.greatest(F.abs(o - e) - F.least(yates, F.abs(o - e)), F.lit(0.0))
        return dev * dev / e

    x = a.select(*g, cell(F.col("np"), e_p).alias("_tp"), cell(F.col("nq"), e_q).alias("_tq"),
                 k.alias("_k"), tot_p.alias("_sp"), tot_q.alias("_sq"))
    agg = x.groupBy(*g).agg(F.sum(F.col("_tp") + F.col("_tq")).alias("_stat"),
                            F.max("_k").alias("_k"), F.max("_sp").alias("_sp"), F.max("_sq").alias("_sq"))

    ok = (F.col("_sp") > 0) & (F.col("_sq") > 0) & (F.col("_k") > 1)
    dof = (F.col("_k") - 1).cast("int")
    return agg.select(*g,
                      F.when(ok, F.col("_stat")).otherwise(F.lit(0.0)).alias("chi2"),
                      F.when(ok, dof).otherwise(F.lit(0)).alias("dof"),
                      F.when(ok, chi2_pvalue(F.col("_stat"), dof)).otherwise(F.lit(1.0)).alias("p_value"))


# ---------------------------------------------------------------- cell sets

def cell_set(df: DataFrame, group_cols=None, key: str = "row_id") -> DataFrame:
    """Distinct (row_id, column) cells, records with a null part skipped."""
    g = _g(group_cols)
    return df.select(*g, key, "column").dropna(subset=[key, "column"]).distinct()


def cell_scores(real: DataFrame, gen: DataFrame, group_cols=None, key: str = "row_id",
                legacy_recall: bool = False) -> DataFrame:
    """Exact match, precision, recall, F1 of generated cells against real cells.

    ``real`` has no group columns (one ground truth); ``gen`` may carry
    ``group_cols`` (one score row per method).  One semi-join count plus
    two set sizes; the real-side count is a scalar aggregate.
    """
    g = _g(group_cols)
    r = cell_set(real, None, key)
    gg = cell_set(gen, g, key)
    hit = gg.join(r.withColumn("_hit", F.lit(1)), [key, "column"], "left")
    per = hit.groupBy(*g).agg(F.count(F.lit(1)).alias("n_gen"),
                              F.count("_hit").alias("tp"))
    # the ground-truth size is a scalar subquery, not a join
    j = per.withColumn("n_real", r.agg(F.count(F.lit(1))).scalar())
    tp, ng, nr = F.col("tp").cast("double"), F.col("n_gen").cast("double"), F.col("n_real").cast("double")
    prec = F.when(ng > 0, tp / ng).otherwise(F.lit(0.0))
    rec = (F.when(tp > 0, F.lit(1.0)).otherwise(F.lit(0.0)) if legacy_recall
           else F.when(nr > 0, tp / nr).otherwise(F.lit(0.0)))
    f1 = F.when((prec + rec) > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    exact = F.when(nr > 0, tp / nr).otherwise(F.lit(0.0))
    return j.select(*g, "n_real", "n_gen", "tp", exact.alias("exact_match"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def rowcol_jaccard(real: DataFrame, gen: DataFrame, axis: str = "row", group_cols=None,
                   key: str = "row_id") -> DataFrame:
    """|A & B| / |A | B| of the touched row ids (axis='row') or columns; empty -> 0."""
    if axis not in ("row", "column"):
        axis = "row"
    c = key if axis == "row" else "column"
    g = _g(group_cols)
    a = real.select(F.col(c).alias("_v")).dropna().distinct().withColumn("_a", F.lit(1))
    b = gen.select(*g, F.col(c).alias("_v")).dropna().distinct().withColumn("_b", F.lit(1))
    if not g:
        j = a.join(b, "_v", "full_outer")
        agg = j.agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"),
                    F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("_ni"),
                    F.count(F.lit(1)).alias("_nu"))
    else:
        inter = b.join(a, "_v").groupBy(*g).agg(F.count(F.lit(1)).alias("_ni"))
        nb = b.groupBy(*g).agg(F.count(F.lit(1)).alias("_nb"))
        agg = (nb.join(inter, g, "left").na.fill(0, ["_ni"])
               .withColumn("_na", a.agg(F.count(F.lit(1))).scalar())
               .withColumn("_nu", F.col("_na") + F.col("_nb") - F.col("_ni")))
    score = F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.col("_ni") / F.col("_nu")).otherwise(F.lit(0.0))
    return agg.select(*g, score.alias(f"{axis}_jaccard"))


# ------------------------------------------------------------- distributions

def log_distribution(log: DataFrame, group_cols=None) -> DataFrame:
    """(column, n) from an error log; empty / null column names skipped."""
    g = _g(group_cols)
    return (log.where(F.col("column").isNotNull() & (F.col("column") != ""))
            .groupBy(*g, "column").agg(F.count(F.lit(1)).alias("n")))


def cellchange_distribution(changes: DataFrame, id_col: str = "_c0", group_cols=None) -> DataFrame:
    """(column, n) from ``row.column`` cell ids; split on the first '.' only."""
    g = _g(group_cols)
    col = F.get(F.split(F.col(id_col), r"\.", 2), 1)
    return (changes.select(*g, col.alias("column")).where(F.col("column").isNotNull())
            .groupBy(*g, "column").agg(F.count(F.lit(1)).alias("n")))


def dataset_profile(clean: DataFrame, log: DataFrame, dataset: str, key: str = "row_id") -> DataFrame:
    """rows, value columns, error cells, error rate, sorted error types."""
    n_cols = len([c for c in clean.columns if c != key])
    errs = log.agg(F.count(F.lit(1)).alias("error_cells"),
                   F.array_join(F.array_sort(F.collect_set("error_type")), ",").alias("error_types"))
    j = errs.withColumn("n_rows", clean.agg(F.count(F.lit(1))).scalar())
    return j.select(F.lit(dataset).alias("dataset"), "n_rows", F.lit(n_cols).alias("n_cols"),
                    "error_cells",
                    F.round(F.col("error_cells") / (F.col("n_rows") * F.lit(n_cols)), 6).alias("error_rate"),
                    "error_types")


# --------------------------------------------------------- value similarity

def numeric_similarity(pairs: DataFrame, a: str = "right_value", b: str = "error_value",
                       group_cols=None) -> DataFrame:
    """1 - mean |z(a) - z(b)|, z from the mean and population sd of a.

    Pairs are kept only when both sides are non-negative decimals (each
    pair stays aligned).  sd = 0 scales by 1.  No pair -> 0.
    """
    g = _g(group_cols)
    x = pairs.where(is_nonneg_decimal(F.col(a)) & is_nonneg_decimal(F.col(b))).select(
        *g, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    agg = x.groupBy(*g).agg(F.avg("_a").alias("_mu"), F.stddev_pop("_a").alias("_sd"),
                            F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("_mad"),
                            F.count(F.lit(1)).alias("_n"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return agg.select(*g, F.when(F.col("_n") > 0, 1 - F.col("_mad") / sd).otherwise(F.lit(0.0))
                      .alias("numeric_similarity"))


# Shapes of dates and times, and the text formats of each, tried in order (Spark patterns).
# Slash and dash dates are read month first; the day comes first only where the month would be above 12.
DATE_FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2}", ["yyyy-M-d"]), (r"\d{4}/\d{1,2}/\d{1,2}", ["yyyy/M/d"]), (r"\d{8}", ["yyyyMMdd"]),
    (r"\d{1,2}/\d{1,2}/\d{4}", ["M/d/yyyy", "d/M/yyyy"]), (r"\d{1,2}-\d{1,2}-\d{4}", ["M-d-yyyy", "d-M-yyyy"]),
    (r"\d{1,2}/\d{1,2}/\d{2}", ["M/d/yy", "d/M/yy"]), (r"\d{1,2} [A-Za-z]+ \d{4}", ["d MMM yyyy", "d MMMM yyyy"]),
    (r"[A-Za-z]+ \d{1,2}, \d{4}", ["MMM d, yyyy", "MMMM d, yyyy"]), (r"[A-Za-z]+ \d{1,2} \d{4}", ["MMM d yyyy", "MMMM d yyyy"]),
    (r"\d{4}-\d{1,2}", ["yyyy-M"]), (r"\d{4}\.\d{1,2}\.\d{1,2}", ["yyyy.M.d"]), (r"\d{1,2}\.\d{1,2}\.\d{4}", ["M.d.yyyy", "d.M.yyyy"]),
    (r"\d{1,2}-[A-Za-z]+-\d{4}", ["d-MMM-yyyy", "d-MMMM-yyyy"]), (r"\d{1,2}-[A-Za-z]+-\d{2}", ["d-MMM-yy"]),
    (r"[A-Za-z]+ \d{4}", ["MMM yyyy", "MMMM yyyy"])]
TIME_FORMATS = [(r"\d{1,2}:\d{2}:\d{2}", ["H:mm:ss"]), (r"\d{1,2}:\d{2}", ["H:mm"]), (r"\d{1,2}:\d{2}:\d{2} [AP]M", ["h:mm:ss a"]),
                (r"\d{1,2}:\d{2} [AP]M", ["h:mm a"]), (r"\d{1,2} [AP]M", ["h a"])]


def _by_shape(x: Column, shapes: list) -> Column:
    """Timestamp of a text by the formats of its shape (a failed format is costly, so only fitting ones are tried)."""
    out = None
    for shape, formats in shapes:
        value = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])
        fits = x.rlike(f"^(?:{shape})$")
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def parse_datetime(x: Column) -> Column:
    """Timestamp of a date, a time or both; null where no format fits.

    Before matching, a leading weekday goes, a 'T' between date and time becomes
    a blank (20200101T101112 gets its colons), fractions of seconds go, months
    and a.m. / p.m. get one spelling.  A closing Z, UTC, GMT or +hh:mm behind a
    time is the zone: the result is in UTC, and a text without a zone is read as
    UTC.  A time without a date is on 1970-01-01, a month without a day on its
    first.  The date and the time part are matched apart, so the formats of both
    need not be multiplied.
    """
    t = F.regexp_replace(F.trim(x.cast("string")), r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+", "")
    t = F.regexp_replace(t, r"^(\d{4}-\d{1,2}-\d{1,2})T", "$1 ")
    t = F.regexp_replace(t, r"^(\d{8})T(\d{2})(\d{2})(\d{2})", "$1 $2:$3:$4")
    t = F.regexp_replace(t, r"(:\d{2})\.\d+", "$1")
    zone = r"(:\d{2}(?:\s?[AaPp][Mm])?)\s*(?:Z|UTC|GMT)?([+-]\d{2}:?\d{2})?$"
    shift = F.regexp_replace(F.regexp_extract(t, zone, 2), ":", "")
    seconds = F.when(shift == "", 0).otherwise(
        F.when(F.left(shift, F.lit(1)) == "-", -1).otherwise(1)
        * (F.substring(shift, 2, 2).try_cast("int") * 3600 + F.substring(shift, 4, 2).try_cast("int") * 60))
    t = F.regexp_replace(t, zone, "$1")
    t = F.regexp_replace(t, r"(?i)\s*\b([ap])\.?\s?m\.?$", " $1M")
    clock = r"\d{1,2}(?::\d{2}){1,2}(?: [APap]M)?|\d{1,2} [APap]M"

    def parts(t):
        at = F.regexp_extract(t["t"], rf"(?:^|[\s,]+)({clock})$", 1)
        day = F.regexp_replace(t["t"], rf"(?:^|[\s,]+)(?:{clock})$", "")
        month = F.regexp_extract(day, r"[A-Za-z]+", 0)
        spelled = F.when(month == "", day).otherwise(F.replace(day, month, F.initcap(month)))
        return F.struct(F.upper(at).alias("at"), spelled.alias("day"), t["s"].alias("s"))

    def whole(p):
        start = F.when(p["day"] == "", F.to_timestamp(F.lit("1970-01-01"))).otherwise(_by_shape(p["day"], DATE_FORMATS))
        return let(_by_shape(p["at"], TIME_FORMATS), lambda time: F.when(p["at"] == "", F.when(p["day"] != "", start)).otherwise(
            F.timestamp_seconds(F.unix_timestamp(start) + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time) - p["s"])))

    return let(let(F.struct(t.alias("t"), seconds.alias("s")), parts), whole)


def datetime_similarity(pairs: DataFrame, a: str = "right_value", b: str = "error_value",
                        group_cols=None) -> DataFrame:
    """1 - mean |a - b| in days; any unparsable value in a group -> 0."""
    g = _g(group_cols)
    ta, tb = parse_datetime(F.col(a)), parse_datetime(F.col(b))
    x = pairs.select(*g, (F.unix_timestamp(ta) - F.unix_timestamp(tb)).alias("_d"),
                     (ta.isNull() | tb.isNull()).alias("_bad"))
    agg = x.groupBy(*g).agg(F.avg(F.abs("_d")).alias("_m"), F.bool_or("_bad").alias("_bad"))
    return agg.select(*g, F.when(F.col("_bad"), F.lit(0.0)).otherwise(1 - F.col("_m") / 86400.0)
                      .alias("datetime_similarity"))


__all__ = ["align", "dist_jaccard", "dist_js", "dist_kl", "chi_square", "cell_set", "cell_scores",
           "rowcol_jaccard", "log_distribution", "cellchange_distribution", "dataset_profile",
           "numeric_similarity", "datetime_similarity", "value_type", "float_value"]


def cells_from_cellchanges(changes: DataFrame, id_col: str = "_c0", key: str = "row_id") -> DataFrame:
    """(row_id, column) from 'row.column' cell ids (split on the first dot), nulls dropped --
    a cell-change list in the log shape, so it can be one ``method`` of a report."""
    parts = F.split(F.col(id_col), r"\.", 2)
    return changes.select(F.get(parts, 0).alias(key), F.get(parts, 1).alias("column")).dropna()
