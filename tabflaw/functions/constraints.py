"""Column expressions over denial-constraint and annotation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Denial-constraint operators and their sentence form.
OPERATOR_TEXT = {
    "EQ": "is equal to",
    "IQ": "is different from",
    "LT": "is less than",
    "GT": "is greater than",
    "LTE": "is less than or equal to",
    "GTE": "is greater than or equal to",
}

# one predicate: OP(t1.left,t2.right); names may contain '-' or spaces, not ',' or parens
PREDICATE_RE = r"(\w+)\(t\d+\.([^,()]+),t\d+\.([^,()]+)\)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dc_parse(rule) -> Column:
    """``EQ(t1.a,t2.a)&IQ(t1.b,t2.b)`` -> array<struct<op,left,right>> (one per '&' part)."""
    parts = F.split(F.trim(_c(rule)), "&")
    return F.transform(parts, lambda p: F.struct(
        F.regexp_extract(F.trim(p), r"^(\w+)\(", 1).alias("op"),
        F.regexp_extract(F.trim(p), r"\(t\d+\.([^,]+),", 1).alias("left"),
        F.regexp_extract(F.trim(p), r",\s*t\d+\.([^)]+)\)", 1).alias("right")))


def _op_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in OPERATOR_TEXT.items() for x in kv])


def dc_to_text(rule) -> Column:
    """Sentence form: 'The A of entity 1 is equal to the A of entity 2 and ... .'

    Predicates with an unknown operator are dropped; an empty rule gives '.'.
    """
    from .vectors import let
    r = _c(rule)
    m = _op_map()
    # one regex pass: every predicate match as 'OP\x00left\x00right'
    parts = F.regexp_extract_all(
        F.regexp_replace(r, PREDICATE_RE, "\u0001$1\u0000$2\u0000$3\u0001"), F.lit("\u0001([^\u0001]*)\u0001"), 1)

    def sentence(p):
        return let(F.split(p, "\u0000"), lambda f: F.concat(
            F.lit("The "), F.get(f, 1), F.lit(" of entity 1 "), F.element_at(m, F.get(f, 0)),
            F.lit(" the "), F.get(f, 2), F.lit(" of entity 2")))

    known = F.filter(parts, lambda p: F.map_contains_key(m, F.get(F.split(p, "\u0000"), 0)))
    return F.concat(F.array_join(F.transform(known, sentence), " and "), F.lit("."))


def constraint_entities(constraint) -> Column:
    """Annotated prose -> entity form.

    'Constraint Violation: The A of Row 3 ... Row 7' -> 'Denial Constraint is: The A
    of entity 1 ... entity 2'.  Row numbers are replaced on word boundaries
    ('Row 1' does not touch 'Row 12').  Fewer than two row mentions ->
    'Invalid constraint format.'
    """
    c = F.replace(_c(constraint), F.lit("Constraint Violation: "), F.lit(""))
    rows = F.regexp_extract_all(c, F.lit(r"Row (\d+)"), 1)
    r1, r2 = F.get(rows, 0), F.get(rows, 1)
    step1 = F.regexp_replace(c, F.concat(F.lit("Row "), r1, F.lit(r"\b")), F.lit("entity 1"))
    # when both mentions name the same row the second replacement finds nothing
    step2 = F.regexp_replace(step1, F.concat(F.lit("Row "), r2, F.lit(r"\b")), F.lit("entity 2"))
    return F.when(F.size(rows) < 2, F.lit("Invalid constraint format.")) \
            .otherwise(F.concat(F.lit("Denial Constraint is: "), step2))


def tuple_ids(tuple_pairs) -> Column:
    """Tolerant: every digit run, as a distinct bigint array ('(698, 704)' -> [698, 704])."""
    runs = F.regexp_extract_all(F.coalesce(_c(tuple_pairs), F.lit("")), F.lit(r"\d+"), 0)
    return F.array_distinct(F.transform(runs, lambda s: s.try_cast("bigint")))


def tuple_ids_strict(tuple_pairs) -> Column:
    """Strict: strip parens, split on ',', keep all-digit parts; first two, or null if < 2."""
    stripped = F.regexp_replace(F.coalesce(_c(tuple_pairs), F.lit("")), r"^[()]+|[()]+$", "")
    parts = F.transform(F.split(stripped, ","), lambda s: F.trim(s))
    digits = F.filter(parts, lambda s: s.rlike(r"^\d+$"))
    ids = F.filter(F.transform(digits, lambda s: s.try_cast("bigint")), lambda i: i.isNotNull())
    return F.when(F.size(ids) >= 2, F.slice(ids, 1, 2))


def constraint_columns(constraint) -> Column:
    """Distinct column names mentioned as 'The X of Row n'."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(constraint), F.lit("")),
                                                 F.lit(r"The (\w+) of Row \d+"), 1))
