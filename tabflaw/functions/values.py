"""Cell-value predicates: null tokens, float-parsable text, value classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens that a pandas CSV read with default
# settings turns into a missing value (even with dtype=str).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Text accepted by Python float(): decimal / exponent forms with optional
# underscores between digits, surrounding whitespace, and nan/inf words.
# Spark's cast is not the same (it accepts "1d", rejects "1_0").
FLOAT_RE = (r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
            r"|^\s*[+-]?(?i:nan|inf|infinity)\s*$")

# Non-negative decimal without sign or exponent: "12", "1.5", ".5", "3."
NONNEG_DECIMAL_RE = r"^(\d+\.?\d*|\.\d+)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def na_to_null(x, tokens=None) -> Column:
    """Null out the pandas null tokens (applied after a raw CSV read)."""
    x = _c(x)
    return F.when(x.isin(tokens or NA_TOKENS), F.lit(None).cast("string")).otherwise(x)


def is_float_text(x) -> Column:
    return _c(x).rlike(FLOAT_RE)


def float_value(x) -> Column:
    """Python-float parse: numeric when the text passes FLOAT_RE."""
    x = _c(x)
    cleaned = F.regexp_replace(F.trim(x), "_", "")
    return F.when(is_float_text(x), cleaned.try_cast("double"))


def value_type(x) -> Column:
    """numeric if float-parsable, else datetime if it has ':' or '-', else text."""
    x = _c(x)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(is_float_text(x), F.lit("numeric"))
            .when(x.contains(":") | x.contains("-"), F.lit("datetime"))
            .otherwise(F.lit("text")))


def is_nonneg_decimal(x) -> Column:
    return _c(x).rlike(NONNEG_DECIMAL_RE)
