"""Vectorised (Arrow-batched) pandas UDFs for the few scalar functions SQL lacks.

No ``from __future__ import annotations`` here: pandas_udf reads the type hints.
"""

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (regularised incomplete gamma)."""
    if x is None or dof is None or x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z < a + 1:  # series for the lower tail
        term = s = 1.0 / a
        k = a
        for _ in range(10000):
            k += 1
            term *= z / k
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        lower = s * math.exp(-z + a * math.log(z) - math.lgamma(a))
        return max(0.0, 1.0 - lower)
    tiny = 1e-300  # continued fraction for the upper tail
    b = z + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


@pandas_udf(DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(s), int(d)) for s, d in zip(stat, dof)], dtype="float64")
