"""Named queries (Spark) and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.
``oracle`` is DuckDB SQL over the same tables; queries without one are
checked by row count (iterative or non-SQL operators).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


ROUND_PLACES = 9


def query(name: str, oracle: str | None = None, round_cols: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` and its SQL twin.

    ``round_cols`` are DOUBLE outputs rounded to ROUND_PLACES in both engines
    (the engines sum floating point in different orders; the last bits differ).
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        if round_cols:
            from pyspark.sql import functions as F

            def wrapped(spark, sf_dir, _fn=fn):
                df = _fn(spark, sf_dir)
                return df.select(*[F.round(F.col(c), ROUND_PLACES).alias(c) if c in round_cols else F.col(c)
                                   for c in df.columns])
            wrapped.__doc__ = fn.__doc__
            QUERIES[name] = wrapped
        else:
            QUERIES[name] = fn
        if oracle is not None:
            sql = oracle
            if round_cols:
                rep = ", ".join(f'round("{c}", {ROUND_PLACES}) as "{c}"' for c in round_cols)
                sql = f"select * replace ({rep}) from (\n{oracle}\n)"
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so its queries register."""
    from . import (q_cells, q_constraints, q_annotations, q_metrics,  # noqa: F401
                   q_prompts, q_patterns, q_generate, q_sources)
