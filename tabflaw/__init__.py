"""Spark-native library for errors in tables: diff, constraints, logs, budgets, repair,
prompt corpora, metrics."""

import sys as _sys

__version__ = "0.1.0"

# Python code shipped to executors (pandas UDFs, mapInPandas / applyInPandas
# functions) is pickled by value, so executors need no installed copy of
# this package on their path.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
