"""Every registered query against its SQL oracle (DuckDB) on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import exact, kind, norm

QUERIES = E.queries()
ORACLES = E.oracle_sql()
from conftest import SF_SMALL  # noqa: E402


def _rows(df):
    return df.collect(), df.columns, {f.name: exact(f.dataType.simpleString()) for f in df.schema.fields}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    rows, cols, types = _rows(QUERIES[name](spark, SF_SMALL))
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    dtypes = {d[0]: str(d[1]).upper() for d in res.description}
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    for c in cols:   # exact type names; structs compared by kind only
        if types[c] == "STRUCT":
            assert dtypes[c].startswith("STRUCT"), c
        else:
            assert types[c] == dtypes[c], (c, types[c], dtypes[c])
    order = sorted(cols)
    sv = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in rows), key=repr)
    dv = sorted((tuple(norm(r[dcols.index(c)]) for c in order) for r in drows), key=repr)
    assert len(sv) == len(dv)
    assert sv == dv


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    assert df.columns[0] == "method"
