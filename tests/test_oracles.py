"""Every core query against its SQL in DuckDB over the same tables."""

import glob
import os
from decimal import Decimal

import pytest

from lutrin import registry


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 5) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else str(v)


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    mine = [tuple(_norm(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert _sorted(mine) == _sorted(theirs)


def test_every_query_is_named_once():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_run(spark, data, name):
    """Every row is made, and the same rows again."""
    first, again = (sorted(map(repr, registry.queries()[name](spark, data).collect())) for _ in range(2))
    assert first and first == again
