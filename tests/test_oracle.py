"""Every proof query against its DuckDB oracle (row count, column names,
order-insensitive value hash) on the smallest driver scale."""

import hashlib
import math

import duckdb
import pytest

from conftest import SF_SMALL

from __spark_entry__ import entry, oracle_sql, queries
from forumflow.plans.adapters import TABLES


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


def _digest(rows):
    return sorted(hashlib.md5("\x1f".join(_norm(x) for x in r).encode()).hexdigest() for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    """All but the training-data operators, which are tested by brute force where SQL can't express them."""
    from forumflow.plans.proofs import QUERIES
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["conv_id", "api_n", "kept_n"]
    assert df.count() > 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in df.schema.fields}
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.sql(oracle_sql()[name])
    ocols = sorted(rel.columns)
    idx = [rel.columns.index(c) for c in ocols]
    orows = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert cols == ocols
    assert stypes == dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert len(srows) == len(orows)
    assert _digest(srows) == _digest(orows)
