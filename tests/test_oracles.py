"""Every query outside the training-data subpackage against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from foliant.plans import report_queries, sheet_queries, statement_queries, text_queries

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = statement_queries.QUERIES | report_queries.QUERIES | sheet_queries.QUERIES | text_queries.QUERIES
ORACLES = statement_queries.ORACLES | report_queries.ORACLES | sheet_queries.ORACLES | text_queries.ORACLES

pytestmark = pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return [plain(y) for y in x] if isinstance(x, list) else x


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    got = sorted_rows(df.columns, [list(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = sorted_rows([d[0] for d in cur.description], [list(r) for r in cur.fetchall()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, str(SF)).limit(5).collect()
