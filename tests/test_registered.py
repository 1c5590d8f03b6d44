"""Every registered query beside its SQL twin, on the smallest tables."""

import pytest

from check import compare, duck, rows_of
from weirgate.plans.registry import load

FOLDER = "/root/testdata/sf0.001"
QUERIES = load()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    query = QUERIES[name]
    df = query.run(spark, FOLDER)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        assert mine[1]
        return
    cursor = con.execute(query.sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert compare(mine, theirs) == ""


def test_names_are_distinct_and_covered():
    covered = {c for q in QUERIES.values() for c in q.covers}
    assert {"S1", "K9", "J2", "A10", "F5", "T6", "L8", "D1", "X14"} <= covered
