import glob
import math
import os

import duckdb
import pytest

from visionloom.plans import more_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    one = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(more_queries.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = more_queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(more_queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    rows = [tuple(r[names.index(c)] for c in cols) for r in want.fetchall()]
    assert plain(df.select(*cols).collect()) == plain([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows])
