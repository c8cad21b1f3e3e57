import glob
import os
from collections import Counter

import duckdb
import pytest

from cellarium.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(r[i] for i in at) for r in got.fetchall())
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == want
