import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from evalloom.session import local_session, ship

    return ship(local_session(4, 4, "4g"))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(run, sql):
        got, want = run(spark, SF).toPandas(), duck.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = [sorted(map(tuple, d[cols].astype(str).to_numpy().tolist())) for d in (got, want)]
        assert rows[0] == rows[1]

    return check
