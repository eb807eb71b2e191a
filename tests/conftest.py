import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from tessella.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(SF)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its statement, whatever the order of rows and columns."""

    def check(query, sql):
        got, want = query(spark, str(SF)).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = sorted(got.columns)
        a, b = (x[key].astype(str).sort_values(key).reset_index(drop=True) for x in (got, want))
        assert a.equals(b)

    return check
