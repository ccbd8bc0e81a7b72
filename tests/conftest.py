import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from granary.session import session

    return session("4", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def same(spark_rows, want):
    """Whether a Spark result and a pandas frame hold the same rows, whatever their order."""

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__.startswith("float") else str(v)

    columns = sorted(spark_rows.columns)
    assert columns == sorted(want.columns)
    keyed = lambda rows: sorted(tuple(map(plain, r)) for r in rows)
    assert keyed(tuple(r) for r in spark_rows.select(columns).collect()) == keyed(want[columns].astype(object).itertuples(index=False, name=None))
