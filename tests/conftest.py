import math
import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return tuple(map(_plain, v.values())) if isinstance(v, dict) else v


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Asserts that a query and its SQL give the same rows on the small tables."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF_DIR}/{f}'")

    def check(query, sql):
        df = query(spark, SF_DIR)
        cols = sorted(df.columns)
        got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        if sql is None:
            return
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want

    return check
