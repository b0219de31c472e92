import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Check a query's rows against its SQL's."""

    def check(query, sql):
        got, want = query(spark, SF), duck.execute(sql)
        names = sorted(got.columns)
        assert names == sorted(c[0] for c in want.description)
        rows = lambda columns, found: sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in names]) for r in found)
        assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())

    return check


def plain(x):
    """A value without the kind of number or row that holds it."""
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if x != x else int(x) if x.is_integer() else x
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x
