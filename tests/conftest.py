import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{at}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from colonnade.session import ship

    ship(session)
    yield session
    session.stop()


def plain(value):
    """A value in a form that compares between engines."""
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        """Two Arrow tables hold the same rows under the same names, in any order."""
        names = sorted(a.column_names)
        assert names == sorted(b.column_names)
        rows = lambda t: sorted(zip(*[[plain(v) for v in t[c].to_pylist()] for c in names]), key=repr)
        assert rows(a) == rows(b)

    return check


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con
