import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("pitchflow-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(spark, sf_dir, query, sql):
    """Rows of a query and of its SQL in DuckDB, as sorted lists over columns in name order."""
    import duckdb
    import pandas as pd

    got = query(spark, sf_dir).toPandas()
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def key(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(key, v)) + "]"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.9g}" if isinstance(v, float) and v != int(v) else str(int(v))
        return str(v)

    rows = lambda f: sorted(tuple(key(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    return rows(got), rows(want)


@pytest.fixture
def check_sql(spark):
    def check(query, sql, sf_dir=SF, least=1):
        got, want = same_rows(spark, sf_dir, query, sql)
        assert len(got) == len(want) and len(got) >= least
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        assert not diff, diff[:3]

    return check
