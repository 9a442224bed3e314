"""Every query with SQL beside it gives the SQL's rows on the smallest tables; the others run."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from claimforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(norm(r[c]) for c in columns)) for r in df.collect()))
    if name not in registry.ORACLE_SQL:
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["vote_majority", "vote_weighted", "compare_vote_modes", "consensus_score"])
def test_sums_are_those_of_the_files_order(spark, tmp_path, name):
    """Last bits of sums decide ties, so they must not depend on how Spark deals rows out; SQL in one thread adds in files' order."""
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    lines.repartition(7, "l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(repr(tuple(map(norm, r))) for r in got) == sorted(repr(tuple(map(norm, r))) for r in found.fetchall())
