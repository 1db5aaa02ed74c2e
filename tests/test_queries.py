"""Queries beside their SQL over small tables."""

import datetime
import decimal
import os
from collections import Counter

import numpy as np
import pytest

from webloom import queries, queries_audit, queries_cases
from webloom.operators import rules

SMALL = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 9)
    if isinstance(x, (list, tuple, np.ndarray)) and not hasattr(x, "asDict"):
        return tuple(map(plain, x))
    if isinstance(x, dict) or hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted((x if isinstance(x, dict) else x.asDict()).items()))
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def same(spark, sql, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = sql.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert not got - want and not want - got
    return got


@pytest.mark.parametrize("name", [f"audit_{c}" for c in queries_audit.CHECKS])
def test_audit_checks(spark, sql, name):
    assert same(spark, sql, name)


@pytest.mark.parametrize("name", sorted(queries_cases.QUERIES))
def test_cases(spark, sql, name):
    same(spark, sql, name)


def test_each_issue_type_fires(sql):
    seen = {r[0] for name in queries_audit.CHECKS for r in sql.execute(queries.SQL[f"audit_{name}"]).fetchall()}
    assert {t for c in rules.CHECKS.values() for t in c} - seen == {"near_duplicate_content"}


def test_the_entry_can_be_imported_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) - set(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-2]) > 200 and said.stdout.split()[-1] == "set()"
