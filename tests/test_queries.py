"""Every query with SQL against DuckDB on the smallest tables, where they are."""

from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int) or hasattr(x, "as_integer_ratio"):
        return f"{float(x):.9g}"
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert names == sorted(rel.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"}))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
