import math
import os
from pathlib import Path

import duckdb
import pytest

from foliomill.queries import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        found.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return found


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return None if value is None else str(value)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted([tuple(map(plain, r)) for r in df.select(columns).collect()], key=str)
    if name not in ORACLE_SQL:
        assert rows
        return
    result = db.execute(ORACLE_SQL[name])
    there = [d[0] for d in result.description]
    assert sorted(there) == columns
    at = [there.index(c) for c in columns]
    assert rows == sorted([tuple(plain(r[i]) for i in at) for r in result.fetchall()], key=str)
