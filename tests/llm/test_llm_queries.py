from pathlib import Path

import duckdb
import pytest

from gleaner.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = sorted(map(tuple, frame.select(*columns).collect()), key=str)
    assert rows
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "pages"):
            db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = db.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert rows == sorted(map(tuple, want), key=str)
