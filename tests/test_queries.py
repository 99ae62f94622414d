import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in frame.select(*columns).collect()), key=str)
    assert rows
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = db.execute(f'select {", ".join(chr(34) + c + chr(34) for c in columns)} from ({ORACLE_SQL[name]})').fetchall()
        assert rows == sorted((tuple(plain(v) for v in r) for r in want), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["answer_json", "json_repair"])
def test_one_file_is_dealt_out(spark, name):
    """A table of one split is worked on by all cores."""
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


CUT = ["a &amp; b", "a &amp", "a &am", "a &", "a &quo", "a &quot", "a &copy", "&middot;&&&amp;&amp;amp; &lt", "&amp;lt; &amplified"]
READ = "page_clean page_values short_titles nav_links article_paragraphs selector_diagnostics nav_top_labels leaf_candidates annotated_context annotated_structure selector_samples element_html".split()


@pytest.mark.parametrize("name", READ)
def test_references_end_with_a_semicolon(spark, tmp_path, name):
    """Titles that were cut within a reference."""
    page = "<html><head><title>{0}</title></head><body><nav><ul><li><a href=\"/a\">{0}</a></li></ul></nav><article><h1>{0}</h1><p>{0}</p></article></body></html>"
    spark.createDataFrame([(i, "http://a.b/c", page.format(x)) for i, x in enumerate(CUT)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    frame = QUERIES[name](spark, str(tmp_path))
    columns = sorted(frame.columns)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f'select {", ".join(chr(34) + c + chr(34) for c in columns)} from ({ORACLE_SQL[name]})').fetchall()
    assert want and sorted((tuple(r) for r in frame.select(*columns).collect()), key=str) == sorted(want, key=str)
