"""Every registered query against its SQL on the smallest corpus, and the shape of the plans."""

import contextlib
import io

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# These walk sorted rows in Python on purpose; everything else must stay in the JVM.
PYTHON = {
    "duplicate_keys", "orphans",
    "revision_fold", "chapter_history", "version_pages", "version_export", "version_restore", "restore_rejects", "late_saves", "row_edits",
    "job_upsert", "fact_review", "fact_state", "quota_accept", "quota_accept_tight",
    # Products of tiles of vectors, and least hashes of shingles.
    "vector_topk", "vector_index_topk", "vector_recall", "hybrid_topk", "hybrid_filtered",
    "repeated_scenes", "scene_classes", "story_health",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.fixture
def written(monkeypatch):
    """The plans of the tables that a query writes on its way; what it returns begins after the last of them."""
    plans, plain = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return plans


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, duck, written, name):
    df = entry.queries()[name](spark, SMALL)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    for plan in (text.getvalue(), *written):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
        assert name in PYTHON or "MapInArrow" not in plan and "MapInPandas" not in plan
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(got, df.columns) == rows(cursor.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, corpus):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        entry.queries()["title_filter"](spark, SMALL).explain()
    assert "ReadSchema: struct<source:string>" in text.getvalue()
