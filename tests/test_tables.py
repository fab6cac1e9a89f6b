import io
import os
import subprocess
import sys
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from foliospark.operators import reports, retrieval
from foliospark.schemas import TABLES
from foliospark.session import cut_lineage, shared_folder
from foliospark.sources.tables import read_owned, read_table


def _write(spark, folder, name, rows):
    schema = TABLES[name]
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/{name}")


def test_owned_reads_and_lists(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder, "projects", [{"project_id": p, "owner_id": o, "title": p} for p, o in [("a", "u1"), ("b", "u2")]])
    _write(
        spark,
        folder,
        "chapters",
        [{"chapter_id": i, "project_id": p, "title": "Bab", "plain_text": "x", "position": n} for i, p, n in [(1, "a", 2), (2, "a", 1), (3, "b", 0)]],
    )
    mine = read_owned(spark, folder, "chapters", "u1")
    assert [r.chapter_id for r in reports.chapter_list(mine).collect()] == [2, 1]
    assert read_owned(spark, folder, "chapters", "nobody").count() == 0
    text = io.StringIO()
    with redirect_stdout(text):
        mine.select("chapter_id").where(F.col("position") > 0).explain()
    assert "ReadSchema: struct<chapter_id:bigint,project_id:string,position:bigint>" in text.getvalue()
    assert "GreaterThan(position,0)" in text.getvalue() and "LeftSemi" in text.getvalue()
    newest = read_table(spark, folder, "projects").withColumn("created_at", F.when(F.col("project_id") == "b", 2).otherwise(1))
    assert [r.project_id for r in reports.project_list(newest).collect()] == ["b", "a"]


def test_planning_views(spark):
    rows = spark.createDataFrame([(1, "p", 2, None), (2, "p", 1, None), (3, "p", 0, "x")], "id long, project_id string, position long, deleted_at string")
    assert [r.id for r in reports.planning_list(rows, ["position"]).collect()] == [2, 1]
    assert [r.id for r in reports.planning_list(rows, ["position"], archived=True).collect()] == [3]


def test_hits_get_their_text(spark, corpus):
    chunks = corpus.chunks
    hits = retrieval.attach_text(retrieval.retrieve(corpus.questions, chunks, corpus.chapters, corpus.jobs), chunks)
    assert hits.where(F.length("content") > 0).count() == hits.count() > 0


def test_written_tables_lie_in_the_named_folder(spark):
    cut = cut_lineage(spark.range(10))
    assert all(shared_folder(spark).rstrip("/") in f for f in cut.inputFiles()) and cut.count() == 10


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A plain session started elsewhere runs the Python walks."""
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", m.queries()["revision_fold"](s, "/root/testdata/sf0.001").count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "rows 1000" in done.stdout, done.stderr[-2000:]
