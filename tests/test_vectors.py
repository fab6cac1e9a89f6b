"""Nearest vectors: the exact search against all products, the index against the exact search."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import vectors as V

ROWS = "vec_id long, project_id string, embedding array<double>"


def rows_of(spark, data):
    return V.usable_vectors(spark.createDataFrame([(i, p, None if x is None else [None if y is None else float(y) for y in x]) for i, p, x in data], ROWS))


def nearest(data, ids, k):
    whole = {i: (p, np.floor(np.array(x, float) * 1024).astype(int)) for i, p, x in data}
    out = []
    for q in ids:
        project, v = whole[q]
        scored = [(-float(v @ w) / (np.sqrt(float(v @ v)) * np.sqrt(float(w @ w))), i) for i, (p, w) in whole.items() if p == project and i != q]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def clustered(rng, n, dims=16):
    """A third of all in one project; each vector has a few near copies."""
    centres = rng.normal(size=(n // 6, dims))
    return [(i, "a" if i % 3 == 0 else f"p{i % 5}", centres[rng.integers(len(centres))] + rng.normal(size=dims) * 0.2) for i in range(n)]


@pytest.mark.parametrize("tile", [4096, 37])
def test_exact_search(spark, tile):
    data = clustered(np.random.default_rng(1), 400)
    data += [(1000 + i, "tied", [1.0] * 16) for i in range(15)] + [(2000, "alone", [1.0] * 16)]
    found = rows_of(spark, data)
    asked = found.where("vec_id % 7 = 0 or vec_id = 2000").withColumnRenamed("vec_id", "query_id")
    ids = [i for i, _, _ in data if i % 7 == 0 or i == 2000]
    got = sorted(tuple(r) for r in V.exact_neighbours(asked, found, 5, tile).collect())
    assert got == nearest(data, ids, 5)


def test_bad_vectors_take_no_part(spark):
    nan = float("nan")
    data = [(1, "p", [1, 2]), (2, "p", [1, None]), (3, "p", [nan, 1]), (4, "p", [float("inf"), 1]), (5, "p", None), (6, None, [1, 1]), (None, "p", [1, 1]), (7, "p", [0, 0]), (8, "p", [2, 1])]
    assert sorted(r.vec_id for r in rows_of(spark, data).collect()) == [1, 8]
    none = rows_of(spark, [])
    assert V.exact_neighbours(none.withColumnRenamed("vec_id", "query_id"), none).count() == 0


def test_index_finds_near_vectors(spark, tmp_path):
    data = clustered(np.random.default_rng(2), 3000)
    found = rows_of(spark, data)
    V.write_vector_index(found, str(tmp_path))
    asked = found.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    probed = V.probe_index(asked, str(tmp_path), probes=8)
    met = asked.select("query_id", "project_id").join(found.select("project_id", F.col("vec_id")), "project_id").count()
    # Structured vectors are found though most rows are never looked at.
    assert probed.count() < 0.5 * met
    exact = V.exact_neighbours(asked, found, 5)
    score = V.recall(exact, V.indexed_neighbours(asked, found, str(tmp_path), 5, probes=8)).first()
    assert score.found >= 0.95 * score.neighbours > 0
    # All rows are in every table.
    assert spark.read.parquet(f"{tmp_path}/buckets").count() == V.TABLES * len(data)


def test_index_recall_on_the_given_vectors(spark, corpus):
    from foliospark.plans.extensions import QUERIES

    row = QUERIES["vector_recall"](spark, corpus.folder).first()
    assert row.recall_milli >= 900


def test_products_are_not_made_of_all_pairs(spark, tmp_path):
    found = rows_of(spark, clustered(np.random.default_rng(3), 60))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        V.exact_neighbours(found.withColumnRenamed("vec_id", "query_id"), found).explain()
    assert "CartesianProduct" not in text.getvalue() and "BroadcastNestedLoopJoin" not in text.getvalue()
