"""Exact top-k search by inner product: products of query and candidate tiles, partial selection, merging in a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foliospark.llm import common

#: Rows of a tile; a task holds one tile of queries and one of candidates.
TILE = 8192
#: Queries multiplied at once inside a task.
STEP = 256
#: Lists merged in one step of the tree.
FAN_IN = 64
SCALE = 1024
LIST = "query_id long, query long, tile int, vec_id long, score long"
EXACT = 2.0**53


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Floored multiples of the components, shorter rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while no sum can reach 2^53, else in Python's integers, held to 64 bits."""
    largest = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(queries.shape[1], 1)
    if largest < EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries).dot(whole(candidates).T)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _select(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {x: [] for x in ("query_id", "query", "tile", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            lists = [x.combine_chunks() for x in (left.column("embedding"), right.column("vector"))]
            width = max((x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for x in lists))
            q, c = (_matrix(x, int(width)) for x in lists)
            query_id, query = (left.column(x).to_numpy() for x in ("query_id", "query"))
            name, copies = (right.column(x).to_numpy() for x in ("name", "copies"))
            unnamed = right.column("vec_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            ids = right.column("vec_id").combine_chunks().fill_null(0).to_numpy()
            tile = right.column("tile")[0].as_py()
            for at in range(0, len(q), STEP):
                score = _products(q[at : at + STEP], c)
                # A query is no candidate of its own; further rows equal to it are.
                own = (query[at : at + STEP, None] == name[None, :]) & (copies[None, :] == 1)
                score[own] = np.iinfo(np.int64).min
                if len(ids) > k:
                    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    row, col = np.nonzero(score >= least[:, None])
                else:
                    row, col = np.nonzero(score > np.iinfo(np.int64).min)
                found = score[row, col]
                row, col, found = (x[found > np.iinfo(np.int64).min] for x in (row, col, found))
                order = np.lexsort((ids[col], unnamed[col], -found, row))
                row, col, found = row[order], col[order], found[order]
                # A row that the table holds several times stands in the list as often, up to k times.
                times = np.minimum(copies[col] - (query[at + row] == name[col]), k)
                before = np.cumsum(times) - times
                before -= np.repeat(before[np.searchsorted(row, np.unique(row))], np.unique(row, return_counts=True)[1])
                times = np.clip(k - before, 0, times)
                row, col, found = (np.repeat(x, times) for x in (row, col, found))
                listed = pa.array(ids[col], pa.int64(), mask=unnamed[col])
                for kind, x in zip(out, (query_id[at + row], query[at + row], np.full(len(row), tile, np.int32), listed, found), strict=True):
                    out[kind].append(pa.array(x))
        kinds = {"query_id": pa.int64(), "query": pa.int64(), "tile": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}
        return pa.table({n: pa.chunked_array(v, kinds[n]) for n, v in out.items()})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, tile: int = TILE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query among all ``vectors``.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on its rows. Components are floored multiples of
    1/1024, the score is the inner product of integers, ties go to the smaller vec_id; fewer candidates give fewer
    rows. Rows whose vector is null or holds a null or non-finite component take no part. A row is no candidate of its own;
    rows without a vec_id are candidates, behind all others of a score, and ask nothing. Repeated rows are one query and as
    many candidates as there are rows, less the one that asks; rows that share a vec_id but not the vector are
    separate queries and candidates of each other. Shorter vectors count as filled up with zeros. Scores
    beyond 64 bits are held to the largest number. An empty table gives an empty one.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vector = F.col("embedding").cast("array<double>")
    sound = vectors.filter(F.col("embedding").isNotNull() & ~F.exists(vector, odd))
    rows = common.stored(
        sound.select("vec_id", vector.alias("embedding"), F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks")).groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks"), F.count("*").alias("copies"))
    )
    name = F.xxhash64("vec_id", "embedding")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    tiles, blocks = -(-max(n, 1) // tile), -(-max(asked, 1) // tile)
    queries = rows.filter("asks").select(
        F.col("vec_id").alias("query_id"),
        name.alias("query"),
        "embedding",
        F.pmod(name, F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"),
    )
    candidates = rows.select(
        "vec_id",
        name.alias("name"),
        # Under a name of its own: both sides read one table, and Spark would drop a column that they share.
        F.col("embedding").alias("vector"),
        "copies",
        F.pmod(name, F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    lists = queries.groupBy("block", "tile").cogroup(candidates.groupBy("block", "tile")).applyInArrow(_select(k), LIST)
    best = [F.desc("score"), F.asc_nulls_last("vec_id")]
    while tiles > FAN_IN:
        lists = lists.withColumn("tile", F.floor(F.col("tile") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query", "tile").orderBy(*best))).filter(F.col("rank") <= k).drop("rank")
        tiles = -(-tiles // FAN_IN)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(*best)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op10_topk_search": op10_topk_search}
ORACLES = {
    "op10_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 10
"""
}
