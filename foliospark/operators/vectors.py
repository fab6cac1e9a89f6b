"""Nearest vectors inside a project: exact, and through a stored index of sign random projections.

An extension: the requirements ask for it, no code had it. Components are kept as whole multiples of 1/1024, so that
products are exact and the cosine is the same on every engine.

The index cuts the space by random planes, several tables of them. A vector's bucket in a table says on which side of each plane
it lies. A query probes its own bucket and those that it would fall into if it crossed the planes it lies closest to,
in order of that distance. What the probed buckets hold is ranked by the exact cosine, so the index can only miss, never
misrank. How many planes a project has follows the number of its vectors; bucket, not project, is the key that
rows are joined by, so a project that holds a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators.ranking import top_rows
from foliospark.session import cut_lineage

SCALE = 1024
#: Vectors of one tile of the exact search.
TILE = 4096
#: Tables of the index, buckets probed in each, vectors that a bucket has on average, planes of a table at most.
TABLES, PROBES, PER_BUCKET, PLANES = 16, 32, 1, 16
#: Planes that a probe may cross; their combinations are weighed against each other.
CROSSED = 10
SEED = 20240101

MATCH = "query_id long, vec_id long, score double"


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, project_id, vector (whole numbers), length_sq; rows with a null key, a null or non-finite component or no length are left out."""
    plain = F.col("embedding").cast("array<double>")
    odd = F.exists(plain, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(plain, lambda x: F.floor(x * SCALE))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("project_id").isNotNull() & plain.isNotNull() & ~odd)
    rows = rows.select("vec_id", "project_id", whole.alias("vector"))
    return rows.withColumn("length_sq", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)).where("length_sq > 0")


def cosine(product: Column, length_sq: Column, other_sq: Column) -> Column:
    return product / (F.sqrt(length_sq) * F.sqrt(other_sq))


def _best_of_tile(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and vectors.num_rows:
            q, c = (np.stack(t.column(x).to_pandas().to_numpy()).astype(np.float64) for t, x in ((queries, "asked"), (vectors, "vector")))
            sizes = [np.sqrt(t.column(x).to_numpy().astype(np.float64)) for t, x in ((queries, "asked_sq"), (vectors, "length_sq"))]
            asked, ids = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
            for at in range(0, len(q), 256):
                # Sums of whole numbers below 2^53 are exact in doubles.
                score = (q[at : at + 256] @ c.T) / (sizes[0][at : at + 256, None] * sizes[1][None, :])
                score[asked[at : at + 256, None] == ids[None, :]] = -np.inf
                least = np.partition(score, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
                row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                for name, values in zip(out, (asked[at + row], ids[column], score[row, column]), strict=True):
                    out[name].append(values)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kind) for (n, v), kind in zip(out.items(), kinds, strict=True)})

    return run


def _ranked(matches: DataFrame, k: int) -> DataFrame:
    best = top_rows(matches, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return best.select("query_id", "rank", "vec_id", "score")


def exact_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of each query's project with the largest cosine, itself left out.

    ``queries`` (query_id, project_id, vector, length_sq) and ``vectors`` come from ``usable_vectors``; all vectors have one
    length. A project is cut in tiles of about ``tile`` vectors, each query meets each tile of its project once, and a tile
    hands on k rows per query. Ties go to the smaller vec_id.
    """
    tiles = vectors.groupBy("project_id").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tile_of = F.pmod(F.xxhash64("vec_id"), F.col("tiles")).alias("tile")
    right = vectors.join(tiles, "project_id").select("project_id", tile_of, "vec_id", "vector", "length_sq")
    # Under names of their own: both sides may come from one table.
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("asked_tile")
    left = queries.join(tiles, "project_id").select(F.col("project_id").alias("asked_project"), each, "query_id", F.col("vector").alias("asked"), F.col("length_sq").alias("asked_sq"))
    met = left.groupBy("asked_project", "asked_tile").cogroup(right.groupBy("project_id", "tile"))
    return _ranked(met.applyInArrow(_best_of_tile(k), MATCH), k)


def _planes(table: int, dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, table]).normal(size=(dims, PLANES))


def _sides(batch: pd.DataFrame, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the planes of a table, those beyond a row's number of planes as endless, and the bucket."""
    vectors = np.stack(batch["vector"].to_numpy()).astype(np.float64)
    distance = vectors @ _planes(table, vectors.shape[1])
    used = np.arange(PLANES)[None, :] < batch["planes"].to_numpy()[:, None]
    bucket = ((distance > 0) & used) @ (1 << np.arange(PLANES))
    return np.where(used, np.abs(distance), np.inf), bucket


def _to_buckets(tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for table in range(tables if len(batch) else 0):
                _, bucket = _sides(batch, table)
                yield pd.DataFrame({"project_id": batch["project_id"], "table": table, "bucket": bucket, "vec_id": batch["vec_id"]})

    return run


def _to_probes(tables: int, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crossed = (np.arange(1 << CROSSED)[:, None] >> np.arange(CROSSED)) & 1
        for batch in batches:
            for table in range(tables if len(batch) else 0):
                distance, bucket = _sides(batch, table)
                near = np.argsort(distance, axis=1, kind="stable")[:, :CROSSED]
                close = np.take_along_axis(distance, near, axis=1)
                endless = np.isinf(close)
                cost = np.where(endless, 0, close) ** 2 @ crossed.T
                cost[(endless.astype(np.int64) @ crossed.T) > 0] = np.inf
                order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                flips = (crossed[order] << near[:, None, :]).sum(axis=2)
                row, which = np.nonzero(np.isfinite(np.take_along_axis(cost, order, axis=1)))
                probed = bucket[row] ^ flips[row, which]
                yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[row], "project_id": batch["project_id"].to_numpy()[row], "table": table, "bucket": probed})

    return run


def _planes_of(vectors: DataFrame, per_bucket: int) -> DataFrame:
    size = F.floor(F.log2(F.greatest(F.lit(1.0), F.count("*") / per_bucket)))
    return vectors.groupBy("project_id").agg(F.least(F.lit(PLANES), size).cast("int").alias("planes"))


def write_vector_index(vectors: DataFrame, path: str, tables: int = TABLES, per_bucket: int = PER_BUCKET) -> None:
    """The bucket of every vector in every table, ordered by project, table and bucket, and how many planes a project has.

    All vectors are indexed; the planes are random, so nothing is fitted to a sample.
    """
    _planes_of(vectors, per_bucket).write.mode("overwrite").parquet(f"{path}/planes")
    planes = vectors.sparkSession.read.parquet(f"{path}/planes")
    rows = vectors.join(planes, "project_id").select("project_id", "vec_id", "vector", "planes")
    order = ["project_id", "table", "bucket", "vec_id"]
    buckets = rows.mapInPandas(_to_buckets(tables), "project_id string, table int, bucket long, vec_id long")
    buckets.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/buckets")


def probe_index(queries: DataFrame, path: str, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id and vec_id of everything in the buckets that a query probes, each once."""
    spark = queries.sparkSession
    rows = queries.join(spark.read.parquet(f"{path}/planes"), "project_id").select("query_id", "project_id", "vector", "planes")
    probed = rows.mapInPandas(_to_probes(tables, probes), "query_id long, project_id string, table int, bucket long")
    found = probed.join(spark.read.parquet(f"{path}/buckets"), ["project_id", "table", "bucket"])
    return found.select("query_id", "vec_id").distinct().where("query_id <> vec_id")


def indexed_neighbours(queries: DataFrame, vectors: DataFrame, path: str, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """As ``exact_neighbours`` among the candidates that the index finds."""
    candidates = cut_lineage(probe_index(queries, path, tables, probes))
    asked = queries.select("query_id", F.col("vector").alias("asked"), F.col("length_sq").alias("asked_sq"))
    pairs = candidates.join(asked, "query_id").join(vectors.select("vec_id", "vector", "length_sq"), "vec_id")
    product = F.aggregate(F.zip_with("asked", "vector", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return _ranked(pairs.select("query_id", "vec_id", cosine(product, F.col("asked_sq"), F.col("length_sq")).alias("score")), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many of the exact neighbours there are and how many of them were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(hit, ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
