"""Ranks and running values that no single task has to compute for a whole key.

A key may hold a third of all rows, so a plain window over it would be one huge task. Two ways out:

* ``top_rows`` keeps the first n of each key; Spark cuts to n rows before the shuffle.
* The others first cut the ordered rows into segments: range partitions of (key, order), written as a table. A
  small key lies in one segment, a big one in as many as its rows need, however its rows are spread over time.
  Then come a window inside each (key, segment), one summary row per segment, a window over the few summaries
  of a key, and a join that adds what came before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.session import cut_lineage

# Up to this many rows per key and map task, one merge of all map outputs of a key stays small.
ONE_MERGE = 50
MERGES = 512


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; ``order`` must be total.

    Every map task passes on n rows per key at most. For a larger n those are merged in two steps, first
    the tasks of one group, then the groups, so that even a key present in all tasks stays bounded.
    """
    if n > ONE_MERGE:
        group = Window.partitionBy(*keys, "_group").orderBy(*order)
        df = (
            df.withColumn("_group", F.spark_partition_id() % MERGES)
            .withColumn("_place", F.row_number().over(group))
            .where(F.col("_place") <= n)
            .drop("_group", "_place")
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("long"))


SEGMENT = "_segment"


def segmented(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add ``_segment``: it rises with ``order`` inside each key, and no segment is larger than its share of all rows."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(SEGMENT, F.spark_partition_id().cast("long")))


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a walk as one Arrow batch."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _inside(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order)


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(keys: list[str], order: list[Column]):
    return _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _carried(parted: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with what came before its segment; null is a key like any other."""
    names = [*keys, SEGMENT]
    other = before.select(*(F.col(k).alias(f"_at{i}") for i, k in enumerate(names)), *(c for c in before.columns if c not in names))
    same = [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(names)]
    return parted.join(other, same).drop(*(f"_at{i}" for i in range(len(names))))


def full_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Row number of every row in its key."""
    parted = segmented(df, keys, order)
    offsets = (
        parted.groupBy(*keys, SEGMENT)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)))
        .drop("_n")
    )
    return (
        parted.withColumn("_local", F.row_number().over(_inside(keys, order)))
        .transform(_carried, offsets, keys)
        .withColumn(rank, (F.col("_before") + F.col("_local")).cast("long"))
        .drop(SEGMENT, "_local", "_before")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one, in order."""
    parted = segmented(df, keys, order)
    offsets = (
        parted.groupBy(*keys, SEGMENT)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(_earlier(keys)), F.lit(0)))
        .drop("_sum")
    )
    return (
        parted.withColumn("_local", F.sum(value).over(_so_far(keys, order)))
        .transform(_carried, offsets, keys)
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop(SEGMENT, "_local", "_before")
    )


def last_seen(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """The latest non-null ``value`` up to and including this row. ``value`` must rise with the order."""
    parted = segmented(df, keys, order)
    carried = (
        parted.groupBy(*keys, SEGMENT)
        .agg(F.max(value).alias("_max"))
        .withColumn("_before", F.max("_max").over(_earlier(keys)))
        .drop("_max")
    )
    return (
        parted.withColumn("_local", F.max(value).over(_so_far(keys, order)))
        .transform(_carried, carried, keys)
        .withColumn(out, F.coalesce("_local", "_before"))
        .drop(SEGMENT, "_local", "_before")
    )


def runs(df: DataFrame, keys: list[str], at: str, tie: str, gap: int, out: str) -> DataFrame:
    """Add the start of the run each row is in; a run ends where the next row is more than ``gap`` later."""
    order = [F.col(at), F.col(tie)]
    parted = segmented(df, keys, order)
    local = parted.withColumn("_prev", F.lag(at).over(_inside(keys, order))).withColumn(
        "_start", F.when(F.col(at) - F.col("_prev") > gap, F.col(at))
    )
    along = Window.partitionBy(*keys).orderBy(SEGMENT)
    carried = (
        local.groupBy(*keys, SEGMENT)
        .agg(F.min(at).alias("_min"), F.max(at).alias("_max"), F.max("_start").alias("_own"))
        .withColumn("_opens", F.coalesce(F.col("_min") - F.lag("_max").over(along) > gap, F.lit(True)))
        .withColumn("_latest", F.coalesce("_own", F.when(F.col("_opens"), F.col("_min"))))
        .withColumn("_carry", F.when(F.col("_opens"), F.col("_min")).otherwise(F.max("_latest").over(_earlier(keys))))
        .select(*keys, SEGMENT, "_carry")
    )
    return (
        local.withColumn("_local", F.max("_start").over(_so_far(keys, order)))
        .transform(_carried, carried, keys)
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop(SEGMENT, "_prev", "_start", "_local", "_carry")
    )
