"""Contiguous shards of nearly equal bytes, by global prefix sums from per-partition totals.

The rows are cut into ordered range partitions. Each partition's bytes and rows are added up, the few totals are summed
along the partitions, and inside a partition a running sum goes on from what came before. A row's place on the line of all
bytes is then known, and the line is cut at equal targets. No step gathers the rows, and no key is needed: rows that are
equal in every ordering column are told apart by where they were read, so a third of all rows may be the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.llm import common
from foliospark.session import cut_lineage

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def byte_shards(rows: DataFrame, order: list[Column], size: Column, shards: int = SHARDS) -> DataFrame:
    """All rows with ``shard`` (from 0) and ``slot`` (from 0 without gaps in each shard, in the given order).

    ``size`` is a whole number of bytes, null as 0. The line of all bytes is cut into equal parts, and a row belongs to the
    part that its middle lies in; so a shard's bytes differ from the target by less than the largest row. A row larger than a
    part has a shard to itself and leaves others empty. Rows equal in all ordering columns are interchangeable: their places
    are those of a run, in the order of reading. Pass only columns that the order or the result needs: the rows
    are shuffled. Columns of ``rows`` named shard or slot are replaced; null is the least value of an order. An empty table
    gives an empty one. Products stay in 64 bits up to 10^17 bytes over all rows.
    """
    names = [f"o{i}" for i in range(len(order))]
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")]
    read = cut_lineage(
        rows.select(
            F.struct(*kept).alias("row"),
            F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
            *(c.alias(n) for c, n in zip(order, names, strict=True)),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    names.append("tie")
    ranged = cut_lineage(read.repartitionByRange(*names).withColumn("part", F.spark_partition_id()))
    # One row per partition: few, and their number does not follow the rows of any key.
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(line), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col("bytes_before") + F.sum("size").over(inside)
    placed = ranged.join(totals, "part").select(
        "row",
        (F.col("rows_before") + F.count("*").over(inside)).alias("place"),
        # Twice the place of the row's middle.
        (2 * ends - F.col("size")).alias("middle"),
        F.greatest("all_bytes", F.lit(1)).alias("all_bytes"),
    )
    shard = F.least(F.expr(f"(middle * {shards}) div (2 * all_bytes)"), F.lit(shards - 1)).cast("int")
    placed = cut_lineage(placed.select("row", "place", shard.alias("shard")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    # As many rows as there are shards.
    return placed.join(F.broadcast(first), "shard").select("row.*", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op11_byte_shards(spark, sf_dir: str) -> DataFrame:
    """Documents in the order of doc_id, size and checksum; a null text has no bytes and the checksum of an empty one."""
    text = F.coalesce("text", F.lit(""))
    rows = common.table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law")
    )
    placed = byte_shards(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op11_byte_shards": op11_byte_shards}
# The checksum of a text, byte by byte with the usual table of the reversed polynomial.
ORACLES = {
    "op11_byte_shards": """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), read AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
  FROM documents
), summed AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size,
         xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM read, crc
), line AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS ends, sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS place
  FROM summed
), cut AS (
  SELECT *, CAST((2 * ends - size) * 24 // (2 * total) AS INTEGER) AS shard FROM line
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
}
