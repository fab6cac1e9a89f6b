"""Reading and writing the tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foliospark.operators.access import scoped
from foliospark.operators.chunking import append_chunks
from foliospark.operators.retrieval import INDEX_KEYS, build_index, with_chunk_key
from foliospark.schemas import TABLES

# Chunks that one bucket of the token index stands for, buckets at most, and chunks whose words one task writes.
CHUNKS_PER_BUCKET = 100_000
MOST_BUCKETS = 256
CHUNKS_PER_TASK = 20_000

# Folders of the chunk table, by chapter.
CHAPTER_BUCKETS = 64


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its declared schema, so nothing is inferred and filters reach the scan."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}").select(*TABLES[name].names)


def read_owned(spark: SparkSession, folder: str, name: str, owner_id: str) -> DataFrame:
    return scoped(read_table(spark, folder, name), read_table(spark, folder, "projects"), owner_id)


def write_new_chunks(fresh: DataFrame, folder: str, chapters: DataFrame | None = None) -> None:
    """Append only chunks the table does not hold; repeating the call adds nothing.

    The table lies in folders by chapter. Only the keys in the folders of the fresh chapters are read; their numbers, at
    most as many as there are folders, are gathered for that. They are taken from ``chapters``, the rows that the chunks
    were made from, where it is given, so that no text is chunked for them.
    """
    spark = fresh.sparkSession
    path = f"{folder}/story_chunks"
    placed = fresh.withColumn("chapter_bucket", _chapter_bucket())
    touched = placed if chapters is None else chapters.select("chapter_id").withColumn("chapter_bucket", _chapter_bucket())
    append_chunks(stored_chunks(spark, path, touched), placed).write.mode("append").partitionBy("chapter_bucket").parquet(path)


def _chapter_bucket() -> Column:
    return F.pmod(F.xxhash64("chapter_id"), F.lit(CHAPTER_BUCKETS)).cast("int")


def stored_chunks(spark: SparkSession, path: str, fresh: DataFrame) -> DataFrame:
    """The stored chunks in the folders that ``fresh`` (with chapter_bucket) touches; none if there is no table yet."""
    try:
        stored = spark.read.schema(T.StructType([*TABLES["story_chunks"].fields, T.StructField("chapter_bucket", T.IntegerType())])).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES["story_chunks"])
    touched = [r[0] for r in fresh.select("chapter_bucket").distinct().collect()]
    return stored.where(F.col("chapter_bucket").isin(touched))


def write_index(chunks: DataFrame, path: str, chunks_per_bucket: int = CHUNKS_PER_BUCKET) -> None:
    """The token index with chapter and number of each chunk, in buckets by a hash of (project, token).

    The number is eight bytes for the chunk_id, which would be most of a row; other keys come from the chunk table when asked for.

    The number of buckets follows the number of chunks up to 256 folders and is stored beside the rows. A bucket is dealt by chunk
    over as many tasks as its share of all, so a frequent word is spread evenly and the words are cut once, with no sample
    of them before. In a file the rows of a word follow one another; they are brought together by a number of the
    word, which is much cheaper than by name, and a task has one bucket.
    """
    spark = chunks.sparkSession
    count = chunks.count()
    buckets = min(MOST_BUCKETS, max(1, -(-count // chunks_per_bucket)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets, count // CHUNKS_PER_TASK)
    parts = -(-tasks // buckets)
    place = F.col("token_bucket") * parts + F.pmod(F.xxhash64(*INDEX_KEYS), F.lit(parts)).cast("int")
    (
        build_index(with_chunk_key(chunks), *INDEX_KEYS)
        .drop("chunk_id")
        .withColumn("token_bucket", _bucket(F.lit(buckets)))
        .repartitionById(buckets * parts, place)
        .sortWithinPartitions(F.xxhash64("project_id", "token"))
        .write.mode("overwrite")
        .partitionBy("token_bucket")
        .parquet(f"{path}/postings")
    )
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("project_id", "token"), buckets).cast("int")


def read_index(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """Index rows in the buckets of the given query words; the others are not even listed as input.

    The numbers of the buckets are gathered, never the words; there are at most as many as the index has partitions.
    """
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    wanted = [r[0] for r in terms.select(_bucket(F.lit(buckets)).alias("bucket")).distinct().collect()]
    return spark.read.parquet(f"{path}/postings").where(F.col("token_bucket").isin(wanted)).drop("token_bucket")


def write_manuscripts(parts: DataFrame, path: str) -> None:
    """Export as text files per project. Files in name order, and lines within them, follow the reading order.

    Every piece ends with the line end the writer adds, so one line end is taken off the seam before it.
    """
    order = ["project_id", "part", "position", "chapter_id"]
    joined = F.when(F.col("part") == 1, F.substring("piece", 2, 2**31 - 1)).otherwise(F.regexp_replace("piece", "\n$", ""))
    (
        parts.withColumn("value", joined)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("project_id", "value")
        .write.mode("overwrite")
        .partitionBy("project_id")
        .text(path)
    )
