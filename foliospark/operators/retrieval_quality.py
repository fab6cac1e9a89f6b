"""How well retrieval finds passages that are known to be there.

An extension: the requirements ask for a measured evaluation, no code had it. The truth is not judged by hand: a passage of the
benchmark that stands word for word in a chunk makes that chunk relevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.functions.text import WORD_BREAK, let
from foliospark.operators.mentions import words_in_order
from foliospark.operators.ranking import top_rows
from foliospark.session import cut_lineage

#: Words that a chunk must share in a row with a passage, resamples of the interval, and its share in percent.
RUN, RESAMPLES, COVERED = 13, 200, 95
MILLION = 1_000_000


def _grams(rows: DataFrame, text: str, keys: list[str], place: str, run: int) -> DataFrame:
    """keys, place and a hash of every row of ``run`` words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (run - 1))
        grams = F.transform(starts, lambda i: F.md5(F.array_join(F.slice(w, i, run), " ").cast("binary")))
        return F.when(F.size(w) >= run, grams).otherwise(F.array().cast("array<string>"))

    # The words of a text are cut once, in one expression.
    return rows.select(*keys, F.posexplode(let(words_in_order(F.col(text)), cut)).alias(place, "gram"))


def _windows(text: Column, words: int, step: int) -> Column:
    """Hashes of ``words`` words in a row, from every ``step``-th word on; a shorter text gives one."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + n) for n in range(words))))

    return let(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), ""), cut)


def _near(chunks: DataFrame, passages: DataFrame, run: int) -> DataFrame:
    """The chunks that may share ``run`` words in a row with a passage; none that does is lost.

    Whatever stands in a row for ``run`` words holds one of the windows of half as many that follow one another in the
    chunk. Those are looked for among all of the passages, so few words of a chunk are hashed and none is moved.
    """
    half = (run + 1) // 2
    # Written, so that Spark knows how few they are.
    asked = cut_lineage(passages.select(F.explode(_windows(F.col("text"), half, 1)).alias("window")).distinct())
    cut = chunks.select(F.xxhash64("content").alias("_text"), F.explode(_windows(F.col("content"), half, half)).alias("window"))
    held = cut_lineage(cut.join(asked, "window", "left_semi").select("_text").distinct())
    return chunks.withColumn("_text", F.xxhash64("content")).join(held, "_text", "left_semi").drop("_text")


def planted_passages(passages: DataFrame, chunks: DataFrame, run: int = RUN) -> DataFrame:
    """item_id, project_id, chunk_id, words: the chunks that hold ``run`` words of a passage in a row, and the longest such row.

    Every row of ``run`` words is one gram on both sides; grams that meet on one diagonal (place in the chunk less place in
    the passage) one after the other belong to one longer row. Case and what stands between words do not matter. Grams of
    the chunks meet those of the passages on their hash, of which frequent ones are spread by Spark as any skewed key;
    chunks that can have none in common are left out before.
    """
    asked = _grams(passages, "text", ["item_id"], "item_place", run).distinct()
    found = _grams(_near(chunks, passages, run), "content", ["project_id", "chunk_id"], "place", run).join(asked, "gram")
    found = found.select("item_id", "project_id", "chunk_id", (F.col("place") - F.col("item_place")).alias("diagonal"), "place")
    # Islands: along a diagonal, place less row number stays the same while places follow one another.
    along = Window.partitionBy("item_id", "project_id", "chunk_id", "diagonal").orderBy("place")
    island = found.withColumn("island", F.col("place") - F.row_number().over(along))
    longest = island.groupBy("item_id", "project_id", "chunk_id", "diagonal", "island").agg(F.count("*").alias("n"))
    return longest.groupBy("item_id", "project_id", "chunk_id").agg((F.max("n") + (run - 1)).alias("words"))


def query_scores(truth: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """query_id, relevant, found, recall, reciprocal, gain: scores of each query that has a relevant chunk, in millionths.

    ``truth`` has query_id, chunk_id and words, the gain of a chunk; ``hits`` query_id, rank and chunk_id. Recall is of the first k
    relevant chunks; reciprocal is one over the rank of the first hit; gain is the discounted gain of the list over that of the
    best list. A query without hits scores zero.
    """
    discount = 1 / F.log2(F.col("place") + 1)
    ideal = top_rows(truth, ["query_id"], [F.desc("words"), F.asc("chunk_id")], k, "place")
    ideal = ideal.groupBy("query_id").agg(F.sum(_fixed(F.col("words") * discount)).alias("ideal"))
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    seen = hits.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("place"))
    good = truth.join(seen, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.count("*").alias("found"), F.min("place").alias("first"), F.sum(_fixed(F.col("words") * discount)).alias("gained")
    )
    both = sizes.join(ideal, "query_id").join(good, "query_id", "left").na.fill(0, ["found", "gained"])
    return both.select(
        "query_id",
        "relevant",
        "found",
        F.expr(f"({MILLION} * found) div least(relevant, {k})").alias("recall"),
        F.coalesce(F.expr(f"{MILLION} div first"), F.lit(0).cast("long")).alias("reciprocal"),
        F.expr(f"({MILLION} * gained) div ideal").alias("gain"),
    )


def _fixed(value: Column) -> Column:
    """Whole millionths, so that sums are the same in any order."""
    return F.floor(value * MILLION + 0.5).cast("long")


# Chances in 2^32 that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923275)


def resampled_weight(query_id: Column, resample: Column) -> Column:
    """How often a query is drawn in a resample: Poisson with mean 1, from a hash, so that reruns and engines agree."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", query_id.cast("string"), resample.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return sum((h >= bound).cast("long") for bound in POISSON)


def summary(scores: DataFrame, metrics: tuple[str, ...] = ("recall", "reciprocal", "gain"), resamples: int = RESAMPLES) -> DataFrame:
    """metric, queries, mean, low, high in millionths: the mean over all queries and a bootstrap interval.

    Every query meets every resample (a fixed number) where it is read and is drawn by its own hash, so resamples are sums that
    combine on the map side, and no list of queries is gathered. The interval leaves out the same share of resamples at
    both ends; a resample that draws nothing is left out. No queries give no rows.
    """
    each = scores.select("query_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")).select("query_id", "x.*")
    means = each.groupBy("metric").agg(F.count("*").alias("queries"), F.expr("sum(value) div count(*)").alias("mean"))
    drawn = each.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    weight = resampled_weight(F.col("query_id"), F.col("resample"))
    sums = drawn.withColumn("weight", weight).groupBy("metric", "resample").agg(F.sum(F.col("weight") * F.col("value")).alias("total"), F.sum("weight").alias("n"))
    ranked = sums.where("n > 0").withColumn("mean", F.expr("total div n"))
    # As many rows per metric as there are resamples.
    place = F.row_number().over(Window.partitionBy("metric").orderBy("mean", "resample"))
    ranked = ranked.withColumn("place", place).withColumn("of", F.count("*").over(Window.partitionBy("metric")))
    cut = F.expr(f"(of * {100 - COVERED}) div 200")
    ends = ranked.groupBy("metric").agg(F.min(F.when(F.col("place") > cut, F.col("mean"))).alias("low"), F.max(F.when(F.col("place") <= F.col("of") - cut, F.col("mean"))).alias("high"))
    return means.join(ends, "metric").select("metric", "queries", "mean", "low", "high")
