"""Chapters for a question by several rankings at once, with filters that every ranking applies before it ranks.

An extension: the requirements sketch it as a sum of similarity, importance, recency and relevance of the entities asked about,
without weights; so weights are parameters here. Every ranking is scaled to 0..1000 within its query, as their units differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators.ranking import top_rows
from foliospark.operators.vectors import exact_neighbours

#: Rows of a ranking that take part in the sum, and the largest share of one ranking.
DEPTH, FULL = 100, 1000


@dataclass(frozen=True)
class StoryFilter:
    """What a chapter must be like to be found; None asks nothing.

    ``up_to_position``: the last chapter that may be known. ``location``: a place that the chapter is set in.
    ``fact_status``: at least one fact of that status is taken from it. ``character_id``: the character is mentioned in it.
    """

    up_to_position: int | None = None
    location: str | None = None
    fact_status: str | None = None
    character_id: int | None = None

    def chapters(self, chapters: DataFrame, places: DataFrame, facts: DataFrame, mentions: DataFrame) -> DataFrame:
        """Keys of the chapters that pass; every condition is a plain comparison, so that it reaches the scan of its table."""
        out = chapters.select("chapter_id", "project_id", "position")
        if self.up_to_position is not None:
            out = out.where(F.col("position") <= self.up_to_position)
        for value, table, column in ((self.location, places, "location"), (self.fact_status, facts, "status"), (self.character_id, mentions, "character_id")):
            if value is not None:
                out = out.join(table.where(F.col(column) == value).select("chapter_id"), "chapter_id", "left_semi")
        return out


def scaled(ranking: DataFrame) -> DataFrame:
    """query_id, item_id and points 0..1000: the value's place between the least and the greatest of its query; all 1000 if these agree."""
    ends = ranking.groupBy("query_id").agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
    share = F.when(F.col("greatest") == F.col("least"), FULL).otherwise(F.expr(f"({FULL} * (value - least)) div (greatest - least)"))
    return ranking.join(ends, "query_id").select("query_id", "item_id", share.cast("long").alias("points"))


def fused(rankings: dict[str, tuple[DataFrame, int]], k: int = 10, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, item_id, score and one column of points per ranking, for the k items with the most weighted points.

    A ranking has query_id, item_id and a whole ``value`` (greater is better); its first ``depth`` rows per query take part, ties
    going to the smaller item. An item that a ranking does not hold has no points from it. Rows are added up in one
    grouping, not by outer joins. Ties of the sum go to the smaller item.
    """
    parts = []
    for name, (ranking, weight) in rankings.items():
        whole = ranking.where(F.col("query_id").isNotNull() & F.col("item_id").isNotNull() & F.col("value").isNotNull())
        first = top_rows(whole.select("query_id", "item_id", F.col("value").cast("long").alias("value")), ["query_id"], [F.desc("value"), F.asc("item_id")], depth)
        points = scaled(first)
        own = [F.when(F.lit(other == name), F.col("points")).otherwise(F.lit(0)).cast("long").alias(other) for other in rankings]
        parts.append(points.select("query_id", "item_id", *own, (F.col("points") * weight).alias("score")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    summed = every.groupBy("query_id", "item_id").agg(F.sum("score").alias("score"), *(F.sum(name).alias(name) for name in rankings))
    return top_rows(summed, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def hybrid_search(
    requests: DataFrame,
    vectors: DataFrame,
    chapters: DataFrame,
    facts: DataFrame,
    mentions: DataFrame,
    places: DataFrame,
    wanted: StoryFilter,
    weights: tuple[int, int, int, int] = (4, 2, 1, 3),
    k: int = 10,
) -> DataFrame:
    """query_id, rank, chapter_id, score, semantic, importance, recency, entities for each request.

    ``requests`` has query_id, project_id, vector, length_sq and character_id (may be null); ``vectors`` has vec_id, the chapter it
    is of, and the same columns. Semantic: cosine of the vectors. Importance: facts of the filter's status (approved, if
    none is given) taken from the chapter. Recency: the chapter's position. Entities: how often the character asked about is
    mentioned. A project's chapters pass the filter once, before any ranking; each ranking joins only those.
    """
    pool = wanted.chapters(chapters, places, facts, mentions)
    keys = pool.select(F.col("chapter_id").alias("vec_id"), "project_id")
    near = exact_neighbours(requests, vectors.join(keys, ["vec_id", "project_id"], "left_semi"), DEPTH)
    semantic = near.select("query_id", F.col("vec_id").alias("item_id"), F.floor(F.col("score") * 1_000_000).alias("value"))
    asked = requests.select("query_id", "project_id", "character_id")
    status = wanted.fact_status or "approved"
    counted = facts.where(F.col("status") == status).join(pool.select("chapter_id"), "chapter_id", "left_semi").groupBy("project_id", "chapter_id").agg(F.count("*").alias("value"))

    def best(rows: DataFrame, on: list[str]) -> DataFrame:
        """The first rows per project, before requests multiply them."""
        cut = top_rows(rows, on, [F.desc("value"), F.asc("chapter_id")], DEPTH + 1, "_place")
        met = asked.join(cut, on).where(F.col("query_id") != F.col("chapter_id"))
        return met.select("query_id", F.col("chapter_id").alias("item_id"), "value")

    importance = best(counted, ["project_id"])
    recency = best(pool.select("project_id", "chapter_id", F.col("position").alias("value")), ["project_id"])
    named = mentions.join(pool.select("chapter_id"), "chapter_id", "left_semi").select("project_id", "character_id", "chapter_id", F.col("times").alias("value"))
    entities = best(named, ["project_id", "character_id"])
    names = ("semantic", "importance", "recency", "entities")
    rankings = dict(zip(names, zip((semantic, importance, recency, entities), weights, strict=True), strict=True))
    return fused(rankings, k).select("query_id", "rank", F.col("item_id").alias("chapter_id"), "score", *names)


