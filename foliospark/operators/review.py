"""Review of extracted facts: approve, ignore or edit, each on the revision the reviewer saw."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.operators.chunking import with_currency
from foliospark.operators.revisions import fold_revisions


def review_outcomes(reviews: DataFrame, facts: DataFrame, chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Outcome of each review: NOT_FOUND, STALE_SOURCE, REVISION_CONFLICT or applied.

    ``reviews``: event_id, fact_id, at_us, base_revision, status, claim. Approval needs a current source.
    """
    sources = with_currency(chunks, chapters).select("chunk_id", "current")
    known = facts.select("fact_id", "chunk_id", F.col("revision").alias("initial")).join(sources, "chunk_id")
    judged = (
        reviews.select("event_id", "fact_id", "at_us", "base_revision", "status")
        .join(known.drop("chunk_id"), "fact_id", "left")
        .withColumn("stale", F.coalesce((F.col("status") == "approved") & ~F.col("current"), F.lit(False)))
        .withColumn("usable", ~F.col("stale"))
    )
    outcome = (
        F.when(F.col("initial").isNull(), "NOT_FOUND")
        .when(F.col("stale"), "STALE_SOURCE")
        .when(~F.col("applied"), "REVISION_CONFLICT")
        .otherwise("applied")
    )
    return fold_revisions(judged, "fact_id").select(
        "event_id", "fact_id", "at_us", "base_revision", "status", "revision_met", outcome.alias("outcome")
    )


def reviewed_facts(facts: DataFrame, reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Facts after all applied reviews: the one with the highest revision gives status and claim."""
    applied = outcomes.where(F.col("outcome") == "applied").select("event_id", "revision_met")
    last = (
        reviews.join(applied, "event_id")
        .groupBy("fact_id")
        .agg(F.max(F.struct(F.col("revision_met"), F.col("status"), F.col("claim"))).alias("last"))
    )
    return facts.join(last, "fact_id", "left").select(
        "fact_id",
        "project_id",
        "chunk_id",
        F.coalesce("last.claim", "claim").alias("claim"),
        "quote",
        F.coalesce("last.status", "status").alias("status"),
        F.coalesce(F.col("last.revision_met") + 1, F.col("revision")).alias("revision"),
    )


def edit_outcomes(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """Edits of planning rows: refused when the row would change project, else the same revision rule.

    ``edits``: event_id, row_id, project_id, at_us, base_revision; ``rows``: row_id, project_id, revision.
    """
    known = rows.select("row_id", F.col("project_id").alias("home"), F.col("revision").alias("initial"))
    moved = F.coalesce(F.col("project_id") != F.col("home"), F.lit(False))
    judged = edits.join(known, "row_id", "left").withColumn("moved", moved).withColumn("usable", ~F.col("moved"))
    outcome = (
        F.when(F.col("initial").isNull(), "NOT_FOUND")
        .when(F.col("base_revision") != F.col("revision_met"), "REVISION_CONFLICT")
        .when(F.col("moved"), "PROJECT_CANNOT_CHANGE")
        .otherwise("applied")
    )
    return fold_revisions(judged, "row_id").select(
        "event_id", "row_id", "at_us", "base_revision", "revision_met", outcome.alias("outcome")
    )
