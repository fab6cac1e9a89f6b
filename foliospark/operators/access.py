"""Owner scope: every table is read through the projects its reader owns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def owned_projects(projects: DataFrame, owner_id: str) -> DataFrame:
    return projects.where(F.col("owner_id") == owner_id).select("project_id")


def scoped(rows: DataFrame, projects: DataFrame, owner_id: str) -> DataFrame:
    """Rows of the owner's projects only; a semi join, so nothing is duplicated."""
    return rows.join(owned_projects(projects, owner_id), "project_id", "left_semi")


def with_right(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests (project_id, asker) with ``owned``: whether the asker owns the project; false for one that is not there."""
    owners = projects.select("project_id", F.col("owner_id").alias("_owner"))
    joined = requests.join(owners, "project_id", "left")
    return joined.withColumn("owned", F.coalesce(F.col("_owner") == F.col("asker"), F.lit(False))).drop("_owner")


def with_owner(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Scope for all owners at once: each row with the one owner who may see it."""
    return rows.join(projects.select("project_id", "owner_id"), "project_id")


def visible_counts(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows visible to each owner, counted per project first so that a big project combines early."""
    per_project = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return with_owner(per_project, projects).groupBy("owner_id").agg(F.sum("n").alias("visible_rows"))


def leaked_rows(rows: DataFrame, parents: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    """Rows that their owner sees although their parent (by ``key``) is another owner's, or nobody's. Must be empty."""
    owners = projects.select("project_id", F.col("owner_id").alias("parent_owner"))
    above = parents.select(key, "project_id").join(owners, "project_id").select(key, "parent_owner")
    seen = with_owner(rows, projects).join(above, key, "left")
    return seen.where(~F.col("owner_id").eqNullSafe(F.col("parent_owner")))
