"""Literal search over the five kinds of project text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.functions.text import excerpt
from foliospark.operators.access import with_right
from foliospark.operators.ranking import top_rows


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("deleted_at").isNull())


def searchable(
    chapters: DataFrame, characters: DataFrame, bibles: DataFrame, notes: DataFrame, outline: DataFrame
) -> DataFrame:
    """(project_id, kind, source_id, heading, body) of all text that is not archived."""

    def source(rows: DataFrame, kind: str, key: str, heading: Column, *body: Column) -> DataFrame:
        return rows.select(
            "project_id",
            F.lit(kind).alias("kind"),
            F.col(key).cast("string").alias("source_id"),
            heading.alias("heading"),
            F.concat_ws("\n", *body).alias("body"),
        )

    c = F.col
    parts = [
        source(chapters, "chapter", "chapter_id", c("title"), c("title"), c("plain_text")),
        source(
            live(characters),
            "characters",
            "character_id",
            c("name"),
            c("name"),
            F.array_join("aliases", ", "),
            c("role"),
            c("description"),
            F.to_json("attributes"),
        ),
        source(
            bibles,
            "story_bibles",
            "bible_id",
            F.lit("Story Bible"),
            *[c(f) for f in ("premise", "synopsis", "themes", "tone", "style_instructions", "world_rules")],
        ),
        source(live(notes), "notes", "note_id", c("title"), c("title"), c("note_type"), c("plain_text")),
        source(live(outline), "outline_items", "item_id", c("title"), c("title"), c("description")),
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def search_code(query: Column, offset: Column) -> Column:
    needle = F.length(F.trim(query))
    bad = query.isNull() | (needle < S.SEARCH_MIN) | (needle > S.SEARCH_MAX) | (offset < 0) | (offset > S.SEARCH_MAX_OFFSET)
    return F.when(bad, F.lit("INVALID_SEARCH"))


def refused_searches(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """request_id and code of the searches (with ``asker``) that are not run: the search itself first, then the right to it."""
    code = F.coalesce(search_code(F.col("query"), F.col("offset")), F.when(~F.col("owned"), F.lit("NOT_FOUND")))
    return with_right(requests, projects).select("request_id", code.alias("code")).where(F.col("code").isNotNull())


def searches_by_owners(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """The searches (with ``asker``) that ``refused_searches`` does not name."""
    return with_right(requests, projects).where(F.col("owned") & search_code(F.col("query"), F.col("offset")).isNull()).drop("owned")


def matches(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """Every hit of every valid request (request_id, project_id, query, offset).

    The containment test is a condition of the join on project, so only hits leave it. Requests are the
    small side; Spark broadcasts them below its size threshold.
    """
    wanted = requests.where(search_code(F.col("query"), F.col("offset")).isNull()).select(
        "request_id", "project_id", "offset", F.lower(F.trim("query")).alias("needle")
    )
    lowered = texts.withColumn("lowered", F.lower("body"))
    found = lowered.join(
        wanted,
        (lowered["project_id"] == wanted["project_id"]) & (F.instr(lowered["lowered"], wanted["needle"]) > 0),
    )
    return found.select(
        "request_id",
        "offset",
        "kind",
        "source_id",
        "heading",
        excerpt(F.col("body"), F.instr(F.col("lowered"), F.col("needle"))).alias("excerpt"),
    )


ORDER = ["kind", "heading", "source_id"]


def search(requests: DataFrame, texts: DataFrame, deepest: int = S.SEARCH_MAX_OFFSET) -> DataFrame:
    """One page of 20 hits per request and whether more follow. ``deepest`` is the largest offset in use."""
    last = deepest + S.SEARCH_PAGE + 1
    ranked = top_rows(matches(requests, texts), ["request_id"], [F.col(c) for c in ORDER], last)
    page = ranked.where((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + S.SEARCH_PAGE + 1))
    return page.select(
        "request_id",
        (F.col("rank") - F.col("offset")).alias("place"),
        "kind",
        "source_id",
        "heading",
        "excerpt",
        (F.col("rank") > F.col("offset") + S.SEARCH_PAGE).alias("look_ahead"),
    )


def search_project(texts: DataFrame, project_id: str, query: str, offset: int = 0) -> DataFrame:
    """One request: filter, order, and take; Spark keeps only the first rows of each partition."""
    needle = query.strip(" ").lower()
    if not S.SEARCH_MIN <= len(needle) <= S.SEARCH_MAX or not 0 <= offset <= S.SEARCH_MAX_OFFSET:
        raise ValueError("INVALID_SEARCH")
    hit = F.instr(F.lower("body"), F.lit(needle))
    return (
        texts.where((F.col("project_id") == project_id) & (hit > 0))
        .select("kind", "source_id", "heading", excerpt(F.col("body"), hit).alias("excerpt"))
        .orderBy(*ORDER)
        .offset(offset)
        .limit(S.SEARCH_PAGE + 1)
    )
