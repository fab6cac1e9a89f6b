"""Reports: memory overview, generation history, usage without content, lists and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark import schemas as S
from foliospark.functions.text import ASK_PREFIX, contains_literal, model_task, pseudonym, row_key, workflow
from foliospark.operators.chunking import current_chunks, with_currency
from foliospark.operators.ranking import full_rank, top_rows


def job_list(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every job with its chapter title; rows, because a project may have any number of chapters."""
    return jobs.join(chapters.select("chapter_id", "title", "position"), "chapter_id")


def chunk_list(chunks: DataFrame, chapters: DataFrame, insights: DataFrame, limit: int = S.OVERVIEW_CHUNKS) -> DataFrame:
    """The first current chunks of each project in reading order, with whether they were analysed."""
    first = top_rows(
        current_chunks(chunks, chapters, "title", "position").drop("content"),
        ["project_id"],
        [F.col("position"), F.col("chapter_id"), F.col("chunk_index")],
        limit,
    )
    done = insights.select("chunk_id", F.lit(True).alias("analyzed"))
    return first.join(done, "chunk_id", "left").withColumn("analyzed", F.coalesce("analyzed", F.lit(False)))


def newest_with_source(
    rows: DataFrame, key: str, chunks: DataFrame, chapters: DataFrame, limit: int
) -> DataFrame:
    """The newest insights or facts of each project with title and whether their source is still current."""
    return _with_source(_newest(rows, key, limit), chunks, chapters)


def _newest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return top_rows(rows, ["project_id"], [F.desc("created_at"), F.col(key)], limit)


def _with_source(newest: DataFrame, chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rows already cut to the newest meet their chunks, and only those chunks are compared with the chapters."""
    source = chunks.select("chunk_id", "project_id", "chapter_id", "chunk_index", "source_revision", "source_hash")
    return with_currency(newest.join(source, ["chunk_id", "project_id"]), chapters, "title").drop("chapter_id", "source_hash")


def overview(
    projects: DataFrame, chunks: DataFrame, chapters: DataFrame, insights: DataFrame, facts: DataFrame
) -> DataFrame:
    """One row per project, also one without any chapter, with the three bounded lists; the unbounded job list stays ``job_list``."""
    c = (
        chunk_list(chunks, chapters, insights)
        .groupBy("project_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "title", "chunk_index", "analyzed"))).alias("chunks"))
    )
    # Both lists are cut first and look up their sources together.
    text = lambda name, kind: F.lit(kind).alias(name)
    newest = (
        _newest(insights, "insight_id", S.OVERVIEW_INSIGHTS)
        .select("project_id", "chunk_id", "rank", text("kind", "insight"), F.col("insight_id").alias("row_id"), F.col("summary").alias("text"), F.lit(None).cast("string").alias("status"))
        .unionByName(
            _newest(facts, "fact_id", S.OVERVIEW_FACTS).select(
                "project_id", "chunk_id", "rank", text("kind", "fact"), F.col("fact_id").alias("row_id"), F.col("claim").alias("text"), "status"
            )
        )
    )
    insight = F.when(F.col("kind") == "insight", F.struct("rank", F.col("row_id").alias("insight_id"), "title", F.col("text").alias("summary"), "current"))
    fact = F.when(F.col("kind") == "fact", F.struct("rank", F.col("row_id").alias("fact_id"), "title", F.col("text").alias("claim"), "status", "current"))
    n = (
        _with_source(newest, chunks, chapters)
        .groupBy("project_id")
        .agg(F.array_sort(F.collect_list(insight)).alias("insights"), F.array_sort(F.collect_list(fact)).alias("facts"))
    )
    joined = projects.select("project_id").distinct().join(c, "project_id", "left").join(n, "project_id", "left")
    for name in ("chunks", "insights", "facts"):
        joined = joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))
    return joined


def newest_generations(generations: DataFrame, limit: int = 20) -> DataFrame:
    return top_rows(generations, ["project_id"], [F.desc("created_us"), F.desc("generation_id")], limit)


def ask_history(generations: DataFrame, limit: int = 10) -> DataFrame:
    """The newest completed questions to the memory."""
    asked = generations.where((F.col("status") == "complete") & F.col("prompt").startswith(ASK_PREFIX))
    return newest_generations(asked, limit)


USAGE = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("inputTokens", "outputTokens", "totalTokens")] + [T.StructField("latency_ms", T.DoubleType())]
)


def usage_facts(generations: DataFrame) -> DataFrame:
    """An allow list of content-free columns; ids become pseudonyms and no text leaves."""
    usage = F.from_json("token_usage", USAGE)
    return generations.select(
        "generation_id",
        pseudonym(F.col("project_id")).alias("project"),
        pseudonym(F.col("user_id").cast("string")).alias("user"),
        workflow(F.col("prompt")).alias("workflow"),
        F.substring_index("model", ":", 1).alias("provider"),
        F.regexp_replace("model", "^[^:]*:", "").alias("model"),
        model_task(F.col("action")).alias("task"),
        F.coalesce(F.size("context_sources"), F.lit(0)).cast("long").alias("retrieved_memory_count"),
        F.lit(False).alias("content_logging"),
        (F.col("status") == "complete").alias("success"),
        F.length("prompt").cast("long").alias("input_characters"),
        F.when(F.col("status") == "complete", F.length("result")).otherwise(0).cast("long").alias("output_characters"),
        usage["inputTokens"].alias("input_tokens"),
        usage["outputTokens"].alias("output_tokens"),
        usage["totalTokens"].alias("total_tokens"),
        usage["latency_ms"].alias("latency_ms"),
        F.when(F.col("status") == "error", "AI_GENERATION_FAILED").alias("error"),
    )


def usage_report(generations: DataFrame) -> DataFrame:
    return usage_facts(generations).groupBy("project", "task", "success").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("input_characters").alias("input_characters"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def title_matches(projects: DataFrame, query: str) -> DataFrame:
    return projects.where(contains_literal(F.col("title"), F.lit(query)))


def next_positions(projects: DataFrame, chapters: DataFrame) -> DataFrame:
    """Position and default title of the next chapter of each project."""
    stats = chapters.groupBy("project_id").agg(F.max("position").alias("last"), F.count(F.lit(1)).alias("n"))
    number = F.coalesce("n", F.lit(0)) + 1
    return projects.select("project_id").join(stats, "project_id", "left").select(
        "project_id",
        F.coalesce(F.col("last") + 1, F.lit(0)).cast("long").alias("next_position"),
        F.concat(F.lit("Bab "), number.cast("string")).alias("next_title"),
        F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0")).alias("list_number"),
    )


def new_projects(requests: DataFrame) -> DataFrame:
    """A project per request (request_id, owner_id, title, genre); its first chapter comes from ``first_chapters``."""
    return requests.select(
        row_key(F.lit("project"), F.col("request_id")).alias("project_id"),
        "owner_id",
        F.trim("title").alias("title"),
        F.lit("").alias("description"),
        "genre",
        F.lit("id").alias("manuscript_language"),
    )


def planning_list(rows: DataFrame, order: list[str], archived: bool = False) -> DataFrame:
    """One view of a planning table: live rows or the archive, in the order it is shown."""
    hidden = F.col("deleted_at").isNotNull()
    return rows.where(hidden if archived else ~hidden).orderBy("project_id", *order)


def planning_places(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row, live and archived, with its ``place`` in the view it is shown in.

    A place is a column, so it outlasts joins, unions and files, which the order of rows does not. ``keys`` name the view
    besides the project; a project with a third of all rows is ranked in segments.
    """
    marked = rows.withColumn("archived", F.col("deleted_at").isNotNull())
    return full_rank(marked, [*keys, "archived", "project_id"], order, "place")


def project_list(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("created_at"), "project_id")


def chapter_list(chapters: DataFrame) -> DataFrame:
    return chapters.orderBy("project_id", "position", "chapter_id")


# The first chapter of a new project.
FIRST_TITLE, FIRST_DOCUMENT = "Bab 1", '{"type":"doc","content":[{"type":"paragraph"}]}'


def first_chapters(projects: DataFrame, chapters: DataFrame) -> DataFrame:
    """The default chapter of every project that has none."""
    empty = projects.join(chapters.select("project_id"), "project_id", "left_anti")
    return empty.select(
        "project_id",
        F.lit(FIRST_TITLE).alias("title"),
        F.lit(FIRST_DOCUMENT).alias("content_json"),
        F.lit("").alias("plain_text"),
        F.lit(0).cast("long").alias("revision_number"),
        F.lit(0).cast("long").alias("position"),
    )


def manuscript_parts(projects: DataFrame, chapters: DataFrame) -> DataFrame:
    """A manuscript as ordered pieces: the pieces of a project joined in order are its Markdown text.

    Pieces, because one project may hold more text than a single value or task can. Each chapter brings the
    blank line before it, so no piece has to know its neighbours.
    """
    filled = chapters.select("project_id").distinct().withColumn("filled", F.lit(True))
    head = projects.join(filled, "project_id", "left").select(
        "project_id",
        F.lit(0).alias("part"),
        F.lit(-1).cast("long").alias("position"),
        F.lit(-1).cast("long").alias("chapter_id"),
        F.concat(F.lit("# "), F.col("title"), F.when(F.col("filled"), "").otherwise("\n\n")).alias("piece"),
    )
    body = chapters.select(
        "project_id",
        F.lit(1).alias("part"),
        F.col("position").cast("long").alias("position"),
        "chapter_id",
        F.concat(F.lit("\n\n## "), F.col("title"), F.lit("\n\n"), F.col("plain_text")).alias("piece"),
    )
    return head.unionByName(body)


def version_text(versions: DataFrame) -> DataFrame:
    return versions.select("chapter_id", "revision", F.concat(F.col("title"), F.lit("\n\n"), F.col("plain_text")).alias("text"))
