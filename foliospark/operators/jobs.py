"""Index jobs: what to index, when it is due, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.functions.text import retry_delay_seconds
from foliospark.operators.chunking import text_hash
from foliospark.operators.ranking import last_seen, runs, top_rows
from foliospark.session import cut_lineage

SECOND = 1_000_000


def backfill_jobs(chapters: DataFrame) -> DataFrame:
    """A queued job for every existing chapter."""
    return chapters.select(
        "chapter_id",
        "project_id",
        F.col("revision_number").alias("source_revision"),
        text_hash(chapters).alias("source_hash"),
        F.lit("queued").alias("status"),
        F.lit(0).cast("long").alias("attempts"),
    )


def debounce(saves: DataFrame, gap_seconds: int = S.DEBOUNCE_SECONDS) -> DataFrame:
    """Runs of saves with no pause longer than the gap; only the last save of a run is indexed.

    ``saves``: chapter_id, at_us, event_id.
    """
    gap = gap_seconds * SECOND
    placed = runs(saves.select("chapter_id", "at_us", "event_id"), ["chapter_id"], "at_us", "event_id", gap, "session_us")
    return placed.groupBy("chapter_id", "session_us").agg(
        F.count(F.lit(1)).alias("saves"),
        F.max("at_us").alias("last_us"),
        F.max(F.struct("at_us", "event_id"))["event_id"].alias("last_event_id"),
        (F.max("at_us") + gap).alias("due_us"),
    )


def upsert_jobs(jobs: DataFrame, queued: DataFrame) -> DataFrame:
    """Keyed upsert: the queued row with the highest revision replaces the chapter's job and clears its failures.

    ``queued``: chapter_id, project_id, source_revision, source_hash, available_us.
    """
    latest = (
        queued.groupBy("chapter_id")
        .agg(F.max(F.struct("source_revision", "available_us", "source_hash", "project_id")).alias("q"))
        .select(
            "chapter_id",
            "q.project_id",
            "q.source_revision",
            "q.source_hash",
            F.lit("queued").alias("status"),
            F.lit(0).cast("long").alias("attempts"),
            "q.available_us",
            F.lit(None).cast("string").alias("error"),
        )
    )
    kept = jobs.select(latest.columns).join(latest.select("chapter_id"), "chapter_id", "left_anti")
    return kept.unionByName(latest)


def is_due(now_us: Column, force: bool = False) -> Column:
    waiting = F.col("status").isin("queued", "failed") & (F.col("attempts") < S.MAX_ATTEMPTS)
    return waiting if force else waiting & (F.col("available_us") <= now_us)


def due_jobs(jobs: DataFrame, now_us: int, batch: int = S.DISPATCH_BATCH, force: bool = False) -> DataFrame:
    """The oldest due jobs first, one dispatch batch of them."""
    return jobs.where(is_due(F.lit(now_us), force)).orderBy("available_us", "chapter_id").limit(batch)


def dispatch(jobs: DataFrame, chapters: DataFrame, now_us: int, batch: int = S.DISPATCH_BATCH) -> DataFrame:
    """The chapters one tick indexes, in order: each time the project of the oldest due job gives its first due chapter.

    Only the oldest few jobs and the first few chapters of their projects can be chosen, so the choice is a fold
    over one short list.
    """
    due = jobs.where(is_due(F.lit(now_us))).select("chapter_id", "project_id", "available_us")
    oldest = due.orderBy("available_us", "chapter_id").limit(batch)
    placed = due.join(oldest.select("project_id").distinct(), "project_id", "left_semi").join(
        chapters.select("chapter_id", "position"), "chapter_id"
    )
    by_age = [F.col("available_us"), F.col("chapter_id")]
    by_place = [F.col("position"), F.col("chapter_id")]
    few = (
        top_rows(placed, ["project_id"], by_age, batch)
        .unionByName(top_rows(placed, ["project_id"], by_place, batch))
        .drop("rank")
        .distinct()
    )
    listed = few.agg(F.collect_list(F.struct("available_us", "chapter_id", "position", "project_id")).alias("left"))
    none = F.array().cast("array<bigint>")

    def pick(done: Column, _: Column) -> Column:
        left = F.filter("left", lambda j: ~F.array_contains(done, j["chapter_id"]))
        project = F.array_min(F.transform(left, lambda j: F.struct(j["available_us"], j["chapter_id"], j["project_id"])))
        mine = F.filter(left, lambda j: j["project_id"] == project["project_id"])
        first = F.array_min(F.transform(mine, lambda j: F.struct(j["position"], j["chapter_id"])))
        return F.when(F.size(left) > 0, F.array_append(done, first["chapter_id"])).otherwise(done)

    order = F.aggregate(F.sequence(F.lit(1), F.lit(batch)), none, pick)
    return listed.select(F.posexplode(order).alias("turn", "chapter_id")).select(F.col("turn").cast("long").alias("turn"), "chapter_id")


def failed_once_more(jobs: DataFrame, now_us: int) -> DataFrame:
    """A failing run: one more attempt, due again after 30, 60, then 120 seconds."""
    return jobs.select(
        "chapter_id",
        F.lit("failed").alias("status"),
        (F.col("attempts") + 1).alias("attempts"),
        (F.lit(now_us) + retry_delay_seconds(F.col("attempts")) * SECOND).alias("available_us"),
        F.lit("INDEX_FAILED").alias("error"),
    )


def requeue_failed(jobs: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return jobs.withColumn("attempts", F.when(failed, F.lit(0).cast("long")).otherwise(F.col("attempts"))).withColumn(
        "status", F.when(failed, F.lit("queued")).otherwise(F.col("status"))
    )


def index_progress(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") != "ready").alias("remaining"),
    )


def job_histories(events: DataFrame) -> DataFrame:
    """Final state of the job after each save. ``events``: chapter_id, at_us, event_id, kind (save, ok, fail).

    A save resets the job, so what follows it up to the next save stands alone. Runs before the due time do
    nothing. A job runs three times at most, which makes three rounds of "first run at or after the due time",
    each one a grouped minimum that combines before the shuffle.
    """
    order = [F.col("at_us"), F.col("event_id")]
    stamped = events.withColumn("_saved", F.when(F.col("kind") == "save", F.struct("at_us", "event_id")))
    placed = last_seen(stamped, ["chapter_id"], order, "_saved", "_epoch").where(F.col("_epoch").isNotNull())
    keys = ["chapter_id", "saved_us", "save_id"]
    placed = cut_lineage(placed)
    tries = placed.where(F.col("kind") != "save").select(
        "chapter_id",
        F.col("_epoch.at_us").alias("saved_us"),
        F.col("_epoch.event_id").alias("save_id"),
        F.struct("at_us", "event_id", "kind").alias("run"),
    )
    state = placed.where(F.col("kind") == "save").select(
        "chapter_id",
        F.col("at_us").alias("saved_us"),
        F.col("event_id").alias("save_id"),
        F.lit("queued").alias("status"),
        F.lit(0).cast("long").alias("attempts"),
        (F.col("at_us") + S.DEBOUNCE_SECONDS * SECOND).alias("available_us"),
    )
    for _ in range(S.MAX_ATTEMPTS):
        # An inner join, so that the runs after one save may be split over tasks when there are very many.
        waiting = state.where(F.col("status") != "ready").select(*keys, "available_us")
        first = (
            tries.join(waiting, keys)
            .where(F.col("run.at_us") >= F.col("available_us"))
            .groupBy(*keys)
            .agg(F.min("run").alias("run"))
        )
        failed = F.col("run.kind") == "fail"
        state = cut_lineage(
            state.join(first, keys, "left").select(
                *keys,
                F.when(failed, "failed").when(F.col("run").isNotNull(), "ready").otherwise(F.col("status")).alias("status"),
                (F.col("attempts") + F.coalesce(failed.cast("long"), F.lit(0))).alias("attempts"),
                F.when(failed, F.col("run.at_us") + retry_delay_seconds(F.col("attempts")) * SECOND)
                .otherwise(F.col("available_us"))
                .alias("available_us"),
            )
        )
    dead = (F.col("status") == "failed") & (F.col("attempts") >= S.MAX_ATTEMPTS)
    return state.withColumn("dead_letter", dead)


def analysis_worklist(current: DataFrame, insights: DataFrame) -> DataFrame:
    """Current chunks nobody has analysed yet."""
    return current.join(insights.select("chunk_id"), "chunk_id", "left_anti")
