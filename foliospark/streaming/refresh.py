"""Keeping the index up to date: accepted saves in, chunks of due chapters out, with retries and dead letters.

Each chapter has a job in the state store, where the jobs of a group of chapters lie together: its latest save, when it is
due, and how often it has failed. A save puts the job back to the start, so a chapter is indexed once it has rested for the
debounce time. A run that fails is due again after 30, 60, then 120 seconds; after three failures the job is a dead letter
until the next save. Timers in event time start the runs: what happens follows from the saves alone and not from how they
fall into micro-batches. One chapter that cannot be indexed neither stops the stream nor holds up others.

Tables in the folder: ``job_log`` grows by one folder per micro-batch, a repeated batch overwrites its own; ``jobs`` is the
newest job of each chapter up to a batch, made by ``compact_jobs``; ``story_chunks`` lies in folders by chapter and never takes
a chunk twice. Chunks of replaced revisions stay as history; freshness decides at read time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliospark import schemas as S
from foliospark.functions.text import md5_text
from foliospark.operators.chunking import chunk_chapters
from foliospark.sources.tables import read_table, write_new_chunks
from foliospark.streaming.folds import use_rocksdb

SAVED = "chapter_id long, project_id string, revision_number long, plain_text string, at_us long"
RUNS = "chapter_id long, project_id string, revision_number long, plain_text string, at_us long, status string, attempts long"
SECOND = 1_000_000
# Chapters are kept in so many groups; a checkpoint goes on with the number it began with.
GROUPS = 4096
# Rows in a value of the state store, column by column. A call costs as much as some hundred rows in it.
PACK = 1_000


def _packed(rows: list[tuple]) -> list[tuple]:
    return [tuple(list(column) for column in zip(*rows[i : i + PACK])) for i in range(0, len(rows), PACK)]


def _unpacked(values: Iterator[tuple]) -> list[tuple]:
    return [row for value in values for row in zip(*value)]


class IndexJobs(StatefulProcessor):
    """The jobs of a group of chapters: a row for each run that has come due.

    Saves wait in the state until the watermark has passed them, so that none is overtaken by an earlier one. Saves and runs
    of a chapter then take place in the order of their times, a save before a run of the same moment. The state holds what is
    still open, and no more of a group than that is read when its timer wakes it.
    """

    def __init__(self, gap: int, backoff: int, most: int):
        self.gap, self.backoff, self.most = gap, backoff, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        save = "revision array<long>, project array<string>, text array<string>, failing array<long>"
        self.waiting = handle.getListState("waiting", f"chapter array<long>, at array<long>, {save}")
        # The latest save, when its next run is due, and the runs that failed.
        self.jobs = handle.getListState("jobs", f"chapter array<long>, due array<long>, attempts array<long>, {save}")

    def _wake(self, at: int) -> None:
        # A moment has passed when the watermark, in milliseconds, has reached the end of its millisecond.
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            chapters, at, revisions, failing = ([int(n) for n in batch[c].tolist()] for c in ("chapter_id", "at_us", "revision_number", "failing"))
            saves = zip(chapters, at, revisions, batch["project_id"].tolist(), batch["plain_text"].tolist(), failing)
            self.waiting.appendList(_packed(list(saves)))
            first = min(at) if first is None else min(first, *at)
        # A group has one timer: the first moment at which something happens.
        timers = list(self.handle.listTimers())
        if not timers or -(-first // 1000) < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self._wake(first)
        return iter([])

    def _run(self, chapter: int, saves: list[tuple], job: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        """What happens to a chapter up to now; its runs are added to ``out``, the job that is left is returned."""
        done = 0
        while True:
            save = saves[done] if done < len(saves) else None
            if save and (not job or save[0] <= job[0]):
                job = (save[0] + self.gap, 0, *save[1:])
                done += 1
            elif job and job[0] <= now:
                due, attempts, revision, project, text, failing = job
                failed = attempts < failing
                status = "ready" if not failed else "dead" if attempts + 1 >= self.most else "failed"
                out.append((chapter, project, revision, text if status == "ready" else None, due, status, attempts + failed))
                job = (due + self.backoff * 2**attempts, attempts + 1, *job[2:]) if status == "failed" else None
            else:
                return job

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        jobs = {job[0]: job[1:] for job in _unpacked(self.jobs.get())}
        saves = _unpacked(self.waiting.get())
        later, out = [s for s in saves if s[1] > now], []
        passed = {chapter: [] for chapter, job in jobs.items() if job[0] <= now}
        for save in sorted((s for s in saves if s[1] <= now), key=lambda s: s[1:3]):
            passed.setdefault(save[0], []).append(save[1:])
        for chapter, own in passed.items():
            job = self._run(chapter, own, jobs.pop(chapter, None), now, out)
            if job:
                jobs[chapter] = job
        if len(later) < len(saves):
            self.waiting.put(_packed(later)) if later else self.waiting.clear()
        if passed:
            self.jobs.put(_packed([(chapter, *job) for chapter, job in jobs.items()])) if jobs else self.jobs.clear()
        # Spark takes away the timer that has expired.
        times = [s[1] for s in later] + [job[0] for job in jobs.values()]
        if times:
            self._wake(min(times))
        if out:
            names = ["chapter_id", "project_id", "revision_number", "plain_text", "at_us", "status", "attempts"]
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def failing_runs(saves: DataFrame) -> DataFrame:
    """The saves with ``failing``: how many runs of each must fail. A text that cannot be chunked fails always, any other never."""
    if "failing" in saves.columns:
        return saves
    bad = F.col("plain_text").isNull() | (F.octet_length("plain_text") > S.MAX_TEXT_BYTES)
    return saves.withColumn("failing", F.when(bad, S.MAX_ATTEMPTS).otherwise(0).cast("long"))


def index_runs(
    saves: DataFrame,
    gap_seconds: int = S.DEBOUNCE_SECONDS,
    delay: str = "10 minutes",
    backoff_seconds: int = S.BACKOFF_SECONDS,
    attempts: int = S.MAX_ATTEMPTS,
) -> DataFrame:
    """Every run of an index job, once the watermark has passed it: chapter, revision, text (of a good run), time, status, attempts.

    ``saves`` is a stream of SAVED, with ``failing`` where a test or a check says how many runs of a save fail. Saves older than
    the watermark are too late and dropped.
    """
    use_rocksdb(saves.sparkSession)
    timed = failing_runs(saves).where(F.col("chapter_id").isNotNull() & F.col("at_us").isNotNull())
    timed = timed.withColumn("ts", F.timestamp_micros("at_us")).withWatermark("ts", delay)
    grouped = timed.withColumn("chapter_group", F.pmod(F.xxhash64("chapter_id"), F.lit(GROUPS)).cast("int"))
    return grouped.groupBy("chapter_group").transformWithStateInPandas(
        statefulProcessor=IndexJobs(gap_seconds * SECOND, backoff_seconds * SECOND, attempts),
        outputStructType=RUNS,
        outputMode="Append",
        timeMode="EventTime",
    )


def index_batch(batch: DataFrame, batch_id: int, folder: str, session: SparkSession | None = None) -> None:
    """Record the runs of one micro-batch, texts included, then chunk the texts that are ready.

    A repeated batch overwrites its own log and finds its chunks stored, so a restart repeats nothing. A stream's own session
    plans without adaptive execution, and every shuffle partition would write a file to every folder; ``session`` is one with it.
    """
    place = f"{folder}/job_log/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(place)
    ready = (session or batch.sparkSession).read.schema(RUNS).parquet(place).where(F.col("status") == "ready")
    write_new_chunks(chunk_chapters(ready), folder, ready)


def refresh_index(saves: DataFrame, folder: str, checkpoint: str, gap_seconds: int = S.DEBOUNCE_SECONDS, delay: str = "10 minutes", backoff_seconds: int = S.BACKOFF_SECONDS, **trigger) -> StreamingQuery:
    """Start the refresh; ``trigger`` as for a stream writer, such as processingTime="1 minute"."""
    session = saves.sparkSession
    return (
        index_runs(saves, gap_seconds, delay, backoff_seconds)
        .writeStream.foreachBatch(lambda batch, batch_id: index_batch(batch, batch_id, folder, session))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _log(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("status") == "dead", "failed").otherwise(F.col("status"))
    return spark.read.parquet(f"{folder}/job_log").select(
        "chapter_id",
        "project_id",
        F.col("revision_number").alias("source_revision"),
        md5_text(F.col("plain_text")).alias("source_hash"),
        status.alias("status"),
        "attempts",
        (F.col("status") == "dead").alias("dead_letter"),
        F.when(F.col("status") != "ready", "INDEX_FAILED").alias("error"),
        "at_us",
        F.col("batch_id").cast("long").alias("batch_id"),
    )


def _newest(log: DataFrame) -> DataFrame:
    rest = [c for c in log.columns if c not in ("chapter_id", "batch_id")]
    return log.groupBy("chapter_id").agg(F.max_by(F.struct(*rest), F.struct("at_us", "source_revision", "attempts")).alias("j")).select("chapter_id", "j.*")


def _compacted(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """The newest keyed table and the batch up to which it holds everything."""
    try:
        jobs = spark.read.parquet(f"{folder}/jobs")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, -1
    upto = jobs.select(F.max("upto")).first()[0]
    return jobs.where(F.col("upto") == upto).drop("upto"), upto


def latest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest job of each chapter: the keyed table and the log folders written since."""
    jobs, upto = _compacted(spark, folder)
    log = _log(spark, folder).where(F.col("batch_id") > upto)
    return _newest(log if jobs is None else log.drop("batch_id").unionByName(jobs))


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters whose last save could not be indexed and is not tried again."""
    return latest_jobs(spark, folder).where("dead_letter")


def compact_jobs(spark: SparkSession, folder: str) -> int:
    """Write the newest jobs as a keyed table of their own, so that readers need no log folder up to that batch; which one is returned.

    A new table stands beside the old until it is whole; readers take the newest. Log folders up to the batch may be removed.
    """
    last = spark.read.parquet(f"{folder}/job_log").select(F.max(F.col("batch_id").cast("long"))).first()[0]
    if last is not None and last > _compacted(spark, folder)[1]:
        latest_jobs(spark, folder).write.mode("overwrite").parquet(f"{folder}/jobs/upto={last}")
    return -1 if last is None else last


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "story_chunks")
