"""Saves, reviews and quotas as streams: the state of a key lives in the state store between micro-batches.

Inside a micro-batch the rows of a key come in no fixed order and are sorted first; what one trigger takes in
bounds that. Across batches late rows keep their arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark import schemas as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """Custom state needs this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["at_us", "event_id"])


class RevisionProcessor(StatefulProcessor):
    """Holds the present revision of a key; applies an event based on it that nothing else refuses, and counts one up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "now long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        first = batch["initial"].iloc[0]
        if pd.isna(first):
            # An unknown key meets nothing and keeps no state.
            met, based = [None] * len(batch), [False] * len(batch)
        else:
            now = self.revision.get()[0] if self.revision.exists() else int(first)
            met, based = [], []
            for base, refused in zip(batch["base_revision"].tolist(), batch["code"].notna().tolist()):
                met.append(now)
                based.append(base == now)
                now += int(based[-1] and not refused)
            self.revision.update((now,))
        yield pd.DataFrame(
            {"event_id": batch["event_id"], "revision_met": pd.array(met, "Int64"), "based": based, "code": batch["code"].astype(object)}
        )

    def close(self) -> None:
        pass


def stream_fold(events: DataFrame) -> DataFrame:
    """The revision rule as a stream. ``events``: key, event_id, at_us, base_revision, initial, code.

    ``initial`` is null for an unknown key, ``code`` is why another check refuses the event, null if none does. Gives
    the revision each event met, whether it was ``based`` on it, and the code.
    """
    use_rocksdb(events.sparkSession)
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RevisionProcessor(),
        outputStructType="event_id long, revision_met long, based boolean, code string",
        outputMode="Append",
        timeMode="None",
    )


def stream_save_outcomes(
    saves: DataFrame, chapters: DataFrame, max_text: int = S.MAX_TEXT_BYTES, max_content: int = S.MAX_CONTENT_BYTES
) -> DataFrame:
    """Outcome of every save, as ``save_outcomes`` gives it. ``chapters`` is a static table with the revisions at the start."""
    too_large = (F.octet_length("plain_text") > max_text) | (F.octet_length("content_json") > max_content)
    is_doc = F.coalesce(F.get_json_object("content_json", "$.type") == "doc", F.lit(False))
    start = chapters.select("chapter_id", F.col("revision_number").alias("initial"))
    folded = stream_fold(
        saves.join(start, "chapter_id", "left").select(
            F.col("chapter_id").alias("key"),
            "event_id",
            "at_us",
            F.coalesce("base_revision", F.lit(-1)).cast("long").alias("base_revision"),
            F.col("initial").cast("long").alias("initial"),
            F.when(too_large, "CHAPTER_TOO_LARGE").when(~is_doc, "INVALID_DOCUMENT").alias("code"),
        )
    )
    outcome = F.when(F.col("revision_met").isNull(), "NOT_FOUND").when(~F.col("based"), "REVISION_CONFLICT")
    return folded.select("event_id", "revision_met", outcome.otherwise(F.coalesce("code", F.lit("accepted"))).alias("outcome"))


def stream_review_outcomes(reviews: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcome of every review, as ``review_outcomes`` gives it. ``sources`` is a static table of chunk_id and current."""
    start = facts.select("fact_id", "chunk_id", F.col("revision").alias("initial")).join(sources.select("chunk_id", "current"), "chunk_id")
    folded = stream_fold(
        reviews.join(start, "fact_id", "left").select(
            F.col("fact_id").alias("key"),
            "event_id",
            "at_us",
            F.coalesce("base_revision", F.lit(-1)).cast("long").alias("base_revision"),
            F.col("initial").cast("long").alias("initial"),
            F.when((F.col("status") == "approved") & ~F.col("current"), "STALE_SOURCE").alias("code"),
        )
    )
    outcome = F.when(F.col("revision_met").isNull(), "NOT_FOUND").when(F.col("code").isNotNull(), F.col("code"))
    return folded.select("event_id", "revision_met", outcome.otherwise(F.when(F.col("based"), "applied").otherwise("REVISION_CONFLICT")).alias("outcome"))


class QuotaProcessor(StatefulProcessor):
    """Holds the accepted times of a user that still count, never more than the limit."""

    def __init__(self, limit: int, window: int, spacing: int):
        self.limit, self.window, self.spacing = limit, window, spacing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        held = list(self.held.get()[0]) if self.held.exists() else []
        decisions = []
        for at in batch["at_us"].tolist():
            held = [t for t in held if t > at - self.window]
            if len(held) >= self.limit:
                decisions.append("AI_DAILY_LIMIT")
            elif held and held[-1] > at - self.spacing:
                decisions.append("AI_RATE_LIMIT")
            else:
                decisions.append("accepted")
                held.append(at)
        self.held.update((held,))
        yield pd.DataFrame(
            {"user_id": key[0], "event_id": batch["event_id"], "at_us": batch["at_us"], "decision": decisions}
        )

    def close(self) -> None:
        pass


def stream_decisions(
    requests: DataFrame,
    limit: int = S.DAILY_LIMIT,
    window_seconds: int = S.DAY_SECONDS,
    spacing_seconds: int = S.SPACING_SECONDS,
) -> DataFrame:
    use_rocksdb(requests.sparkSession)
    return requests.select("user_id", "event_id", "at_us").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=QuotaProcessor(limit, window_seconds * SECOND, spacing_seconds * SECOND),
        outputStructType="user_id long, event_id long, at_us long, decision string",
        outputMode="Append",
        timeMode="None",
    )


def stream_debounce(saves: DataFrame, gap_seconds: int = S.DEBOUNCE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Closed runs of saves. A run is given out once the watermark has passed its end."""
    timed = saves.withColumn("ts", F.timestamp_micros("at_us")).withWatermark("ts", delay)
    runs = timed.groupBy("chapter_id", F.session_window("ts", f"{gap_seconds} seconds").alias("run")).agg(
        F.count(F.lit(1)).alias("saves"), F.max(F.struct("at_us", "event_id")).alias("last")
    )
    return runs.select(
        "chapter_id",
        F.unix_micros("run.start").alias("session_us"),
        "saves",
        F.col("last.at_us").alias("last_us"),
        F.col("last.event_id").alias("last_event_id"),
        F.unix_micros("run.end").alias("due_us"),
    )
