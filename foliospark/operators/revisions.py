"""Revision-checked writes: saves of chapters, reviews of facts, edits of planning rows.

An event names the revision it was based on and is applied only while that is still the present one; each
applied event adds one. Which events apply depends on all earlier ones of the same key, and one key may hold
a third of the events, so the ordered events are cut into segments and handled in three passes:

1. every (key, segment) on its own: which revision it would end with, for each revision it could start with.
   Only the bases named inside the segment matter; any other start passes through unchanged. Neighbouring
   starts with the same end become one range, so a segment's summary is short;
2. every key: walk its few segment summaries in order, which gives each segment its real start;
3. every (key, segment) on its own again: replay it from the known start.

The passes stream over sorted Arrow batches and hold the numbers of one segment. Texts take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliospark import schemas as S
from foliospark.operators.ranking import SEGMENT, full_rank, record_batch, segmented


def _ranges(ends: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(low, high, end) runs of neighbouring starts that share an end."""
    low = high = end = None
    for base in sorted(ends):
        if end == ends[base] and base == high + 1:
            high = base
            continue
        if end is not None:
            yield low, high, end
        low, high, end = base, base, ends[base]
    if end is not None:
        yield low, high, end


SUMMARY = pa.schema([("_key", pa.string()), (SEGMENT, pa.int64()), *[(c, pa.int64()) for c in ("initial", "low", "high", "end")]])
STARTS = pa.schema([("_key", pa.string()), (SEGMENT, pa.int64()), ("start", pa.int64())])
# A summary row no start can fall into; it only says that the segment exists.
EMPTY_RANGE = (-1, -1, -1)


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segment by segment, latest event first: starting at an event's base means going on from base + 1."""
    place, ends = None, {}

    def finished():
        return [(*place, *r) for r in (list(_ranges(ends)) or [EMPTY_RANGE])] if place else []

    for batch in batches:
        out = []
        for *here, base, usable in _rows(batch, "_key", SEGMENT, "initial", "_base", "usable"):
            if here != place:
                out += finished()
                place, ends = here, {}
            if usable:
                ends[base] = ends.get(base + 1, base + 1)
        yield record_batch(out, SUMMARY)
    yield record_batch(finished(), SUMMARY)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the summaries of each key in order and give every segment its start."""
    key_now, segment_now, start, end = None, None, None, None
    for batch in batches:
        out = []
        for key, segment, initial, low, high, stop in _rows(batch, *SUMMARY.names):
            if key != key_now:
                key_now, segment_now, end = key, None, initial
            if segment != segment_now:
                segment_now, start = segment, end
                out.append((key, segment, start))
            if low <= start <= high:
                end = stop
        yield record_batch(out, STARTS)


def _replay(kept: list[str]):
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each segment begins with the row that brings its start; the events follow in order."""
        now = None
        for batch in batches:
            events, met, applied = [], [], []
            for place, (start, base, usable) in enumerate(_rows(batch, "start", "_base", "usable")):
                if start is not None:
                    now = start
                    continue
                ok = usable and base == now
                events.append(place)
                met.append(now)
                applied.append(ok)
                now += ok
            body = batch.take(pa.array(events, pa.int64()))
            columns = [body.column(c) for c in kept] + [pa.array(met, pa.int64()), pa.array(applied, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "revision_met", "applied"])

    return replay


def fold_revisions(events: DataFrame, key: str) -> DataFrame:
    """All events with the revision each one met and whether it was applied.

    ``events`` has the key, at_us, event_id, base_revision, usable and initial, and may have more narrow columns.
    They arrive in the order (at_us, event_id). ``usable`` is false for an event another check refuses, and
    ``initial`` is the key's revision before all events, null for an unknown key, whose events meet nothing.
    """
    order = [F.col("at_us"), F.col("event_id")]
    placed = segmented(
        events.withColumn("_key", F.col(key).cast("string"))
        .withColumn("_base", F.coalesce(F.col("base_revision").cast("long"), F.lit(-1)))
        .withColumn("initial", F.col("initial").cast("long")),
        ["_key"],
        order,
    )
    known = placed.where(F.col("initial").isNotNull())
    by_segment = ["_key", SEGMENT]
    summaries = (
        known.select(*by_segment, "initial", "at_us", "event_id", "_base", "usable")
        .repartition(*by_segment)
        .sortWithinPartitions(*by_segment, F.desc("at_us"), F.desc("event_id"))
        .mapInArrow(_summarise, f"_key string, {SEGMENT} long, initial long, low long, high long, end long")
    )
    starts = (
        summaries.repartition("_key")
        .sortWithinPartitions(*by_segment, "low")
        .mapInArrow(_compose, f"_key string, {SEGMENT} long, start long")
    )
    kept = placed.drop("_key", SEGMENT, "_base").schema
    met = [T.StructField("revision_met", T.LongType()), T.StructField("applied", T.BooleanType())]
    # The starts travel as rows in front of their segments, which saves a join and its shuffle.
    replayed = (
        known.unionByName(starts, allowMissingColumns=True)
        .repartition(*by_segment)
        .sortWithinPartitions(*by_segment, F.col("start").isNull(), *order)
        .mapInArrow(_replay(kept.names), T.StructType(kept.fields + met))
    )
    unknown = placed.where(F.col("initial").isNull()).select(
        *kept.names, F.lit(None).cast("long").alias("revision_met"), F.lit(False).alias("applied")
    )
    return replayed.unionByName(unknown)


def save_outcomes(
    saves: DataFrame,
    chapters: DataFrame,
    max_text: int = S.MAX_TEXT_BYTES,
    max_content: int = S.MAX_CONTENT_BYTES,
) -> DataFrame:
    """Outcome of every save: NOT_FOUND, REVISION_CONFLICT, CHAPTER_TOO_LARGE, INVALID_DOCUMENT or accepted.

    ``saves``: event_id, chapter_id, at_us, base_revision, title, content_json, plain_text.
    """
    start = chapters.select("chapter_id", F.col("revision_number").alias("initial"))
    judged = (
        saves.select(
            "event_id",
            "chapter_id",
            "at_us",
            "base_revision",
            ((F.octet_length("plain_text") > max_text) | (F.octet_length("content_json") > max_content)).alias("too_large"),
            F.coalesce(F.get_json_object("content_json", "$.type") != "doc", F.lit(True)).alias("not_a_doc"),
        )
        .join(start, "chapter_id", "left")
        .withColumn("usable", ~F.col("too_large") & ~F.col("not_a_doc"))
    )
    outcome = (
        F.when(F.col("revision_met").isNull(), "NOT_FOUND")
        .when(F.col("base_revision").isNull() | (F.col("base_revision") != F.col("revision_met")), "REVISION_CONFLICT")
        .when(F.col("too_large"), "CHAPTER_TOO_LARGE")
        .when(F.col("not_a_doc"), "INVALID_DOCUMENT")
        .otherwise("accepted")
    )
    return fold_revisions(judged, "chapter_id").select(
        "event_id",
        "chapter_id",
        "at_us",
        "base_revision",
        "revision_met",
        outcome.alias("outcome"),
        F.when(F.col("applied"), F.col("revision_met") + 1).alias("new_revision"),
    )


def chapter_states(saves: DataFrame, chapters: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every state a chapter ever had, with its lifetime (SCD-2). The state without an end is the present one.

    The save that ends revision r is the accepted one that met r, so lifetimes come from an equi join.
    """
    accepted = outcomes.where(F.col("outcome") == "accepted")
    first = chapters.select(
        "chapter_id",
        "project_id",
        F.col("revision_number").alias("revision"),
        "title",
        "content_json",
        "plain_text",
        F.lit(None).cast("long").alias("from_us"),
    )
    saved = (
        accepted.select("event_id", F.col("new_revision").alias("revision"), F.col("at_us").alias("from_us"))
        .join(saves.select("event_id", "chapter_id", "title", "content_json", "plain_text"), "event_id")
        .join(chapters.select("chapter_id", "project_id"), "chapter_id")
        .select(first.columns)
    )
    ends = accepted.select("chapter_id", F.col("revision_met").alias("revision"), F.col("at_us").alias("to_us"))
    return first.unionByName(saved).join(ends, ["chapter_id", "revision"], "left")


def chapter_versions(states: DataFrame) -> DataFrame:
    """The history table: a snapshot of each replaced state, one per (chapter, revision)."""
    return states.where(F.col("to_us").isNotNull()).withColumnRenamed("to_us", "saved_us")


def present_chapters(states: DataFrame) -> DataFrame:
    return states.where(F.col("to_us").isNull())


def version_pages(versions: DataFrame, page: int = S.VERSION_PAGE) -> DataFrame:
    """Newest first in pages of 25. ``has_next`` says that the page is full, so the next one is asked for.

    Texts are no part of a list, so none are sorted or written.
    """
    ranked = full_rank(versions.drop("content_json", "plain_text"), ["chapter_id"], [F.desc("revision")], "place")
    paged = ranked.withColumn("page", F.floor((F.col("place") - 1) / page))
    full = paged.groupBy("chapter_id", "page").agg((F.count(F.lit(1)) == page).alias("has_next"))
    return paged.join(full, ["chapter_id", "page"])


def restore_saves(requests: DataFrame, versions: DataFrame, present: DataFrame) -> DataFrame:
    """A restore is an ordinary save of an old snapshot on top of the present revision.

    ``requests``: event_id, chapter_id, revision, at_us. Feed the result to ``save_outcomes``.
    """
    now = present.select("chapter_id", F.col("revision").alias("base_revision"))
    old = versions.select("chapter_id", "revision", "title", "content_json", "plain_text")
    return requests.join(old, ["chapter_id", "revision"]).join(now, "chapter_id").select(
        "event_id", "chapter_id", "at_us", "base_revision", "title", "content_json", "plain_text"
    )


def refused_restores(requests: DataFrame, versions: DataFrame, present: DataFrame) -> DataFrame:
    """event_id and code of the restores that ``restore_saves`` makes no save of: the chapter is gone, or never had that version.

    A request that names no chapter or no revision is refused for the same reasons; together the two hold every request.
    """
    chapters = present.select("chapter_id").distinct().withColumn("_chapter", F.lit(True))
    known = versions.select("chapter_id", "revision").distinct().withColumn("_version", F.lit(True))
    seen = requests.join(chapters, "chapter_id", "left").join(known, ["chapter_id", "revision"], "left")
    code = F.when(F.col("_chapter").isNull(), "NOT_FOUND").when(F.col("_version").isNull(), "VERSION_NOT_FOUND")
    return seen.select("event_id", code.alias("code")).where(F.col("code").isNotNull())


def late_saves(outcomes: DataFrame) -> DataFrame:
    """Saves that came too late: based on a revision already replaced. Time plays no part."""
    return outcomes.where((F.col("outcome") == "REVISION_CONFLICT") & (F.col("base_revision") < F.col("revision_met"))).withColumn(
        "revisions_behind", F.col("revision_met") - F.col("base_revision")
    )
