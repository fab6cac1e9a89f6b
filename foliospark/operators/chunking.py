"""Overlap chunking with exact offsets, and the freshness rule that decides which chunks count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.functions.text import let, md5_text, row_key

# A page holds this many characters plus one chunk span, so every slice lies in one page and
# cutting it never scans the text from its beginning. Long texts stay linear.
PAGE = 16_384
SHORTEST_ADVANCE = S.CHUNK_SPAN - S.BREAK_WINDOW - S.CHUNK_OVERLAP

UP_TO_LAST_BREAK = rf"(?s)^(.*[{S.BREAK_CHARACTERS}])"


def _pages(text: Column) -> Column:
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / PAGE).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(text, i * PAGE + 1, F.lit(PAGE + S.CHUNK_SPAN)),
    )


def _slice(pages: Column, start: Column, length: Column) -> Column:
    """Characters from 1-based ``start``; ``length`` is one chunk span at most."""
    zero = start - 1
    page = F.floor(zero / PAGE).cast("int")
    return F.substring(F.get(pages, page), zero % PAGE + 1, length)


def _finish(pages: Column, start: Column, total: Column) -> Column:
    """Last position of the chunk that starts at ``start``: its last break character, else the full span."""
    full = F.least(start + (S.CHUNK_SPAN - 1), total)

    def nearest_break(end: Column) -> Column:
        tail = _slice(pages, end - S.BREAK_WINDOW, F.lit(S.BREAK_WINDOW + 1))
        through_break = F.length(F.regexp_extract(tail, UP_TO_LAST_BREAK, 1))
        return let(
            through_break,
            lambda kept: F.when(kept > 0, end - S.BREAK_WINDOW + kept - 1).otherwise(end),
        )

    return let(full, lambda end: F.when(end < total, nearest_break(end)).otherwise(end))


def chunk_spans(text: Column) -> Column:
    """array<struct<start_offset, end_offset, content>> of every chunk that is not only spaces."""
    none = F.array().cast("array<struct<start:int,finish:int>>")

    def walk(pages: Column, total: Column) -> Column:
        def step(done: Column, _: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))["finish"]
            return let(
                F.coalesce(last, F.lit(0)),
                lambda end: F.when(end >= total, done).otherwise(
                    let(
                        F.when(end > 0, end - (S.CHUNK_OVERLAP - 1)).otherwise(F.lit(1)),
                        lambda at: F.array_append(
                            done, F.struct(at.alias("start"), _finish(pages, at, total).alias("finish"))
                        ),
                    )
                ),
            )

        steps = F.sequence(F.lit(1), F.ceil(total / SHORTEST_ADVANCE).cast("int") + 1)
        cut = F.transform(
            F.aggregate(steps, none, step),
            lambda s: F.struct(
                (s["start"] - 1).cast("long").alias("start_offset"),
                s["finish"].cast("long").alias("end_offset"),
                _slice(pages, s["start"], s["finish"] - s["start"] + 1).alias("content"),
            ),
        )
        return F.filter(cut, lambda c: F.trim(c["content"]) != "")

    return let(_pages(text), lambda pages: let(F.length(text), lambda total: walk(pages, total)))


def text_hash(chapters: DataFrame) -> Column:
    """The hash stored with the text; a table without one is hashed here."""
    return F.col("text_hash") if "text_hash" in chapters.columns else md5_text(F.col("plain_text"))


def chunk_chapters(chapters: DataFrame) -> DataFrame:
    """One row per chunk of each chapter's present text, numbered in order without gaps."""
    spans = chapters.select(
        "project_id",
        "chapter_id",
        F.col("revision_number").alias("source_revision"),
        text_hash(chapters).alias("source_hash"),
        F.posexplode(chunk_spans(F.col("plain_text"))).alias("chunk_index", "span"),
    )
    return spans.select(
        row_key(F.col("chapter_id"), F.col("source_revision"), F.col("source_hash"), F.col("chunk_index")).alias("chunk_id"),
        "project_id",
        "chapter_id",
        "source_revision",
        "source_hash",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "span.start_offset",
        "span.end_offset",
        "span.content",
    )


def chapter_versions_key(chapters: DataFrame, *extra: str) -> DataFrame:
    """What a chunk must agree with to be current. With a stored hash no text is read."""
    return chapters.select(
        "chapter_id",
        "project_id",
        F.col("revision_number").alias("current_revision"),
        text_hash(chapters).alias("current_hash"),
        *extra,
    )


def with_currency(rows: DataFrame, chapters: DataFrame, *extra: str, how: str = "inner") -> DataFrame:
    """Add ``current``: does the row's source revision and hash equal the chapter's present text.

    Rows of deleted chapters go, or with ``how="left"`` stay with a null.
    """
    now = chapter_versions_key(chapters, *extra)
    joined = rows.join(now, ["chapter_id", "project_id"], how)
    fresh = (F.col("source_revision") == F.col("current_revision")) & (F.col("source_hash") == F.col("current_hash"))
    return joined.withColumn("current", fresh).drop("current_revision", "current_hash")


def current_chunks(chunks: DataFrame, chapters: DataFrame, *extra: str) -> DataFrame:
    """Only current chunks. Freshness is part of the join key, so many old revisions of one chapter spread out."""
    now = chapter_versions_key(chapters, *extra).select(
        "chapter_id",
        "project_id",
        F.col("current_revision").alias("source_revision"),
        F.col("current_hash").alias("source_hash"),
        *extra,
    )
    return chunks.join(now, ["chapter_id", "project_id", "source_revision", "source_hash"])


def offset_violations(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks of the present text whose content is not the text at their offsets."""
    return current_chunks(chunks, chapters, "plain_text").where(
        F.substring("plain_text", (F.col("start_offset") + 1).cast("int"), (F.col("end_offset") - F.col("start_offset")).cast("int"))
        != F.col("content")
    )


def append_chunks(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows to append so that a repeated run adds nothing."""
    key = ["chapter_id", "source_revision", "source_hash", "chunk_index"]
    return fresh.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
