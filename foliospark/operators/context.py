"""Context for a writing request: consented sources in a fixed order, packed into a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.functions.text import let
from foliospark.operators.ranking import top_rows

PART = "struct<label:string,text:string,chars:bigint>"


def _part(label: Column, text: Column) -> Column:
    """A source cut to its own cap; ``chars`` keeps the length it had."""
    return F.struct(
        label.alias("label"),
        F.substring(text, 1, S.SOURCE_BUDGET).alias("text"),
        F.length(text).cast("long").alias("chars"),
    )


def consented(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("include_in_ai_context") & F.col("deleted_at").isNull())


def chapter_part(action: Column) -> Column:
    """The chapter as a source; "continue" takes the last 12,000 characters, which is not a cut."""
    title = F.concat(F.lit("Bab: "), F.col("title"), F.lit(" (versi "), F.col("revision_number").cast("string"), F.lit(")"))
    text = F.when(action == "continue", F.right("plain_text", F.lit(S.SOURCE_BUDGET))).otherwise(F.col("plain_text"))
    return let(text, lambda t: _part(title, t))


def _ordered_parts(rows: DataFrame, key: str, limit: int, label: Column, text: Column, out: str) -> DataFrame:
    first = top_rows(rows, ["project_id"], [F.col("created_at"), F.col(key)], limit)
    return first.groupBy("project_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), _part(label, text).alias("part")))), lambda r: r["part"]).alias(out)
    )


def character_json() -> Column:
    return F.to_json(F.struct("name", "aliases", "role", "description", "attributes"))


def bible_json() -> Column:
    return F.to_json(F.struct("premise", "synopsis", "themes", "tone", "style_instructions", "world_rules"))


def project_parts(bibles: DataFrame, characters: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per project: bible, first 20 characters, first 10 notes. Bounded lists of capped texts."""
    b = bibles.select("project_id", F.array(_part(F.lit("Story Bible"), bible_json())).alias("bible"))
    c = _ordered_parts(
        consented(characters), "character_id", S.CONTEXT_CHARACTERS, F.concat(F.lit("Karakter: "), F.col("name")), character_json(), "cast"
    )
    n = _ordered_parts(
        consented(notes), "note_id", S.CONTEXT_NOTES, F.concat(F.lit("Catatan: "), F.col("title")), F.col("plain_text"), "notes"
    )
    return b.join(c, "project_id", "full").join(n, "project_id", "full")


def packed(parts: Column, budget: int = S.CONTEXT_BUDGET) -> Column:
    """struct<used, parts>: each part takes what earlier ones left of the budget; empty ones are dropped."""
    none = F.array().cast("array<struct<label:string,text:string,cut:boolean>>")

    def add(state: Column, part: Column) -> Column:
        room = F.greatest(F.lit(budget) - state["used"], F.lit(0)).cast("int")
        return let(
            F.substring(part["text"], F.lit(1), room),
            lambda text: F.struct(
                (state["used"] + F.length(text)).cast("long").alias("used"),
                F.array_append(
                    state["parts"],
                    F.struct(part["label"].alias("label"), text.alias("text"), (F.length(text) < part["chars"]).alias("cut")),
                ).alias("parts"),
            ),
        )

    zero = F.struct(F.lit(0).cast("long").alias("used"), none.alias("parts"))
    return F.aggregate(parts, zero, add)


def with_chapter(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each request with its chapter's columns, null where it names none or one that is not there."""
    texts = chapters.select("project_id", "chapter_id", "title", "revision_number", "plain_text")
    return requests.join(texts, ["project_id", "chapter_id"], "left")


def refusal() -> Column:
    """Why a request with its chapter is refused; null if it is not."""
    asked = F.col("use_chapter") & F.col("chapter_id").isNotNull()
    return F.when(asked & F.col("title").isNull(), "CONTEXT_UNAVAILABLE").when((F.col("action") == "continue") & ~asked, "CHAPTER_REQUIRED")


def context_rejects(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """request_id and code of the requests that get no context."""
    return with_chapter(requests, chapters).select("request_id", refusal().alias("code")).where(F.col("code").isNotNull())


def assemble_context(
    requests: DataFrame, chapters: DataFrame, bibles: DataFrame, characters: DataFrame, notes: DataFrame
) -> DataFrame:
    """``requests``: request_id, project_id, chapter_id, action, use_chapter, use_bible, use_characters, use_notes.

    The chapter is optional; ``context_rejects`` has the requests that are refused for lack of it. A request has at most 32 parts, so packing is a fold inside its row and needs no shuffle of its own.
    """
    none = F.array().cast(f"array<{PART}>")

    def wanted(flag: str, parts: Column) -> Column:
        return F.when(F.col(flag), F.coalesce(parts, none)).otherwise(none)

    chapter = F.when(F.col("title").isNotNull(), F.array(chapter_part(F.col("action"))))
    joined = (
        with_chapter(requests, chapters)
        .where(refusal().isNull())
        .select(*requests.columns, chapter.alias("chapter"))
        .join(project_parts(bibles, characters, notes), "project_id", "left")
    )
    parts = F.concat(
        wanted("use_chapter", F.col("chapter")),
        wanted("use_bible", F.col("bible")),
        wanted("use_characters", F.col("cast")),
        wanted("use_notes", F.col("notes")),
    )
    filled = joined.withColumn("pack", packed(parts))
    return filled.select(
        "request_id",
        "project_id",
        "action",
        F.filter("pack.parts", lambda p: F.length(p["text"]) > 0).alias("sources"),
        F.exists("pack.parts", lambda p: p["cut"]).alias("truncated"),
    )


def source_rows(contexts: DataFrame) -> DataFrame:
    """One row per included source in order."""
    return contexts.select("request_id", "truncated", F.posexplode("sources").alias("place", "source")).select(
        "request_id",
        F.col("place").cast("long").alias("place"),
        F.col("source.label").alias("label"),
        F.col("source.text").alias("text"),
        "truncated",
    )


def request_payload(contexts: DataFrame, instruction: Column, selection: Column) -> DataFrame:
    """The whole request as one JSON text."""
    parts = F.transform("sources", lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text")))
    return contexts.select(
        "request_id",
        F.to_json(
            F.struct(
                F.col("action"),
                instruction.alias("instruction"),
                selection.alias("selected_text"),
                parts.alias("context"),
                F.col("truncated").alias("context_truncated"),
            )
        ).alias("payload"),
    )


def evidence_labels(evidence: DataFrame) -> DataFrame:
    """The labels of a question's evidence in rank order; six at most."""
    label = F.concat_ws(
        " · ",
        F.col("title"),
        F.concat(F.lit("v"), F.col("source_revision").cast("string")),
        F.concat(F.lit("bagian "), (F.col("chunk_index") + 1).cast("string")),
        F.col("chunk_id"),
    )
    return evidence.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("evidence_rank", label.alias("label")))), lambda r: r["label"]).alias("labels")
    )
