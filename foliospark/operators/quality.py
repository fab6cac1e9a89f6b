"""Data-quality reports: row rules, duplicate keys and orphans, each in one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.functions.text import MODEL_ID, UUID, strip_spaces


def _title(name: str) -> Column:
    return F.length(F.trim(name)).between(1, 200)


def _span(name: str, low: int, high: int) -> Column:
    return F.length(name).between(low, high)


def _json_type(name: str) -> Column:
    """OBJECT, ARRAY, ... of a JSON text; null when it does not parse."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(name)), r"^[A-Z]+", 0)


def _model(name: str) -> Column:
    """Stored as provider:id; one provider takes any id, the other binds it to a pattern."""
    provider, rest = F.substring_index(name, ":", 1), F.substring(name, 8, 1 << 20)
    return F.when(provider == "nebius", rest.rlike(MODEL_ID)).otherwise((provider == "gateway") & (F.length(rest) > 1))


def rules() -> dict[str, dict[str, Column]]:
    """Per table the conditions a row must meet. A condition that is null counts as met, as a check does."""
    c = F.col
    return {
        "projects": {"title_length": _title("title")},
        "chapters": {
            "title_length": _span("title", 1, 200),
            "revision_not_negative": c("revision_number") >= 0,
            "content_is_object": F.coalesce(_json_type("content_json") == "OBJECT", F.lit(False)),
            "text_bytes": F.octet_length("plain_text") <= S.MAX_TEXT_BYTES,
            "content_bytes": F.octet_length("content_json") <= S.MAX_CONTENT_BYTES,
        },
        "memory_jobs": {"status": c("status").isin(*S.JOB_STATUS)},
        "story_facts": {
            "status": c("status").isin(*S.FACT_STATUS),
            "claim_length": _span("claim", 1, S.MAX_FACT_CLAIM),
            "quote_length": _span("quote", 1, S.MAX_QUOTE),
        },
        "ai_generations": {
            "action": c("action").isin(*S.GENERATION_ACTION),
            "status": c("status").isin(*S.GENERATION_STATUS),
            "prompt_length": F.length("prompt") <= 6000,
            "model_id": _model("model"),
        },
        "characters": {"name_length": _title("name")},
        "notes": {"title_length": _title("title")},
        "outline_items": {
            "title_length": _title("title"),
            "item_type": c("item_type").isin(*S.OUTLINE_TYPE),
            "status": c("status").isin(*S.OUTLINE_STATUS),
        },
        "requests": {
            "project_uuid": F.coalesce(c("project_id").rlike(UUID), F.lit(False)),
            "chapter_uuid": c("chapter_id").rlike(UUID),
            "action": c("action").isin(*S.GENERATION_ACTION),
            "instruction": (strip_spaces(c("instruction")) != "") & (F.length("instruction") <= 2000),
            "selection_length": F.length("selection") <= 4000,
            "rewrite_needs_selection": (c("action") != "rewrite") | (strip_spaces(c("selection")) != ""),
            "continue_needs_chapter": (c("action") != "continue") | c("use_chapter"),
            "budget": F.length("prompt") + F.length("system") <= 48000,
            "output_tokens": c("max_output_tokens").between(1, 2400),
        },
    }


def violations(rows: DataFrame, table: str, key: str) -> DataFrame:
    """One row per broken rule; all rules of the table are tested in the same pass."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules()[table].items()])
    )
    return rows.select(
        F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("rule")
    )


def violation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("violations"))


def duplicate_keys(rows: DataFrame, key: list[str], live_only: bool = False) -> DataFrame:
    """Keys held by more than one row; with ``live_only`` among rows that are not archived and have a key."""
    if live_only:
        present = F.col("deleted_at").isNull()
        for name in key:
            present = present & F.col(name).isNotNull()
        rows = rows.where(present)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def orphans(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Children whose parent is missing; a null key refers to nothing and is no orphan."""
    for name in key:
        children = children.where(F.col(name).isNotNull())
    return children.join(parents.select(*key), key, "left_anti")
