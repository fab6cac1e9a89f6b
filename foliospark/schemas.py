"""Table schemas and the fixed limits every operator shares."""

from pyspark.sql import types as T

# Chunking, in code points.
CHUNK_SPAN = 3200
CHUNK_OVERLAP = 320
BREAK_WINDOW = 700
BREAK_CHARACTERS = "\n.!? "

# Retrieval and answering.
MAX_QUERY_TERMS = 20
MAX_QUERY_LENGTH = 2000
RETRIEVED_CHUNKS = 8
EVIDENCE_CHUNKS = 6
MAX_CLAIMS = 6
MAX_CLAIM_TEXT = 1200
MIN_QUOTE = 5
MAX_QUOTE = 1000
MAX_SUMMARY = 3000
MAX_FACTS = 8
MAX_FACT_CLAIM = 1000
ALIAS_CHARACTERS = 100

# Context packing.
SOURCE_BUDGET = 12000
CONTEXT_BUDGET = 22000
CONTEXT_CHARACTERS = 20
CONTEXT_NOTES = 10

# Literal search.
SEARCH_PAGE = 20
SEARCH_MIN = 2
SEARCH_MAX = 100
SEARCH_MAX_OFFSET = 10000
EXCERPT_LEAD = 60
EXCERPT_LENGTH = 260

# Saves, jobs and quotas.
MAX_TEXT_BYTES = 2_000_000
MAX_CONTENT_BYTES = 4_000_000
DEBOUNCE_SECONDS = 45
BACKOFF_SECONDS = 30
MAX_ATTEMPTS = 3
DISPATCH_BATCH = 5
DAILY_LIMIT = 20
DAY_SECONDS = 86_400
SPACING_SECONDS = 10
VERSION_PAGE = 25

# Overview list lengths.
OVERVIEW_CHUNKS = 500
OVERVIEW_INSIGHTS = 100
OVERVIEW_FACTS = 100

# Enumerations checked by the constraint report.
JOB_STATUS = ("queued", "ready", "failed")
FACT_STATUS = ("pending", "approved", "ignored")
GENERATION_ACTION = ("chat", "rewrite", "continue", "brainstorm")
GENERATION_STATUS = ("pending", "complete", "error")
OUTLINE_TYPE = ("act", "part", "chapter", "scene", "beat", "custom")
OUTLINE_STATUS = ("planned", "in_progress", "drafted", "revised", "complete")


def _struct(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(),
        "l": T.LongType(),
        "i": T.IntegerType(),
        "b": T.BooleanType(),
        "t": T.TimestampType(),
        "a": T.ArrayType(T.StringType()),
        "m": T.MapType(T.StringType(), T.StringType()),
        "d": T.DecimalType(18, 6),
    }
    return T.StructType(
        [T.StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in spec.split())]
    )


TABLES = {
    "projects": _struct("project_id:s owner_id:s title:s description:s genre:s manuscript_language:s created_at:t updated_at:t"),
    "chapters": _struct("chapter_id:l project_id:s title:s content_json:s plain_text:s text_hash:s revision_number:l position:l created_at:t updated_at:t"),
    "chapter_versions": _struct("chapter_id:l project_id:s revision_number:l title:s content_json:s plain_text:s created_at:t"),
    "memory_jobs": _struct("chapter_id:l project_id:s source_revision:l source_hash:s status:s attempts:l available_at:t error:s"),
    "story_chunks": _struct(
        "chunk_id:s project_id:s chapter_id:l source_revision:l source_hash:s chunk_index:l start_offset:l end_offset:l content:s"
    ),
    "memory_insights": _struct("insight_id:s project_id:s chunk_id:s generation_id:s summary:s created_at:t"),
    "story_facts": _struct("fact_id:s project_id:s chunk_id:s claim:s quote:s status:s revision:l created_at:t"),
    "ai_generations": _struct(
        "generation_id:l user_id:s project_id:s action:s prompt:s result:s model:s status:s context_sources:a "
        "token_usage:s estimated_cost_usd:d created_at:t"
    ),
    "characters": _struct(
        "character_id:l project_id:s name:s aliases:a role:s attributes:m description:s include_in_ai_context:b "
        "revision:l deleted_at:t created_at:t"
    ),
    "story_bibles": _struct("bible_id:l project_id:s premise:s synopsis:s themes:s tone:s style_instructions:s world_rules:s"),
    "notes": _struct("note_id:l project_id:s title:s note_type:s plain_text:s include_in_ai_context:b revision:l deleted_at:t created_at:t"),
    "outline_items": _struct(
        "item_id:l project_id:s title:s description:s item_type:s status:s position:l chapter_id:l revision:l deleted_at:t created_at:t"
    ),
}
