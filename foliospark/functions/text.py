"""Column functions for text: tokens, trims, excerpts, hashes, counts, redaction.

All of them are built-in expressions, so they stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from foliospark import schemas as S

# Question words that never help retrieval.
STOP_WORDS = (
    "apa siapa kapan dimana mana bagaimana mengapa kenapa yang dan atau dengan untuk dari pada dalam adalah itu ini "
    "pernah tentang the what where when does and was said did"
).split()

# Fixed value: everything that is neither a letter nor a number separates words.
WORD_BREAK = r"[^\p{L}\p{N}]+"

# Fixed value: marks left by hidden reasoning.
REASONING_TAG = r"(?i)</?think(?:ing)?>"

# Fixed value: the accepted shape of a restricted model id.
MODEL_ID = r"(?i)^nvidia/[a-z0-9._-]*nemotron[a-z0-9._-]*$"

# Fixed value: the accepted shape of a uuid.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# Fixed value: the prefix that marks a question to the memory.
ASK_PREFIX = "[Ask My Story]"

# Fixed value: the prefix that marks the analysis of a chunk.
ANALYZE_PREFIX = "[Memory]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def md5_text(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def query_words(text: Column) -> Column:
    """The distinct words of a question that take part in retrieval, first occurrence first, 20 at most."""
    long_words = F.filter(F.split(text, WORD_BREAK), lambda w: F.length(w) > 2)
    lowered = F.transform(long_words, lambda w: F.lower(w))
    kept = F.filter(lowered, lambda w: ~w.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, S.MAX_QUERY_TERMS)


def strip_spaces(text: Column) -> Column:
    """Strip every kind of white space at both ends (plain ``trim`` strips spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip_spaces(text) == ""


# One word of a sorted line and its repeats. The last loop gives nothing back, so long runs need no stack.
RUN_OF_WORD = r"(\S++)(?: \1(?= |$))*+"


def word_runs(text: Column) -> Column:
    """The words of a text in lower case and sorted order, equal ones in one string, parted by single spaces.

    Words are brought together inside the row, so that counting a whole table moves nothing, and without lambdas, so
    that it stays in generated code.
    """
    words = F.split(F.lower(F.array_join(F.split(text, WORD_BREAK), " ")), " ")
    return F.regexp_extract_all(F.ltrim(F.array_join(F.sort_array(words), " ")), F.lit(RUN_OF_WORD), F.lit(0))


def run_word(run: Column) -> Column:
    return F.substring_index(run, " ", 1)


def run_length(run: Column) -> Column:
    return ((F.length(run) + 1) / (F.length(run_word(run)) + 1)).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def pseudonym(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 24)


def row_key(*parts: Column) -> Column:
    """A repeatable id, so a rebuild writes the same keys."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def alias_list(text: Column) -> Column:
    parts = F.transform(F.split(text, ","), strip_spaces)
    return F.filter(parts, lambda p: p != "")


def redact(text: Column, limit: int = 400) -> Column:
    return F.substring(F.regexp_replace(text, r"Bearer\s+\S+", "Bearer [redacted]"), 1, limit)


def unfence(text: Column) -> Column:
    """Remove a Markdown code fence around a JSON answer."""
    opened = F.regexp_replace(strip_spaces(text), r"^```(?:json)?\s*", "")
    return F.regexp_replace(opened, r"\s*```$", "")


def rejected_output(text: Column) -> Column:
    return is_blank(text) | text.rlike(REASONING_TAG)


def excerpt(body: Column, hit: Column) -> Column:
    """260 characters from 60 before the hit, with an ellipsis where text is cut off."""
    start = F.greatest(F.lit(1), hit - S.EXCERPT_LEAD)
    return F.concat(
        F.when(hit > S.EXCERPT_LEAD, F.lit("…")).otherwise(F.lit("")),
        F.substring(body, start, F.lit(S.EXCERPT_LENGTH)),
        F.when(F.length(body) > start + (S.EXCERPT_LENGTH - 1), F.lit("…")).otherwise(F.lit("")),
    )


def contains_literal(text: Column, needle: Column) -> Column:
    """Case-insensitive containment without wildcards."""
    return F.instr(F.lower(text), F.lower(needle)) > 0


def model_task(action: Column) -> Column:
    return (
        F.when(action.isin("chat", "ask"), "qa")
        .when(action == "analyze", "memory")
        .when(action == "brainstorm", "planner")
        .when(action.isin("rewrite", "continue"), "writer")
    )


def workflow(prompt: Column) -> Column:
    """Which part of the product made a generation, from the mark its prompt begins with."""
    return (
        F.when(prompt.startswith(ASK_PREFIX), "memory-ask")
        .when(prompt.startswith(ANALYZE_PREFIX), "memory-analyze")
        .otherwise("assistant")
    )


def retry_delay_seconds(attempts: Column) -> Column:
    """Seconds until the next try, from the number of attempts before this failure."""
    return (F.lit(S.BACKOFF_SECONDS) * F.pow(F.lit(2), attempts)).cast("long")

