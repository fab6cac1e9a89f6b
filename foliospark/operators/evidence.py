"""Checks on model output: cited claims, extracted facts, and answers put together from valid claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.functions.text import is_blank, row_key, unfence
from foliospark.operators.chunking import with_currency

# Fixed value: the answer given when claims are an empty list.
NO_EVIDENCE = "Bukti yang ditemukan belum cukup untuk menjawab pertanyaan ini."


def _field(value: Column, name: str) -> Column:
    """A string field of a JSON object, null when it is missing or not a string."""
    raw = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def parse_claims(answers: DataFrame) -> DataFrame:
    """Add ``claims``: array of (text, source_id, quote), null when the JSON is no valid answer."""
    raw = F.try_variant_get(F.try_parse_json(unfence(F.col("payload"))), "$.claims", "array<variant>")
    typed = F.transform(
        raw,
        lambda c: F.struct(
            _field(c, "text").alias("text"),
            _field(c, "source_id").alias("source_id"),
            _field(c, "quote").alias("quote"),
        ),
    )
    return answers.withColumn("claims", F.when(F.size(raw) <= S.MAX_CLAIMS, typed))


def check_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per claim with ``valid``. ``sources`` holds the retrieved set: (answer_id, source_id, content).

    The source is found by an equi join and the quote tested on the joined row.
    """
    claims = parse_claims(answers).where(F.col("claims").isNotNull()).select(
        "answer_id", F.posexplode("claims").alias("claim_no", "claim")
    )
    rows = claims.select(
        "answer_id",
        (F.col("claim_no") + 1).cast("long").alias("claim_no"),
        F.col("claim.text").alias("text"),
        F.col("claim.source_id").alias("source_id"),
        F.col("claim.quote").alias("quote"),
    )
    found = rows.join(sources.select("answer_id", "source_id", "content"), ["answer_id", "source_id"], "left")
    return found.withColumn("valid", _valid_claim()).drop("content")


def _valid_claim() -> Column:
    ok = (
        F.col("text").isNotNull()
        & ~is_blank(F.col("text"))
        & (F.length("text") <= S.MAX_CLAIM_TEXT)
        & F.length("quote").between(S.MIN_QUOTE, S.MAX_QUOTE)
        & (F.instr(F.col("content"), F.col("quote")) > 0)
    )
    return F.coalesce(ok, F.lit(False))


def _judged(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per answer with its outcome and its claims, from one parse, one look-up of sources and one grouping.

    An answer has six claims at most, so the collected list is bounded. An answer without claims keeps one empty row.
    """
    parsed = parse_claims(answers).select("answer_id", F.size("claims").alias("n"), F.col("claims").isNull().alias("broken"), F.posexplode_outer("claims").alias("place", "claim"))
    rows = parsed.select(
        "answer_id",
        "n",
        "broken",
        (F.col("place") + 1).cast("long").alias("claim_no"),
        F.col("claim.text").alias("text"),
        F.col("claim.source_id").alias("source_id"),
        F.col("claim.quote").alias("quote"),
    )
    found = rows.join(sources.select("answer_id", "source_id", "content"), ["answer_id", "source_id"], "left")
    part = F.when(F.col("claim_no").isNotNull(), F.struct("claim_no", "text", "source_id", "quote"))
    grouped = found.withColumn("valid", _valid_claim()).groupBy("answer_id").agg(
        F.first("n").alias("n"),
        F.first("broken").alias("broken"),
        F.bool_and("valid").alias("all_valid"),
        F.count("claim_no").alias("claims"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    outcome = (
        F.when(F.col("broken"), "INVALID_ANSWER")
        .when(F.col("n") == 0, "abstained")
        .when(F.col("all_valid"), "accepted")
        .otherwise("UNSUPPORTED_CITATION")
    )
    return grouped.withColumn("outcome", outcome)


def answer_outcomes(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per answer: accepted, abstained, INVALID_ANSWER or UNSUPPORTED_CITATION. One bad claim voids all."""
    return _judged(answers, sources).select("answer_id", "outcome", "claims")


def assemble_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answer text with numbered claims and its citation list, for accepted and abstained answers."""
    text = F.array_join(
        F.transform(F.col("parts"), lambda p: F.concat(p["text"], F.lit(" ["), p["claim_no"].cast("string"), F.lit("]"))),
        "\n\n",
    )
    cited = F.array_join(
        F.transform(F.col("parts"), lambda p: F.concat(p["claim_no"].cast("string"), F.lit(":"), p["source_id"])), ","
    )
    empty = F.size("parts") == 0
    return _judged(answers, sources).where(F.col("outcome").isin("accepted", "abstained")).select(
        "answer_id",
        F.when(empty, F.lit(NO_EVIDENCE)).otherwise(text).alias("answer"),
        F.when(empty, F.lit("")).otherwise(cited).alias("citations"),
        (F.col("outcome") == "abstained").alias("abstained"),
    )


def citation_list(answers: DataFrame, sources: DataFrame, chapters: DataFrame) -> DataFrame:
    """The numbered citations of accepted answers: quote, source, chapter, title and revision of each.

    An answer is accepted if all its claims are valid, so the claims alone decide and are checked once.
    """
    checked = check_claims(answers, sources)
    accepted = checked.groupBy("answer_id").agg(F.bool_and("valid").alias("ok")).where("ok").select("answer_id")
    where = sources.select("answer_id", "source_id", "chapter_id", "source_revision")
    titles = chapters.select("chapter_id", "title")
    return (
        checked.join(accepted, "answer_id")
        .join(where, ["answer_id", "source_id"])
        .join(titles, "chapter_id", "left")
        .select("answer_id", F.col("claim_no").alias("number"), "quote", "source_id", "chapter_id", "title", F.col("source_revision").alias("revision"))
    )


def void_stale(outcomes: DataFrame, cited: DataFrame, chapters: DataFrame) -> DataFrame:
    """Re-check after answering: one changed or deleted source voids the answer. ``cited`` lists all retrieved sources."""
    stale = (
        with_currency(cited, chapters, how="left")
        .groupBy("answer_id")
        .agg(F.bool_or(~F.coalesce("current", F.lit(False))).alias("changed"))
    )
    return outcomes.join(stale, "answer_id", "left").withColumn(
        "outcome",
        F.when(F.col("changed") & F.col("outcome").isin("accepted", "abstained"), "STALE_SOURCE").otherwise(F.col("outcome")),
    ).drop("changed")


def parse_analyses(analyses: DataFrame) -> DataFrame:
    """Add ``summary`` and ``facts`` read from the payload, and ``code`` for a payload that is refused as a whole."""
    doc = F.try_parse_json(unfence(F.col("payload")))
    raw = F.try_variant_get(doc, "$.facts", "array<variant>")
    summary = _field(doc, "summary")
    typed = F.transform(
        raw, lambda f: F.struct(_field(f, "claim").alias("claim"), _field(f, "quote").alias("quote"))
    )
    good = (
        summary.isNotNull()
        & ~is_blank(summary)
        & (F.length(summary) <= S.MAX_SUMMARY)
        & raw.isNotNull()
        & (F.size(raw) <= S.MAX_FACTS)
    )
    return analyses.select(
        "*",
        summary.alias("summary"),
        typed.alias("facts"),
        F.when(~F.coalesce(good, F.lit(False)), F.lit("INVALID_INSIGHTS")).alias("code"),
    )


def _own_generation(analyses: DataFrame, generations: DataFrame | None) -> DataFrame:
    """Add the project of the generation that made each analysis, if its user is the one who asks."""
    if generations is None:
        return analyses.withColumn("_made_for", F.lit(None).cast("string"))
    made = generations.select("generation_id", "user_id", F.col("project_id").alias("_made_for"))
    return analyses.join(made, ["generation_id", "user_id"], "left")


def analysis_outcomes(
    analyses: DataFrame, chunks: DataFrame, chapters: DataFrame, insights: DataFrame, generations: DataFrame | None = None
) -> DataFrame:
    """Decide each analysis: NOT_FOUND, STALE_SOURCE, existing, INVALID_INSIGHTS, or saved (first per chunk).

    With ``generations``, an analysis names its generation_id and user_id; a generation that does not exist, is
    somebody else's or of another project than the chunk gives NOT_FOUND too.
    """
    strange = F.lit(False) if generations is None else ~F.coalesce(F.col("_made_for") == F.col("project_id"), F.lit(False))
    made_by = F.col("generation_id") if "generation_id" in analyses.columns else F.lit(None).cast("string").alias("generation_id")
    currency = with_currency(chunks, chapters).select("chunk_id", "project_id", "content", "current")
    known = insights.select("chunk_id").distinct().withColumn("has_insight", F.lit(True))
    judged = (
        _own_generation(parse_analyses(analyses), generations)
        .join(currency, "chunk_id", "left")
        .join(known, "chunk_id", "left")
        .withColumn(
            "outcome",
            F.when(F.col("current").isNull(), "NOT_FOUND")
            .when(~F.col("current"), "STALE_SOURCE")
            .when(F.coalesce("has_insight", F.lit(False)), "existing")
            .when(strange, "NOT_FOUND")
            .when(F.col("code").isNotNull(), F.col("code"))
            .otherwise("saved"),
        )
    )
    first = (
        judged.where(F.col("outcome") == "saved")
        .groupBy("chunk_id")
        .agg(F.min(F.struct("created_at", "analysis_id"))["analysis_id"].alias("first_id"))
    )
    return (
        judged.join(first, "chunk_id", "left")
        .withColumn(
            "outcome",
            F.when((F.col("outcome") == "saved") & (F.col("first_id") != F.col("analysis_id")), "existing").otherwise(
                F.col("outcome")
            ),
        )
        .select("analysis_id", "chunk_id", "project_id", made_by, "created_at", "summary", "facts", "content", "outcome")
    )


def accepted_insights(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == "saved").select(
        row_key(F.lit("insight"), F.col("chunk_id")).alias("insight_id"), "project_id", "chunk_id", "generation_id", "summary", "created_at"
    )


def accepted_facts(outcomes: DataFrame) -> DataFrame:
    """Facts of saved analyses whose quote stands in the chunk; the others are dropped one by one."""
    rows = outcomes.where(F.col("outcome") == "saved").select(
        "project_id", "chunk_id", "content", "created_at", F.posexplode("facts").alias("fact_no", "fact")
    )
    good = (
        F.length("fact.claim").between(1, S.MAX_FACT_CLAIM)
        & F.length("fact.quote").between(S.MIN_QUOTE, S.MAX_QUOTE)
        & (F.instr(F.col("content"), F.col("fact.quote")) > 0)
    )
    return rows.where(good).select(
        row_key(F.lit("fact"), F.col("chunk_id"), F.col("fact_no")).alias("fact_id"),
        "project_id",
        "chunk_id",
        F.col("fact.claim").alias("claim"),
        F.col("fact.quote").alias("quote"),
        F.lit("pending").alias("status"),
        F.lit(0).cast("long").alias("revision"),
        "created_at",
    )
