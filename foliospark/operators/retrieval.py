"""Token index, ranked retrieval for a whole table of questions, and the evidence set of each question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.functions.text import WORD_BREAK, is_blank, query_words, run_length, run_word, strip_spaces, word_runs
from foliospark.operators.access import with_right
from foliospark.operators.chunking import chapter_versions_key
from foliospark.operators.ranking import top_rows
from foliospark.session import cut_lineage


def checked_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into queries that may run and rejects with their code. A null query may run and finds nothing."""
    too_long = F.coalesce(F.length("query") > S.MAX_QUERY_LENGTH, F.lit(False))
    return (
        queries.where(~too_long),
        queries.where(too_long).withColumn("code", F.lit("QUERY_TOO_LONG")),
    )


def question_code(question: Column) -> Column:
    """Null for a question that may be asked, else its reject code."""
    bad = (F.length(strip_spaces(question)) < 3) | (F.length(question) > 1500)
    return F.when(bad, F.lit("INVALID_QUESTION"))


def refused_questions(questions: DataFrame, projects: DataFrame) -> DataFrame:
    """query_id and code of the questions (with ``asker``) that are not asked: their text first, then the right to ask."""
    code = F.coalesce(question_code(F.coalesce("query", F.lit(""))), F.when(~F.col("owned"), F.lit("NOT_FOUND")))
    return with_right(questions, projects).select("query_id", code.alias("code")).where(F.col("code").isNotNull())


def asked_by_owners(questions: DataFrame, projects: DataFrame) -> DataFrame:
    """The questions (with ``asker``) that ``refused_questions`` does not name."""
    return with_right(questions, projects).where(F.col("owned") & question_code(F.coalesce("query", F.lit(""))).isNull()).drop("owned")


def answers_to(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per question asked: how many sources it has, and whether to abstain for want of any."""
    found = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"))
    return questions.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), F.col("sources").isNull().alias("abstained")
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per (query, distinct word); a query without usable words gives none."""
    return queries.select(
        "query_id", "project_id", F.posexplode(query_words(F.col("query"))).alias("term_order", "token")
    ).select("query_id", "project_id", F.col("term_order").cast("long").alias("term_order"), "token")


def exploded_words(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word, lower-cased, in plain generated code; no stemming and no stop words."""
    cut = rows.select(*keep, F.explode(F.split(text, WORD_BREAK)).alias("_word"))
    return cut.where(F.col("_word") != "").select(*keep, F.lower("_word").alias("token"))


def token_positions(chunks: DataFrame, *carry: str) -> DataFrame:
    """One row per word of each chunk, with ``tf`` 1."""
    return exploded_words(chunks, "content", "project_id", "chunk_id", *carry).withColumn("tf", F.lit(1))


def build_index(chunks: DataFrame, *carry: str) -> DataFrame:
    """(project, token, chunk, tf) and, of the chunk, the columns of ``carry``; no shuffle."""
    words = chunks.select("project_id", "chunk_id", *carry, F.explode(word_runs(F.col("content"))).alias("_run"))
    run = F.col("_run")
    return words.select("project_id", run_word(run).alias("token"), "chunk_id", *carry, run_length(run).alias("tf"))


def ready_chapters(chapters: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a chunk must agree with to be used: the present text of a chapter whose index job is ready."""
    ready = jobs.where(F.col("status") == "ready").select("chapter_id")
    return (
        chapter_versions_key(chapters, "title", "position")
        .join(ready, "chapter_id", "left_semi")
        .withColumnsRenamed({"current_revision": "source_revision", "current_hash": "source_hash"})
    )


# What tells a chunk from any other, and what a hit shows of it.
CHUNK_KEYS = ["chunk_id", "project_id", "chapter_id", "source_revision", "source_hash", "chunk_index"]
HIT = ["chunk_id", "chapter_id", "title", "source_revision", "position", "chunk_index"]
# What a row of the stored index has of its chunk. The number stands for chunk_id; it only has to tell the chunks of one chapter apart.
INDEX_KEYS = ["chapter_id", "chunk_key"]
# Chunks whose hits one task counts, for all queries.
CHUNKS_PER_COUNT = 2_000


def with_chunk_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk_key", F.xxhash64("chunk_id"))


def usable_chunks(chunks: DataFrame, chapters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Keys, title and position of the chunks that may be found, each once for every equal row of its chapter (``copy``)."""
    at = ["chapter_id", "project_id", "source_revision", "source_hash"]
    ready = ready_chapters(chapters, jobs).groupBy(*at, "title", "position").agg(F.count(F.lit(1)).alias("copies"))
    rows = chunks.select(*CHUNK_KEYS).join(ready, at).distinct()
    return with_chunk_key(rows).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "source_hash")


def _fact_words(wanted: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """The wanted words of the claims of approved facts whose quote stands in the chunk, one row for each time they stand there.

    Of facts stored with ``grounded`` (see ``with_grounding``) no text is read; without it, the text of chunks that have a
    matching fact is compared.
    """
    stored = "grounded" in facts.columns
    usable = facts.where((F.col("status") == "approved") & (F.col("grounded") if stored else F.lit(True)))
    carry = ["fact_id", "project_id", "chunk_id", *([] if stored else ["quote"])]
    words = exploded_words(usable, "claim", *carry).join(wanted, ["project_id", "token"], "left_semi")
    if not stored:
        text = chunks.select(F.col("chunk_id").alias("_chunk"), F.col("project_id").alias("_project"), "content")
        held = (F.col("chunk_id") == F.col("_chunk")) & (F.col("project_id") == F.col("_project")) & (F.instr(F.col("content"), F.col("quote")) > 0)
        words = words.join(text, held, "left_semi")
    return words


def with_grounding(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The facts with ``grounded``: whether the quote stands in the chunk. A chunk never changes, so this is stored once, with the fact.

    A fact whose chunk is not there, or without a quote, is not grounded.
    """
    text = chunks.select("chunk_id", "project_id", F.col("content").alias("_content"))
    joined = facts.join(text, ["chunk_id", "project_id"], "left")
    return joined.withColumn("grounded", F.coalesce(F.instr(F.col("_content"), F.col("quote")) > 0, F.lit(False))).drop("_content")


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    chapters: DataFrame,
    jobs: DataFrame,
    facts: DataFrame | None = None,
    limit: int = S.RETRIEVED_CHUNKS,
    index: DataFrame | None = None,
) -> DataFrame:
    """The best chunks for every query: a tenth of a point for each matching word position, plus the best fact.

    ``index`` is a stored token index; without it the chunks are read. Words that some query asks for, of texts and of claims
    alike, are brought together by chunk, and only then meet the queries, where Spark's broadcast threshold lets their words
    go to all tasks (20 short words a query at most). So what is moved follows the text and not queries times chunks: all hits
    of a chunk are counted by the task that has its words, and a task passes on as many rows per query as are asked for.
    """
    allowed, _ = checked_queries(queries)
    # Written, so that Spark knows how few they are, however the queries were made.
    terms = cut_lineage(query_terms(allowed).select("query_id", "project_id", "token"))
    wanted = terms.select("project_id", "token").distinct()
    postings = token_positions(with_chunk_key(chunks), *INDEX_KEYS) if index is None else index
    none = F.lit(None).cast("string")
    words = postings.join(wanted, ["project_id", "token"], "left_semi").select("project_id", "token", *INDEX_KEYS, F.col("tf").cast("long").alias("tf"))
    if facts is not None:
        said = with_chunk_key(_fact_words(wanted, chunks, facts))
        said = said.select("project_id", "token", "chunk_key", F.lit(1).cast("long").alias("tf"), "fact_id", F.col("chunk_id").alias("fact_chunk"))
        words = words.withColumns({"fact_id": none, "fact_chunk": none}).unionByName(said, allowMissingColumns=True)
    # A fact does not name its chapter, so with facts the chapter is compared after the join.
    place = ["project_id", "chunk_key"] if facts is not None else ["project_id", *INDEX_KEYS]
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count() // CHUNKS_PER_COUNT)
    usable = usable_chunks(chunks, chapters, jobs).repartition(tasks, *place).hint("shuffle_hash")
    if facts is not None:
        words = words.withColumnRenamed("chapter_id", "_chapter")
    placed = words.repartition(tasks, *place).join(usable, place)
    if facts is not None:
        placed = placed.where(F.coalesce(F.col("_chapter") == F.col("chapter_id"), F.col("fact_chunk") == F.col("chunk_id")))
    by_chunk = ["query_id", "project_id", "chunk_key", *HIT, "copy"]
    met = placed.join(terms, ["project_id", "token"])
    if facts is None:
        scored = met.groupBy(*by_chunk).agg(F.sum("tf").alias("points"))
    else:
        # The best fact of a chunk counts, so the hits of each are summed apart from those of the text.
        each = met.groupBy(*by_chunk, "fact_chunk", "fact_id").agg(F.sum("tf").alias("n"))
        text, fact = F.when(F.col("fact_chunk").isNull(), F.col("n")), F.when(F.col("fact_chunk").isNotNull(), F.col("n"))
        points = F.coalesce(F.sum(text), F.lit(0)) + F.coalesce(F.max(fact), F.lit(0))
        scored = each.groupBy(*by_chunk).agg(points.alias("points"))
    scored = scored.withColumn("score", F.col("points").cast("double") / 10)
    order = [F.col("points").desc(), F.col("position"), F.col("chunk_index"), F.col("chapter_id")]
    return top_rows(scored, ["query_id"], order, limit).select("query_id", "rank", *HIT, "score")


def attach_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunk text to a cut list of hits."""
    return hits.join(chunks.select("chunk_id", "content"), "chunk_id")


def without_neighbours(hits: DataFrame, keep: int = S.EVIDENCE_CHUNKS) -> DataFrame:
    """Drop a hit next to any better hit of the same chapter, then keep the first ones.

    The comparison is with the raw list, so it needs no loop. A query has at most eight hits, which
    makes the collected list bounded.
    """
    columns = [c for c in hits.columns if c != "query_id"]
    ordered = ["rank"] + [c for c in columns if c != "rank"]
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("hits"))
    kept = F.filter(
        F.col("hits"),
        lambda h: ~F.exists(
            F.col("hits"),
            lambda b: (b["rank"] < h["rank"])
            & (b["chapter_id"] == h["chapter_id"])
            & (F.abs(b["chunk_index"] - h["chunk_index"]) <= 1),
        ),
    )
    cut = lists.select("query_id", F.posexplode(F.slice(kept, 1, keep)).alias("place", "hit"))
    return cut.select(
        "query_id", (F.col("place") + 1).cast("long").alias("evidence_rank"), *[F.col(f"hit.{c}").alias(c) for c in columns]
    )


def cast_of(characters: DataFrame, limit: int = S.ALIAS_CHARACTERS) -> DataFrame:
    """One row per project with its first 100 live characters that consent to be used."""
    allowed = characters.where(F.col("include_in_ai_context") & F.col("deleted_at").isNull()).select(
        "project_id", "created_at", "character_id", "name", "aliases"
    )
    first = top_rows(allowed, ["project_id"], [F.col("created_at"), F.col("character_id")], limit)
    return first.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "aliases"))).alias("cast")
    )


def expand_with_aliases(questions: DataFrame, characters: DataFrame) -> DataFrame:
    """Append name and aliases of every character the question mentions, and cut at 2000 characters.

    Characters arrive as one bounded list per project, so no (question, character) pairs are made.
    """
    asked = F.lower("query")

    def mentioned(c: Column) -> Column:
        return F.exists(
            F.concat(F.array(c["name"]), c["aliases"]),
            lambda a: (F.length(a) > 1) & (F.instr(asked, F.lower(a)) > 0),
        )

    none = F.array().cast("array<struct<rank:bigint,name:string,aliases:array<string>>>")
    known = questions.join(cast_of(characters), "project_id", "left").select(
        "query_id", "project_id", "query", F.filter(F.coalesce("cast", none), mentioned).alias("known")
    )
    extra = F.transform("known", lambda c: F.concat(F.lit(" "), c["name"], F.lit(" "), F.array_join(c["aliases"], " ")))
    return known.select(
        "query_id",
        "project_id",
        F.substring(F.concat(F.col("query"), F.array_join(extra, "")), 1, S.MAX_QUERY_LENGTH).alias("query"),
        F.size("known").cast("long").alias("mentioned"),
    )


def ask(
    questions: DataFrame,
    characters: DataFrame,
    chunks: DataFrame,
    chapters: DataFrame,
    jobs: DataFrame,
    facts: DataFrame | None = None,
    index: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Evidence for every valid question. A question without a row here is one to abstain from.

    ``index`` gives the stored index rows of a table of query words.
    """
    valid = questions.where(question_code(F.col("query")).isNull() & ~is_blank(F.col("query")))
    expanded = expand_with_aliases(valid, characters)
    found = index(query_terms(checked_queries(expanded)[0])) if index else None
    return without_neighbours(retrieve(expanded, chunks, chapters, jobs, facts, index=found))


def question_payload(questions: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id and the JSON text that is sent for it: the question and its sources in rank order, six at most."""
    source = F.struct("evidence_rank", "chunk_id", "chapter_id", "title", "source_revision", "chunk_index", "content")
    listed = attach_text(evidence, chunks).groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    shown = F.transform("sources", lambda s: s.dropFields("evidence_rank"))
    return questions.select("query_id", "query").join(listed, "query_id").select(
        "query_id", F.to_json(F.struct(F.col("query").alias("question"), shown.alias("sources"))).alias("payload")
    )
