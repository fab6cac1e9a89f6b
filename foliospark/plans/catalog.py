"""Every query by name: the Spark plan over the whole corpus and, where SQL can say it, the SQL for the check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.functions import text as X
from foliospark.operators import (
    access,
    chunking,
    context,
    evidence,
    jobs,
    quality,
    quota,
    ranking,
    reports,
    retrieval,
    review,
    revisions,
    search,
)
from foliospark.plans.oracle import sql, words
from foliospark.session import cut_lineage, run_folder
from foliospark.sources.fixtures import EPOCH_US, Corpus
from foliospark.streaming import folds, refresh, replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The moment "now" for due-work queries: half of the jobs are due by then.
NOW_US = EPOCH_US + 500 * 1_000_000


def query(name: str, oracle: str | None = None):
    def register(plan: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Corpus(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def digest(name: str) -> Column:
    return X.md5_text(F.col(name))


# --- chunks and index ---------------------------------------------------------------------------------------


@query(
    "chunk_overlap",
    sql(
        "SELECT chunk_id, chapter_id, chunk_index, start_offset, end_offset, md5(content) AS content_hash FROM fresh_chunks",
        "fresh_chunks",
    ),
)
def chunk_overlap(c: Corpus) -> DataFrame:
    return c.fresh_chunks.select(
        "chunk_id", "chapter_id", "chunk_index", "start_offset", "end_offset", digest("content").alias("content_hash")
    )


@query(
    "chunk_offset_check",
    sql(
        """SELECT count(*) AS chunks, CAST(count_if(substring(c.plain_text, p.start_offset + 1, p.end_offset - p.start_offset) <> p.content) AS BIGINT) AS violations
           FROM fresh_chunks p JOIN chapters c USING (chapter_id)""",
        "fresh_chunks",
    ),
)
def chunk_offset_check(c: Corpus) -> DataFrame:
    broken = chunking.offset_violations(c.fresh_chunks, c.chapters).select(F.lit(0).alias("chunks"), F.lit(1).alias("bad"))
    every = c.fresh_chunks.select(F.lit(1).alias("chunks"), F.lit(0).alias("bad"))
    return every.unionByName(broken).agg(F.sum("chunks").alias("chunks"), F.sum("bad").alias("violations"))


@query(
    "token_index",
    sql(
        f"""SELECT project_id, token, chunk_id, count(*) AS tf
            FROM (SELECT project_id, chunk_id, unnest({words('content')}) AS token FROM chunks) GROUP BY ALL""",
        "chunks",
    ),
)
def token_index(c: Corpus) -> DataFrame:
    """The index of the stored chunks."""
    return retrieval.build_index(c.chunks)


@query(
    "chunk_append",
    sql(
        """SELECT f.chunk_id, f.chapter_id, f.source_revision, f.chunk_index FROM fresh_chunks f
           WHERE NOT EXISTS (SELECT 1 FROM chunks s WHERE s.chapter_id = f.chapter_id AND s.source_revision = f.source_revision
             AND s.source_hash = f.source_hash AND s.chunk_index = f.chunk_index)""",
        "fresh_chunks",
        "chunks",
    ),
)
def chunk_append(c: Corpus) -> DataFrame:
    return chunking.append_chunks(c.chunks, c.fresh_chunks).select("chunk_id", "chapter_id", "source_revision", "chunk_index")


@query(
    "chunk_currency",
    sql(
        """SELECT s.chunk_id, s.chapter_id, c.title, s.source_revision = c.revision_number AND s.source_hash = c.text_hash AS current
           FROM chunks s JOIN chapters c ON c.chapter_id = s.chapter_id AND c.project_id = s.project_id""",
        "chunks",
    ),
)
def chunk_currency(c: Corpus) -> DataFrame:
    return chunking.with_currency(c.chunks, c.chapter_keys, "title").select("chunk_id", "chapter_id", "title", "current")


# --- retrieval ----------------------------------------------------------------------------------------------


@query(
    "query_tokens",
    sql(
        """SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS term_order,
           string_agg(token, ' | ') OVER (PARTITION BY query_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS any_of
           FROM terms""",
        "terms",
    ),
)
def query_tokens(c: Corpus) -> DataFrame:
    allowed, _ = retrieval.checked_queries(c.questions)
    any_of = allowed.select("query_id", F.array_join(X.query_words(F.col("query")), " | ").alias("any_of"))
    return retrieval.query_terms(allowed).join(any_of, "query_id").select("query_id", "token", "term_order", "any_of")


_RANKED = """SELECT query_id, rank, chunk_id, chapter_id, title, source_revision, position, chunk_index, score FROM (
  SELECT h.query_id, s.chunk_id, s.chapter_id, s.title, s.source_revision, s.position, s.chunk_index,
    CAST(h.points AS DOUBLE) / 10 AS score,
    row_number() OVER (PARTITION BY h.query_id ORDER BY h.points DESC, s.position, s.chunk_index, s.chapter_id) AS rank
  FROM hits h JOIN live s ON s.chunk_id = h.chunk_id) WHERE rank <= 8"""


@query("retrieve_topk", sql(_RANKED.replace("hits h", "(SELECT query_id, chunk_id, hits AS points FROM word_hits) h"), "word_hits"))
def retrieve_topk(c: Corpus) -> DataFrame:
    return retrieval.retrieve(c.questions, c.chunks, c.chapter_keys, c.jobs, index=c.index_for(c.questions))


_BOOSTED = """(SELECT query_id, chunk_id, coalesce(w.hits, 0) + coalesce(f.hits, 0) AS points
  FROM word_hits w FULL JOIN fact_hits f USING (query_id, chunk_id)) h"""


@query("retrieve_fact_boost", sql(_RANKED.replace("hits h", _BOOSTED), "word_hits", "fact_hits"))
def retrieve_fact_boost(c: Corpus) -> DataFrame:
    return retrieval.retrieve(c.questions, c.chunks, c.chapter_keys, c.jobs, c.grounded_facts, index=c.index_for(c.questions))


def _asked_sql(body: str) -> str:
    """The question table replaced by the one expanded with the names of mentioned characters."""
    expanded = """SELECT q.query_id, q.project_id, substring(q.query || coalesce(x.extra, ''), 1, 2000) AS query, coalesce(x.n, 0) AS mentioned
      FROM (SELECT item_id AS query_id, 'src' || (item_id % 20) AS project_id, text AS query FROM benchmark
        WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 3 AND length(text) <= 1500) q
      LEFT JOIN (SELECT q.item_id AS query_id, count(*) AS n,
          string_agg(' ' || k.name || ' ' || array_to_string(k.aliases, ' '), '' ORDER BY k.created_at, k.character_id) AS extra
        FROM benchmark q JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, character_id) AS n
            FROM characters WHERE include_in_ai_context AND deleted_at IS NULL) WHERE n <= 100) k
          ON k.project_id = 'src' || (q.item_id % 20)
          AND len(list_filter(list_concat([k.name], k.aliases), lambda a: length(a) > 1 AND contains(lower(q.text), lower(a)))) > 0
        GROUP BY 1) x ON x.query_id = q.query_id"""
    plain = "SELECT item_id AS query_id, 'src' || (item_id % 20) AS project_id, text AS query FROM benchmark"
    full = sql(body, "characters", "word_hits", "fact_hits")
    return full.replace(f"questions AS ({plain})", f"questions AS ({expanded})")


@query("alias_expansion", _asked_sql("SELECT query_id, project_id, md5(query) AS query_hash, mentioned FROM questions"))
def alias_expansion(c: Corpus) -> DataFrame:
    valid = c.questions.where(retrieval.question_code(F.col("query")).isNull())
    return retrieval.expand_with_aliases(valid, c.characters).select(
        "query_id", "project_id", digest("query").alias("query_hash"), "mentioned"
    )


_EVIDENCE = (
    "(SELECT query_id, chunk_id, chapter_id, title, source_revision, chunk_index, score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY rank) AS evidence_rank FROM "
    f"({_RANKED.replace('hits h', _BOOSTED)}) a WHERE NOT EXISTS (SELECT 1 FROM ({_RANKED.replace('hits h', _BOOSTED)}) b "
    "WHERE b.query_id = a.query_id AND b.rank < a.rank AND b.chapter_id = a.chapter_id AND abs(b.chunk_index - a.chunk_index) <= 1))"
)


@query(
    "ask_evidence",
    _asked_sql(
        f"SELECT query_id, evidence_rank, chunk_id, chapter_id, title, source_revision, chunk_index, score FROM {_EVIDENCE} WHERE evidence_rank <= 6"
    ),
)
def ask_evidence(c: Corpus) -> DataFrame:
    found = retrieval.ask(c.questions, c.characters, c.chunks, c.chapter_keys, c.jobs, c.grounded_facts, c.index)
    return found.select("query_id", "evidence_rank", "chunk_id", "chapter_id", "title", "source_revision", "chunk_index", "score")


_OWN = "item_id % 6 <> 0"
_SOUND = "item_id % 9 <> 4 AND item_id % 11 <> 5"


@query(
    "ask_answers",
    _asked_sql(
        f"""SELECT b.item_id AS query_id, coalesce(n, 0) AS sources, n IS NULL AS abstained
            FROM (SELECT item_id FROM benchmark WHERE {_OWN} AND {_SOUND}) b
            LEFT JOIN (SELECT query_id, count(*) AS n FROM {_EVIDENCE} WHERE evidence_rank <= 6 GROUP BY 1) e ON e.query_id = b.item_id"""
    ),
)
def ask_answers(c: Corpus) -> DataFrame:
    """Only owners are answered; a question without evidence has a row that says so."""
    own = retrieval.asked_by_owners(c.asked, c.projects)
    return retrieval.answers_to(own, retrieval.ask(own, c.characters, c.chunks, c.chapter_keys, c.jobs, c.grounded_facts, c.index))


@query(
    "query_rejects",
    f"SELECT item_id AS query_id, CASE WHEN {_SOUND} THEN 'NOT_FOUND' ELSE 'INVALID_QUESTION' END AS code FROM benchmark WHERE NOT ({_OWN} AND {_SOUND})",
)
def query_rejects(c: Corpus) -> DataFrame:
    return retrieval.refused_questions(c.asked, c.projects)


@query(
    "search_rejects",
    f"""SELECT item_id AS request_id, CASE WHEN item_id % 7 <> 3 AND item_id % 13 <> 6 THEN 'NOT_FOUND' ELSE 'INVALID_SEARCH' END AS code
        FROM benchmark WHERE NOT ({_OWN} AND item_id % 7 <> 3 AND item_id % 13 <> 6)""",
)
def search_rejects(c: Corpus) -> DataFrame:
    return search.refused_searches(c.asked_searches, c.projects)


@query(
    "evidence_labels",
    _asked_sql(
        f"""SELECT query_id, string_agg(title || ' · v' || source_revision || ' · bagian ' || (chunk_index + 1) || ' · ' || chunk_id, '; '
            ORDER BY evidence_rank) AS labels FROM {_EVIDENCE} WHERE evidence_rank <= 6 GROUP BY 1"""
    ),
)
def evidence_labels(c: Corpus) -> DataFrame:
    found = retrieval.ask(c.questions, c.characters, c.chunks, c.chapter_keys, c.jobs, c.grounded_facts, c.index)
    return context.evidence_labels(found).select("query_id", F.array_join("labels", "; ").alias("labels"))


@query(
    "question_payload",
    _asked_sql(
        f"""SELECT e.query_id, md5(q.query) AS question_hash, e.evidence_rank AS place, e.chunk_id, e.chapter_id, e.title, e.source_revision, e.chunk_index,
              md5(s.content) AS text_hash
            FROM {_EVIDENCE} e JOIN chunks s USING (chunk_id) JOIN (SELECT item_id AS query_id, text AS query FROM benchmark) q ON q.query_id = e.query_id
            WHERE e.evidence_rank <= 6"""
    ),
)
def question_payload(c: Corpus) -> DataFrame:
    """What is sent for each question, as its reader parses it."""
    found = retrieval.ask(c.questions, c.characters, c.chunks, c.chapter_keys, c.jobs, c.grounded_facts, c.index)
    made = retrieval.question_payload(c.questions, found, c.chunks)
    source = "chunk_id string, chapter_id bigint, title string, source_revision bigint, chunk_index bigint, content string"
    read = made.select("query_id", F.from_json("payload", "question string, sources array<struct<" + ",".join(":".join(f.split()) for f in source.split(", ")) + ">>").alias("p"))
    parts = read.select("query_id", digest("p.question").alias("question_hash"), F.posexplode("p.sources").alias("n", "s"))
    return parts.select("query_id", "question_hash", (F.col("n") + 1).cast("long").alias("place"), "s.*").withColumn("text_hash", digest("content")).drop("content")


# --- literal search -----------------------------------------------------------------------------------------

_SEARCH = """SELECT request_id, n - page_offset AS place, kind, source_id, heading, excerpt, n > page_offset + 20 AS look_ahead FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY kind, heading, source_id) AS n FROM (
    SELECT request_id, page_offset, kind, source_id, heading,
      CASE WHEN hit > 60 THEN '…' ELSE '' END || substring(body, greatest(1, hit - 60), 260)
        || CASE WHEN length(body) > greatest(1, hit - 60) + 259 THEN '…' ELSE '' END AS excerpt
    FROM (SELECT r.request_id, r.page_offset, t.*, instr(lower(t.body), lower(trim(r.query))) AS hit
      FROM searches r JOIN texts t ON t.project_id = r.project_id WHERE length(trim(r.query)) BETWEEN 2 AND 100)
    WHERE hit > 0)) WHERE n BETWEEN page_offset + 1 AND page_offset + 21"""


@query("project_search", sql(_SEARCH, "texts", "searches"))
def project_search(c: Corpus) -> DataFrame:
    texts = search.searchable(c.chapters, c.characters, c.bibles, c.notes, c.outline)
    return search.search(c.searches, texts)


@query(
    "search_sources",
    sql("SELECT project_id, kind, count(*) AS texts, CAST(sum(length(body)) AS BIGINT) AS characters FROM texts GROUP BY ALL", "texts"),
)
def search_sources(c: Corpus) -> DataFrame:
    texts = search.searchable(c.chapters, c.characters, c.bibles, c.notes, c.outline)
    return texts.groupBy("project_id", "kind").agg(
        count().alias("texts"), F.sum(F.length("body")).cast("long").alias("characters")
    )


@query("title_filter", sql("SELECT project_id, title FROM projects WHERE contains(lower(title), lower('SRC1'))", "projects"))
def title_filter(c: Corpus) -> DataFrame:
    return reports.title_matches(c.projects, "SRC1").select("project_id", "title")


# --- access -------------------------------------------------------------------------------------------------


@query(
    "tenant_scope",
    sql(
        """SELECT chapter_id, project_id, title FROM chapters c
           WHERE EXISTS (SELECT 1 FROM projects p WHERE p.project_id = c.project_id AND p.owner_id = 'user3')""",
        "chapters",
        "projects",
    ),
)
def tenant_scope(c: Corpus) -> DataFrame:
    return access.scoped(c.chapters, c.projects, "user3").select("chapter_id", "project_id", "title")


@query(
    "tenant_leaks",
    sql(
        """SELECT p.owner_id, count(*) AS visible_rows, count(*) FILTER (WHERE q.owner_id IS DISTINCT FROM p.owner_id) AS leaked_rows
           FROM chunks s JOIN projects p USING (project_id) LEFT JOIN chapters c USING (chapter_id) LEFT JOIN projects q ON q.project_id = c.project_id
           GROUP BY 1""",
        "chunks",
        "chapters",
        "projects",
    ),
)
def tenant_leaks(c: Corpus) -> DataFrame:
    leaked = access.leaked_rows(c.chunks, c.chapters, c.projects, "chapter_id").groupBy("owner_id").agg(count().alias("leaked"))
    visible = access.visible_counts(c.chunks, c.projects)
    return visible.join(leaked, "owner_id", "left").select(
        "owner_id", "visible_rows", F.coalesce("leaked", F.lit(0)).cast("long").alias("leaked_rows")
    )


# --- evidence checks ----------------------------------------------------------------------------------------


@query("citation_validate", sql("SELECT answer_id, outcome, claims FROM answer_outcomes", "answer_outcomes"))
def citation_validate(c: Corpus) -> DataFrame:
    return evidence.answer_outcomes(c.answers, c.answer_sources)


@query("claim_check", sql("SELECT answer_id, claim_no, text, source_id, md5(quote) AS quote_hash, valid FROM claims", "claims"))
def claim_check(c: Corpus) -> DataFrame:
    checked = evidence.check_claims(c.answers, c.answer_sources)
    return checked.select("answer_id", "claim_no", "text", "source_id", digest("quote").alias("quote_hash"), "valid")


@query(
    "answer_assembly",
    sql(
        f"""SELECT o.answer_id, coalesce(x.answer, '{evidence.NO_EVIDENCE}') AS answer, coalesce(x.citations, '') AS citations,
              o.outcome = 'abstained' AS abstained
            FROM answer_outcomes o LEFT JOIN (SELECT answer_id, string_agg(text || ' [' || claim_no || ']', chr(10) || chr(10) ORDER BY claim_no) AS answer,
              string_agg(claim_no || ':' || source_id, ',' ORDER BY claim_no) AS citations FROM claims GROUP BY 1) x USING (answer_id)
            WHERE o.outcome IN ('accepted', 'abstained')""",
        "answer_outcomes",
    ),
)
def answer_assembly(c: Corpus) -> DataFrame:
    return evidence.assemble_answers(c.answers, c.answer_sources)


@query(
    "answer_citations",
    sql(
        """SELECT c.answer_id, c.claim_no AS number, md5(c.quote) AS quote_hash, c.source_id, s.chapter_id, h.title, s.source_revision AS revision
           FROM claims c JOIN answer_outcomes o ON o.answer_id = c.answer_id AND o.outcome = 'accepted'
           JOIN answer_sources s ON s.answer_id = c.answer_id AND s.source_id = c.source_id LEFT JOIN chapters h ON h.chapter_id = s.chapter_id""",
        "answer_outcomes",
        "chapters",
    ),
)
def answer_citations(c: Corpus) -> DataFrame:
    cited = evidence.citation_list(c.answers, c.answer_sources, c.chapters)
    return cited.select("answer_id", "number", digest("quote").alias("quote_hash"), "source_id", "chapter_id", "title", "revision")


@query(
    "staleness_recheck",
    sql(
        """SELECT o.answer_id, CASE WHEN s.changed AND o.outcome IN ('accepted', 'abstained') THEN 'STALE_SOURCE' ELSE o.outcome END AS outcome
           FROM answer_outcomes o LEFT JOIN (SELECT a.answer_id, bool_or(a.source_revision IS DISTINCT FROM c.revision_number OR a.source_hash IS DISTINCT FROM c.text_hash) AS changed
             FROM answer_sources a LEFT JOIN chapters c ON c.chapter_id = a.chapter_id GROUP BY 1) s USING (answer_id)""",
        "answer_outcomes",
    ),
)
def staleness_recheck(c: Corpus) -> DataFrame:
    outcomes = evidence.answer_outcomes(c.answers, c.answer_sources)
    return evidence.void_stale(outcomes, c.answer_sources, c.chapter_keys).select("answer_id", "outcome")


@query("insight_outcomes", sql("SELECT analysis_id, outcome FROM analysis_outcomes", "analysis_outcomes"))
def insight_outcomes(c: Corpus) -> DataFrame:
    return evidence.analysis_outcomes(c.analyses, c.chunks, c.chapter_keys, c.insights, c.analysis_generations).select("analysis_id", "outcome")


@query(
    "fact_accept",
    sql(
        """SELECT sha256('fact:' || chunk_id || ':' || no) AS fact_id, project_id, chunk_id, claim, md5(q) AS quote_hash, 'pending' AS status, CAST(0 AS BIGINT) AS revision
           FROM (SELECT o.*, v.no, v.claim FROM analysis_outcomes o JOIN (VALUES (0, 0, 'fakta'), (2, 0, 'fakta'), (2, 1, 'fakta'), (7, 1, 'fakta')) v(kind, no, claim)
             ON v.kind = o.kind) WHERE outcome = 'saved' AND length(q) BETWEEN 5 AND 1000 AND contains(content, q)""",
        "analysis_outcomes",
    ),
)
def fact_accept(c: Corpus) -> DataFrame:
    outcomes = evidence.analysis_outcomes(c.analyses, c.chunks, c.chapter_keys, c.insights, c.analysis_generations)
    return evidence.accepted_facts(outcomes).select(
        "fact_id", "project_id", "chunk_id", "claim", digest("quote").alias("quote_hash"), "status", "revision"
    )


@query(
    "insight_accept",
    sql(
        """SELECT sha256('insight:' || chunk_id) AS insight_id, project_id, chunk_id, 'g' || chunk_id AS generation_id, summary FROM analysis_outcomes WHERE outcome = 'saved'""",
        "analysis_outcomes",
    ),
)
def insight_accept(c: Corpus) -> DataFrame:
    outcomes = evidence.analysis_outcomes(c.analyses, c.chunks, c.chapter_keys, c.insights, c.analysis_generations)
    return evidence.accepted_insights(outcomes).select("insight_id", "project_id", "chunk_id", "generation_id", "summary")


@query(
    "analysis_worklist",
    sql(
        """SELECT chunk_id, chapter_id, title, chunk_index FROM current_chunks s
           WHERE NOT EXISTS (SELECT 1 FROM insights i WHERE i.chunk_id = s.chunk_id)""",
        "current_chunks",
        "insights",
    ),
)
def analysis_worklist(c: Corpus) -> DataFrame:
    current = chunking.current_chunks(c.chunks, c.chapter_keys, "title")
    return jobs.analysis_worklist(current, c.insights).select("chunk_id", "chapter_id", "title", "chunk_index")


@query(
    "fact_review",
    sql("SELECT event_id, fact_id, at_us, base_revision, status, revision_met, outcome FROM review_outcomes", "review_outcomes"),
)
def fact_review(c: Corpus) -> DataFrame:
    return review.review_outcomes(c.reviews, c.facts, c.chunks, c.chapter_keys)


@query(
    "fact_state",
    sql(
        """SELECT f.fact_id, f.project_id, f.chunk_id, md5(coalesce(r.claim, f.claim)) AS claim_hash, coalesce(r.status, f.status) AS status,
             coalesce(r.revision_met + 1, f.revision) AS revision
           FROM facts f LEFT JOIN (SELECT * FROM review_outcomes WHERE outcome = 'applied'
             QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY revision_met DESC) = 1) r USING (fact_id)""",
        "review_outcomes",
    ),
)
def fact_state(c: Corpus) -> DataFrame:
    outcomes = cut_lineage(review.review_outcomes(c.reviews, c.facts, c.chunks, c.chapter_keys))
    return review.reviewed_facts(c.facts, c.reviews, outcomes).select(
        "fact_id", "project_id", "chunk_id", digest("claim").alias("claim_hash"), "status", "revision"
    )


# --- saves and versions -------------------------------------------------------------------------------------


def _save_outcomes(c: Corpus) -> DataFrame:
    return revisions.save_outcomes(c.saves, c.chapters)


def _states(c: Corpus) -> DataFrame:
    return revisions.chapter_states(c.saves, c.chapters, cut_lineage(_save_outcomes(c)))


@query(
    "revision_fold",
    sql("SELECT event_id, chapter_id, at_us, base_revision, revision_met, outcome, new_revision FROM save_outcomes", "save_outcomes"),
)
def revision_fold(c: Corpus) -> DataFrame:
    return _save_outcomes(c)


@query(
    "chapter_history",
    sql("SELECT chapter_id, project_id, revision, title, md5(plain_text) AS text_hash, from_us, to_us FROM states", "states"),
)
def chapter_history(c: Corpus) -> DataFrame:
    return _states(c).select("chapter_id", "project_id", "revision", "title", digest("plain_text").alias("text_hash"), "from_us", "to_us")


_PAGES = """SELECT chapter_id, revision, title, place, (place - 1) // 25 AS page,
  count(*) OVER (PARTITION BY chapter_id, (place - 1) // 25) = 25 AS has_next
  FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY revision DESC) AS place FROM versions)"""


@query("version_pages", sql(_PAGES, "versions"))
def version_pages(c: Corpus) -> DataFrame:
    paged = revisions.version_pages(revisions.chapter_versions(_states(c)))
    return paged.select("chapter_id", "revision", "title", "place", "page", "has_next")


@query(
    "version_export",
    sql("SELECT chapter_id, revision, md5(title || chr(10) || chr(10) || plain_text) AS text_hash FROM versions", "versions"),
)
def version_export(c: Corpus) -> DataFrame:
    texts = reports.version_text(revisions.chapter_versions(_states(c)))
    return texts.select("chapter_id", "revision", digest("text").alias("text_hash"))


@query(
    "restore_rejects",
    sql(
        """SELECT e.event_id, CASE WHEN c.chapter_id IS NULL THEN 'NOT_FOUND' ELSE 'VERSION_NOT_FOUND' END AS code
           FROM (SELECT event_id, user_id + CASE WHEN k >= 95 THEN 1000000000 ELSE 0 END AS chapter_id, k % 8 AS revision FROM ev) e
           LEFT JOIN chapters c ON c.chapter_id = e.chapter_id
           WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.chapter_id = e.chapter_id AND v.revision = e.revision)""",
        "ev",
        "chapters",
        "versions",
    ),
)
def restore_rejects(c: Corpus) -> DataFrame:
    """A restore per event: some chapters are unknown, some never had the revision asked for."""
    states = cut_lineage(_states(c))
    wanted = c.saves.select("event_id", "chapter_id", F.col("base_revision").alias("revision"), "at_us")
    return revisions.refused_restores(wanted, revisions.chapter_versions(states), revisions.present_chapters(states))


@query(
    "version_restore",
    sql(
        """SELECT v.chapter_id, v.revision AS restored, p.revision AS base_revision, p.revision + 1 AS new_revision, md5(v.plain_text) AS text_hash
           FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY revision) = 1) v
           JOIN states p ON p.chapter_id = v.chapter_id AND p.to_us IS NULL""",
        "versions",
    ),
)
def version_restore(c: Corpus) -> DataFrame:
    """Restore the oldest version of every chapter that has one."""
    states = cut_lineage(_states(c))
    versions, present = revisions.chapter_versions(states), revisions.present_chapters(states)
    wanted = versions.groupBy("chapter_id").agg(F.min("revision").alias("revision")).select(
        F.col("chapter_id").alias("event_id"), "chapter_id", "revision", F.lit(EPOCH_US * 2).alias("at_us")
    )
    saves = revisions.restore_saves(wanted, versions, present)
    now = present.select("chapter_id", F.col("revision").alias("revision_number"))
    done = revisions.save_outcomes(saves, now).where(F.col("outcome") == "accepted")
    return (
        done.select("event_id", "chapter_id", "base_revision", "new_revision")
        .join(saves.select("event_id", digest("plain_text").alias("text_hash")), "event_id")
        .join(wanted.select("event_id", F.col("revision").alias("restored")), "event_id")
        .select("chapter_id", "restored", "base_revision", "new_revision", "text_hash")
    )


@query(
    "late_saves",
    sql(
        """SELECT event_id, chapter_id, revision_met - base_revision AS revisions_behind FROM save_outcomes
           WHERE outcome = 'REVISION_CONFLICT' AND base_revision < revision_met""",
        "save_outcomes",
    ),
)
def late_saves(c: Corpus) -> DataFrame:
    return revisions.late_saves(_save_outcomes(c)).select("event_id", "chapter_id", "revisions_behind")


@query(
    "row_edits",
    sql(
        """SELECT e.event_id, e.user_id AS row_id, e.at_us, e.k % 4 AS base_revision, f.met AS revision_met,
             CASE WHEN s.row_id IS NULL THEN 'NOT_FOUND' WHEN s.base_revision <> f.met THEN 'REVISION_CONFLICT'
               WHEN s.moved THEN 'PROJECT_CANNOT_CHANGE' ELSE 'applied' END AS outcome
           FROM ev e LEFT JOIN edit_steps s ON s.event_id = e.event_id LEFT JOIN edit_fold f ON f.event_id = e.event_id""",
        "edit_steps",
        "edit_fold",
    ),
)
def row_edits(c: Corpus) -> DataFrame:
    """Every event as an edit of the outline item numbered like the user."""
    edits = c.events.select(
        "event_id",
        F.col("user_id").alias("row_id"),
        F.concat(F.lit("src"), (F.col("k") % 20).cast("string")).alias("project_id"),
        "at_us",
        (F.col("k") % 4).alias("base_revision"),
    )
    rows = c.outline.select(F.col("item_id").alias("row_id"), "project_id", F.lit(0).cast("long").alias("revision"))
    return review.edit_outcomes(edits, rows)


# --- index jobs ---------------------------------------------------------------------------------------------


@query(
    "backfill_jobs",
    sql(
        "SELECT chapter_id, project_id, revision_number AS source_revision, text_hash AS source_hash, 'queued' AS status, CAST(0 AS BIGINT) AS attempts FROM chapters",
        "chapters",
    ),
)
def backfill_jobs(c: Corpus) -> DataFrame:
    return jobs.backfill_jobs(c.chapter_keys)


def _session_sql(seconds: int) -> str:
    gap = seconds * 1_000_000
    return sql(
        f"""SELECT chapter_id, min(at_us) AS session_us, count(*) AS saves, max(at_us) AS last_us, arg_max(event_id, at_us) AS last_event_id,
              max(at_us) + {gap} AS due_us
            FROM (SELECT *, sum(CASE WHEN prev IS NULL OR at_us - prev > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY at_us, event_id) AS run
              FROM (SELECT *, lag(at_us) OVER (PARTITION BY chapter_id ORDER BY at_us, event_id) AS prev FROM saves)) GROUP BY chapter_id, run""",
        "saves",
    )


@query("debounce_sessions", _session_sql(45))
def debounce_sessions(c: Corpus) -> DataFrame:
    return jobs.debounce(c.saves)


@query("debounce_long_gap", _session_sql(21600))
def debounce_long_gap(c: Corpus) -> DataFrame:
    """A pause of six hours, so that runs hold several saves."""
    return jobs.debounce(c.saves, 21600)


@query(
    "job_upsert",
    sql(
        """SELECT chapter_id, project_id, source_revision, source_hash, status, attempts, available_us FROM jobs j
             WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.chapter_id = j.chapter_id AND s.from_us IS NOT NULL)
           UNION ALL
           SELECT chapter_id, project_id, revision, md5(plain_text), 'queued', 0, from_us + 45000000 FROM states
             WHERE to_us IS NULL AND from_us IS NOT NULL""",
        "jobs",
        "states",
    ),
)
def job_upsert(c: Corpus) -> DataFrame:
    saved = _states(c).where(F.col("from_us").isNotNull())
    queued = saved.select(
        "chapter_id",
        "project_id",
        F.col("revision").alias("source_revision"),
        digest("plain_text").alias("source_hash"),
        (F.col("from_us") + jobs.S.DEBOUNCE_SECONDS * jobs.SECOND).alias("available_us"),
    )
    return jobs.upsert_jobs(c.jobs, queued).drop("error")


@query(
    "due_jobs",
    sql(
        f"""SELECT chapter_id, project_id, status, attempts, available_us FROM jobs
            WHERE status IN ('queued', 'failed') AND attempts < 3 AND available_us <= {NOW_US} ORDER BY available_us, chapter_id LIMIT 5""",
        "jobs",
    ),
)
def due_jobs(c: Corpus) -> DataFrame:
    return jobs.due_jobs(c.jobs, NOW_US).select("chapter_id", "project_id", "status", "attempts", "available_us")


def _dispatch_sql(turns: int) -> str:
    """Turn by turn: the project of the oldest due job gives its first due chapter not yet taken."""
    views = [
        f""", due AS (SELECT j.chapter_id, j.project_id, j.available_us, c.position FROM jobs j JOIN chapters c USING (chapter_id)
          WHERE j.status IN ('queued', 'failed') AND j.attempts < 3 AND j.available_us <= {NOW_US})"""
    ]
    taken = "SELECT CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS chapter_id WHERE false"
    for n in range(turns):
        free = f"(SELECT d.* FROM due d ANTI JOIN ({taken}) t ON t.chapter_id = d.chapter_id)"
        views.append(
            f"""turn{n} AS (SELECT {n} AS turn, f.chapter_id FROM {free} f
              JOIN (SELECT project_id FROM {free} ORDER BY available_us, chapter_id LIMIT 1) p ON p.project_id = f.project_id
              ORDER BY f.position, f.chapter_id LIMIT 1)"""
        )
        taken = " UNION ALL ".join(f"SELECT turn, chapter_id FROM turn{i}" for i in range(n + 1))
    return sql("", "jobs", "chapters") + ",\n".join(views) + f" SELECT CAST(turn AS BIGINT) AS turn, chapter_id FROM ({taken})"


@query("dispatch_turns", _dispatch_sql(5))
def dispatch_turns(c: Corpus) -> DataFrame:
    return jobs.dispatch(c.jobs, c.chapters, NOW_US)


@query(
    "job_backoff",
    sql(
        f"""SELECT chapter_id, 'failed' AS status, attempts + 1 AS attempts, {NOW_US} + CAST(30 * pow(2, attempts) AS BIGINT) * 1000000 AS available_us,
            'INDEX_FAILED' AS error FROM jobs WHERE status IN ('queued', 'failed') AND attempts < 3 AND available_us <= {NOW_US}""",
        "jobs",
    ),
)
def job_backoff(c: Corpus) -> DataFrame:
    return jobs.failed_once_more(c.jobs.where(jobs.is_due(F.lit(NOW_US))), NOW_US)


@query(
    "requeue_failed",
    sql(
        """SELECT chapter_id, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status,
           CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM jobs""",
        "jobs",
    ),
)
def requeue_failed(c: Corpus) -> DataFrame:
    return jobs.requeue_failed(c.jobs).select("chapter_id", "status", "attempts")


@query(
    "index_progress",
    sql(
        "SELECT project_id, count(*) AS total, CAST(count_if(status = 'ready') AS BIGINT) AS ready, CAST(count_if(status <> 'ready') AS BIGINT) AS remaining FROM jobs GROUP BY 1",
        "jobs",
    ),
)
def index_progress(c: Corpus) -> DataFrame:
    return jobs.index_progress(c.jobs)


def _first_run(n: int) -> str:
    """The n-th effective run of each save: the first one at or after the due time."""
    before = f"state{n - 1}"
    return f"""state{n} AS (SELECT s.chapter_id, s.saved_us, s.save_id,
        CASE WHEN r.run.kind = 'fail' THEN 'failed' WHEN r.run IS NOT NULL THEN 'ready' ELSE s.status END AS status,
        s.attempts + CASE WHEN r.run.kind = 'fail' THEN 1 ELSE 0 END AS attempts,
        CASE WHEN r.run.kind = 'fail' THEN r.run.at_us + CAST(30 * pow(2, s.attempts) AS BIGINT) * 1000000 ELSE s.available_us END AS available_us
      FROM {before} s LEFT JOIN (SELECT s.save_id, arg_min({{'at_us': j.at_us, 'kind': j.kind}}, j.at_us) AS run FROM {before} s
        JOIN placed j ON j.save_id = s.save_id AND j.kind <> 'save' AND j.at_us >= s.available_us WHERE s.status <> 'ready' GROUP BY 1) r
        ON r.save_id = s.save_id)"""


_JOB_VIEWS = """, placed AS (SELECT chapter_id, at_us, event_id, kind,
    max(CASE WHEN kind = 'save' THEN at_us END) OVER w AS saved_us,
    last_value(CASE WHEN kind = 'save' THEN event_id END IGNORE NULLS) OVER w AS save_id
  FROM (SELECT user_id AS chapter_id, at_us, event_id, CASE WHEN event_type = 'purchase' THEN 'save' WHEN k % 3 = 0 THEN 'ok' ELSE 'fail' END AS kind FROM ev)
  WINDOW w AS (PARTITION BY chapter_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
state0 AS (SELECT chapter_id, saved_us, save_id, 'queued' AS status, CAST(0 AS BIGINT) AS attempts, saved_us + 45000000 AS available_us
  FROM placed WHERE kind = 'save'),
""" + ",\n".join(_first_run(n) for n in (1, 2, 3))


@query(
    "job_states",
    sql("", "ev")
    + _JOB_VIEWS
    + " SELECT chapter_id, saved_us, save_id, status, attempts, available_us, status = 'failed' AND attempts >= 3 AS dead_letter FROM state3",
)
def job_states(c: Corpus) -> DataFrame:
    return jobs.job_histories(c.job_events)


# --- quotas -------------------------------------------------------------------------------------------------


def _quota_sql(limit: int, window: int, spacing: int) -> str:
    w, s = window * 1_000_000, spacing * 1_000_000
    return sql(
        f""", asked AS (SELECT user_id, at_us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS n FROM ev),
        fold AS (SELECT user_id, n, event_id, at_us, 'accepted' AS decision, [at_us] AS held FROM asked WHERE n = 1
          UNION ALL
          SELECT user_id, n, event_id, at_us, decision, CASE WHEN decision = 'accepted' THEN list_append(held, at_us) ELSE held END FROM (
            SELECT a.user_id, a.n, a.event_id, a.at_us, list_filter(f.held, lambda t: t > a.at_us - {w}) AS held,
              CASE WHEN len(list_filter(f.held, lambda t: t > a.at_us - {w})) >= {limit} THEN 'AI_DAILY_LIMIT'
                WHEN len(list_filter(f.held, lambda t: t > a.at_us - {s})) > 0 THEN 'AI_RATE_LIMIT' ELSE 'accepted' END AS decision
            FROM fold f JOIN asked a ON a.user_id = f.user_id AND a.n = f.n + 1))
        SELECT user_id, event_id, at_us, decision FROM fold""",
        "ev",
    ).replace(")\n, asked", "), asked")


@query("quota_accept", _quota_sql(20, 86400, 10))
def quota_accept(c: Corpus) -> DataFrame:
    return quota.decide_requests(c.requests)


@query("quota_accept_tight", _quota_sql(3, 86400, 3600))
def quota_accept_tight(c: Corpus) -> DataFrame:
    """Three a day and an hour apart, so that both rules refuse something."""
    return quota.decide_requests(c.requests, limit=3, spacing_seconds=3600)


@query(
    "attempt_rate",
    sql(
        """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS last_day,
           count(*) OVER (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 9999999 PRECEDING AND 1 PRECEDING) AS last_seconds FROM ev""",
        "ev",
    ),
)
def attempt_rate(c: Corpus) -> DataFrame:
    return quota.attempt_rates(c.requests, {"last_day": 86_400, "last_seconds": 10})


_SIX_HOURS = 21_600_000_000

# --- the same folds as streams ------------------------------------------------------------------------------


def _event_stream(c: Corpus) -> DataFrame:
    raw = replay.read_stream(c.spark, c.folder, c.table("events"), "events.parquet")
    return c.shape_events(raw)


@query(
    "stream_revision_saves",
    sql(
        "SELECT event_id, revision_met, outcome FROM save_outcomes",
        "save_outcomes",
    ),
)
def stream_revision_saves(c: Corpus) -> DataFrame:
    saves = c.shape_saves(_event_stream(c))
    return replay.drain(folds.stream_save_outcomes(saves, c.chapters))


@query("stream_quota", ORACLES["quota_accept_tight"])
def stream_quota(c: Corpus) -> DataFrame:
    return replay.drain(folds.stream_decisions(_event_stream(c), limit=3, spacing_seconds=3600))


@query(
    "stream_debounce",
    f"SELECT * FROM ({ORACLES['debounce_long_gap']}) WHERE due_us <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)",
)
def stream_debounce(c: Corpus) -> DataFrame:
    """Runs closed by the watermark, ten minutes behind the newest save."""
    return replay.drain(folds.stream_debounce(c.shape_saves(_event_stream(c)), 21600))


_RUNS = f"""SELECT chapter_id, source_revision, at_us, failing >= try AS failed, try - CASE WHEN failing >= try THEN 0 ELSE 1 END AS attempts, body FROM (
    SELECT *, saved + {_SIX_HOURS} + CASE try WHEN 1 THEN 0 WHEN 2 THEN 7200000000 ELSE 21600000000 END AS at_us FROM (
      SELECT user_id AS chapter_id, event_id AS source_revision, at_us AS saved, event_type || ' ' || props AS body,
        CASE WHEN k % 10 = 0 THEN 3 WHEN k % 10 = 1 THEN 1 WHEN k % 10 = 2 THEN 2 ELSE 0 END AS failing, lead(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS next
      FROM ev), range(1, 4) AS tries(try) WHERE failing >= try - 1)
    WHERE (next IS NULL OR at_us < next) AND at_us <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)"""


def _refreshed(c: Corpus) -> str:
    """Folder of tables after the refresh has taken in every event as a save; some runs of some saves fail, of others all."""
    kind = F.col("k") % 10
    saves = _event_stream(c).select(
        F.col("user_id").alias("chapter_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project_id"),
        F.col("event_id").alias("revision_number"),
        F.concat_ws(" ", "event_type", "props").alias("plain_text"),
        "at_us",
        F.when(kind == 0, 3).when(kind == 1, 1).when(kind == 2, 2).otherwise(0).cast("long").alias("failing"),
    )
    folder = run_folder(c.spark, "refresh")
    refresh.refresh_index(saves, f"{folder}/tables", f"{folder}/state", 21600, backoff_seconds=7200).awaitTermination()
    return f"{folder}/tables"


@query(
    "stream_refresh",
    sql(f"SELECT chapter_id, source_revision, 0 AS chunk_index, md5(body) AS text_hash FROM ({_RUNS}) WHERE NOT failed", "ev"),
)
def stream_refresh(c: Corpus) -> DataFrame:
    """Chunks that the refresh stream stores: the latest text of every chapter that has rested and could be indexed."""
    stored = refresh.stored_chunks(c.spark, _refreshed(c))
    return stored.select("chapter_id", "source_revision", F.col("chunk_index").cast("int").alias("chunk_index"), digest("content").alias("text_hash"))


@query(
    "stream_index_jobs",
    sql(
        f"""SELECT chapter_id, source_revision, CASE WHEN failed THEN 'failed' ELSE 'ready' END AS status, attempts, failed AND attempts >= 3 AS dead_letter, at_us
            FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY at_us DESC, source_revision DESC) = 1""",
        "ev",
    ),
)
def stream_index_jobs(c: Corpus) -> DataFrame:
    """The job of every chapter after the refresh, from the keyed table that compaction leaves."""
    folder = _refreshed(c)
    refresh.compact_jobs(c.spark, folder)
    return refresh.latest_jobs(c.spark, folder).select("chapter_id", "source_revision", "status", F.col("attempts").cast("int").alias("attempts"), "dead_letter", "at_us")


# --- context ------------------------------------------------------------------------------------------------


def _contexts(c: Corpus) -> DataFrame:
    return context.assemble_context(c.context_requests, c.chapters, c.bibles, c.characters, c.notes)


@query(
    "context_pack",
    sql("SELECT request_id, place, label, md5(text) AS text_hash, length(text) AS characters, truncated FROM context", "context"),
)
def context_pack(c: Corpus) -> DataFrame:
    rows = context.source_rows(_contexts(c))
    return rows.select(
        "request_id", "place", "label", digest("text").alias("text_hash"), F.length("text").cast("long").alias("characters"), "truncated"
    )


@query(
    "context_rejects",
    sql("SELECT request_id, 'CHAPTER_REQUIRED' AS code FROM asked WHERE action = 'continue' AND NOT with_chapter", "asked"),
)
def context_rejects(c: Corpus) -> DataFrame:
    return context.context_rejects(c.context_requests, c.chapters)


@query(
    "request_payload",
    sql(
        """SELECT request_id, action, 'Lanjutkan.' AS instruction, '' AS selected_text, t.truncated AS context_truncated, t.place, t.label, md5(t.text) AS text_hash
           FROM allowed JOIN context t USING (request_id)""",
        "allowed",
        "context",
    ),
)
def request_payload(c: Corpus) -> DataFrame:
    """The payload as its reader parses it: JSON text differs in escapes between engines, fields do not."""
    made = context.request_payload(_contexts(c), F.lit("Lanjutkan."), F.lit(""))
    shape = "action string, instruction string, selected_text string, context array<struct<label:string,text:string>>, context_truncated boolean"
    read = made.select("request_id", F.from_json("payload", shape).alias("p")).select("request_id", "p.*")
    return read.select("*", F.posexplode("context").alias("place", "part")).select(
        "request_id", "action", "instruction", "selected_text", "context_truncated", F.col("place").cast("long").alias("place"), "part.label", digest("part.text").alias("text_hash")
    )


@query(
    "consent_filter",
    sql(
        """SELECT 'characters' AS kind, project_id, count(*) AS consented FROM characters WHERE include_in_ai_context AND deleted_at IS NULL GROUP BY ALL
           UNION ALL SELECT 'notes', project_id, count(*) FROM notes WHERE include_in_ai_context AND deleted_at IS NULL GROUP BY ALL""",
        "characters",
        "notes",
    ),
)
def consent_filter(c: Corpus) -> DataFrame:
    def counted(rows: DataFrame, kind: str) -> DataFrame:
        return context.consented(rows).groupBy(F.lit(kind).alias("kind"), "project_id").agg(count().alias("consented"))

    return counted(c.characters, "characters").unionByName(counted(c.notes, "notes"))


# --- reports ------------------------------------------------------------------------------------------------

_CURRENT = "s.source_revision = c.revision_number AND s.source_hash = c.text_hash"


@query(
    "overview_jobs",
    sql("SELECT j.project_id, j.chapter_id, j.status, j.attempts, c.title, c.position FROM jobs j JOIN chapters c USING (chapter_id)", "jobs"),
)
def overview_jobs(c: Corpus) -> DataFrame:
    return reports.job_list(c.jobs, c.chapters).select("project_id", "chapter_id", "status", "attempts", "title", "position")


@query(
    "overview_chunks",
    sql(
        """SELECT project_id, rank, s.chunk_id, title, chunk_index, i.chunk_id IS NOT NULL AS analyzed FROM (
             SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY position, chapter_id, chunk_index) AS rank FROM current_chunks) s
           LEFT JOIN (SELECT chunk_id FROM insights) i ON i.chunk_id = s.chunk_id WHERE rank <= 500""",
        "current_chunks",
        "insights",
    ),
)
def overview_chunks(c: Corpus) -> DataFrame:
    listed = reports.chunk_list(c.chunks, c.chapter_keys, c.insights)
    return listed.select("project_id", "rank", "chunk_id", "title", "chunk_index", "analyzed")


def _newest_sql(table: str, key: str, columns: str) -> str:
    return sql(
        f"""SELECT n.project_id, n.rank, n.{key}, {columns}, c.title, s.chunk_index, s.source_revision, {_CURRENT} AS current FROM (
              SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, {key}) AS rank FROM {table}) n
            JOIN chunks s USING (chunk_id) JOIN chapters c ON c.chapter_id = s.chapter_id WHERE n.rank <= 100""",
        "chunks",
        table,
    )


@query("overview_insights", _newest_sql("insights", "insight_id", "n.summary"))
def overview_insights(c: Corpus) -> DataFrame:
    listed = reports.newest_with_source(c.insights, "insight_id", c.chunks, c.chapter_keys, reports.S.OVERVIEW_INSIGHTS)
    return listed.select("project_id", "rank", "insight_id", "summary", "title", "chunk_index", "source_revision", "current")


@query("overview_facts", _newest_sql("facts", "fact_id", "n.status"))
def overview_facts(c: Corpus) -> DataFrame:
    listed = reports.newest_with_source(c.facts, "fact_id", c.chunks, c.chapter_keys, reports.S.OVERVIEW_FACTS)
    return listed.select("project_id", "rank", "fact_id", "status", "title", "chunk_index", "source_revision", "current")


@query(
    "memory_overview",
    sql(
        f"""SELECT p.project_id, coalesce(c.chunks, '') AS chunks, coalesce(f.facts, '') AS facts, coalesce(i.insights, '') AS insights
            FROM (SELECT project_id FROM projects UNION SELECT project_id FROM bibles) p
            LEFT JOIN (SELECT project_id, md5(string_agg(chunk_id, ',' ORDER BY rank)) AS chunks FROM (SELECT *, row_number() OVER
              (PARTITION BY project_id ORDER BY position, chapter_id, chunk_index) AS rank FROM current_chunks) WHERE rank <= 500 GROUP BY 1) c USING (project_id)
            LEFT JOIN (SELECT project_id, md5(string_agg(fact_id || (CASE WHEN cur THEN '+' ELSE '-' END), ',' ORDER BY rank)) AS facts FROM (
              SELECT n.*, {_CURRENT} AS cur FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, fact_id) AS rank FROM facts) n
              JOIN chunks s USING (chunk_id) JOIN chapters c ON c.chapter_id = s.chapter_id) WHERE rank <= 100 GROUP BY 1) f USING (project_id)
            LEFT JOIN (SELECT project_id, md5(string_agg(insight_id, ',' ORDER BY rank)) AS insights FROM (SELECT *, row_number() OVER
              (PARTITION BY project_id ORDER BY created_at DESC, insight_id) AS rank FROM insights) WHERE rank <= 100 GROUP BY 1) i USING (project_id)""",
        "projects",
        "bibles",
        "current_chunks",
        "facts",
        "insights",
    ),
)
def memory_overview(c: Corpus) -> DataFrame:
    """Some projects have a story bible and nothing else; their lists are empty."""
    projects = c.projects.select("project_id").unionByName(c.bibles.select("project_id"))

    def listed(name: str, text: Callable[[Column], Column]) -> Column:
        joined = F.array_join(F.transform(name, text), ",")
        return F.when(F.size(name) > 0, F.md5(joined.cast("binary"))).otherwise("").alias(name)

    whole = reports.overview(projects, c.chunks, c.chapter_keys, c.insights, c.facts)
    return whole.select(
        "project_id",
        listed("chunks", lambda r: r["chunk_id"]),
        listed("facts", lambda r: F.concat(r["fact_id"], F.when(r["current"], "+").otherwise("-"))),
        listed("insights", lambda r: r["insight_id"]),
    )


@query(
    "generation_history",
    sql(
        """SELECT project_id, rank, generation_id, action, status FROM (SELECT *, row_number() OVER
           (PARTITION BY project_id ORDER BY created_us DESC, generation_id DESC) AS rank FROM generations) WHERE rank <= 20""",
        "generations",
    ),
)
def generation_history(c: Corpus) -> DataFrame:
    return reports.newest_generations(c.generations).select("project_id", "rank", "generation_id", "action", "status")


@query(
    "ask_history",
    sql(
        """SELECT project_id, rank, generation_id, prompt, result FROM (SELECT *, row_number() OVER
           (PARTITION BY project_id ORDER BY created_us DESC, generation_id DESC) AS rank FROM generations
           WHERE status = 'complete' AND prompt LIKE '[Ask My Story]%') WHERE rank <= 10""",
        "generations",
    ),
)
def ask_history(c: Corpus) -> DataFrame:
    return reports.ask_history(c.generations).select("project_id", "rank", "generation_id", "prompt", "result")


_USAGE = """SELECT generation_id, substring(sha256(project_id), 1, 24) AS project, substring(sha256(CAST(user_id AS VARCHAR)), 1, 24) AS user,
  CASE WHEN starts_with(prompt, '[Ask My Story]') THEN 'memory-ask' WHEN starts_with(prompt, '[Memory]') THEN 'memory-analyze' ELSE 'assistant' END AS workflow,
  split_part(model, ':', 1) AS provider, substring(model, instr(model, ':') + 1) AS model, retrieved AS retrieved_memory_count, false AS content_logging,
  CASE WHEN status = 'error' THEN 'AI_GENERATION_FAILED' END AS error, input_tokens, output_tokens,
  CASE WHEN action = 'chat' THEN 'qa' WHEN action = 'brainstorm' THEN 'planner' ELSE 'writer' END AS task, status = 'complete' AS success,
  length(prompt) AS input_characters, CASE WHEN status = 'complete' THEN length(result) ELSE 0 END AS output_characters,
  total_tokens, latency_ms FROM generations"""


@query("usage_trace", sql(_USAGE, "generations"))
def usage_trace(c: Corpus) -> DataFrame:
    return reports.usage_facts(c.generations)


@query(
    "usage_report",
    sql(
        f"""SELECT project, task, success, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
            CAST(sum(input_characters) AS BIGINT) AS input_characters, max(latency_ms) AS max_latency_ms FROM ({_USAGE}) GROUP BY ALL""",
        "generations",
    ),
)
def usage_report(c: Corpus) -> DataFrame:
    return reports.usage_report(c.generations)


@query(
    "next_positions",
    sql(
        """SELECT p.project_id, coalesce(max(c.position) + 1, 0) AS next_position, 'Bab ' || (count(c.chapter_id) + 1) AS next_title,
           lpad(CAST(count(c.chapter_id) + 1 AS VARCHAR), CAST(greatest(2, length(CAST(count(c.chapter_id) + 1 AS VARCHAR))) AS INT), '0') AS list_number
           FROM projects p LEFT JOIN chapters c USING (project_id) GROUP BY 1""",
        "projects",
        "chapters",
    ),
)
def next_positions(c: Corpus) -> DataFrame:
    return reports.next_positions(c.projects, c.chapters)


@query(
    "new_projects",
    """SELECT p.project_id, p.owner_id, p.title, p.genre, 'Bab 1' AS chapter_title, '{"type":"doc","content":[{"type":"paragraph"}]}' AS content_json,
       '' AS plain_text, CAST(0 AS BIGINT) AS revision_number, CAST(0 AS BIGINT) AS position
       FROM (SELECT sha256('project:' || s_suppkey) AS project_id, 'user' || (s_suppkey % 5) AS owner_id, trim(s_name) AS title, 'novel' AS genre FROM supplier) p""",
)
def new_projects(c: Corpus) -> DataFrame:
    """A new project per supplier, beside the existing ones, each with its default chapter."""
    key = F.col("s_suppkey")
    wanted = c.table("supplier").select(
        key.alias("request_id"),
        F.concat(F.lit("user"), (key % 5).cast("string")).alias("owner_id"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("title"),
        F.lit("novel").alias("genre"),
    )
    made = reports.new_projects(wanted)
    every = c.projects.select("project_id").unionByName(made.select("project_id"))
    first = reports.first_chapters(every, c.chapters).withColumnRenamed("title", "chapter_title")
    return made.select("project_id", "owner_id", "title", "genre").join(first, "project_id")


@query(
    "manuscript_export",
    sql(
        """SELECT project_id, 0 AS part, CAST(-1 AS BIGINT) AS position, CAST(-1 AS BIGINT) AS chapter_id, md5('# ' || title) AS piece_hash FROM projects
           UNION ALL SELECT project_id, 1, position, chapter_id, md5(chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) || plain_text) FROM chapters""",
        "projects",
        "chapters",
    ),
)
def manuscript_export(c: Corpus) -> DataFrame:
    return reports.manuscript_parts(c.projects, c.chapters).select(
        "project_id", "part", "position", "chapter_id", digest("piece").alias("piece_hash")
    )


@query(
    "planning_lists",
    sql(
        """SELECT view, archived, project_id, row_id, title, row_number() OVER (PARTITION BY view, archived, project_id ORDER BY place, row_id) AS place FROM (
             SELECT 'outline_items' AS view, deleted_at IS NOT NULL AS archived, project_id, item_id AS row_id, title, position AS place FROM outline
             UNION ALL SELECT 'notes', deleted_at IS NOT NULL, project_id, note_id, title, created_at FROM notes
             UNION ALL SELECT 'characters', deleted_at IS NOT NULL, project_id, character_id, name, created_at FROM characters)""",
        "outline",
        "notes",
        "characters",
    ),
)
def planning_lists(c: Corpus) -> DataFrame:
    """Both views, live and archived, of each planning table, with the place of each row in the view."""

    def view(rows: DataFrame, name: str, key: str, title: str, order: str) -> DataFrame:
        return rows.select(
            F.lit(name).alias("view"),
            "project_id",
            "deleted_at",
            F.col(order).alias("order"),
            F.col(key).alias("row_id"),
            F.col(title).alias("title"),
        )

    every = (
        view(c.outline, "outline_items", "item_id", "title", "position")
        .unionByName(view(c.notes, "notes", "note_id", "title", "created_at"))
        .unionByName(view(c.characters, "characters", "character_id", "name", "created_at"))
    )
    placed = reports.planning_places(every, ["view"], [F.col("order"), F.col("row_id")])
    return placed.select("view", "archived", "project_id", "row_id", "title", "place")


@query("chapter_list", sql("SELECT project_id, position, chapter_id, title, revision_number FROM chapters", "chapters"))
def chapter_list(c: Corpus) -> DataFrame:
    return reports.chapter_list(c.chapters.select("project_id", "position", "chapter_id", "title", "revision_number"))


# --- quality ------------------------------------------------------------------------------------------------


@query(
    "constraint_report",
    sql(
        """SELECT table_name, rule, count(*) AS violations FROM (
             SELECT 'outline_items' AS table_name, 'item_type' AS rule FROM outline WHERE item_type NOT IN ('act', 'part', 'chapter', 'scene', 'beat', 'custom')
             UNION ALL SELECT 'ai_generations', 'model_id' FROM generations WHERE NOT (starts_with(model, 'gateway:') AND length(model) > 8
               OR starts_with(model, 'nebius:') AND regexp_matches(substring(model, 8), '(?i)^nvidia/[a-z0-9._-]*nemotron[a-z0-9._-]*$'))
             UNION ALL SELECT 'story_facts', 'quote_length' FROM facts WHERE length(quote) NOT BETWEEN 1 AND 1000
             UNION ALL SELECT 'story_facts', 'claim_length' FROM facts WHERE length(claim) NOT BETWEEN 1 AND 1000
             UNION ALL SELECT 'notes', 'title_length' FROM notes WHERE length(trim(title)) NOT BETWEEN 1 AND 200
             UNION ALL SELECT 'chapters', 'text_bytes' FROM chapters WHERE strlen(plain_text) > 2000000
             UNION ALL SELECT 'requests', 'project_uuid' FROM conversations WHERE conv_id % 5 = 0
             UNION ALL SELECT 'requests', 'chapter_uuid' FROM conversations WHERE turn % 4 = 1
             UNION ALL SELECT 'requests', 'action' FROM conversations WHERE (conv_id * 1000 + turn) % 6 = 2
             UNION ALL SELECT 'requests', 'instruction' FROM conversations
               WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' OR length(text) > 2000
             UNION ALL SELECT 'requests', 'selection_length' FROM conversations WHERE (conv_id * 1000 + turn) % 4 = 0 AND length(text) > 4000
             UNION ALL SELECT 'requests', 'rewrite_needs_selection' FROM conversations
               WHERE (conv_id * 1000 + turn) % 6 = 0 AND ((conv_id * 1000 + turn) % 4 <> 0 OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '')
             UNION ALL SELECT 'requests', 'continue_needs_chapter' FROM conversations
               WHERE (conv_id * 1000 + turn) % 6 = 1 AND (conv_id * 1000 + turn) % 3 = 0
             UNION ALL SELECT 'requests', 'budget' FROM conversations WHERE length(text) * ((conv_id * 1000 + turn) % 40) + length(role) > 48000
             UNION ALL SELECT 'requests', 'output_tokens' FROM conversations WHERE (conv_id * 1000 + turn) % 3000 NOT BETWEEN 1 AND 2400)
           GROUP BY ALL""",
        "outline",
        "generations",
        "facts",
        "notes",
        "chapters",
    ),
)
def constraint_report(c: Corpus) -> DataFrame:
    checked = [
        (c.projects, "projects", "project_id"),
        (c.chapters, "chapters", "chapter_id"),
        (c.jobs, "memory_jobs", "chapter_id"),
        (c.facts, "story_facts", "fact_id"),
        (c.generations, "ai_generations", "generation_id"),
        (c.characters, "characters", "character_id"),
        (c.notes, "notes", "note_id"),
        (c.outline, "outline_items", "item_id"),
        (c.ai_requests, "requests", "request_id"),
    ]
    found = [quality.violation_counts(quality.violations(*t)) for t in checked]
    first, *rest = found
    for other in rest:
        first = first.unionByName(other)
    return first


_UNIQUE = {
    "outline_items": ("outline", ["chapter_id"]),
    "chapters": ("chapters", ["chapter_id"]),
    "story_bibles": ("bibles", ["project_id"]),
    "story_chunks": ("chunks", ["chapter_id", "source_revision", "source_hash", "chunk_index"]),
    "memory_insights": ("insights", ["chunk_id"]),
    "chapter_versions": ("versions", ["chapter_id", "revision"]),
}


def _unique_sql(table: str, view: str, key: list[str]) -> str:
    live = " WHERE deleted_at IS NULL AND chapter_id IS NOT NULL" if view == "outline" else ""
    value = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"SELECT '{table}.{':'.join(key)}' AS key_name, {value} AS key_value, count(*) AS copies FROM {view}{live} GROUP BY {', '.join(key)} HAVING count(*) > 1"


@query(
    "duplicate_keys",
    sql(" UNION ALL ".join(_unique_sql(t, v, k) for t, (v, k) in _UNIQUE.items()), *(v for v, _ in _UNIQUE.values())),
)
def duplicate_keys(c: Corpus) -> DataFrame:
    """Every unique key of the tables."""
    rows = {"versions": revisions.chapter_versions(_states(c))}

    def found(table: str) -> DataFrame:
        view, key = _UNIQUE[table]
        held = quality.duplicate_keys(rows[view] if view in rows else getattr(c, view), key, live_only=view == "outline")
        return held.select(F.lit(f"{table}.{':'.join(key)}").alias("key_name"), F.concat_ws(":", *key).alias("key_value"), "copies")

    return reduce(DataFrame.unionByName, map(found, _UNIQUE))


# Child table, its key, and the parent it points to.
_PARENTS = {
    "outline_items": ("outline", "item_id", "chapters", ["chapter_id", "project_id"]),
    "memory_jobs": ("jobs", "chapter_id", "chapters", ["chapter_id", "project_id"]),
    "story_chunks": ("chunks", "chunk_id", "chapters", ["chapter_id", "project_id"]),
    "memory_insights": ("insights", "insight_id", "chunks", ["chunk_id", "project_id"]),
    "story_facts": ("facts", "fact_id", "chunks", ["chunk_id", "project_id"]),
    "chapter_versions": ("versions", "revision", "chapters", ["chapter_id", "project_id"]),
    "fact_reviews": ("reviews", "event_id", "facts", ["fact_id"]),
}


def _orphan_sql(table: str, child: str, name: str, parent: str, key: list[str]) -> str:
    same = " AND ".join(f"p.{k} = o.{k}" for k in key)
    return f"SELECT '{table}' AS table_name, CAST({name} AS VARCHAR) AS row_key, CAST({key[0]} AS VARCHAR) AS refers_to FROM {child} o WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {same})"


@query(
    "orphans",
    sql(" UNION ALL ".join(_orphan_sql(t, *x) for t, x in _PARENTS.items()), "outline", "jobs", "chunks", "insights", "facts", "versions", "reviews"),
)
def orphans(c: Corpus) -> DataFrame:
    """Every reference from one table to another that leads nowhere."""
    rows = {"versions": revisions.chapter_versions(_states(c))}

    def found(table: str) -> DataFrame:
        child, name, parent, key = _PARENTS[table]
        lost = quality.orphans(rows[child] if child in rows else getattr(c, child), getattr(c, parent), key)
        return lost.select(F.lit(table).alias("table_name"), F.col(name).cast("string").alias("row_key"), F.col(key[0]).cast("string").alias("refers_to"))

    return reduce(DataFrame.unionByName, map(found, _PARENTS))


# --- scalar functions over whole tables ---------------------------------------------------------------------


@query(
    "word_count",
    r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS words, length(text) AS characters,
        strlen(text) AS bytes FROM documents""",
)
def word_count(c: Corpus) -> DataFrame:
    return c.documents.select(
        "doc_id",
        X.word_count(F.col("text")).alias("words"),
        F.length("text").cast("long").alias("characters"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


@query(
    "output_reject",
    r"""SELECT page_id, regexp_replace(html, '^\s+|\s+$', '', 'g') = '' OR regexp_matches(html, '(?i)</?think(?:ing)?>') AS rejected,
        md5(left(regexp_replace(html, 'Bearer\s+\S+', 'Bearer [redacted]', 'g'), 400)) AS redacted_hash FROM pages""",
)
def output_reject(c: Corpus) -> DataFrame:
    html = F.col("html")
    return c.table("pages").select(
        "page_id", X.rejected_output(html).alias("rejected"), X.md5_text(X.redact(html)).alias("redacted_hash")
    )


@query(
    "alias_lists",
    r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')),
        lambda p: p <> ''), '|') AS aliases FROM conversations""",
)
def alias_lists(c: Corpus) -> DataFrame:
    return c.table("conversations").select("conv_id", "turn", F.array_join(X.alias_list(F.col("text")), "|").alias("aliases"))


@query(
    "request_checks",
    sql(
        """SELECT conv_id, turn, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 3 OR length(text) > 1500 AS bad_question, length(text) > 2000 AS too_long_query,
           length(trim(text)) < 2 OR length(trim(text)) > 100 AS bad_search FROM conversations"""
    ),
)
def request_checks(c: Corpus) -> DataFrame:
    text = F.col("text")
    return c.table("conversations").select(
        "conv_id",
        "turn",
        retrieval.question_code(text).isNotNull().alias("bad_question"),
        (F.length(text) > retrieval.S.MAX_QUERY_LENGTH).alias("too_long_query"),
        search.search_code(text, F.lit(0)).isNotNull().alias("bad_search"),
    )


@query(
    "attempt_ranks",
    sql(
        "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS place FROM ev",
        "ev",
    ),
)
def attempt_ranks(c: Corpus) -> DataFrame:
    ranked = ranking.full_rank(c.requests, ["user_id"], [F.col("at_us"), F.col("event_id")], "place")
    return ranked.select("user_id", "event_id", "place")
