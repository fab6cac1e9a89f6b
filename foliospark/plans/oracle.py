"""SQL views of the derived tables, written independently of the Spark code, for the side-by-side check."""

from __future__ import annotations

from foliospark.functions.text import STOP_WORDS

_EPOCH = 1_704_067_200_000_000
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _finish(start: str) -> str:
    full = f"least({start} + 3199, total)"
    window = f"substring(plain_text, {full} - 700, 701)"
    return (
        rf"CASE WHEN {full} < total AND regexp_matches({window}, '[\n.!? ]') "
        rf"THEN {full} - 700 + length(regexp_extract({window}, '(?s)^(.*)[\n.!? ]', 1)) ELSE {full} END"
    )


def words(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)), "
        f"lambda w: w <> '')"
    )


FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "projects": (
        (),
        """SELECT DISTINCT source AS project_id, 'user' || (CAST(substring(source, 4) AS INT) % 5) AS owner_id,
           source AS title, '' AS genre FROM documents""",
    ),
    "chapters": (
        (),
        """SELECT doc_id AS chapter_id, source AS project_id, 'Bab ' || doc_id AS title, '{"type":"doc"}' AS content_json,
           text AS plain_text, doc_id % 4 + 1 AS revision_number, doc_id // 20 AS position, md5(text) AS text_hash
           FROM documents""",
    ),
    "jobs": (
        ("chapters",),
        f"""SELECT chapter_id, project_id, revision_number AS source_revision, text_hash AS source_hash,
           CASE WHEN chapter_id % 10 = 0 THEN 'failed' WHEN chapter_id % 10 = 1 THEN 'queued' ELSE 'ready' END AS status,
           CASE WHEN chapter_id % 10 = 0 THEN chapter_id % 4 ELSE 0 END AS attempts,
           {_EPOCH} + chapter_id % 1000 * 1000000 AS available_us,
           CASE WHEN chapter_id % 10 = 0 THEN 'INDEX_FAILED' END AS error FROM chapters""",
    ),
    "span": (
        ("chapters",),
        f"""SELECT chapter_id, plain_text, CAST(length(plain_text) AS BIGINT) AS total, CAST(1 AS BIGINT) AS s,
             CAST({_finish('1').replace('total', 'length(plain_text)')} AS BIGINT) AS e
           FROM chapters WHERE length(plain_text) > 0
           UNION ALL
           SELECT chapter_id, plain_text, total, e - 319, CAST({_finish('e - 319')} AS BIGINT) FROM span WHERE e < total""",
    ),
    "pieces": (
        ("span",),
        """SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY s) - 1 AS chunk_index, s - 1 AS start_offset,
           e AS end_offset, substring(plain_text, s, e - s + 1) AS content
           FROM span WHERE trim(substring(plain_text, s, e - s + 1)) <> ''""",
    ),
    "fresh_chunks": (
        ("chapters", "pieces"),
        """SELECT sha256(concat_ws(':', p.chapter_id, c.revision_number, c.text_hash, p.chunk_index)) AS chunk_id, c.project_id,
           p.chapter_id, c.revision_number AS source_revision, c.text_hash AS source_hash, p.chunk_index, p.start_offset,
           p.end_offset, p.content FROM pieces p JOIN chapters c USING (chapter_id)""",
    ),
    "chunks": (
        ("chapters", "pieces"),
        """SELECT sha256(concat_ws(':', chapter_id, source_revision, source_hash, chunk_index)) AS chunk_id, * FROM (
             SELECT c.project_id, p.chapter_id,
             c.revision_number - CASE WHEN p.chapter_id % 7 = 0 THEN 1 ELSE 0 END AS source_revision,
             c.text_hash AS source_hash, p.chunk_index, p.start_offset, p.end_offset, p.content
             FROM pieces p JOIN chapters c USING (chapter_id))""",
    ),
    "current_chunks": (
        ("chunks", "chapters"),
        """SELECT s.*, c.title, c.position FROM chunks s JOIN chapters c ON c.chapter_id = s.chapter_id
           AND c.project_id = s.project_id AND c.revision_number = s.source_revision AND c.text_hash = s.source_hash""",
    ),
    "live": (
        ("current_chunks", "jobs"),
        "SELECT s.* FROM current_chunks s JOIN jobs j ON j.chapter_id = s.chapter_id WHERE j.status = 'ready'",
    ),
    "questions": (
        (),
        "SELECT item_id AS query_id, 'src' || (item_id % 20) AS project_id, text AS query FROM benchmark",
    ),
    "facts": (
        ("chunks",),
        """SELECT 'f' || s.chunk_id AS fact_id, s.project_id, s.chunk_id, b.text AS claim,
           CASE WHEN s.chapter_id % 5 = 4 THEN 'tidak ada ' || s.chapter_id ELSE substring(s.content, 1, 60) END AS quote,
           CASE s.number % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'ignored' END AS status,
           CAST(0 AS BIGINT) AS revision, s.number AS created_at
           FROM (SELECT *, chapter_id * 1000 + chunk_index AS number FROM chunks) s JOIN benchmark b ON b.item_id = s.chapter_id % (SELECT count(*) FROM benchmark)""",
    ),
    "insights": (
        ("chunks",),
        """SELECT 'i' || chunk_id AS insight_id, project_id, chunk_id, substring(content, 1, 80) AS summary,
           chapter_id * 1000 + chunk_index AS created_at FROM chunks WHERE chapter_id IN (SELECT doc_id FROM labels)""",
    ),
    "characters": (
        (),
        """SELECT item_id AS character_id, 'src' || (item_id % 20) AS project_id, w[1] AS name, [w[2], w[3]] AS aliases,
           'supporting' AS role, '' AS description, {'appearance': '', 'personality': '', 'background': '',
           'goals': 'goal ' || item_id, 'fears': '', 'arc': ''} AS attributes, item_id % 2 = 0 AS include_in_ai_context,
           CASE WHEN item_id % 9 = 0 THEN 'archived' END AS deleted_at, item_id AS created_at
           FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)""",
    ),
    "bibles": (
        (),
        """SELECT CAST(n_nationkey AS BIGINT) AS bible_id, 'src' || n_nationkey AS project_id, n_name AS premise, '' AS synopsis,
           '' AS themes, '' AS tone, '' AS style_instructions, '' AS world_rules FROM nation""",
    ),
    "notes": (
        (),
        """SELECT conv_id * 1000 + turn AS note_id, 'src' || (conv_id % 20) AS project_id, role AS title, 'general' AS note_type,
           text AS plain_text, turn % 2 = 0 AS include_in_ai_context,
           CASE WHEN turn % 5 = 0 THEN 'archived' END AS deleted_at, conv_id * 1000 + turn AS created_at FROM conversations""",
    ),
    "outline": (
        (),
        """SELECT p_partkey AS item_id, 'src' || (p_partkey % 20) AS project_id, p_name AS title,
           p_type || ' ' || p_brand AS description,
           CASE p_partkey % 6 WHEN 0 THEN 'act' WHEN 1 THEN 'scene' WHEN 2 THEN 'chapter' ELSE 'other' END AS item_type,
           CASE WHEN p_partkey % 4 = 0 THEN 'drafted' ELSE 'planned' END AS status, CAST(p_size AS BIGINT) AS position,
           p_partkey // 2 AS chapter_id, CASE WHEN p_partkey % 11 = 0 THEN 'archived' END AS deleted_at FROM part""",
    ),
    "ev": (
        (),
        """SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS at_us,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    ),
    "saves": (
        ("ev",),
        """SELECT event_id, user_id + CASE WHEN k >= 95 THEN 1000000000 ELSE 0 END AS chapter_id, at_us, k % 8 AS base_revision,
           'Bab ' || user_id AS title, CASE WHEN event_type = 'error' THEN '{"type":"note"}' ELSE '{"type":"doc"}' END AS content_json,
           event_type || ' ' || props AS plain_text FROM ev""",
    ),
    "save_steps": (
        ("saves", "chapters"),
        """SELECT s.*, c.revision_number AS initial, strlen(s.plain_text) > 2000000 AS too_large, s.content_json NOT LIKE '%"doc"%' AS not_a_doc,
           row_number() OVER (PARTITION BY s.chapter_id ORDER BY at_us, event_id) AS n
           FROM saves s JOIN chapters c ON c.chapter_id = s.chapter_id""",
    ),
    "save_fold": (
        ("save_steps",),
        """SELECT chapter_id, n, event_id, initial AS met, initial + CASE WHEN base_revision = initial AND NOT too_large AND NOT not_a_doc
             THEN 1 ELSE 0 END AS after FROM save_steps WHERE n = 1
           UNION ALL
           SELECT s.chapter_id, s.n, s.event_id, f.after, f.after + CASE WHEN s.base_revision = f.after AND NOT s.too_large
             AND NOT s.not_a_doc THEN 1 ELSE 0 END FROM save_fold f JOIN save_steps s ON s.chapter_id = f.chapter_id AND s.n = f.n + 1""",
    ),
    "save_outcomes": (
        ("saves", "save_fold"),
        """SELECT s.event_id, s.chapter_id, s.at_us, s.base_revision, f.met AS revision_met,
           CASE WHEN f.met IS NULL THEN 'NOT_FOUND' WHEN s.base_revision <> f.met THEN 'REVISION_CONFLICT'
             WHEN strlen(s.plain_text) > 2000000 THEN 'CHAPTER_TOO_LARGE'
             WHEN s.content_json NOT LIKE '%"doc"%' THEN 'INVALID_DOCUMENT' ELSE 'accepted' END AS outcome,
           CASE WHEN f.after > f.met THEN f.after END AS new_revision
           FROM saves s LEFT JOIN save_fold f ON f.event_id = s.event_id""",
    ),
    "states": (
        ("chapters", "saves", "save_outcomes"),
        """SELECT a.*, o.at_us AS to_us FROM (
             SELECT chapter_id, project_id, revision_number AS revision, title, content_json, plain_text, CAST(NULL AS BIGINT) AS from_us
             FROM chapters
             UNION ALL
             SELECT s.chapter_id, c.project_id, o.new_revision, s.title, s.content_json, s.plain_text, o.at_us
             FROM save_outcomes o JOIN saves s ON s.event_id = o.event_id JOIN chapters c ON c.chapter_id = s.chapter_id
             WHERE o.outcome = 'accepted') a
           LEFT JOIN save_outcomes o ON o.outcome = 'accepted' AND o.chapter_id = a.chapter_id AND o.revision_met = a.revision""",
    ),
    "versions": (("states",), "SELECT * FROM states WHERE to_us IS NOT NULL"),
    "generations": (
        ("ev",),
        """SELECT event_id AS generation_id, user_id, 'src' || (user_id % 20) AS project_id,
           CASE event_type WHEN 'click' THEN 'rewrite' WHEN 'signup' THEN 'continue' WHEN 'purchase' THEN 'brainstorm' ELSE 'chat' END AS action,
           CASE event_type WHEN 'view' THEN '[Ask My Story] ' || props WHEN 'purchase' THEN '[Memory] ' || props ELSE props END AS prompt, 'Jawaban ' || props AS result,
           CASE event_type WHEN 'click' THEN 'nebius:other/model' WHEN 'view' THEN 'gateway:any/model-' || k ELSE 'nebius:nvidia/nemotron-' || k END AS model,
           CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END AS status, k AS total_tokens, k - k // 3 AS input_tokens, k // 3 AS output_tokens, k % 7 AS retrieved, value AS latency_ms,
           at_us AS created_us FROM ev""",
    ),
    "answers": (
        ("chunks",),
        """SELECT chapter_id * 1000 + chunk_index AS answer_id, CASE (chapter_id + chunk_index) % 8
             WHEN 0 THEN to_json({'claims': [good]})
             WHEN 1 THEN to_json({'claims': [good, {'text': 'Klaim', 'source_id': 'bukan sumber', 'quote': q}]})
             WHEN 2 THEN to_json({'claims': [{'text': 'Klaim', 'source_id': chunk_id, 'quote': q || '~~'}]})
             WHEN 3 THEN '{"claims":[]}'
             WHEN 4 THEN NULL
             WHEN 5 THEN to_json({'claims': [good, good]})
             WHEN 6 THEN to_json({'claims': [good, good, good, good, good, good, good]})
             ELSE to_json({'claims': [{'text': chapter_id, 'source_id': chunk_id, 'quote': q}]}) END AS doc
           FROM (SELECT chapter_id, chunk_index, chunk_id, substring(content, 3, 60) AS q,
             {'text': 'Klaim ' || chapter_id, 'source_id': chunk_id, 'quote': substring(content, 3, 60)} AS good FROM chunks)""",
    ),
    "answer_sources": (
        ("chunks",),
        """SELECT chapter_id * 1000 + chunk_index - back AS answer_id, chunk_id AS source_id, content, chapter_id, project_id, source_revision,
           source_hash FROM chunks CROSS JOIN (VALUES (0), (1)) v(back) WHERE chunk_index >= back""",
    ),
    "claims": (
        ("answers", "answer_sources"),
        r"""SELECT c.answer_id, c.claim_no, c.text, c.source_id, c.quote,
           coalesce(c.text IS NOT NULL AND regexp_replace(c.text, '^\s+|\s+$', '', 'g') <> '' AND length(c.text) <= 1200
             AND length(c.quote) BETWEEN 5 AND 1000 AND contains(s.content, c.quote), false) AS valid
           FROM (SELECT answer_id, i AS claim_no,
               CASE WHEN json_type(doc, '$.claims[' || (i - 1) || '].text') = 'VARCHAR'
                 THEN json_extract_string(doc, '$.claims[' || (i - 1) || '].text') END AS text,
               json_extract_string(doc, '$.claims[' || (i - 1) || '].source_id') AS source_id,
               json_extract_string(doc, '$.claims[' || (i - 1) || '].quote') AS quote
             FROM (SELECT answer_id, doc, unnest(range(1, CAST(json_array_length(doc, '$.claims') AS BIGINT) + 1)) AS i
               FROM answers WHERE json_array_length(doc, '$.claims') <= 6)) c
           LEFT JOIN answer_sources s ON s.answer_id = c.answer_id AND s.source_id = c.source_id""",
    ),
    "answer_outcomes": (
        ("answers", "claims"),
        """SELECT a.answer_id, CASE WHEN a.doc IS NULL OR json_array_length(a.doc, '$.claims') > 6 THEN 'INVALID_ANSWER'
             WHEN json_array_length(a.doc, '$.claims') = 0 THEN 'abstained' WHEN c.ok THEN 'accepted'
             ELSE 'UNSUPPORTED_CITATION' END AS outcome, coalesce(c.n, 0) AS claims
           FROM answers a LEFT JOIN (SELECT answer_id, bool_and(valid) AS ok, count(*) AS n FROM claims GROUP BY 1) c USING (answer_id)""",
    ),
    "analyses": (
        ("chunks",),
        """SELECT 'a' || chunk_id AS analysis_id, CASE WHEN kind = 6 THEN 'tidak dikenal' ELSE chunk_id END AS chunk_id, number AS created_at,
           kind, 'Ringkasan ' || chapter_id AS summary, substring(content, 5, 40) AS q, content
           FROM (SELECT *, chapter_id + chunk_index AS number, (chapter_id + chunk_index) % 8 AS kind FROM chunks)""",
    ),
    "analysis_outcomes": (
        ("analyses", "chunks", "chapters", "insights"),
        """SELECT a.*, s.project_id, CASE WHEN s.chunk_id IS NULL THEN 'NOT_FOUND'
             WHEN s.source_revision <> c.revision_number OR s.source_hash <> c.text_hash THEN 'STALE_SOURCE'
             WHEN i.chunk_id IS NOT NULL THEN 'existing'
             WHEN a.created_at % 19 = 0 OR a.created_at % 17 = 0 OR a.created_at % 23 = 0 THEN 'NOT_FOUND'
             WHEN a.kind IN (1, 3, 4) THEN 'INVALID_INSIGHTS' ELSE 'saved' END AS outcome
           FROM analyses a LEFT JOIN chunks s ON s.chunk_id = a.chunk_id LEFT JOIN chapters c ON c.chapter_id = s.chapter_id
           LEFT JOIN insights i ON i.chunk_id = s.chunk_id""",
    ),
    "reviews": (
        ("facts",),
        f"""SELECT created_at * 4 + step AS event_id, CASE WHEN created_at % 13 = 0 THEN 'x' ELSE '' END || fact_id AS fact_id,
           {_EPOCH} + (created_at * 4 + step) * 1000000 AS at_us, base_revision, st AS status, claim
           FROM facts CROSS JOIN (VALUES (0, CAST(0 AS BIGINT), 'approved'), (1, 1, 'ignored'), (2, 1, 'approved'), (3, 2, 'pending'))
           v(step, base_revision, st)""",
    ),
    "review_steps": (
        ("reviews", "facts", "chunks", "chapters"),
        """SELECT r.*, f.revision AS initial, r.status = 'approved' AND (s.source_revision <> c.revision_number OR s.source_hash <> c.text_hash) AS stale,
           row_number() OVER (PARTITION BY r.fact_id ORDER BY r.at_us, r.event_id) AS n
           FROM reviews r JOIN facts f ON f.fact_id = r.fact_id JOIN chunks s ON s.chunk_id = f.chunk_id
           JOIN chapters c ON c.chapter_id = s.chapter_id""",
    ),
    "edit_steps": (
        ("ev", "outline"),
        """SELECT e.event_id, e.user_id AS row_id, e.at_us, e.k % 4 AS base_revision, o.project_id <> 'src' || (e.k % 20) AS moved,
           row_number() OVER (PARTITION BY e.user_id ORDER BY e.at_us, e.event_id) AS n
           FROM ev e JOIN outline o ON o.item_id = e.user_id""",
    ),
    "edit_fold": (
        ("edit_steps",),
        """SELECT row_id, n, event_id, CAST(0 AS BIGINT) AS met, CAST(CASE WHEN base_revision = 0 AND NOT moved THEN 1 ELSE 0 END AS BIGINT) AS after
           FROM edit_steps WHERE n = 1
           UNION ALL
           SELECT s.row_id, s.n, s.event_id, f.after, f.after + CASE WHEN s.base_revision = f.after AND NOT s.moved THEN 1 ELSE 0 END
           FROM edit_fold f JOIN edit_steps s ON s.row_id = f.row_id AND s.n = f.n + 1""",
    ),
    "review_fold": (
        ("review_steps",),
        """SELECT fact_id, n, event_id, initial AS met, initial + CASE WHEN base_revision = initial AND NOT stale THEN 1 ELSE 0 END AS after
           FROM review_steps WHERE n = 1
           UNION ALL
           SELECT s.fact_id, s.n, s.event_id, f.after, f.after + CASE WHEN s.base_revision = f.after AND NOT s.stale THEN 1 ELSE 0 END
           FROM review_fold f JOIN review_steps s ON s.fact_id = f.fact_id AND s.n = f.n + 1""",
    ),
    "review_outcomes": (
        ("reviews", "review_steps", "review_fold"),
        """SELECT r.event_id, r.fact_id, r.at_us, r.base_revision, r.status, r.claim, f.met AS revision_met,
           CASE WHEN s.fact_id IS NULL THEN 'NOT_FOUND' WHEN s.stale THEN 'STALE_SOURCE' WHEN f.after = f.met THEN 'REVISION_CONFLICT'
             ELSE 'applied' END AS outcome
           FROM reviews r LEFT JOIN review_steps s ON s.event_id = r.event_id LEFT JOIN review_fold f ON f.event_id = r.event_id""",
    ),
    "terms": (
        ("questions",),
        f"""SELECT query_id, project_id, token, min(pos) AS first FROM (
             SELECT query_id, project_id, lower(w) AS token, pos FROM (
               SELECT query_id, project_id, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM (
                 SELECT query_id, project_id, regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}]+') AS a FROM questions))
             WHERE length(w) > 2 AND lower(w) NOT IN ({_STOP})) GROUP BY 1, 2, 3
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) <= 20""",
    ),
    "word_hits": (
        ("live", "terms"),
        f"""SELECT t.query_id, s.chunk_id, count(*) AS hits FROM (SELECT project_id, chunk_id, unnest({words('content')}) AS token FROM live) s
           JOIN terms t ON t.project_id = s.project_id AND t.token = s.token GROUP BY 1, 2""",
    ),
    "fact_hits": (
        ("live", "facts", "terms"),
        f"""SELECT query_id, chunk_id, max(hits) AS hits FROM (
             SELECT t.query_id, f.chunk_id, f.fact_id, count(*) AS hits FROM (
               SELECT f.project_id, f.chunk_id, f.fact_id, unnest({words('f.claim')}) AS token
               FROM facts f JOIN live s ON s.chunk_id = f.chunk_id WHERE f.status = 'approved' AND contains(s.content, f.quote)) f
             JOIN terms t ON t.project_id = f.project_id AND t.token = f.token GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ),
    "texts": (
        ("chapters", "characters", "bibles", "notes", "outline"),
        r"""SELECT project_id, 'chapter' AS kind, CAST(chapter_id AS VARCHAR) AS source_id, title AS heading, title || chr(10) || plain_text AS body
           FROM chapters
           UNION ALL SELECT project_id, 'characters', CAST(character_id AS VARCHAR), name,
             concat_ws(chr(10), name, array_to_string(aliases, ', '), role, description, CAST(to_json(attributes) AS VARCHAR))
             FROM characters WHERE deleted_at IS NULL
           UNION ALL SELECT project_id, 'story_bibles', CAST(bible_id AS VARCHAR), 'Story Bible',
             concat_ws(chr(10), premise, synopsis, themes, tone, style_instructions, world_rules) FROM bibles
           UNION ALL SELECT project_id, 'notes', CAST(note_id AS VARCHAR), title, concat_ws(chr(10), title, note_type, plain_text)
             FROM notes WHERE deleted_at IS NULL
           UNION ALL SELECT project_id, 'outline_items', CAST(item_id AS VARCHAR), title, concat_ws(chr(10), title, description)
             FROM outline WHERE deleted_at IS NULL""",
    ),
    "searches": (
        (),
        """SELECT item_id AS request_id, 'src' || (item_id % 20) AS project_id,
           CASE WHEN item_id % 2 = 0 THEN substring(text, 4, 3) ELSE substring(text, 1, 14) END AS query,
           CASE WHEN item_id % 4 = 0 THEN 20 ELSE 0 END AS page_offset FROM benchmark""",
    ),
    "asked": (
        ("chapters",),
        """SELECT chapter_id AS request_id, project_id, CASE chapter_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'rewrite' WHEN 2 THEN 'continue' ELSE 'brainstorm' END AS action,
           chapter_id % 10 <> 9 AND chapter_id % 7 <> 0 AS with_chapter FROM chapters""",
    ),
    "allowed": (("asked",), "SELECT *, request_id AS chapter_id FROM asked WHERE action <> 'continue' OR with_chapter"),
    "context_parts": (
        ("allowed", "chapters", "bibles", "characters", "notes"),
        """SELECT a.request_id, 0 AS kind, CAST(0 AS BIGINT) AS ord, 'Bab: ' || title || ' (versi ' || revision_number || ')' AS label,
             CASE WHEN action = 'continue' THEN right(plain_text, 12000) ELSE plain_text END AS text FROM allowed a JOIN chapters USING (chapter_id) WHERE with_chapter
           UNION ALL
           SELECT c.chapter_id, 1, 0, 'Story Bible', CAST(to_json({'premise': b.premise, 'synopsis': b.synopsis, 'themes': b.themes, 'tone': b.tone,
             'style_instructions': b.style_instructions, 'world_rules': b.world_rules}) AS VARCHAR)
             FROM allowed c JOIN bibles b USING (project_id) WHERE c.chapter_id % 2 = 0
           UNION ALL
           SELECT c.chapter_id, 2, k.n, 'Karakter: ' || k.name, CAST(to_json({'name': k.name, 'aliases': k.aliases, 'role': k.role,
             'description': k.description, 'attributes': k.attributes}) AS VARCHAR)
             FROM allowed c JOIN (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, character_id) AS n
               FROM characters WHERE include_in_ai_context AND deleted_at IS NULL) k USING (project_id) WHERE k.n <= 20
           UNION ALL
           SELECT c.chapter_id, 3, k.n, 'Catatan: ' || k.title, k.plain_text
             FROM allowed c JOIN (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, note_id) AS n
               FROM notes WHERE include_in_ai_context AND deleted_at IS NULL) k USING (project_id)
             WHERE k.n <= 10 AND c.chapter_id % 3 <> 0""",
    ),
    "context": (
        ("context_parts",),
        """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY kind, ord) - 1 AS place, label,
             substring(text, 1, CAST(taken AS BIGINT)) AS text, truncated
           FROM (SELECT *, bool_or(taken < total) OVER (PARTITION BY request_id) AS truncated FROM (
             SELECT *, least(capped, greatest(0, 22000 - coalesce(sum(capped) OVER (PARTITION BY request_id ORDER BY kind, ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken
             FROM (SELECT *, length(text) AS total, least(length(text), 12000) AS capped FROM context_parts)))
           WHERE taken > 0""",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the views it names, and those they need, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in FRAGMENTS[name][0]:
            need(other)
        order.append(name)

    for name in names:
        need(name)
    views = ",\n".join(f"{name} AS ({FRAGMENTS[name][1]})" for name in order)
    return f"WITH RECURSIVE {views}\n{body}" if order else body
