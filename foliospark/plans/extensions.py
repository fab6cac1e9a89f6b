"""Queries of the extensions, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from foliospark.operators import health, hybrid, mentions, repeats, retrieval, retrieval_quality, snapshots, story_checks, timeline, vectors
from foliospark.operators.chunking import with_currency
from foliospark.plans.catalog import ORACLES, QUERIES
from foliospark.plans.oracle import FRAGMENTS, sql, words
from foliospark.session import cut_lineage, run_folder
from foliospark.sources.story_fixtures import StoryCorpus

_MINUTES = "(at_us - 1704067200000000) // 60000000"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


FRAGMENTS.update(
    {
        "vectors": (
            (),
            """SELECT * FROM (SELECT *, list_sum([x * x FOR x IN v]) AS length_sq FROM (
                 SELECT e.vec_id, coalesce(d.source, 'src' || (e.vec_id % 20)) AS project_id,
                   [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN e.embedding] AS v
                 FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)) WHERE length_sq > 0""",
        ),
        "cosines": (
            ("vectors",),
            """SELECT q.vec_id AS query_id, c.vec_id, q.project_id,
                 CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, 65)]) AS DOUBLE) / (sqrt(CAST(q.length_sq AS DOUBLE)) * sqrt(CAST(c.length_sq AS DOUBLE))) AS score
               FROM vectors q JOIN vectors c ON c.project_id = q.project_id AND c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0""",
        ),
        "shingled": (
            ("chunks",),
            f"""SELECT project_id, chunk_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS shingles
               FROM (SELECT project_id, chunk_id, {words('content')} AS w FROM chunks) WHERE len(w) > 0""",
        ),
        "scene_classes": (
            ("shingled",),
            """SELECT project_id, chunk_id, shingles, min(chunk_id) OVER (PARTITION BY project_id, shingles) AS class_id,
                 count(*) OVER (PARTITION BY project_id, shingles) AS copies FROM shingled""",
        ),
        "scene_links": (
            ("scene_classes",),
            """SELECT project_id, a, b, shared, size_a + size_b - shared AS united FROM (
                 SELECT x.project_id, x.chunk_id AS a, y.chunk_id AS b, any_value(x.n) AS size_a, any_value(y.n) AS size_b, count(*) AS shared
                 FROM (SELECT project_id, chunk_id, len(shingles) AS n, unnest(shingles) AS s FROM scene_classes WHERE chunk_id = class_id) x
                 JOIN (SELECT project_id, chunk_id, len(shingles) AS n, unnest(shingles) AS s FROM scene_classes WHERE chunk_id = class_id) y
                   ON x.project_id = y.project_id AND x.s = y.s AND x.chunk_id < y.chunk_id
                 GROUP BY 1, 2, 3) WHERE 5 * shared >= 4 * (size_a + size_b - shared)""",
        ),
        "story_events": (
            ("ev",),
            f"SELECT event_id, 'src' || (event_id % 20) AS project_id, {_MINUTES} + k % 7 * 60 AS story_time FROM ev",
        ),
        "statements": (
            ("ev",),
            """SELECT event_id AS before, CASE WHEN floor(target / 2000.0) = floor(event_id / 2000.0) THEN target END AS after,
                 'src' || (event_id % 20) AS project_id
               FROM (SELECT event_id, CASE WHEN k = 50 THEN event_id WHEN k % 29 = 0 THEN event_id - 20 * (1 + k % 11)
                 ELSE event_id + 20 * (1 + k % 5) END AS target FROM ev)""",
        ),
        "reach": (
            ("statements",),
            """SELECT before AS a, after AS b FROM statements WHERE after IS NOT NULL
               UNION SELECT r.a, s.after FROM reach r JOIN statements s ON s.before = r.b WHERE s.after IS NOT NULL""",
        ),
        "cycles": (
            ("reach",),
            """SELECT event_id, cycle_id, count(*) OVER (PARTITION BY cycle_id) AS events FROM (
                 SELECT x.a AS event_id, min(x.b) AS cycle_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1)""",
        ),
        "sound_events": (
            ("statements", "reach", "cycles"),
            """SELECT e AS event_id FROM (SELECT before AS e FROM statements WHERE after IS NOT NULL UNION SELECT after FROM statements WHERE after IS NOT NULL)
               WHERE e NOT IN (SELECT event_id FROM cycles) AND e NOT IN (SELECT r.b FROM reach r JOIN cycles c ON c.event_id = r.a)""",
        ),
        "depths": (
            ("statements", "sound_events"),
            """SELECT event_id, 0 AS depth FROM sound_events
               UNION SELECT s.after, d.depth + 1 FROM depths d JOIN statements s ON s.before = d.event_id JOIN sound_events g ON g.event_id = s.after""",
        ),
        "states_of": (
            ("ev",),
            f"""SELECT event_id AS state_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS character_id, {_MINUTES} AS story_time,
                 CASE event_type WHEN 'error' THEN 'dead' WHEN 'purchase' THEN 'missing' WHEN 'view' THEN 'asleep' WHEN 'click' THEN 'awake' ELSE 'alive' END AS state
               FROM ev""",
        ),
        "scenes": (
            (),
            """SELECT o_orderkey AS scene_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 150 END AS character_id, o_orderkey * 37 % 44640 AS starts,
                 CASE WHEN o_orderkey % 997 <> 0 THEN o_orderkey * 37 % 44640 + o_orderkey % 90 END AS ends, o_orderkey % 11 = 0 AS is_flashback FROM orders""",
        ),
        "state_conflicts": (
            ("states_of", "scenes"),
            """SELECT c.scene_id, s.state_id, c.character_id, s.state
               FROM (SELECT *, lead(story_time) OVER (PARTITION BY character_id ORDER BY story_time, state_id) AS until FROM states_of) s
               JOIN scenes c ON c.character_id = s.character_id AND NOT c.is_flashback AND s.state IN ('dead', 'missing', 'asleep')
                 AND (s.until IS NULL OR s.until > s.story_time)
                 AND (s.until IS NULL OR c.starts < s.until) AND (c.ends IS NULL OR greatest(c.ends, c.starts + 1) > s.story_time)""",
        ),
        "knowledge": (
            (),
            """SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 50 END AS character_id,
                 CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey % 100 END AS fact_id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS story_time,
                 CASE WHEN l_returnflag = 'R' THEN 'not_known' ELSE 'known' END AS state FROM lineitem""",
        ),
        "uses": (
            ("ev",),
            """SELECT event_id AS use_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 60 END AS character_id,
                 CASE WHEN event_id % 3 = 0 THEN 0 ELSE k END AS fact_id, event_id * 7 % 3600 AS story_time FROM ev""",
        ),
        "verdicts": (
            ("knowledge", "uses"),
            """SELECT u.use_id, u.character_id, u.fact_id,
                 CASE WHEN k.state = 'known' THEN 'known' WHEN t.character_id IS NOT NULL THEN 'not_yet' ELSE 'unknown' END AS verdict,
                 CASE WHEN k.state = 'known' THEN k.row_id END AS learned_id
               FROM uses u
               ASOF LEFT JOIN (SELECT * FROM knowledge QUALIFY row_number() OVER (PARTITION BY character_id, fact_id, story_time ORDER BY row_id DESC, state DESC) = 1) k
                 ON k.character_id = u.character_id AND k.fact_id = u.fact_id AND u.story_time >= k.story_time
               LEFT JOIN (SELECT DISTINCT character_id, fact_id FROM knowledge) t ON t.character_id = u.character_id AND t.fact_id = u.fact_id""",
        ),
        "triples": (
            (),
            """SELECT o_orderkey AS fact_id, 'src' || (who % 20) AS project_id, 'n' || who AS subject, o_orderpriority || '/' || month(o_orderdate) AS predicate,
                 o_orderstatus AS object FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS who FROM orders)""",
        ),
        "alias_pairs": (
            (),
            """SELECT 'src' || (c_custkey % 20) AS project_id, 'n' || c_custkey AS name, 'n' || other AS other
               FROM (SELECT c_custkey, c_custkey - 20 * (1 + c_nationkey % 3) AS other FROM customer) WHERE other >= 0 AND c_custkey % 7 <> 0""",
        ),
        "alike": (
            ("alias_pairs",),
            """SELECT project_id, name AS a, other AS b FROM alias_pairs UNION SELECT project_id, other, name FROM alias_pairs
               UNION SELECT r.project_id, r.a, p.other FROM alike r JOIN (SELECT * FROM alias_pairs UNION SELECT project_id, other, name FROM alias_pairs) p
                 ON p.project_id = r.project_id AND p.name = r.b""",
        ),
        "subjects": (("alike",), "SELECT project_id, a AS name, least(a, min(b)) AS subject_id FROM alike GROUP BY project_id, a"),
        "named_facts": (
            ("triples", "subjects"),
            """SELECT t.*, coalesce(s.subject_id, t.subject) AS subject_id FROM triples t LEFT JOIN subjects s ON s.project_id = t.project_id AND s.name = t.subject""",
        ),
        "said": (
            ("named_facts",),
            """SELECT project_id, subject_id, predicate, count(DISTINCT object) AS objects, count(*) AS facts FROM named_facts GROUP BY 1, 2, 3""",
        ),
        "canon_steps": (
            ("ev",),
            """SELECT event_id, 'src' || (u % 20) AS project_id, 's' || u AS subject, 'p' || (k % 2) AS predicate, k % 5 AS fact_id,
                 CASE WHEN event_type IN ('purchase', 'click') THEN 'approve' WHEN event_type = 'error' THEN 'retract' ELSE 'propose' END AS kind,
                 row_number() OVER (PARTITION BY u, k % 2 ORDER BY at_us, event_id) AS n
               FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS u FROM ev)""",
        ),
        "canon_fold": (
            ("canon_steps",),
            """SELECT subject, predicate, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS fact_id, CAST(NULL AS VARCHAR) AS kind,
                 CAST(NULL AS BIGINT) AS was, CAST(NULL AS BIGINT) AS canon FROM canon_steps WHERE n = 1
               UNION ALL
               SELECT s.subject, s.predicate, s.n, s.event_id, s.fact_id, s.kind, f.canon,
                 CASE WHEN s.kind = 'approve' AND f.canon IS NULL THEN s.fact_id WHEN s.kind = 'retract' AND f.canon = s.fact_id THEN NULL ELSE f.canon END
               FROM canon_fold f JOIN canon_steps s ON s.subject = f.subject AND s.predicate = f.predicate AND s.n = f.n + 1""",
        ),
        "canon_outcomes": (
            ("canon_fold", "canon_steps"),
            """SELECT f.event_id, s.project_id, f.subject, f.predicate, f.fact_id, f.n,
                 CASE f.kind WHEN 'propose' THEN CASE WHEN was = f.fact_id THEN 'UNCHANGED' ELSE 'PROPOSED' END
                   WHEN 'retract' THEN CASE WHEN was = f.fact_id THEN 'RETRACTED' ELSE 'UNCHANGED' END
                   ELSE CASE WHEN was IS NULL THEN 'CANON' WHEN was = f.fact_id THEN 'UNCHANGED' ELSE 'CONFLICTED' END END AS outcome
               FROM canon_fold f JOIN canon_steps s ON s.event_id = f.event_id""",
        ),
        "named_characters": (
            ("characters",),
            "SELECT character_id, project_id, name, [name || ' ' || aliases[1], aliases[2]] AS aliases, deleted_at FROM characters",
        ),
        "alias_words": (
            ("named_characters",),
            f"""SELECT DISTINCT character_id, project_id, {_words('alias')} AS a FROM (
                 SELECT character_id, project_id, unnest(list_concat([name], aliases)) AS alias FROM named_characters WHERE deleted_at IS NULL)
               WHERE length(alias) > 1 AND len({_words('alias')}) > 0""",
        ),
        "mentions": (
            ("alias_words", "chapters"),
            f"""SELECT character_id, project_id, chapter_id, count(*) AS times FROM (
                 SELECT DISTINCT a.character_id, a.project_id, c.chapter_id, c.i
                 FROM (SELECT project_id, chapter_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT project_id, chapter_id, {_words('plain_text')} AS w FROM chapters)) c
                 JOIN alias_words a ON a.project_id = c.project_id AND a.a[1] = c.w[c.i] AND c.w[c.i:c.i + len(a.a) - 1] = a.a) GROUP BY 1, 2, 3""",
        ),
        "last_mentions": (
            ("mentions", "named_characters", "chapters"),
            """SELECT n.character_id, n.project_id, n.name, coalesce(m.chapters, 0) AS chapters, CAST(coalesce(m.times, 0) AS BIGINT) AS times, m.last_position,
                 e.last_place - m.last_position AS silent_for, coalesce(e.last_place - m.last_position >= 8, false) AS forgotten
               FROM named_characters n
               LEFT JOIN (SELECT m.character_id, m.project_id, count(*) AS chapters, sum(times) AS times, max(position) AS last_position
                 FROM mentions m JOIN chapters c ON c.chapter_id = m.chapter_id AND c.project_id = m.project_id GROUP BY 1, 2) m
                 ON m.character_id = n.character_id AND m.project_id = n.project_id
               LEFT JOIN (SELECT project_id, max(position) AS last_place FROM chapters GROUP BY 1) e ON e.project_id = n.project_id
               WHERE n.deleted_at IS NULL""",
        ),
        "planted": (
            ("chunks",),
            f"""SELECT item_id, project_id, chunk_id, max(n) + 12 AS words FROM (
                 SELECT item_id, project_id, chunk_id, diagonal, place - rn AS island, count(*) AS n FROM (
                   SELECT *, row_number() OVER (PARTITION BY item_id, project_id, chunk_id, diagonal ORDER BY place) AS rn FROM (
                     SELECT b.item_id, c.project_id, c.chunk_id, c.i - b.i AS diagonal, c.i AS place
                     FROM (SELECT item_id, i, w[i:i + 12] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT item_id, {_words('text')} AS w FROM benchmark))) b
                     JOIN (SELECT project_id, chunk_id, i, w[i:i + 12] AS g FROM (SELECT project_id, chunk_id, w, unnest(range(1, len(w) - 11)) AS i
                       FROM (SELECT project_id, chunk_id, {_words('content')} AS w FROM chunks))) c ON c.g = b.g))
                 GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3""",
        ),
        "eval_questions": (
            ("planted",),
            """SELECT DISTINCT p.item_id * 1000 + CAST(substring(p.project_id, 4) AS BIGINT) AS query_id, p.project_id, b.text AS query
               FROM planted p JOIN benchmark b ON b.item_id = p.item_id""",
        ),
        "eval_truth": (
            ("planted",),
            "SELECT item_id * 1000 + CAST(substring(project_id, 4) AS BIGINT) AS query_id, chunk_id, words FROM planted",
        ),
        "eval_terms": (("eval_questions",), FRAGMENTS["terms"][1].replace("FROM questions", "FROM eval_questions")),
        "eval_word_hits": (("live", "eval_terms"), FRAGMENTS["word_hits"][1].replace("JOIN terms", "JOIN eval_terms")),
        "eval_hits": (
            ("eval_word_hits", "live"),
            """SELECT * FROM (SELECT h.query_id, s.chunk_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.hits DESC, s.position, s.chunk_index, s.chapter_id) AS rank
               FROM eval_word_hits h JOIN live s ON s.chunk_id = h.chunk_id) WHERE rank <= 8""",
        ),
        "eval_scores": (
            ("eval_truth", "eval_hits"),
            """SELECT r.query_id, r.relevant, coalesce(g.found, 0) AS found, 1000000 * coalesce(g.found, 0) // least(r.relevant, 8) AS recall,
                 coalesce(1000000 // g.first, 0) AS reciprocal, CAST(1000000 * coalesce(g.gained, 0) // r.ideal AS BIGINT) AS gain
               FROM (SELECT query_id, count(*) AS relevant, sum(CASE WHEN place <= 8 THEN CAST(floor(words * (1 / log2(place + 1)) * 1000000 + 0.5) AS BIGINT) END) AS ideal
                 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, chunk_id) AS place FROM eval_truth) GROUP BY 1) r
               LEFT JOIN (SELECT t.query_id, count(*) AS found, min(h.rank) AS first, sum(CAST(floor(t.words * (1 / log2(h.rank + 1)) * 1000000 + 0.5) AS BIGINT)) AS gained
                 FROM eval_truth t JOIN eval_hits h ON h.query_id = t.query_id AND h.chunk_id = t.chunk_id GROUP BY 1) g USING (query_id)""",
        ),
        "places": ((), "SELECT p_partkey // 2 AS chapter_id, p_brand AS location FROM part"),
        "memory_before": (
            (),
            """SELECT 'src' || (o_custkey % 20) AS project_id, CASE o_orderstatus WHEN 'F' THEN 'event' WHEN 'O' THEN 'state' ELSE 'timeline entry' END AS kind,
                 o_orderkey AS row_id, o_orderpriority AS body FROM orders""",
        ),
        "memory_changes": (
            ("memory_before",),
            """SELECT project_id, kind, row_id, 'removed' AS change FROM memory_before WHERE row_id % 997 = 5
               UNION ALL SELECT project_id, kind, row_id, 'changed' FROM memory_before WHERE row_id % 499 = 7 AND row_id % 997 <> 5
               UNION ALL SELECT project_id, kind, row_id + 1000000000, 'added' FROM memory_before WHERE row_id % 701 = 11""",
        ),
    }
)


def query(name: str, oracle: str | None = None):
    def register(plan: Callable[[StoryCorpus], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(StoryCorpus(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


# --- vectors ------------------------------------------------------------------------------------------------

_NEAREST = """SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM cosines
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


@query("vector_topk", sql(_NEAREST, "cosines"))
def vector_topk(c: StoryCorpus) -> DataFrame:
    """The nearest vectors of each query's project, exactly."""
    return vectors.exact_neighbours(c.vector_queries, c.vectors)


@query("vector_index_topk")
def vector_index_topk(c: StoryCorpus) -> DataFrame:
    """The same through the stored index; what it misses is measured by vector_recall."""
    return vectors.indexed_neighbours(c.vector_queries, c.vectors, c.vector_index)


@query("vector_recall")
def vector_recall(c: StoryCorpus) -> DataFrame:
    exact = cut_lineage(vector_topk(c))
    return vectors.recall(exact, vector_index_topk(c)).select("neighbours", "found", F.expr("(1000 * found) div neighbours").alias("recall_milli"))


# --- repeated scenes ----------------------------------------------------------------------------------------


@query("repeated_scenes", sql("SELECT * FROM scene_links", "scene_links"))
def repeated_scenes(c: StoryCorpus) -> DataFrame:
    """Links between the first chunks of classes of equal shingles."""
    return repeats.repeated_scenes(c.chunks)[0]


@query(
    "scene_classes",
    sql(
        """SELECT c.project_id, c.chunk_id, c.class_id, c.copies, coalesce(l.links, 0) AS links FROM scene_classes c
           LEFT JOIN (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM scene_links UNION ALL SELECT b FROM scene_links) GROUP BY 1) l USING (class_id)""",
        "scene_classes",
        "scene_links",
    ),
)
def scene_classes(c: StoryCorpus) -> DataFrame:
    """Every chunk with its class and the number of classes that say much the same."""
    return repeats.repeated_scenes(c.chunks)[1]


# --- story time ---------------------------------------------------------------------------------------------


@query(
    "timeline_reversals",
    sql(
        """SELECT s.before, s.after, x.story_time AS before_time, y.story_time AS after_time FROM statements s
           JOIN story_events x ON x.event_id = s.before JOIN story_events y ON y.event_id = s.after WHERE x.story_time >= y.story_time""",
        "statements",
        "story_events",
    ),
)
def timeline_reversals(c: StoryCorpus) -> DataFrame:
    return timeline.reversals(c.statements, c.story_events).select("before", "after", "before_time", "after_time")


@query("timeline_cycles", sql("SELECT * FROM cycles", "cycles"))
def timeline_cycles(c: StoryCorpus) -> DataFrame:
    """Events that the statements put before themselves."""
    return timeline.cycles(c.statements)


@query(
    "timeline_levels",
    sql(
        """SELECT e AS event_id, CAST(d.level AS BIGINT) AS level FROM (SELECT before AS e FROM statements WHERE after IS NOT NULL UNION SELECT after FROM statements WHERE after IS NOT NULL)
           LEFT JOIN (SELECT event_id, max(depth) AS level FROM depths GROUP BY 1) d ON d.event_id = e""",
        "statements",
        "depths",
    ),
)
def timeline_levels(c: StoryCorpus) -> DataFrame:
    return timeline.levels(c.statements)


# --- continuity ---------------------------------------------------------------------------------------------


@query("state_conflicts", sql("SELECT * FROM state_conflicts", "state_conflicts"))
def state_conflicts(c: StoryCorpus) -> DataFrame:
    return story_checks.state_conflicts(c.states, c.scenes)


@query("knowledge_check", sql("SELECT * FROM verdicts", "verdicts"))
def knowledge_check(c: StoryCorpus) -> DataFrame:
    return story_checks.knowledge_check(c.uses, c.knowledge)


@query("subject_names", sql("SELECT fact_id, project_id, subject, subject_id FROM named_facts", "named_facts"))
def subject_names(c: StoryCorpus) -> DataFrame:
    return story_checks.canonical_facts(c.triples, c.aliases).select("fact_id", "project_id", "subject", "subject_id")


@query("contradictions", sql("SELECT * FROM said WHERE objects > 1", "said"))
def contradictions(c: StoryCorpus) -> DataFrame:
    return story_checks.contradictions(c.triples, c.aliases)


@query("canon_outcomes", sql("SELECT event_id, project_id, subject, predicate, fact_id, outcome FROM canon_outcomes", "canon_outcomes"))
def canon_outcomes(c: StoryCorpus) -> DataFrame:
    return story_checks.canon_states(c.canon_events)[0]


@query(
    "canon_states",
    sql(
        """SELECT project_id, subject, predicate, fact_id, arg_max(outcome, n) AS state FROM canon_outcomes WHERE outcome <> 'UNCHANGED' GROUP BY ALL""",
        "canon_outcomes",
    ),
)
def canon_states(c: StoryCorpus) -> DataFrame:
    return story_checks.canon_states(c.canon_events)[1]


# --- mentions -----------------------------------------------------------------------------------------------


@query("character_mentions", sql("SELECT * FROM mentions", "mentions"))
def character_mentions(c: StoryCorpus) -> DataFrame:
    return mentions.mentions(c.named_characters, *c.positions)


@query("forgotten_characters", sql("SELECT * FROM last_mentions", "last_mentions"))
def forgotten_characters(c: StoryCorpus) -> DataFrame:
    return mentions.last_mentions(c.named_characters, c.mentions, c.chapter_keys)


# --- hybrid retrieval ---------------------------------------------------------------------------------------


def _hybrid_sql(conditions: str, status: str) -> str:
    """The rankings as the library defines them, among the chapters that meet the conditions."""
    ranked = """SELECT query_id, item_id, CASE WHEN most = least THEN 1000 ELSE 1000 * (value - least) // (most - least) END AS points FROM (
        SELECT *, min(value) OVER (PARTITION BY query_id) AS least, max(value) OVER (PARTITION BY query_id) AS most FROM (
          SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, item_id) <= 100))"""
    lists = {
        "semantic": "(SELECT query_id, vec_id AS item_id, CAST(floor(score * 1000000) AS BIGINT) AS value FROM cosines JOIN pool ON pool.chapter_id = vec_id AND pool.project_id = cosines.project_id)",
        "importance": f"""(SELECT r.query_id, f.chapter_id AS item_id, count(*) AS value FROM requests r
            JOIN (SELECT f.project_id, c.chapter_id FROM facts f JOIN chunks c USING (chunk_id) WHERE f.status = '{status}') f ON f.project_id = r.project_id
            JOIN pool p ON p.chapter_id = f.chapter_id WHERE f.chapter_id <> r.query_id GROUP BY 1, 2)""",
        "recency": "(SELECT r.query_id, p.chapter_id AS item_id, p.position AS value FROM requests r JOIN pool p ON p.project_id = r.project_id WHERE p.chapter_id <> r.query_id)",
        "entities": """(SELECT r.query_id, m.chapter_id AS item_id, m.times AS value FROM requests r
            JOIN mentions m ON m.project_id = r.project_id AND m.character_id = r.character_id JOIN pool p ON p.chapter_id = m.chapter_id WHERE m.chapter_id <> r.query_id)""",
    }
    names = list(lists)
    parts = " UNION ALL ".join(
        f"SELECT query_id, item_id, {', '.join(f'points AS {n}' if n == name else f'0 AS {n}' for n in names)}, points * {weight} AS score FROM ({ranked.format(of=lists[name])})"
        for name, weight in zip(names, (4, 2, 1, 3), strict=True)
    )
    sums = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)
    body = f""", requests AS (SELECT vec_id AS query_id, project_id, CAST(substring(project_id, 4) AS BIGINT) AS character_id FROM vectors WHERE vec_id % 50 = 0),
      pool AS (SELECT chapter_id, project_id, position FROM chapters WHERE {conditions}),
      parts AS ({parts}),
      summed AS (SELECT query_id, item_id, CAST(sum(score) AS BIGINT) AS score, {sums} FROM parts GROUP BY 1, 2)
      SELECT query_id, row_number() OVER w AS rank, item_id AS chapter_id, score, {', '.join(names)} FROM summed
      WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item_id) QUALIFY row_number() OVER w <= 10"""
    return sql(body, "cosines", "facts", "chunks", "mentions", "places", "chapters")


def _hybrid(c: StoryCorpus, wanted: hybrid.StoryFilter) -> DataFrame:
    return hybrid.hybrid_search(c.hybrid_requests, c.vectors, c.chapter_keys, c.stored_facts, c.mentions, c.places, wanted)


@query("hybrid_topk", _hybrid_sql("position <= 400", "approved"))
def hybrid_topk(c: StoryCorpus) -> DataFrame:
    return _hybrid(c, hybrid.StoryFilter(up_to_position=400))


@query(
    "hybrid_filtered",
    _hybrid_sql(
        """position <= 300 AND chapter_id IN (SELECT chapter_id FROM places WHERE location = 'Brand#3')
           AND chapter_id IN (SELECT c.chapter_id FROM facts f JOIN chunks c USING (chunk_id) WHERE f.status = 'pending')""",
        "pending",
    ),
)
def hybrid_filtered(c: StoryCorpus) -> DataFrame:
    return _hybrid(c, hybrid.StoryFilter(up_to_position=300, location="Brand#3", fact_status="pending"))


# --- retrieval quality --------------------------------------------------------------------------------------


def _truth(c: StoryCorpus) -> tuple[DataFrame, DataFrame]:
    """Questions, one per passage and project that holds it, and their relevant chunks."""
    planted = cut_lineage(retrieval_quality.planted_passages(c.benchmark, c.chunks))
    query_id = (F.col("item_id") * 1000 + F.substring("project_id", 4, 10).cast("long")).alias("query_id")
    asked = planted.select("item_id", "project_id").distinct().join(c.benchmark, "item_id").select(query_id, "project_id", F.col("text").alias("query"))
    return asked, planted.select(query_id, "chunk_id", "words")


def _scores(c: StoryCorpus) -> DataFrame:
    asked, truth = _truth(c)
    hits = retrieval.retrieve(asked, c.chunks, c.chapter_keys, c.jobs, index=c.index_for(asked))
    return retrieval_quality.query_scores(truth, hits, 8)


@query("planted_passages", sql("SELECT * FROM planted", "planted"))
def planted_passages(c: StoryCorpus) -> DataFrame:
    return retrieval_quality.planted_passages(c.benchmark, c.chunks)


@query("retrieval_scores", sql("SELECT * FROM eval_scores", "eval_scores"))
def retrieval_scores(c: StoryCorpus) -> DataFrame:
    return _scores(c)


def _summary_sql(scores: str, metrics: tuple[str, ...]) -> str:
    values = ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS BIGINT)}}" for m in metrics)
    drawn = " + ".join(f"CAST(h >= {b} AS BIGINT)" for b in retrieval_quality.POISSON)
    return f"""each AS (SELECT query_id, x.metric, x.value FROM (SELECT query_id, unnest([{values}]) AS x FROM {scores})),
      drawn AS (SELECT metric, r, value, {drawn} AS weight FROM (
        SELECT *, CAST('0x' || substring(md5(query_id || ':' || r), 1, 8) AS BIGINT) AS h FROM each, range(1, 201) AS resample(r))),
      sums AS (SELECT metric, r, sum(weight * value) // sum(weight) AS mean FROM drawn GROUP BY 1, 2 HAVING sum(weight) > 0),
      placed AS (SELECT metric, mean, row_number() OVER (PARTITION BY metric ORDER BY mean, r) AS place, count(*) OVER (PARTITION BY metric) AS n FROM sums)
      SELECT e.metric, e.queries, e.mean, p.low, p.high FROM (SELECT metric, count(*) AS queries, CAST(sum(value) // count(*) AS BIGINT) AS mean FROM each GROUP BY 1) e
      JOIN (SELECT metric, CAST(min(CASE WHEN place > n * 5 // 200 THEN mean END) AS BIGINT) AS low, CAST(max(CASE WHEN place <= n - n * 5 // 200 THEN mean END) AS BIGINT) AS high
        FROM placed GROUP BY 1) p USING (metric)"""


@query("retrieval_quality", sql("", "eval_scores").rstrip() + ", " + _summary_sql("eval_scores", ("recall", "reciprocal", "gain")))
def retrieval_quality_(c: StoryCorpus) -> DataFrame:
    return retrieval_quality.summary(cut_lineage(_scores(c)))


# --- update summary -----------------------------------------------------------------------------------------


def _memory_changes(c: StoryCorpus) -> DataFrame:
    before, after = (run_folder(c.spark, f"snapshot-{x}") for x in ("before", "after"))
    for rows, path in ((c.memory_before, before), (c.memory_after, after)):
        snapshots.write_snapshot(rows, ["row_id"], path, 64)
    return snapshots.changes(c.spark, before, after, ["row_id"], ["project_id", "kind"])


@query("memory_changes", sql("SELECT * FROM memory_changes", "memory_changes"))
def memory_changes(c: StoryCorpus) -> DataFrame:
    return _memory_changes(c)


@query(
    "update_summary",
    sql(
        """SELECT project_id, kind, CAST(count_if(change = 'added') AS BIGINT) AS added, CAST(count_if(change = 'removed') AS BIGINT) AS removed,
           CAST(count_if(change = 'changed') AS BIGINT) AS changed FROM memory_changes GROUP BY 1, 2""",
        "memory_changes",
    ),
)
def update_summary(c: StoryCorpus) -> DataFrame:
    return snapshots.update_summary(_memory_changes(c))


# --- story health -------------------------------------------------------------------------------------------


@query(
    "story_health",
    sql(
        """SELECT CASE grouping(project_id, category, "check") WHEN 0 THEN 'check' WHEN 1 THEN 'category' WHEN 3 THEN 'project' WHEN 5 THEN 'category of all' ELSE 'total' END AS level,
             project_id, category, "check", CAST(sum(n) AS BIGINT) AS checked, CAST(sum(ok) AS BIGINT) AS passed, CAST(100 * sum(ok) // sum(n) AS BIGINT) AS percent FROM (
             SELECT 'Continuity' AS category, 'contradictions' AS "check", project_id, count(*) AS n, count_if(objects = 1) AS ok FROM said GROUP BY project_id
             UNION ALL SELECT 'Continuity', 'canon conflicts', project_id, count(*), count_if(outcome <> 'CONFLICTED') FROM canon_outcomes GROUP BY project_id
             UNION ALL SELECT 'Characters', 'knowledge', 'src' || (character_id % 20), count(*), count_if(verdict <> 'not_yet') FROM verdicts GROUP BY 3
             UNION ALL SELECT 'Characters', 'states', 'src' || (character_id % 20), count(*), count_if(scene_id NOT IN (SELECT scene_id FROM state_conflicts)) FROM scenes GROUP BY 3
             UNION ALL SELECT 'Characters', 'forgotten', project_id, count(*), count_if(NOT forgotten) FROM last_mentions GROUP BY project_id
             UNION ALL SELECT 'Timeline', 'order', project_id, count(*), count_if(event_id NOT IN (SELECT event_id FROM cycles)) FROM story_events GROUP BY project_id
             UNION ALL SELECT 'Timeline', 'story time', s.project_id, count(*), count_if(NOT coalesce(x.story_time >= y.story_time, false)) FROM statements s
               LEFT JOIN story_events x ON x.event_id = s.before LEFT JOIN story_events y ON y.event_id = s.after GROUP BY s.project_id
             UNION ALL SELECT 'Scenes', 'repeated', project_id, count(*), count_if(copies = 1 AND NOT class_id IN (SELECT a FROM scene_links UNION ALL SELECT b FROM scene_links))
               FROM scene_classes GROUP BY project_id
             UNION ALL SELECT 'Memory', 'current chunks', s.project_id, count(*), count_if(s.source_revision = c.revision_number AND s.source_hash = c.text_hash)
               FROM chunks s JOIN chapters c USING (chapter_id) GROUP BY s.project_id)
           GROUP BY GROUPING SETS ((project_id, category, "check"), (project_id, category), (project_id), (category), ())""",
        "said",
        "canon_outcomes",
        "verdicts",
        "scenes",
        "state_conflicts",
        "last_mentions",
        "cycles",
        "story_events",
        "statements",
        "scene_classes",
        "scene_links",
        "chunks",
        "chapters",
    ),
)
def story_health(c: StoryCorpus) -> DataFrame:
    """All story checks, each over everything it looks at."""
    own = F.concat(F.lit("src"), (F.col("character_id") % 20).cast("string")).alias("project_id")
    said = story_checks.canonical_facts(c.triples, c.aliases).groupBy("project_id", "subject_id", "predicate").agg(F.count_distinct("object").alias("objects"))
    broken = story_checks.state_conflicts(c.states, c.scenes).select("scene_id").distinct().withColumn("bad", F.lit(True))
    looped = timeline.cycles(c.statements).select("event_id", F.lit(True).alias("bad"))
    turned = timeline.reversals(c.statements, c.story_events).select("before", F.lit(True).alias("bad"))
    fine = F.col("bad").isNull().alias("passed")
    checks = {
        ("Continuity", "contradictions"): said.select("project_id", (F.col("objects") == 1).alias("passed")),
        ("Continuity", "canon conflicts"): canon_outcomes(c).select("project_id", (F.col("outcome") != "CONFLICTED").alias("passed")),
        ("Characters", "knowledge"): knowledge_check(c).select(own, (F.col("verdict") != "not_yet").alias("passed")),
        ("Characters", "states"): c.scenes.join(broken, "scene_id", "left").select(own, fine),
        ("Characters", "forgotten"): forgotten_characters(c).select("project_id", (~F.col("forgotten")).alias("passed")),
        ("Timeline", "order"): c.story_events.join(looped, "event_id", "left").select("project_id", fine),
        ("Timeline", "story time"): c.statements.join(turned, "before", "left").select("project_id", fine),
        ("Scenes", "repeated"): scene_classes(c).select("project_id", ((F.col("copies") == 1) & (F.col("links") == 0)).alias("passed")),
        ("Memory", "current chunks"): with_currency(c.chunks, c.chapter_keys).select("project_id", F.col("current").alias("passed")),
    }
    return health.health(cut_lineage(health.check_rows(checks)))
