import contextlib
import io

import pytest

from pyspark.sql import functions as F

from foliospark.operators import access, retrieval as R
from foliospark.operators.chunking import chunk_chapters
from foliospark.operators.evidence import analysis_outcomes
from foliospark.operators.review import review_outcomes, reviewed_facts
from foliospark.sources.tables import read_index, write_index
from tests.helpers import chapters, ready_jobs
from tests.test_chunking import LONG

LOFT = "Nadir menaruh peta laut di loteng. Wening menjual ikan asin kepada Nadir tiap Rabu."


@pytest.fixture(scope="module")
def story(spark):
    df = chapters(
        spark,
        ("north", 11, "Loteng", LOFT, 2),
        ("north", 12, "Dermaga", LONG, 0),
        ("south", 13, "Pasar", "Penjaga pasar hafal kata MerpatiSenja sejak kecil.", 0),
    ).cache()
    return df, chunk_chapters(df).cache()


def ask(spark, story, text, project="north", facts=None, chapters_df=None, chunks=None):
    df = story[0] if chapters_df is None else chapters_df
    q = spark.createDataFrame([(1, project, text)], "query_id long, project_id string, query string")
    return R.retrieve(q, story[1] if chunks is None else chunks, df, ready_jobs(df), facts).orderBy("rank").collect()


@pytest.mark.parametrize(
    "project, text, found",
    [("north", "MerpatiSenja", {12}), ("south", "merpatisenja!", {13}), ("north", "siapa menjual ikan?", {11}), ("south", "loteng", set()), ("north", "y" * 2001, set()), ("north", "dan yang itu", set())],
)
def test_chunks_of_the_own_project_are_found(spark, story, project, text, found):
    assert {r.chapter_id for r in ask(spark, story, text, project)} == found


def test_each_matching_word_counts_a_tenth(spark, story):
    assert ask(spark, story, "NADIR peta")[0].score == pytest.approx(0.3)


def test_text_that_is_not_indexed_yet_is_not_found(spark, story):
    q = spark.createDataFrame([(1, "north", "Wening")], "query_id long, project_id string, query string")
    for status, hits in (("processing", 0), ("failed", 0), ("ready", 1)):
        jobs = story[0].select("chapter_id", F.lit(status).alias("status"))
        assert R.retrieve(q, story[1], story[0], jobs).count() == hits


def test_facts_help_only_when_approved_current_and_grounded(spark, story):
    df, chunks = story
    chunk = chunks.where("chapter_id = 11").first().chunk_id
    facts = spark.createDataFrame(
        [("f1", "north", chunk, "Pedagang keliling langganan", "menjual ikan asin", "pending", 0), ("f2", "north", chunk, "Saudagar rempah", "menjual rempah", "approved", 0)],
        "fact_id string, project_id string, chunk_id string, claim string, quote string, status string, revision long",
    )
    # Refused, approved, back to pending, approved again; one review comes too late and names an old revision.
    steps = [(1, 0, "ignored"), (2, 1, "approved"), (3, 1, "ignored"), (4, 2, "pending"), (5, 3, "approved")]

    def after(n, chapters_df=df):
        reviews = spark.createDataFrame(
            [(i, "f1", i, base, status, "Pedagang keliling langganan") for i, base, status in steps[:n]],
            "event_id long, fact_id string, at_us long, base_revision long, status string, claim string",
        )
        outcomes = review_outcomes(reviews, facts, chunks, chapters_df)
        return outcomes, reviewed_facts(facts, reviews, outcomes).cache()

    found = [bool(ask(spark, story, "pedagang keliling", facts=after(n)[1])) for n in (1, 2, 3, 4, 5)]
    assert found == [False, True, True, False, True]
    # An approved claim whose quote is not in the chunk helps nobody.
    assert ask(spark, story, "saudagar", facts=facts) == []
    outcomes, approved = after(5)
    assert [r.outcome for r in outcomes.orderBy("event_id").collect()].count("applied") == 4
    rewritten = chapters(spark, ("north", 11, "Loteng", "Loteng itu kini kosong.", 3))
    assert ask(spark, story, "pedagang ikan asin", facts=approved, chapters_df=rewritten) == []
    assert {r.outcome for r in after(2, rewritten)[0].where("status = 'approved'").collect()} == {"STALE_SOURCE"}
    payload = '{"summary":"s","facts":[]}'
    analysis = spark.createDataFrame([("a", chunk, 1, payload)], "analysis_id string, chunk_id string, created_at long, payload string")
    assert analysis_outcomes(analysis, chunks, rewritten, spark.createDataFrame([], "chunk_id string")).first().outcome == "STALE_SOURCE"
    assert [r.chapter_id for r in ask(spark, story, "kosong", chapters_df=rewritten, chunks=chunk_chapters(rewritten))] == [11]


def test_owner_scope_and_planted_leak(spark, story):
    df, chunks = story
    projects = spark.createDataFrame([("north", "ana"), ("south", "ben"), ("west", "ana")], "project_id string, owner_id string")
    seen = {o: {r.chapter_id for r in access.scoped(chunks, projects, o).collect()} for o in ("ana", "ben", "eve")}
    assert seen == {"ana": {11, 12}, "ben": {13}, "eve": set()}
    leaks = lambda rows: {r.chapter_id for r in access.leaked_rows(rows, df, projects, "chapter_id").collect()}
    assert leaks(chunks) == set()
    moved = lambda at: chunks.withColumn("project_id", F.when(F.col("chapter_id") == 11, at).otherwise(F.col("project_id")))
    assert leaks(moved("south")) == {11} and leaks(moved("west")) == set()
    assert leaks(chunks.withColumn("chapter_id", F.col("chapter_id") + F.when(F.col("chapter_id") == 13, 100).otherwise(0))) == {113}


def test_neighbours_are_compared_with_the_raw_list(spark):
    rows = [(1, 1, 9, 5), (1, 2, 9, 6), (1, 3, 9, 7), (1, 4, 9, 9), (1, 5, 8, 6), (1, 6, 7, 0), (1, 7, 6, 0), (1, 8, 5, 0)]
    hits = spark.createDataFrame(rows, "query_id long, rank long, chapter_id long, chunk_index long")
    kept = R.without_neighbours(hits).orderBy("evidence_rank").collect()
    # The chunk at 7 goes although its neighbour at 6 has gone as well.
    assert [(r.chapter_id, r.chunk_index) for r in kept] == [(9, 5), (9, 9), (8, 6), (7, 0), (6, 0), (5, 0)]


def test_alias_expansion(spark):
    people = spark.createDataFrame(
        [
            ("p", 1, "Raka", ["Si Elang", "E"], True, None, 1),
            ("p", 2, "Sari", ["Bunga"], False, None, 2),
            ("p", 3, "Dewi", ["Lala"], True, "archived", 3),
            ("q", 4, "Elang", [], True, None, 4),
        ],
        "project_id string, character_id long, name string, aliases array<string>, include_in_ai_context boolean, deleted_at string, created_at long",
    )
    asked = spark.createDataFrame(
        [(1, "p", "Di mana si elang, Bunga dan lala?"), (2, "p", "e"), (3, "x", "Elang?")],
        "query_id long, project_id string, query string",
    )
    got = {r.query_id: (r.query, r.mentioned) for r in R.expand_with_aliases(asked, people).collect()}
    assert got == {1: ("Di mana si elang, Bunga dan lala? Raka Si Elang E", 1), 2: ("e", 0), 3: ("Elang?", 0)}


def test_stored_index_gives_the_same_hits(spark, corpus, tmp_path):
    """Few chunks a bucket, so that there are many buckets; only those of the words asked for are read."""
    chunks, path = corpus.chunks, str(tmp_path / "index")
    write_index(chunks, path, chunks_per_bucket=3)
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    assert buckets == -(-chunks.count() // 3) > 50
    direct = R.retrieve(corpus.questions, chunks, corpus.chapters, corpus.jobs)
    for asked in (corpus.questions, corpus.questions.where("query_id = 1")):
        index = read_index(spark, path, R.query_terms(asked))
        indexed = R.retrieve(asked, chunks, corpus.chapter_keys, corpus.jobs, index=index)
        want = direct.join(asked.select("query_id"), "query_id", "left_semi").select(indexed.columns)
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, indexed.collect()))
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            indexed.explain("formatted")
        assert "PartitionFilters: [token_bucket" in text.getvalue()
        assert "plain_text" not in text.getvalue() and "content" not in text.getvalue() and "md5" not in text.getvalue()
    wanted = {r[0] for r in R.query_terms(asked).selectExpr(f"pmod(xxhash64(project_id, token), {buckets})").collect()}
    files = read_index(spark, path, R.query_terms(asked)).select(F.input_file_name()).distinct().collect()
    read = {int(f[0].split("token_bucket=")[1].split("/")[0]) for f in files}
    assert read <= wanted and len(read) < buckets / 2


def test_words_are_counted_in_their_row(spark):
    texts = ["", None, "satu", "b a B a, A!", " -- ", "x " * 20_000 + "xy", "ΟΔΟΣ οδος İ é É 1 11 1"]
    chunks = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project_id string, chunk_id string, content string")
    got = {}
    for r in R.build_index(chunks).collect():
        got.setdefault(int(r.chunk_id), []).append((r.token, r.tf))
    plain = R.token_positions(chunks).groupBy("chunk_id", "token").agg(F.sum("tf").alias("tf")).collect()
    want = {}
    for r in sorted(plain, key=lambda r: r.token.encode()):
        want.setdefault(int(r.chunk_id), []).append((r.token, r.tf))
    assert got == want and got[3] == [("a", 3), ("b", 2)] and got[5] == [("x", 20_000), ("xy", 1)]


def test_hits_are_counted_where_the_words_of_a_chunk_are(spark, corpus, tmp_path):
    """Nothing is moved per query and chunk but the first rows of each query, and the index has no text keys in its rows."""
    path = str(tmp_path / "index")
    write_index(corpus.chunks, path)
    assert set(spark.read.parquet(f"{path}/postings").columns) == {"project_id", "token", "chapter_id", "chunk_key", "tf", "token_bucket"}
    index = read_index(spark, path, R.query_terms(corpus.questions))
    for facts in (None, corpus.grounded_facts):
        hits = R.retrieve(corpus.questions, corpus.chunks, corpus.chapter_keys, corpus.jobs, facts, index=index)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            hits.explain()
        plan = text.getvalue().splitlines()
        # The exchange by query takes the rows that its limit leaves; no other one has a query in its key.
        moved = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(query_id" in line]
        assert len(moved) == 1 and "WindowGroupLimit" in plan[moved[0] + 1] and "Partial" in plan[moved[0] + 1]
        assert "SortMergeJoin [project_id" not in text.getvalue()


def test_a_fact_without_an_id_and_equal_chapters(spark, story):
    df, chunks = story
    asked = spark.createDataFrame([(1, "north", "rahasia kapal")], "query_id long, project_id string, query string")
    one = chunks.where("project_id = 'north'").limit(1).select(
        F.lit(None).cast("string").alias("fact_id"), "project_id", "chunk_id", F.lit("kapal kapal rahasia").alias("claim"), F.substring("content", 1, 5).alias("quote"), F.lit("approved").alias("status"), F.lit(0).cast("long").alias("revision")
    )
    jobs = ready_jobs(df)
    plain = {r.chunk_id: r.score for r in R.retrieve(asked, chunks, df, jobs).collect()}
    hit = one.first().chunk_id
    got = {r.chunk_id: r.score for r in R.retrieve(asked, chunks, df, jobs, one).collect()}
    assert round(10 * got[hit]) == round(10 * plain.get(hit, 0)) + 3
    twice = R.retrieve(asked, chunks, df.unionByName(df), jobs, one).collect()
    assert sorted(r.score for r in twice) == sorted([*got.values(), *got.values()])
