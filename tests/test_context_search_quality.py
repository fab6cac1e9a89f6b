import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import context, quality, reports, search
from foliospark.sources.tables import write_manuscripts
from tests import helpers


def test_packing_equals_plain_loop(spark):
    rng = random.Random(1)
    cases = [["x" * rng.choice([0, 1, 500, 9000, 12000, 12001, 30000]) for _ in range(rng.randrange(0, 7))] for _ in range(80)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, texts array<string>")
    parts = F.transform(
        "texts",
        lambda t: F.struct(F.lit("l").alias("label"), F.substring(t, 1, 12000).alias("text"), F.length(t).cast("long").alias("chars")),
    )
    got = df.select("i", context.packed(parts).alias("p")).collect()
    for r in got:
        kept, cut = helpers.pack(cases[r.i])
        assert [len(p.text) for p in r.p.parts if p.text] == [len(k) for k in kept]
        assert any(p.cut for p in r.p.parts) == cut


def _texts(spark, *bodies):
    rows = [("p", "chapter", str(i), "Bab", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "project_id string, kind string, source_id string, heading string, body string")


def test_search_is_literal(spark):
    texts = _texts(spark, "100% benar", "a_b", "aXb", "Surat Di Perpustakaan")
    found = lambda q: [r.source_id for r in search.search_project(texts, "p", q).collect()]
    assert found("0%") == ["0"] and found("a_") == ["1"] and found(" SURAT di ") == ["3"] and found("tidak ada") == []
    for bad in ("a", " a ", "x" * 101):
        with pytest.raises(ValueError):
            search.search_project(texts, "p", bad)
    with pytest.raises(ValueError):
        search.search_project(texts, "p", "ab", 10001)


def test_excerpt_and_paging(spark):
    body = "a" * 100 + "JARUM" + "b" * 400
    texts = _texts(spark, *[body] * 45)
    first = search.search_project(texts, "p", "jarum").collect()
    assert len(first) == 21 and first[0].excerpt == "…" + body[40:300] + "…"
    requests = spark.createDataFrame(
        [(1, "p", "jarum", 0), (2, "p", "jarum", 40), (3, "q", "jarum", 0), (4, "p", "j", 0)],
        "request_id long, project_id string, query string, offset long",
    )
    got = search.search(requests, texts).collect()
    assert sorted(r.place for r in got if r.request_id == 1) == list(range(1, 22))
    assert [r.place for r in got if r.request_id == 1 and r.look_ahead] == [21]
    assert sum(r.request_id == 2 for r in got) == 5 and not any(r.request_id in (3, 4) for r in got)


def test_rules(spark):
    known = "33333333-3333-4333-8333-333333333333"
    requests = spark.createDataFrame(
        [
            (1, known, None, "chat", "Halo", "", True, "p", "s", 1400),
            (2, known, known, "rewrite", "Halo", " ", True, "p", "s", 1400),
            (3, known, None, "continue", "Halo", "", False, "p", "s", 1400),
            (4, "P3", "x", "ask", " ", "x" * 4001, True, "p" * 48000, "s", 2401),
        ],
        "id long, project_id string, chapter_id string, action string, instruction string, selection string, "
        "use_chapter boolean, prompt string, system string, max_output_tokens long",
    )
    found = {(r.row_key, r.rule) for r in quality.violations(requests, "requests", "id").collect()}
    broken = "project_uuid chapter_uuid action instruction selection_length budget output_tokens".split()
    assert found == {("2", "rewrite_needs_selection"), ("3", "continue_needs_chapter"), *[("4", rule) for rule in broken]}


def test_content_must_be_an_object(spark):
    rows = helpers.chapters(spark, ("p", 1, "Bab", "x", 0), ("p", 2, "", "x", -1)).withColumn(
        "content_json", F.when(F.col("chapter_id") == 2, "[1]").otherwise(F.col("content_json"))
    )
    found = {r.rule for r in quality.violations(rows, "chapters", "chapter_id").collect()}
    assert found == {"title_length", "revision_not_negative", "content_is_object"}


def test_unique_among_live_rows_and_orphans(spark):
    rows = spark.createDataFrame(
        [(1, 5, None), (2, 5, "archived"), (3, 6, None), (4, 6, None), (5, None, None), (6, None, None)],
        "item_id long, chapter_id long, deleted_at string",
    )
    assert [r.chapter_id for r in quality.duplicate_keys(rows, ["chapter_id"], live_only=True).collect()] == [6]
    parents = spark.createDataFrame([(5,)], "chapter_id long")
    assert {r.item_id for r in quality.orphans(rows, parents, ["chapter_id"]).collect()} == {3, 4}


def test_manuscript_text(spark, tmp_path):
    projects = spark.createDataFrame([("p", "Judul"), ("kosong", "Kosong")], "project_id string, title string")
    chapters = helpers.chapters(spark, ("p", 1, "Bab 1", "satu\ndua", 0), ("p", 2, "Bab 2", "tiga", 0)).withColumn(
        "position", F.col("chapter_id")
    )
    parts = reports.manuscript_parts(projects, chapters)
    pieces = parts.orderBy("project_id", "part", "position").collect()
    whole = {p: "".join(r.piece for r in pieces if r.project_id == p) for p in ("p", "kosong")}
    assert whole == {"p": "# Judul\n\n## Bab 1\n\nsatu\ndua\n\n## Bab 2\n\ntiga", "kosong": "# Kosong\n\n"}
    write_manuscripts(parts, str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "project_id=p").glob("*.txt"))
    assert "".join(f.read_text() for f in files) == whole["p"] + "\n"


def test_scalar_functions(spark):
    row = spark.createDataFrame(
        [("  Kapal\tlayar \n baru ", "Elang, , Si  Raka ,", "Bearer abc.def x", "<THINK>a", "```json\n{}\n```")],
        "words string, aliases string, secret string, output string, fenced string",
    ).select(
        X.word_count(F.col("words")).alias("n"),
        X.alias_list(F.col("aliases")).alias("a"),
        X.redact(F.col("secret")).alias("s"),
        X.rejected_output(F.col("output")).alias("r"),
        X.unfence(F.col("fenced")).alias("u"),
        X.pseudonym(F.lit("project-private")).alias("p"),
        X.query_words(F.lit("Siapa Kapal kapal di ÉCOLE x-ray 12 345")).alias("q"),
        X.word_count(F.lit(" \n")).alias("zero"),
        F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), X.retry_delay_seconds).alias("delays"),
    ).first()
    assert (row.n, row.a, row.s, row.r, row.u) == (3, ["Elang", "Si  Raka"], "Bearer [redacted] x", True, "{}")
    assert len(row.p) == 24 and row.q == ["kapal", "école", "ray", "345"] and row.zero == 0
    assert row.delays == [30, 60, 120]
