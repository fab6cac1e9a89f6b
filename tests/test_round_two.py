"""Requests without a chapter, model names by provider, keys that are null."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import context, quality, ranking
from tests.helpers import chapters


def test_context_without_a_chapter(spark):
    df = chapters(spark, ("p", 1, "Satu", "isi bab", 0))
    rows = [(1, 1, "chat", True), (2, None, "chat", True), (3, 1, "rewrite", False), (4, 9, "chat", True), (5, None, "continue", True), (6, 1, "continue", False), (7, 1, "continue", True)]
    requests = spark.createDataFrame([(i, "p", c, a, u, True, True, True) for i, c, a, u in rows], "request_id long, project_id string, chapter_id long, action string, use_chapter boolean, use_bible boolean, use_characters boolean, use_notes boolean")
    bibles = spark.createDataFrame([("p", "awal", "", "", "", "", "")], "project_id string, premise string, synopsis string, themes string, tone string, style_instructions string, world_rules string")
    none = "project_id string, include_in_ai_context boolean, deleted_at string, created_at long, "
    people = spark.createDataFrame([], none + "character_id long, name string, aliases array<string>, role string, description string, attributes string")
    notes = spark.createDataFrame([], none + "note_id long, title string, plain_text string")
    made = context.assemble_context(requests, df, bibles, people, notes).collect()
    labels = {r.request_id: [s.label for s in r.sources] for r in made}
    assert labels == {1: ["Bab: Satu (versi 0)", "Story Bible"], 2: ["Story Bible"], 3: ["Story Bible"], 7: ["Bab: Satu (versi 0)", "Story Bible"]}
    codes = {r.request_id: r.code for r in context.context_rejects(requests, df).collect()}
    assert codes == {4: "CONTEXT_UNAVAILABLE", 5: "CHAPTER_REQUIRED", 6: "CHAPTER_REQUIRED"}


@pytest.mark.parametrize("model, ok", [("gateway:any/thing", True), ("gateway:", False), ("nebius:nvidia/x-nemotron-9", True), ("nebius:other/x", False), ("nvidia/nemotron", False), (None, True)])
def test_models_by_provider(spark, model, ok):
    row = spark.createDataFrame([(model,)], "model string").select(quality.rules()["ai_generations"]["model_id"].alias("met")).first()
    assert (row.met is not False) == ok


def test_rows_without_a_key_are_ranked_too(spark):
    rows = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(5)], "k string, v long")
    got = ranking.full_rank(rows, ["k"], [F.col("v")]).collect()
    assert len(got) == 55 and all(r["rank"] == r.v + 1 for r in got)
    sums = ranking.running_sum(rows, ["k"], [F.col("v")], "v", "s").collect()
    assert len(sums) == 55 and all(r.s == r.v * (r.v + 1) // 2 for r in sums)


def test_top_rows_leave_the_session_alone(spark):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    assert ranking.top_rows(rows, ["k"], [F.col("id")], 1500).count() == 3000
    assert spark.conf.get(name) == before
