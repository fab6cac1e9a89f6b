import random

import pytest

from foliospark.operators import quota as Q, ranking
from foliospark.operators.revisions import (
    chapter_states,
    chapter_versions,
    fold_revisions,
    present_chapters,
    restore_saves,
    save_outcomes,
    version_pages,
)
from pyspark.sql import functions as F
from tests import helpers

SECOND = 1_000_000
EVENTS = "key long, at_us long, event_id long, base_revision long, usable boolean, initial long"


@pytest.mark.parametrize("seed", [1, 2])
def test_revisions_equal_plain_loop_with_one_hot_key(spark, seed):
    rng = random.Random(seed)
    rows, event = [], 0
    for key, n, now in [(1, 3000, 0), (2, 40, 1), (4, 5, 7)]:
        for i in range(n):
            event += 1
            base, usable = now + rng.choice([-2, -1, 0, 0, 0, 1]), rng.random() < 0.8
            # Many events share a moment, and the hot key runs through many segments.
            rows.append((key, i * 40 // n * SECOND, event, base, usable))
            now += usable and base == now
    frame = spark.createDataFrame([(*r, {1: 0, 2: 1, 4: 7}[r[0]]) for r in rows] + [(9, 1, 99999, 0, True, None)], EVENTS)
    got = fold_revisions(frame, "key").collect()
    want = []
    for key, start in [(1, 0), (2, 1), (4, 7)]:
        want += helpers.fold([(e, t, b, u) for k, t, e, b, u in rows if k == key], start)
    assert sum(ok for _, _, ok in want) > 200
    assert {(r.event_id, r.revision_met, r.applied) for r in got} == {*want, (99999, None, False)}


def test_a_hot_key_is_cut_into_segments(spark):
    """Half of all rows in one key at one moment: no segment holds more than its share."""
    df = spark.range(40000).selectExpr("if(id % 2 = 0, 0, id) as k", "if(id % 2 = 0, 5, id) as at", "id")
    sizes = ranking.segmented(df, ["k"], [F.col("at"), F.col("id")]).groupBy("k", "_segment").count()
    biggest = sizes.agg(F.max("count")).first()[0]
    assert sizes.where("k = 0").count() >= 4 and biggest < 10000


SAVES = "event_id long, chapter_id long, at_us long, base_revision long, title string, content_json string, plain_text string"
DOC = '{"type":"doc"}'


def _saves(spark, *rows):
    return spark.createDataFrame(rows, SAVES)


def test_save_outcomes_history_and_restore(spark):
    start = helpers.chapters(spark, ("p", 1, "Bab 1", "nol", 0))
    saves = _saves(
        spark,
        (1, 1, 10, 0, "Bab 1", DOC, "satu"),
        (2, 1, 20, 0, "Bab 1", DOC, "basi"),
        (3, 1, 30, 1, "Bab 1", DOC, "x" * 60),
        (4, 1, 40, 1, "Bab 1", '{"type":"note"}', "dua"),
        (5, 1, 50, 1, "Bab satu", DOC, "dua"),
        (6, 9, 60, 0, "Bab 9", DOC, "x"),
    )
    outcomes = save_outcomes(saves, start, max_text=50).cache()
    assert [r.outcome for r in outcomes.orderBy("event_id").collect()] == [
        "accepted", "REVISION_CONFLICT", "CHAPTER_TOO_LARGE", "INVALID_DOCUMENT", "accepted", "NOT_FOUND",
    ]
    states = chapter_states(saves, start, outcomes)
    versions, now = chapter_versions(states), present_chapters(states)
    assert [(v.revision, v.plain_text) for v in versions.orderBy("revision").collect()] == [(0, "nol"), (1, "satu")]
    assert [(v.revision, v.plain_text, v.title) for v in now.collect()] == [(2, "dua", "Bab satu")]
    wanted = spark.createDataFrame([(7, 1, 0, 70)], "event_id long, chapter_id long, revision long, at_us long")
    again = restore_saves(wanted, versions, now)
    present = now.select("chapter_id", F.col("revision").alias("revision_number"))
    assert [(r.outcome, r.new_revision) for r in save_outcomes(again, present).collect()] == [("accepted", 3)]
    assert again.first().plain_text == "nol"


def test_version_pages(spark):
    rows = spark.createDataFrame([(1, r) for r in range(60)] + [(2, r) for r in range(25)], "chapter_id long, revision long")
    got = version_pages(rows).collect()
    one = sorted((r.place, r.revision, r.page, r.has_next) for r in got if r.chapter_id == 1)
    assert one[0] == (1, 59, 0, True) and one[25] == (26, 34, 1, True) and one[59] == (60, 0, 2, False)
    assert {r.has_next for r in got if r.chapter_id == 2} == {True}


@pytest.mark.parametrize(
    "limit,window,spacing,step",
    [(20, 86400, 10, 4 * 3600), (3, 600, 30, 40), (5, 100, 10, 2), (2, 50, 20, 0.05)],
)
def test_quota_equals_plain_loop(spark, limit, window, spacing, step):
    """From sparse use to a user who sends without pause, with equal times and exact boundaries."""
    rng = random.Random(limit)
    rows, event = [], 0
    for user, n in [(1, 1500), (2, 60), (3, 1)]:
        at = 0
        for _ in range(n):
            event += 1
            at += rng.choice([0, spacing * SECOND, int(rng.random() * step * SECOND), int(step * SECOND)])
            rows.append((user, at, event))
    got = Q.decide_requests(spark.createDataFrame(rows, "user_id long, at_us long, event_id long"), limit, window, spacing)
    got = {r.event_id: r.decision for r in got.collect()}
    want = {}
    for user in (1, 2, 3):
        want |= helpers.quota([(t, e) for u, t, e in rows if u == user], limit, window * SECOND, spacing * SECOND)
    assert got == want


def test_quota_of_a_user_without_pause_needs_few_rounds(spark, monkeypatch):
    rounds = []
    original = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: (rounds.append(1), original(df))[1])
    rng = random.Random(3)
    at, rows = 0, []
    for event in range(40000):
        at += rng.randrange(1, 20000)
        rows.append((1, at, event))
    frame = spark.createDataFrame(rows, "user_id long, at_us long, event_id long")
    got = {r.event_id: r.decision for r in Q.decide_requests(frame, 8, 200, 10).collect()}
    assert got == helpers.quota([(t, e) for _, t, e in rows], 8, 200 * SECOND, 10 * SECOND)
    accepted = sum(d == "accepted" for d in got.values())
    assert accepted > 15 and len(rounds) <= 3 * 8


def test_attempt_rate_excludes_the_far_edge(spark):
    rows = spark.createDataFrame([(1, t * SECOND, t) for t in (0, 5, 10, 20)], "user_id long, at_us long, event_id long")
    got = {r.event_id: r.near for r in Q.attempt_rates(rows, {"near": 10}).collect()}
    assert got == {0: 0, 5: 1, 10: 1, 20: 0}


def test_running_helpers_over_segments(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(100), i, rng.randrange(5)) for i, k in enumerate([1] * 300 + [2] * 30)]
    df = spark.createDataFrame(rows, "k long, at long, id long, v long")
    order = [F.col("at"), F.col("id")]
    ranks = {r.id: r["rank"] for r in ranking.full_rank(df, ["k"], order).collect()}
    sums = {r.id: r.s for r in ranking.running_sum(df, ["k"], order, "v", "s").collect()}
    for k in (1, 2):
        total = 0
        for n, row in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            total += row[3]
            assert ranks[row[2]] == n and sums[row[2]] == total


def test_top_rows_in_two_merges(spark):
    df = spark.range(20000).selectExpr("id % 2 as k", "id", "(id * 7919) % 20011 as v")
    for n in (5, 200, 3000):
        got = ranking.top_rows(df, ["k"], [F.col("v"), F.col("id")], n).collect()
        for k in (0, 1):
            want = sorted(((i * 7919) % 20011, i) for i in range(20000) if i % 2 == k)[:n]
            assert [(r.v, r.id) for r in sorted((r for r in got if r.k == k), key=lambda r: r["rank"])] == want
