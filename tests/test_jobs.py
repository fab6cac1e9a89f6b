import random

from foliospark.operators import jobs as J

SECOND = 1_000_000


def test_debounce_equals_plain_loop(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for event in range(400):
        at += rng.choice([1, 20, 45, 46, 300, 8000]) * SECOND
        rows.append((rng.choice([1, 1, 1, 2]), at, event))
    got = J.debounce(spark.createDataFrame(rows, "chapter_id long, at_us long, event_id long")).collect()
    want = []
    for chapter in (1, 2):
        run = None
        for at, event in sorted((t, e) for c, t, e in rows if c == chapter):
            if run is None or at - run[3] > 45 * SECOND:
                run = [chapter, at, 0, at, event]
                want.append(run)
            run[2], run[3], run[4] = run[2] + 1, at, event
    assert sorted((r.chapter_id, r.session_us, r.saves, r.last_us, r.last_event_id) for r in got) == sorted(map(tuple, want))


def test_job_histories_equal_plain_loop(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for event in range(600):
        at += rng.choice([5, 20, 40, 90]) * SECOND
        rows.append((rng.choice([1, 1, 2]), at, event, rng.choice(["save", "ok", "fail", "fail", "fail", "fail"])))
    got = J.job_histories(spark.createDataFrame(rows, "chapter_id long, at_us long, event_id long, kind string"))
    want = []
    for chapter in (1, 2):
        state = None
        for _, at, event, kind in sorted((r for r in rows if r[0] == chapter), key=lambda r: r[1:3]):
            if kind == "save":
                state = [chapter, event, "queued", 0, at + 45 * SECOND]
                want.append(state)
            elif state and state[2] != "ready" and state[3] < 3 and at >= state[4]:
                if kind == "ok":
                    state[2] = "ready"
                else:
                    state[2], state[4] = "failed", at + 30 * 2 ** state[3] * SECOND
                    state[3] += 1
    rows = sorted((r.chapter_id, r.save_id, r.status, r.attempts, r.available_us) for r in got.collect())
    assert rows == sorted(map(tuple, want))
    assert any(r[3] == 3 for r in rows) and any(r[2] == "ready" for r in rows)


JOBS = "chapter_id long, project_id string, source_revision long, source_hash string, status string, attempts long, available_us long, error string"


def test_due_backoff_and_requeue(spark):
    jobs = spark.createDataFrame(
        [
            (1, "p", 1, "h", "queued", 0, 100, None),
            (2, "p", 1, "h", "failed", 2, 50, "INDEX_FAILED"),
            (3, "p", 1, "h", "failed", 3, 50, "INDEX_FAILED"),
            (4, "p", 1, "h", "ready", 0, 50, None),
            (5, "p", 1, "h", "queued", 0, 900, None),
        ],
        JOBS,
    )
    assert [r.chapter_id for r in J.due_jobs(jobs, 100).collect()] == [2, 1]
    assert [r.chapter_id for r in J.due_jobs(jobs, 100, force=True).collect()] == [2, 1, 5]
    assert [r.available_us for r in J.failed_once_more(jobs, 0).orderBy("chapter_id").limit(2).collect()] == [
        30 * SECOND,
        120 * SECOND,
    ]
    again = {r.chapter_id: (r.status, r.attempts) for r in J.requeue_failed(jobs).collect()}
    assert again[3] == ("queued", 0) and again[4] == ("ready", 0)


def test_upsert_keeps_one_job_per_chapter(spark):
    jobs = spark.createDataFrame([(1, "p", 1, "h", "failed", 3, 5, "INDEX_FAILED"), (2, "p", 4, "g", "ready", 0, 5, None)], JOBS)
    queued = spark.createDataFrame(
        [(1, "p", 3, "new", 70), (1, "p", 2, "mid", 60), (3, "p", 1, "x", 80)],
        "chapter_id long, project_id string, source_revision long, source_hash string, available_us long",
    )
    got = {r.chapter_id: (r.source_revision, r.source_hash, r.status, r.attempts, r.error) for r in J.upsert_jobs(jobs, queued).collect()}
    assert got == {1: (3, "new", "queued", 0, None), 2: (4, "g", "ready", 0, None), 3: (1, "x", "queued", 0, None)}


def test_dispatch_serves_the_project_of_the_oldest_job(spark):
    jobs = spark.createDataFrame(
        [(c, p, 1, "h", "queued", 0, t, None) for c, p, t in [(1, "a", 30), (2, "a", 10), (3, "a", 50), (4, "b", 20), (5, "b", 90), (6, "c", 5)]],
        JOBS,
    )
    chapters = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 0), (5, 1), (6, 0)], "chapter_id long, position long")
    # 6 is oldest; then 2 is oldest but 1 stands before it in its project; then 2 itself; then 4.
    assert [r.chapter_id for r in J.dispatch(jobs, chapters, 60).orderBy("turn").collect()] == [6, 1, 2, 4, 3]
    assert [r.chapter_id for r in J.dispatch(jobs, chapters, 60, batch=2).orderBy("turn").collect()] == [6, 1]
    assert J.dispatch(jobs, chapters, 1).count() == 0
