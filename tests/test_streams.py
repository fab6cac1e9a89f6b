import contextlib
import io
import random

import pandas as pd
from pyspark.sql import functions as F

from foliospark.operators import quota
from foliospark.operators.chunking import with_currency
from foliospark.operators.jobs import debounce
from foliospark.operators.review import review_outcomes
from foliospark.operators.revisions import save_outcomes
from foliospark.session import cut_lineage, run_folder
from foliospark.sources import tables
from foliospark.streaming import folds, refresh, replay

SECOND = 1_000_000


def _files(df, path, parts):
    """The rows in arrival order, one file per micro-batch."""
    bound = df.agg(F.max("at_us")).first()[0] + 1
    for i in range(parts):
        low, high = bound * i // parts, bound * (i + 1) // parts
        df.where((F.col("at_us") >= low) & (F.col("at_us") < high)).coalesce(1).write.mode("append").parquet(path)


def test_saves_in_many_batches_equal_one_batch(spark, corpus, tmp_path):
    saves = corpus.saves.withColumn("at_us", F.col("at_us") - F.lit(1_704_067_200_000_000))
    _files(saves, str(tmp_path), 4)
    stream = replay.read_stream(spark, str(tmp_path), saves, files_per_trigger=1)
    got = replay.drain(folds.stream_save_outcomes(stream, corpus.chapters, max_text=17))
    want = save_outcomes(saves, corpus.chapters, max_text=17).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.outcome for r in got.collect()} == {"NOT_FOUND", "REVISION_CONFLICT", "CHAPTER_TOO_LARGE", "INVALID_DOCUMENT", "accepted"}


def test_reviews_in_many_batches_equal_one_batch(spark, corpus, tmp_path):
    facts, chunks = cut_lineage(corpus.facts), corpus.chunks
    reviews = cut_lineage(corpus.reviews.withColumn("at_us", F.col("at_us") - F.lit(1_704_067_200_000_000)))
    _files(reviews, str(tmp_path), 3)
    stream = replay.read_stream(spark, str(tmp_path), reviews, files_per_trigger=1)
    sources = with_currency(chunks, corpus.chapters).select("chunk_id", "current")
    got = replay.drain(folds.stream_review_outcomes(stream, facts, sources))
    want = review_outcomes(reviews, facts, chunks, corpus.chapters).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_quota_in_many_batches_equals_one_batch(spark, corpus, tmp_path):
    requests = corpus.requests.withColumn("at_us", F.col("at_us") - F.lit(1_704_067_200_000_000))
    _files(requests, str(tmp_path), 3)
    stream = replay.read_stream(spark, str(tmp_path), requests, files_per_trigger=1)
    got = replay.drain(folds.stream_decisions(stream, 3, 86400, 3600))
    want = quota.decide_requests(requests, 3, 86400, 3600).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_debounce_stream_gives_the_closed_runs(spark, tmp_path):
    rng = random.Random(1)
    rows, at = [], 0
    for event in range(200):
        at += rng.choice([1, 30, 50, 400]) * SECOND
        rows.append((rng.choice([1, 2]), at, event))
    saves = spark.createDataFrame(rows, "chapter_id long, at_us long, event_id long")
    _files(saves, str(tmp_path), 3)
    got = replay.drain(folds.stream_debounce(replay.read_stream(spark, str(tmp_path), saves, files_per_trigger=1)))
    closed = max(r[1] for r in rows) - 600 * SECOND
    want = debounce(saves).where(F.col("due_us") <= closed).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 10


REFRESH = refresh.SAVED + ", failing long"


def test_refresh_indexes_due_chapters_once(spark, tmp_path):
    rows = [
        (1, "p", 1, "Aurel bekerja.", 0, 0),
        (1, "p", 2, "Aurel pindah ke Bandung.", 20 * SECOND, 0),
        (2, "p", 1, "Kenan menulis.", 30 * SECOND, 0),
        (2, "p", 2, "Kenan menulis lagi.", 200 * SECOND, 0),
        (3, "p", 1, "Baru saja disimpan.", 600 * SECOND, 0),
        (4, "p", 1, "Gagal sekali.", 40 * SECOND, 1),
        (5, "p", 1, "Gagal terus.", 50 * SECOND, 9),
        (6, "p", 1, "Gagal, lalu diganti.", 100 * SECOND, 9),
        (6, "p", 2, "Gantinya baik.", 160 * SECOND, 0),
        (7, "p", 1, None, 60 * SECOND, 3),
    ]
    saves = spark.createDataFrame(rows, REFRESH)
    source, folder = str(tmp_path / "in"), str(tmp_path / "tables")
    _files(saves, source, 4)
    state = run_folder(spark, "refresh")

    def run():
        stream = replay.read_stream(spark, source, saves, files_per_trigger=1)
        refresh.refresh_index(stream, folder, state, delay="0 seconds").awaitTermination()
        return sorted((r.chapter_id, r.source_revision, r.content) for r in refresh.stored_chunks(spark, folder).collect())

    # The first text of chapter 1 was replaced before it was due; chapter 3 still rests.
    want = [(1, 2, "Aurel pindah ke Bandung."), (2, 1, "Kenan menulis."), (2, 2, "Kenan menulis lagi."), (4, 1, "Gagal sekali."), (6, 2, "Gantinya baik.")]
    assert run() == want
    log = spark.read.parquet(f"{folder}/job_log").collect()
    tries = sorted((r.chapter_id, r.at_us // SECOND, r.status, r.attempts) for r in log if r.chapter_id > 3)
    assert tries == [
        (4, 85, "failed", 1), (4, 115, "ready", 1),
        (5, 95, "failed", 1), (5, 125, "failed", 2), (5, 185, "dead", 3),
        (6, 145, "failed", 1), (6, 205, "ready", 0),
        (7, 105, "failed", 1), (7, 135, "failed", 2), (7, 195, "dead", 3),
    ]
    state_of = {r.chapter_id: (r.status, r.source_revision, r.dead_letter) for r in refresh.latest_jobs(spark, folder).collect()}
    assert state_of == {1: ("ready", 2, False), 2: ("ready", 2, False), 4: ("ready", 1, False), 5: ("failed", 1, True), 6: ("ready", 2, False), 7: ("failed", 1, True)}
    assert sorted(r.chapter_id for r in refresh.dead_letters(spark, folder).collect()) == [5, 7]
    # A restart with nothing new adds nothing, a repeated batch finds its chunks stored, and compaction changes no answer.
    assert run() == want
    batch = next(p for p in (tmp_path / "tables" / "job_log").glob("batch_id=*") if spark.read.parquet(str(p)).where("status = 'ready'").count())
    rows = spark.read.schema(refresh.RUNS).parquet(str(batch)).collect()
    refresh.index_batch(spark.createDataFrame(rows, refresh.RUNS), int(batch.name.split("=")[1]), folder)
    assert sorted((r.chapter_id, r.source_revision, r.content) for r in refresh.stored_chunks(spark, folder).collect()) == want
    upto = refresh.compact_jobs(spark, folder)
    assert upto >= 0 and refresh.compact_jobs(spark, folder) == upto
    assert {r.chapter_id: (r.status, r.source_revision, r.dead_letter) for r in refresh.latest_jobs(spark, folder).collect()} == state_of


def test_what_is_indexed_does_not_depend_on_the_batches(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], 0
    for event in range(150):
        at += rng.choice([0, 1, 30, 45, 50, 400]) * SECOND
        rows.append((rng.choice([1, 1, 2, 3]), "p", event, f"teks {event}", at, rng.choice([0, 0, 1, 2, 3])))
    saves = spark.createDataFrame(rows, REFRESH)
    results = []
    for parts in (1, 5):
        source = str(tmp_path / f"in{parts}")
        _files(saves, source, parts)
        stream = replay.read_stream(spark, source, saves, files_per_trigger=1)
        results.append(sorted(map(repr, replay.drain(refresh.index_runs(stream, delay="30 seconds")).collect())))
    assert results[0] == results[1] and len(results[0]) > 50


class _Store:
    """One key of a state store in memory; counts the calls."""

    def __init__(self):
        self.calls, self.lists, self.timers = 0, {}, []

    def getListState(self, name, schema):
        return _List(self, self.lists.setdefault(name, []))

    def getValueState(self, name, schema):
        return _List(self, self.lists.setdefault(name, []))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def listTimers(self):
        self.calls += 1
        return iter(list(self.timers))


class _List:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def get(self):
        self.store.calls += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.store.calls += 1
        self.rows[:] = rows

    def appendList(self, rows):
        self.store.calls += 1
        self.rows.extend(rows)

    def appendValue(self, row):
        self.appendList([row])

    def exists(self):
        self.store.calls += 1
        return bool(self.rows)

    def clear(self):
        self.put([])


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_to_the_state_store_do_not_grow_with_the_saves():
    columns = ["chapter_id", "project_id", "revision_number", "plain_text", "at_us", "failing"]
    seen = []
    for n in (100, 3000):
        store, jobs = _Store(), refresh.IndexJobs(45 * SECOND, 30 * SECOND, 3)
        jobs.init(store)
        rows = [(i % 7, "p", i, f"teks {i}" if i % 5 else None, i * 60 * SECOND, 0 if i % 5 else 3) for i in range(n)]
        half = pd.DataFrame(rows[: n // 2], columns=columns), pd.DataFrame(rows[n // 2 :], columns=columns)
        for part in half:
            assert list(jobs.handleInputRows((1,), iter([part]), _Watermark(0))) == []
        out = []
        for watermark in (n * 20_000, n * 60_000 + 1_000_000):
            store.timers = [t for t in store.timers if t > watermark]
            out += [tuple(r) for f in jobs.handleExpiredTimer((1,), _Watermark(watermark), None) for r in f.itertuples(index=False, name=None)]
        assert sorted(r[2] for r in out if r[5] == "ready") == [i for i in range(n) if i % 5]
        assert sorted(r[2] for r in out if r[5] == "dead") == [i for i in range(n) if i % 5 == 0]
        assert not store.timers and not any(store.lists.values())
        seen.append(store.calls)
    assert seen[0] == seen[1] < 30


def test_chapters_of_a_group_keep_apart(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows, at = [], 0
    for event in range(240):
        at += rng.choice([0, 7, 30, 45, 90]) * SECOND
        rows.append((rng.randrange(40), "p", event, rng.choice([None, f"teks {event}"]), at, rng.choice([0, 0, 1, 2, 3])))
    saves = spark.createDataFrame(rows, REFRESH)
    _files(saves, str(tmp_path / "in"), 4)

    def run(label):
        stream = replay.read_stream(spark, str(tmp_path / "in"), saves, files_per_trigger=1)
        folder = str(tmp_path / label)
        query = refresh.refresh_index(stream, folder, run_folder(spark, "refresh"), delay="30 seconds")
        query.awaitTermination()
        most = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
        return sorted(map(repr, spark.read.parquet(f"{folder}/job_log").drop("batch_id").collect())), most

    apart, _ = run("many")
    monkeypatch.setattr(refresh, "GROUPS", 2)
    together, most = run("two")
    assert apart == together and len(apart) > 60
    # Two lists and a timer for each of two groups, however many chapters are open.
    assert most <= 6
    # Plain loop over the saves of each chapter.
    end = max(r[4] for r in rows) // 1000 * 1000 - 30 * SECOND
    want = []
    for chapter in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == chapter), key=lambda r: (r[4], r[2]))
        for save, later in zip(own, [*own[1:], None]):
            due = save[4] + 45 * SECOND
            for attempt in range(3):
                if due > end or later and due >= later[4]:
                    break
                failed = attempt < save[5]
                want.append((chapter, save[2], due, "dead" if failed and attempt == 2 else "failed" if failed else "ready", attempt + failed))
                if not failed:
                    break
                due += 30 * SECOND * 2**attempt
    log = spark.read.parquet(str(tmp_path / "two" / "job_log")).collect()
    assert sorted((r.chapter_id, r.revision_number, r.at_us, r.status, r.attempts) for r in log) == sorted(want)


def test_adaptive_plans_append_the_chunks(spark, tmp_path, monkeypatch):
    saves = spark.createDataFrame([(1, "p", 1, "Aurel bekerja.", 10 * SECOND, 0), (1, "p", 2, "Lagi.", 900 * SECOND, 0)], REFRESH)
    _files(saves, str(tmp_path / "in"), 1)
    found, write = [], refresh.write_new_chunks

    def spied(fresh, folder, chapters):
        found.append(fresh.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        write(fresh, folder, chapters)

    monkeypatch.setattr(refresh, "write_new_chunks", spied)
    stream = replay.read_stream(spark, str(tmp_path / "in"), saves)
    refresh.refresh_index(stream, str(tmp_path / "tables"), run_folder(spark, "refresh")).awaitTermination()
    assert found and set(found) == {"true"}
    assert [r.content for r in refresh.stored_chunks(spark, str(tmp_path / "tables")).collect()] == ["Aurel bekerja."]


def test_chunks_are_appended_once(spark, tmp_path, corpus):
    folder = str(tmp_path)
    fresh = corpus.fresh_chunks.where("chapter_id < 40")
    tables.write_new_chunks(fresh.where("chapter_id < 20"), folder)
    tables.write_new_chunks(fresh, folder)
    tables.write_new_chunks(fresh, folder)
    stored = tables.read_table(spark, folder, "story_chunks")
    assert stored.columns == fresh.select(stored.columns).columns and stored.count() == stored.dropDuplicates(["chunk_id"]).count() == fresh.count()
    # One chapter's append looks into one folder.
    one = fresh.where("chapter_id = 7").withColumn("chapter_bucket", tables._chapter_bucket())
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        tables.stored_chunks(spark, f"{folder}/story_chunks", one).explain()
    assert "PartitionFilters: [isnotnull(chapter_bucket" in text.getvalue()
