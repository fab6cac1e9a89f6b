import random

from pyspark.sql import functions as F

from foliospark.operators.chunking import append_chunks, chunk_chapters, current_chunks, offset_violations, with_currency
from foliospark.sources.tables import write_new_chunks
from tests.helpers import chapters, chunks_of

# Sentences of growing number words, so that breaks fall at ever different places; the last one is found nowhere else.
LONG = " ".join(f"Lampu ke-{i} menyala di dermaga." for i in range(18_000)) + " Kata sandinya MerpatiSenja."


def _spans(spark, *texts):
    df = chapters(spark, *[("p", i, f"Bab {i}", t, 0) for i, t in enumerate(texts)])
    rows = chunk_chapters(df).select("chapter_id", "chunk_index", "start_offset", "end_offset").collect()
    return {
        i: sorted((r.chunk_index, r.start_offset, r.end_offset) for r in rows if r.chapter_id == i) for i in range(len(texts))
    }


def test_edge_cases(spark):
    texts = ["", "     ", "\n", "q" * 9999, LONG]
    got = _spans(spark, *texts)
    assert [got[i] for i in range(5)] == [chunks_of(t) for t in texts]
    assert got[0] == got[1] == [] and got[2] == [(0, 0, 1)]
    assert len(got[4]) > 150 and got[4][-1][2] == len(LONG)


def test_equals_plain_loop_on_random_texts(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        alphabet = rng.choice(["abc .\n", "x", "aé😀 ", "ab!?", " " * 40 + "x", "word " * 3 + "\n"])
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3199, 3200, 3201, 9000, 70000, 140000]))))
    got = _spans(spark, *texts)
    for i, text in enumerate(texts):
        assert got[i] == chunks_of(text), (i, len(text))


def test_offsets_coverage_and_repeat(spark, corpus):
    fresh = corpus.fresh_chunks
    assert offset_violations(fresh, corpus.chapters).count() == 0
    texts = {r.chapter_id: r.plain_text for r in corpus.chapters.collect()}
    covered = {i: set() for i in texts}
    for r in fresh.select("chapter_id", "start_offset", "end_offset").collect():
        covered[r.chapter_id].update(range(r.start_offset, r.end_offset))
    for i, text in texts.items():
        assert all(k in covered[i] or text[k] == " " for k in range(len(text)))
    assert append_chunks(fresh, fresh).count() == 0


def test_writing_chunks_twice_adds_nothing(spark, corpus, tmp_path):
    write_new_chunks(corpus.fresh_chunks, str(tmp_path))
    once = spark.read.parquet(f"{tmp_path}/story_chunks").count()
    write_new_chunks(corpus.fresh_chunks, str(tmp_path))
    assert once == corpus.fresh_chunks.count() == spark.read.parquet(f"{tmp_path}/story_chunks").count()


def test_currency_follows_revision_and_text(spark):
    old = chapters(spark, ("p", 1, "Bab 1", "Peti itu kosong.", 0))
    chunks = chunk_chapters(old)
    assert current_chunks(chunks, old).count() == 1
    assert current_chunks(chunks, chapters(spark, ("p", 1, "Bab 1", "Peti itu kosong.", 1))).count() == 0
    assert current_chunks(chunks, chapters(spark, ("p", 1, "Bab 1", "Peti itu penuh.", 0))).count() == 0
    assert not with_currency(chunks, chapters(spark, ("p", 1, "Bab 1", "x", 1))).where(F.col("current")).count()
