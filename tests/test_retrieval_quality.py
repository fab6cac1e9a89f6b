"""Planted passages against a plain search, and what is moved for them and for the token index."""

import random
import re

from foliospark.operators import retrieval_quality as Q
from foliospark.sources import tables

CHUNKS = "project_id string, chunk_id string, content string"


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def longest(passage, text):
    """Words of the longest row that both have."""
    a, b, best = words(passage), words(text), 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_passages_are_found_at_every_place(spark):
    rng = random.Random(4)
    passages = {1: [f"p{i}" for i in range(30)], 2: [f"q{i}" for i in range(13)], 3: ["too", "short"]}
    rows = [(None, "none", " ".join(passages[2])), ("p", None, " ".join(passages[2])), ("p", "empty", None), ("p", "short", "too short")]
    for lead in range(15):
        for length in (12, 13, 14, 20):
            item = rng.choice([1, 2])
            at = rng.randrange(0, max(len(passages[item]) - length, 0) + 1)
            text = [*(f"x{rng.randrange(99)}" for _ in range(lead)), *passages[item][at : at + length], *(f"y{i}" for i in range(rng.randrange(9)))]
            rows.append(("p", f"c{lead}-{length}", ", ".join(text).title()))
    rows.append(rows[-1])
    found = Q.planted_passages(
        spark.createDataFrame([(i, " ".join(p)) for i, p in passages.items()], "item_id long, text string"), spark.createDataFrame(rows, CHUNKS).repartition(5)
    ).collect()
    want = {(i, p, c, n) for p, c, t in set(rows) for i, x in passages.items() if (n := longest(" ".join(x), t)) >= Q.RUN}
    got = {tuple(r) for r in found}
    twice = rows[-1][1]
    assert {r for r in got if r[2] != twice} == {r for r in want if r[2] != twice} and len(found) == len(got) > 30


def test_only_chunks_near_a_passage_are_cut_into_grams(spark, monkeypatch):
    seen, plain = [], Q._grams
    monkeypatch.setattr(Q, "_grams", lambda rows, *a: seen.append(rows) or plain(rows, *a))
    texts = [" ".join(f"w{i}-{j}" for j in range(40)) for i in range(50)]
    chunks = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], CHUNKS)
    passages = spark.createDataFrame([(1, texts[7])], "item_id long, text string")
    assert [(r.item_id, r.chunk_id, r.words) for r in Q.planted_passages(passages, chunks).collect()] == [(1, "7", 80)]
    assert [rows.count() for rows in seen] == [1, 1]


def test_index_is_written_without_a_sample(spark, tmp_path, monkeypatch):
    """Words are cut once and dealt by chunk: a word that all chunks have lies in all files of its bucket, in like shares."""
    from pyspark.sql import functions as F
    from pyspark.sql.readwriter import DataFrameWriter

    plans, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or parquet(self, *a, **b))
    rows = [("p", f"c{i}", i, f"word word own{i}") for i in range(2000)]
    path = str(tmp_path / "index")
    tables.write_index(spark.createDataFrame(rows, "project_id string, chunk_id string, chapter_id long, content string"), path, chunks_per_bucket=1000)
    assert not any("rangepartitioning" in p for p in plans)
    index = spark.read.parquet(f"{path}/postings")
    shares = [r["count"] for r in index.where("token = 'word'").groupBy(F.input_file_name()).count().collect()]
    assert sum(shares) == 2000 and len(shares) >= 4 and max(shares) < 2 * min(shares)
    assert index.count() == 4000 and index.select(F.sum("tf")).first()[0] == 6000
    assert index.where(F.col("token_bucket") != F.expr("pmod(xxhash64(project_id, token), 2)")).isEmpty()
