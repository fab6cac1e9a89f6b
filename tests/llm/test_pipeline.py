"""Each stage on what the one before kept, against brute force, and the whole run."""

from collections import Counter

import duckdb

import corpus_pipeline
from foliospark import llm
from foliospark.llm import toxicity
from tests.conftest import SMALL
from tests.llm.test_simhash_gph import plain_fingerprint, plain_roots
from tests.llm.test_suffix_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_sql(path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    return con.execute(llm.ORACLES[name]).fetchall()


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "benchmark_decontamination", "source_mix"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SMALL).write.parquet(str(tmp_path / str(number)))
        kept.append(spark.read.parquet(str(tmp_path / str(number))))
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert all(k.columns == COLUMNS for k in kept[:-1]) and kept[-1].columns[:5] == COLUMNS

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert set(rows[1]) == {r.doc_id for r in judged if not r.predicted}
    assert all(rows[0][i] == r for i, r in rows[1].items())

    prints = {i: plain_fingerprint(r.text) for i, r in rows[1].items()}
    signed = {i: v - 2**64 if v >> 63 else v for i, v in prints.items()}
    roots = plain_roots(sorted(set(signed.values())))
    first = {}
    for i in sorted(signed):
        first.setdefault(roots[signed[i]], i)
    assert set(rows[2]) == set(first.values())

    ids = sorted(rows[2])
    removed = {i: b[1] for i, b in zip(ids, brute([rows[2][i].text for i in ids], 200))}
    assert set(rows[3]) == set(ids)
    for i, r in rows[3].items():
        assert r.n_chars == len(r.text)
        lost = len(rows[2][i].text.encode()) - len(r.text.encode())
        assert removed[i] <= lost <= removed[i] + 12 and (removed[i] or r.text == rows[2][i].text)

    leaked = {r[0] for r in in_sql(tmp_path / "2", "op2_decontamination")}
    assert set(rows[4]) == set(rows[3]) - leaked

    mix = {(i, n, taken) for i, n, _, _, taken in in_sql(tmp_path / "3", "op5_source_mix") if taken > 0}
    assert {(r.doc_id, r["size"], r.taken) for r in rows[5].values()} == mix

    whole = Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    assert whole == Counter(map(tuple, kept[-1].collect()))


def test_rows_without_ids_and_texts(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "a", 0), (2, "few words here", "en", None, 14)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [2]
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
