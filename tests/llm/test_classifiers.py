"""Features, index and calibration against plain code; held-out accuracy of both classifiers."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from foliospark.llm import common, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_features_against_plain_code(monkeypatch):
    rand = random.Random(1)
    texts = ["", "a", "ab ab\tab  c", " lead", "é é é"] + ["".join(rand.choice("abcé \n") for _ in range(rand.randint(0, 300))) for _ in range(20)]
    raw, starts = common.byte_rows(pa.array(texts))
    prints = common.Fingerprints(quality.PIECE * 2)
    (word, word_row), (gram, gram_row), (mark, _) = quality.features(prints, raw, starts)
    for i, t in enumerate(texts):
        data = t.encode()
        assert len(set(word[word_row == i])) == len(set(data.split()))
        assert (word_row == i).sum() == len(data.split())
        assert (gram_row == i).sum() == sum(max(len(data) - n + 1, 0) for n in quality.GRAMS)
    repeats = sum(a == b for t in texts for a, b in zip(t.encode().split(), t.encode().split()[1:]))
    assert (mark - 2 * (1 << quality.BUCKET_BITS)).sum() == repeats
    # Cut into pieces, each text still gives all its words.
    monkeypatch.setattr(quality, "PIECE", 50)
    count = Counter()
    for part, at, rows in quality.pieces(raw, starts):
        for r in quality.features(prints, part, at)[0][1]:
            count[int(rows[r])] += 1
    assert [count[i] for i in range(len(texts))] == [len(t.encode().split()) if len(t.encode()) <= 50 else count[i] for i, t in enumerate(texts)]
    assert all(count[i] >= len(t.encode().split()) for i, t in enumerate(texts))


def test_collapsed_model_is_the_softmax():
    rand = np.random.default_rng(3)
    bags = [(np.sort(rand.choice(5000, 30, replace=False)), np.full(30, 1 / 30, np.float32)) for _ in range(60)]
    labels = np.array([int(b[0][0] % 2) for b in bags])
    model = quality.train(bags, labels)
    score = [1 / (1 + np.exp(-(w @ model.weights[b] + model.bias))) for b, w in bags]
    assert np.mean((np.array(score) > 0.5) == labels) > 0.9


@pytest.mark.parametrize("common_share", [0.02, 0.3, 2.0, -1.0])
def test_nearest_against_all_products(monkeypatch, common_share):
    monkeypatch.setattr(toxicity, "COMMON", common_share)
    rand = np.random.default_rng(4)
    dense = np.zeros((500, 30))
    for i in range(500):
        ids = rand.choice(30, rand.integers(1, 6), replace=False)
        weight = rand.integers(1, 4, len(ids)).astype(float)
        dense[i, ids] = weight / np.sqrt(weight @ weight)
    dense = dense[np.argsort((dense > 0).sum(1), kind="stable")]
    row, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(row, term, dense[row, term], 500, 30)
    asked = np.arange(0, 500, 7)
    query, its = np.nonzero(dense[asked])
    for skip in (asked, None):
        got = index.nearest(query, its, dense[asked][query, its], len(asked), 16, skip)
        for q, near in zip(asked, got, strict=True):
            product = np.round(dense @ dense[q], 12)
            want = sorted((-p, i) for i, p in enumerate(product) if p > 0 and (skip is None or i != q))[:16]
            assert [i for i, _ in near] == [i for _, i in want]
            assert [s for _, s in near] == pytest.approx([-s for s, _ in want])
    nothing = toxicity.BlockMaxIndex(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0, 0)
    assert nothing.nearest(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 2, 3) == [[], []]


def test_terms_of_texts(monkeypatch):
    rand = random.Random(2)
    texts = [None, "", " .!", "Idiot", "IDIOT, idiot.", "été été1 a"] + ["".join(rand.choice("abcdé AB.\n") for _ in range(rand.randint(0, 400))) for _ in range(30)]

    def forms(text):
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text or "").lower().split()
        return Counter(t for w in words for t in [w, *(w[:n] + "-" for n in toxicity.STEMS if len(w) >= n)])

    names = {t: pd.util.hash_array(np.array([t], object), categorize=False)[0] for x in texts for t in forms(x)}
    known = np.sort(np.array([v for t, v in names.items() if len(t) % 2], np.uint64))
    place = {v: i for i, v in enumerate(known)}
    monkeypatch.setattr(toxicity, "SLICE", 300)
    for kept in (None, known, known[:0]):
        got = [Counter() for _ in texts]
        for a, _, row, term, count in toxicity.text_terms(pa.array(texts), kept):
            assert (np.diff(row) >= 0).all()
            for r, t, n in zip(row, term, count, strict=True):
                got[a + r][t] += n
        for text, found in zip(texts, got, strict=True):
            want = {names[t]: n for t, n in forms(text).items()}
            assert found == (want if kept is None else {place[v]: n for v, n in want.items() if v in kept})


def test_information_is_that_of_the_table():
    n0, n1 = np.array([10.0, 0, 5, 40]), np.array([2.0, 8, 0, 10])
    got = toxicity.information(n0, n1, 40, 10)
    for a, b, weight in zip(n0, n1, got, strict=True):
        cells = [(a, 40, a + b), (40 - a, 40, 50 - a - b), (b, 10, a + b), (10 - b, 10, 50 - a - b)]
        ratio = 2 * sum(x * np.log(x * 50 / (label * term)) for x, label, term in cells if x)
        left = max(ratio - 1, 0)
        assert weight == pytest.approx(left / 100 * left / (left + toxicity.DOUBT))


def test_scores_against_plain_cosine(spark):
    """The whole result from dense vectors and all products, with the same terms, votes and calibration."""
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels)
    found = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score_toxicity(docs, model).collect())
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def dense(text):
        out = np.zeros(len(model.names))
        for _, _, _, term, count in toxicity.text_terms(pa.array([text]), model.names):
            out[term] = (1 + np.log(count)) * model.weights[term]
        return out / max(np.sqrt(out @ out), 1e-300)

    text_of = {d: t for d, t in texts if d is not None}
    examples = np.array([dense(text_of[i]) for i in model.examples])
    want = []
    for doc_id, text in texts:
        product = np.round(examples @ dense(text), 12)
        near = [(i, -s) for s, i in sorted((-p, i) for i, p in enumerate(product) if p > 0)[: toxicity.NEIGHBOURS]]
        want.append((str(doc_id), round(model.judge(near), 9)))
    assert found == sorted(want)


def test_rising_means():
    steps, values = toxicity.rising_means(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert steps.tolist() == [0.1, 0.2, 0.9] and values.tolist() == pytest.approx([0, 1 / 3, 1])


def tables(spark):
    rand = random.Random(5)
    clean = ["tree", "river", "stone", "cloud", "light", "water", "field", "house"]
    foul = ["vileness", "vilest", "vile", "grubby"]
    docs, labels = [], []
    for i in range(600):
        words = [rand.choice(clean) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rand.randrange(40)] = rand.choice(foul)
        good = i % 3 != 0
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "vilest house", "en", "s", 1), (1002, "tree " * 30_000, "en", "s", 1), (1002, "tree " * 30_000, "en", "s", 1)]
    labels += [(0, 1, None), (1, None, 0), (None, 1, 1), (2, 1, 0), (2, 1, 0), (5000, 1, 1)]
    return spark.createDataFrame(docs, DOCS).selectExpr("*", "doc_id AS score", "text AS label"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert held and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), nothing).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 605 and all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert next(r for r in rows if r.doc_id is None).predicted == 1
    assert all(r.evidence for r in rows if r.predicted)
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 and (i % 5 == 0 or not r.predicted) for r in rows for i in r.evidence)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxic_documents_go(spark, tmp_path):
    docs, labels = tables(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = toxicity.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows) == Counter([i for i in range(600) if i % 5] + [1000, 1001, 1002, 1002])


@pytest.mark.parametrize("name, label", [("op8_quality_classifier", "quality"), ("op9_toxicity", "toxic")])
def test_queries_on_held_out_rows(spark, name, label):
    from foliospark import llm

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in llm.QUERIES[name](spark, folder).collect()}
    held = [(got[r.doc_id], r[label]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == y for r, y in held]) > 0.9


@pytest.mark.parametrize(("scale", "caught", "left"), [("sf0.01", 0.75, 0.9), ("sf0.1", 0.9, 0.98)])
def test_toxic_documents_are_caught_held_out(spark, scale, caught, left):
    from foliospark import llm

    folder = f"/root/testdata/{scale}"
    got = {r.doc_id: r for r in llm.QUERIES["op9_toxicity"](spark, folder).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([p for p, y in held if y]) >= caught and np.mean([not p for p, y in held if not y]) >= left
