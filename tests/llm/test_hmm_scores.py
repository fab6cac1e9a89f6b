"""Likelihood and expected counts against sums over all state paths; counts and base score against plain code."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from foliospark.llm import hmm_scores as hmm


def random_model(rand, classes, states=3):
    rows = lambda *shape: rand.random(shape) + 0.05
    start, move, emit = rows(states), rows(states, states), rows(classes, states)
    return hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_against_all_paths():
    rand = np.random.default_rng(1)
    model = random_model(rand, 5)
    texts = sorted((rand.integers(0, 5, n) for n in (1, 6, 4, 4, 2)), key=lambda t: -len(t))
    counts = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    got = hmm.forward_backward(model, texts, counts)
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for i, text in enumerate(texts):
        paths = {}
        for path in product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for (a, b), c in zip(zip(path, path[1:]), text[1:]):
                p *= model.move[a, b] * model.emit[c, b]
            paths[path] = p
        total = sum(paths.values())
        assert got[i] == pytest.approx(math.log(total))
        for path, p in paths.items():
            want[0][path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want[1][a, b] += p / total
            for c, s in zip(text, path):
                want[2][c, s] += p / total
    for a, b in zip(counts, want):
        assert a == pytest.approx(b)


def corpus(n=400):
    rand = random.Random(2)
    voices = [[f"{v}{i}" for i in range(40)] for v in "abc"]
    docs = []
    for i in range(n):
        voice = rand.choice(voices)
        docs.append((i, " ".join(rand.choice(voice[: rand.randint(1, 40)]) for _ in range(rand.randint(1, 60))).title() + f" only{i}"))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n\x0b"), (None, "a1 a2"), (7, docs[7][1]), (n + 3, "a1 " * 30_000)]


def test_scores_against_plain_code(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 60)
    monkeypatch.setattr(hmm, "OWN", 20)
    monkeypatch.setattr(hmm, "SHARED", 8)
    monkeypatch.setattr(hmm, "GATHER", 2000)
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text AS rare", "doc_id AS key")
    tokens = lambda t: [w.lower() for w in (t or "").split()]
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    seen = Counter(w for i, t in docs if learned(i) for w in [*tokens(t), None])
    total = sum(seen.values())
    table, words = hmm.count_words(frame)
    assert (words.total, words.distinct) == (total, len(seen))
    assert words.shares.sum() == pytest.approx(1)
    model = hmm.train(frame, words)
    rows = hmm.score_texts(frame, table, words, model).collect()
    assert len(rows) == len(docs)
    texts = {i: t for i, t in docs}
    own = {w.decode(): r for w, r in words.rank.items()}
    for r in rows:
        words_of = tokens(texts[r.doc_id])
        assert r.held_out == (not learned(r.doc_id)) and r.train_tokens == total and r.n_tokens == len(words_of) + 1
        assert r.n_known == sum(seen[w] > 0 for w in [*words_of, None])
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (len(seen) + 1))) for w in [*words_of, None]))
        classes, inner = [], 0.0
        for w in words_of:
            if own.get(w, 99) < 20:
                classes.append(own[w])
                continue
            b = zlib.crc32(w.encode()) % 8
            classes.append(20 + b)
            inner += math.log10((seen[w] + 0.1 if seen[w] else words.unseen) / words.mass[b])
        like = hmm.forward_backward(model, [np.array([*classes, len(words.shares) - 1])])[0]
        assert r.score == pytest.approx(like / math.log(10) + inner)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_of_a_class_share_it_wholly(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 60)
    monkeypatch.setattr(hmm, "OWN", 20)
    monkeypatch.setattr(hmm, "SHARED", 8)
    table, words = hmm.count_words(spark.createDataFrame(corpus(100), "doc_id long, text string"))
    left = words.mass - words.unseen
    for r in table.collect():
        if words.rank.get(bytes(r.word), 99) >= 20:
            left[zlib.crc32(bytes(r.word)) % 8] -= r.n + 0.1
    assert left == pytest.approx(np.zeros(8), abs=1e-6)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    table, words = hmm.count_words(frame)
    assert hmm.score_texts(frame, table, words, hmm.train(frame, words)).count() == 0
    held = spark.createDataFrame([(i, "x") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    table, words = hmm.count_words(held)
    assert {r.base_score for r in hmm.score_texts(held, table, words, hmm.train(held, words)).collect()} == {0.0}
