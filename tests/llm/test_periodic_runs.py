"""Periodic runs against a walk over all periods, the common extensions against comparing word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import llm
from foliospark.llm import common, periodic_runs as P
from tests.conftest import SMALL


def all_runs(words, shortest=24, repeats=3):
    found, n = {}, len(words)
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(shortest, repeats * p):
                found.setdefault((start, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapse(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w for w in re.split("[ \t-\r]", text or "") if w]


def made(rng, n, letters):
    words = [f"w{rng.randrange(letters)}é" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            a, p = rng.randrange(n), rng.randint(1, n // 3)
            for i in range(a, a + rng.randint(0, n - a)):
                words[i] = words[a + (i - a) % p]
    return words


def test_every_distance_is_covered():
    assert {(a - b) % P.PERIOD for a in P.COVER for b in P.COVER} == set(range(P.PERIOD))
    for a in range(P.PERIOD):
        for b in range(P.PERIOD):
            d = P.Extensions.SHIFTS[a, b]
            assert (a + d) % P.PERIOD in P.COVER and (b + d) % P.PERIOD in P.COVER


@pytest.mark.parametrize(("n", "letters"), [(1, 1), (40, 1), (200, 2), (700, 3), (500, 1), (400, 90)])
def test_extensions(n, letters):
    rng = random.Random(n)
    words = [rng.randint(1, letters) for _ in range(n)]
    words[n // 2 :] = words[: n - n // 2]
    words.append(1000)
    lce = P.Extensions(np.array(words))
    pairs = [(a, b) for a in range(0, n, 3) for b in range(0, n, 7) if a != b]
    if not pairs:
        return
    got = lce(*(np.array(x) for x in zip(*pairs, strict=True)))
    for (a, b), found in zip(pairs, got, strict=True):
        want = 0
        while words[a + want : a + want + 1] == words[b + want : b + want + 1] and max(a, b) + want < len(words):
            want += 1
        assert found == want


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_runs_against_all_periods(monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        texts = [made(rng, rng.choice([0, 1, 23, 24, 25, 80, 300]), rng.choice([1, 2, 3, 60])) for _ in range(rng.randrange(7))]
        numbers = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        codes = np.array([numbers[w] for t in texts for w in t], np.int64)
        text, *rest = P.find_runs(codes, np.array([len(t) for t in texts], np.int64))
        got = [[] for _ in texts]
        for which, *run in zip(text, *rest, strict=True):
            got[which].append(tuple(int(x) for x in run))
        assert got == [all_runs(t) for t in texts]


def test_operator(spark, monkeypatch):
    rng = random.Random(7)
    spaces = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"]
    texts = [None, "", " \n", "a", "a " * 24, "a " * 23, "ha " * 5000, "one two " * 40 + "x " + "one two " * 40]
    texts += ["".join(w + rng.choice(spaces) for w in made(rng, rng.choice([30, 100, 400]), rng.choice([2, 50]))) for _ in range(40)]
    texts += [texts[-1]] * 3
    docs = spark.createDataFrame([(i if i % 5 else None, t, [i], "c") for i, t in enumerate(texts)], "doc_id long, text string, runs array<int>, collapsed string")
    got = P.periodic_runs(docs.repartition(3), F.col("text"))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()))
    want = []
    for i, t in enumerate(texts):
        words = split(t)
        runs = all_runs(words)
        want.append((bool(i % 5), i if i % 5 else 0, len(words), runs, collapse(words, runs)))
    assert rows == sorted(want)
    assert P.periodic_runs(docs.limit(0), F.col("text")).count() == 0


def digest(doc_id, text):
    words = split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{p}\n" for s, length, p in runs), collapse(words, runs))]
    return (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], *hashes)


def test_query_on_all_documents(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = {tuple(r) for r in llm.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    want = {digest(d, t) for d, t in docs if len(split(t)) < 4000}
    assert want <= got and len(got) == len(docs) and any(x[1] for x in want)


def test_query_takes_nulls(spark, tmp_path):
    rows = [(None, "a b"), (3, None), (None, None), (11, ""), (6, "x y z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, llm.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()))
    assert len(got) == 5 and all("None" not in x.split("runs_sha256")[1] for x in got)
