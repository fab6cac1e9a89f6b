"""Phrase counts from the graph against counting every phrase."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from foliospark.llm import collocations

DOCS = "doc_id long, text string, lang string, n long, word string, root string"


def words_of(docs):
    for lang, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            yield lang or "und", [w for w in re.split(r"[ \t]", piece) if w]


def counted(docs, longest):
    found, total = defaultdict(Counter), Counter()
    for lang, words in words_of(docs):
        total[lang] += len(words)
        for k in range(1, longest + 1):
            for i in range(len(words) - k + 1):
                found[lang][tuple(words[i : i + k])] += 1
    return found, total


def best(docs, least, share, top, longest):
    found, total = counted(docs, longest)
    out = []
    for lang, f in found.items():
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = {
            g[i : i + k] for g, b in frequent.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * b >= share * f[g[i : i + k]]
        }
        rows = []
        for g, a in frequent.items():
            if g in inside:
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.drop("path_words").collect())


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, 1, "w", "r") for i, (lang, t) in enumerate(docs)], DOCS).repartition(4)


def random_docs(seed, n=40, words=6):
    rng = random.Random(seed)
    vocabulary = ["Ab", "ab", "é", "b", "c'", "naïve", "日本", "x"][:words]
    made = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", " ; "]) for _ in range(rng.randint(0, 60)))
        made.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return made


@pytest.mark.parametrize(("seed", "least", "share", "top", "longest"), [(1, 3, 100, 1000, 5), (2, 5, 80, 10, 5), (3, 2, 100, 500, 4), (4, 4, 50, 200, 3), (5, 3, 100, 100, 2), (6, 2, 100, 99, 6)])
def test_against_all_phrases(spark, monkeypatch, seed, least, share, top, longest):
    docs = random_docs(seed) + [(None, None), ("en", ""), ("fr", ". , ;"), ("en", "ab " * 300)] + [("en", "the very same text again, and again")] * 20
    monkeypatch.setattr(collocations, "SLICE", 200)
    assert rows(collocations.phrases(frame(spark, docs), least, share, top, longest)) == best(docs, least, share, top, longest)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 4 * 10**9), ("en", "b", 5 * 10**9), ("en", "rest", 10**13)], "lang string, word string, n long")
    flow = spark.createDataFrame([("en", "a b", 2, 3 * 10**9)], "lang string, phrase string, words int, n long")
    n = 10**13 + 9 * 10**9
    (row,) = collocations.score_phrases(flow, counts).collect()
    assert row.score == int(Fraction(1000 * 3 * 10**9 * n, 4 * 10**9 * 5 * 10**9)) and row.n == n


def test_paths_are_the_passages_repeated_as_a_whole(spark):
    passage = [f"w{i}" for i in range(40)]
    docs = [("en", " ".join(passage))] * 6 + [("en", " ".join(["other", *passage[10:20], "end"]))] * 3 + [("en", "o o o o o o o o o")] * 4
    texts = frame(spark, docs).select("lang", "text")
    flow = collocations.node_flow(collocations.edges(texts, 3), 3)
    paths = defaultdict(list)
    for r in collocations.compact_paths(flow).collect():
        paths[r.path].append((r.place, r.n, r.path_words, r.phrase))
    found = sorted((min(n for _, n, _, _ in x), x[0][2], len(x)) for x in paths.values())
    # The passage falls into what stands before, in and after its ten shared words; the looping word is no passage.
    assert (9, 10, 6) in found and all(size == words - 4 for _, words, size in found)
    for path, members in paths.items():
        assert sorted(p for p, *_ in members) == list(range(len(members))) and min(members)[3] == path


def test_pairs_that_share_buckets_change_no_count(spark, monkeypatch):
    docs = random_docs(9)
    monkeypatch.setattr(collocations, "LANES", 1)
    assert rows(collocations.phrases(frame(spark, docs), 6)) == best(docs, 6, 100, collocations.TOP, 5)


def test_empty_and_rare(spark):
    assert rows(collocations.phrases(frame(spark, []))) == []
    assert rows(collocations.phrases(frame(spark, [("en", "too rare to count")]))) == []
