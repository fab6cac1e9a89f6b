"""Every byte range against a count of all substrings."""

import hashlib
import random
from collections import Counter

import pytest

from foliospark.llm.suffix_dedup import remove_repeats, stage

SCHEMA = "doc_id long, text string"


def brute(texts, threshold):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + threshold] for b in raw for i in range(len(b) - threshold + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - threshold + 1):
            if seen[b[i : i + threshold]] > 1:
                gone[i : i + threshold] = [True] * threshold
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fields(frame):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize("threshold", [20, 200])
def test_against_all_substrings(spark, threshold):
    rand = random.Random(threshold)
    word = lambda chars, most: "".join(rand.choice(chars) for _ in range(rand.randint(1, most)))
    passages = [word("abcé ", 3 * threshold) for _ in range(6)]
    texts = [None, "", "é" * 500, "a" * 1000, word("xyz ", 30_000)]
    for _ in range(60):
        parts = [rand.choice([word("abcdefgh é", 2 * threshold), rand.choice(passages)]) for _ in range(rand.randint(0, 5))]
        texts.append("".join(parts))
    for base in texts[10:30]:
        near = list(base)
        if near:
            near[rand.randrange(len(near))] = "Z"
        texts.append("".join(near))
    ids = [None if i == 3 else i for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)
    want = Counter((i, *w) for i, w in zip(ids, brute(texts, threshold), strict=True))
    assert fields(remove_repeats(frame, threshold, with_text=False)) == want


def test_repeated_rows_empty_table_and_clashing_names(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, text + "tail", None)], "doc_id long, text string, ranges string")
    got = fields(remove_repeats(rows, with_text=False))
    assert got == Counter((i, *w) for i, w in zip([1, 1, 2], brute([text, text, text + "tail"], 200), strict=True))
    clash = rows.selectExpr("*", "ranges AS n_spans", "doc_id AS s", "doc_id AS key")
    assert sorted(r.kept_text for r in remove_repeats(clash).collect()) == ["", "", "tail"]
    assert remove_repeats(rows.limit(0)).count() == 0


def test_stage_keeps_columns_and_rows(spark):
    text = "".join(random.Random(2).choice("abcdefgh é") for _ in range(300))
    docs = spark.createDataFrame([(1, text + "é", "en", "a", 0), (2, text + "b", "en", "a", 0), (3, "kept", None, None, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "é", 1), (2, "b", 1), (3, "kept", 4)}


def test_many_equal_rows(spark):
    """Equal rows share one list of ranges, however many they are."""
    rand = random.Random(8)
    text = "".join(rand.choice("abcdefgh ") for _ in range(900))
    docs = spark.createDataFrame([(1, text)] * 2000 + [(2, "kept " * 30)], "doc_id long, text string").repartition(8)
    out = remove_repeats(docs, with_text=False).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in out} == {(1, 900, 1, 2000), (2, 0, 0, 1)}
