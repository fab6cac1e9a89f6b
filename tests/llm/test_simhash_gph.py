"""Fingerprints against their definition, components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from foliospark.llm import simhash_gph as gph
from foliospark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, distance=4):
    """Least value reachable by links, by looking at all pairs."""
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    bits = np.array(values, np.int64).view(np.uint64)
    for k in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= distance) + k + 1:
            a, b = find(values[k]), find(values[j])
            up[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B\x0bc", "a a a a a a", "É é x y z w v", "w " * 70_000, " ".join(map(str, range(500)))])
def test_fingerprint(text):
    assert gph.fingerprint(text) == plain_fingerprint(text)


def test_links_of_a_dense_group_and_of_skewed_bits(spark):
    rand = random.Random(3)
    base = rand.getrandbits(64)
    values = {base}
    for _ in range(1500):
        value = base
        for _ in range(rand.randint(0, 6)):
            value ^= 1 << rand.randrange(64)
        values.add(value)
    values |= {rand.getrandbits(64) & ~0xFF | rand.choice([1, 2, 200]) for _ in range(1000)}
    values = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r.node: r.root for r in connected_components(gph.links(frame, block=256)).collect()}
    assert {v: found.get(v, v) for v in values} == plain_roots(values)


def test_thresholds_cover_the_distance():
    rand = np.random.default_rng(5)
    bits = rand.random((4000, 64)) < rand.random(64)
    bits[:, 1] = bits[:, 0]
    joint = bits.T.astype(float) @ bits
    for total in (10, 10**5, 10**8, 10**11):
        plan = gph.allocate(joint * total / 4000, total)
        assert sorted(b for group, _ in plan for b in group) == list(range(64))
        assert sum(t + 1 for _, t in plan) == gph.DISTANCE + 1
        masks = [m % 2**64 for m in gph.signature_masks(plan)]
        for _ in range(200):
            flips = sum(1 << int(b) for b in rand.choice(64, gph.DISTANCE, replace=False))
            assert any(flips & mask == 0 for mask in masks)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7), (2000, 2001), (2001, 2000)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1050), 1000), 2000: 2000, 2001: 2000}


def test_groups_with_nulls_ties_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (None, text), (9, None), (8, ""), (7, "alone here"), (None, "only this one")]
    got = sorted(map(tuple, gph.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    signed = lambda t: int(np.uint64(plain_fingerprint(t)).view(np.int64))
    want = [(i, signed(t), {text: 3, None: 8, "": 8, "alone here": 7, "only this one": None}[t]) for i, t in rows]
    assert got == sorted(want, key=str)
    assert gph.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    signed = {i: v - 2**64 if v >> 63 else v for i, v in prints.items()}
    roots = plain_roots(sorted(set(signed.values())))
    least = {}
    for i in sorted(signed, reverse=True):
        least[roots[signed[i]]] = i
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in gph.op7_simhash_near_dedup(spark, folder).collect()}
    assert got == {i: (f"{v:016x}", least[roots[signed[i]]]) for i, v in prints.items()}


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "en", "b", 1), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (None, text, None, None, None), (4, "alone", "en", "a", 5), (None, "unnamed", "en", "a", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    out = gph.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)


def test_unlike_rows_of_one_id_both_stay(spark):
    texts = ["one text about rivers and their stones that nobody else wrote down", "a wholly different text on towers with windows facing the northern sea"]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1] + " "), (None, texts[0]), (7, texts[0])]
    kept = sorted((r.doc_id, r.text) for r in gph.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert kept == [(3, texts[1] + " "), (5, texts[0])]
    named = spark.createDataFrame([(f"d{i}", t) for i, (_, t) in enumerate(rows)], "doc_id string, text string")
    assert sorted(r.doc_id for r in gph.stage(spark, named, "").collect()) == ["d0", "d1"]
    assert {r.doc_id: r.component_id for r in gph.near_groups(named).collect()} == {"d0": "d0", "d1": "d1", "d2": "d1", "d3": "d0", "d4": "d0"}
