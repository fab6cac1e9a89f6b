"""Byte shards against a plain loop."""

import contextlib
import io
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark import llm
from foliospark.llm import sharding

ROWS = "doc_id long, text string, part string, size int, shard string"


def cut(docs, shards):
    """doc_id, size, shard, slot by walking the rows in order."""
    rows = sorted(((d is not None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs))
    total, before, out, slots = sum(r[2] for r in rows), 0, [], Counter()
    for known, d, size, crc in rows:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((d if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


CASES = {
    "texts": [(i, "é" * (i * 7 % 50)) for i in range(300)],
    "nulls": [(None, None), (None, "a"), (1, None), (1, ""), (2, "x" * 10_000), (None, None)],
    "one row for a third": [(5, "same text")] * 200 + [(i, "t" * (i % 9)) for i in range(400)],
    "one long text": [(i, "ab") for i in range(50)] + [(25, "z" * 100_000)],
    "one": [(9, "only")],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_shards_and_slots(spark, case):
    docs = spark.createDataFrame([(d, t, "p", 3, "s") for d, t in CASES[case]], ROWS).repartition(5)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    crc = F.crc32(F.coalesce("text", F.lit("")))
    got = sharding.byte_shards(docs, [F.col("doc_id"), size, crc], size, 7)
    assert got.columns == ["doc_id", "text", "part", "size", "shard", "slot"]
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in got.collect()]
    assert Counter(rows) == Counter(cut(CASES[case], 7))


def test_shards_are_nearly_equal_and_gapless(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 37 % 400).cast("int")).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = llm.QUERIES["op11_byte_shards"](spark, str(tmp_path)).collect()
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    target, largest = sum(sizes.values()) / 24, max(r.size for r in rows)
    assert len(rows) == 5000 and set(sizes) == set(range(24))
    assert all(abs(x - target) < largest for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_stays_native(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        llm.QUERIES["op11_byte_shards"](spark, str(tmp_path)).explain()
    assert not any(x in text.getvalue() for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
