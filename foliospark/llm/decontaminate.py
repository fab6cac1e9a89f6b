"""Benchmark decontamination by spaced seeds.

A seed looks at some tokens of a short window and ignores the rest, so a copied passage is hit even where some of its
tokens were changed. Documents and benchmark items that share the hash of a seed are laid side by side at that offset
and compared token by token.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm import common

# The tokens of a window that each mask looks at. Found by enumeration: whichever 2 tokens of 13 are changed
# (all that the share below allows), a window of some mask misses both; for 11 and 12 tokens MIDDLE does the same.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
MIDDLE = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 8, 9), (0, 1, 5, 6, 7, 8))
SPAN = 11
#: Items shorter than SPAN are looked for as a whole; items below the least length say too little to be traced.
LEAST = 5
#: An overlap counts if so many neighbouring tokens (or the whole item) agree in this share or more.
OVERLAP, SHARE = 13, 0.8
#: Rows up to which one side of a join is sent to all executors; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: White space, control characters and ASCII punctuation stand between tokens.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Hashes of the lower-case words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _window(number: int, places: tuple[int, ...]):
    """The seed of one mask at a place of the tokens ``w``."""
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(number), *(F.get(F.col("w"), i + p) for p in places)).alias("seed"))


def _short(n: int) -> list[tuple[int, ...]]:
    """Masks over all of n tokens, dealt to two blocks more than may change: each mask leaves out as many blocks as tokens may change."""
    changes = n - math.ceil(n * SHARE)
    return [tuple(p for p in range(n) if p % (changes + 2) not in out) for out in itertools.combinations(range(changes + 2), changes)]


def _kinds(lengths: list[int]) -> list[tuple[tuple[int, ...], int, int, int]]:
    """(places, span, least, most) of each mask that items of these lengths need; it is for items of least to most tokens."""
    kinds = [(m, m[-1] + 1, OVERLAP, 2**31 - 1) for m in MASKS if max(lengths, default=0) >= OVERLAP]
    kinds += [(m, m[-1] + 1, SPAN, OVERLAP - 1) for m in MIDDLE if any(SPAN <= n < OVERLAP for n in lengths)]
    return kinds + [(m, n, n, n) for n in sorted(lengths) if n < SPAN for m in _short(n)]


def _seeds(ids: list[str], rows: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """(ids, at, seed) of every window of every mask; of items (``whole``) only of the masks for their length."""
    parts = [F.array().cast("array<struct<at:int,seed:bigint>>")]
    for number, (places, span, least, most) in enumerate(_kinds(lengths)):
        fits = F.col("n").between(least, most) if whole else F.col("n") >= span
        parts.append(F.when(fits, F.transform(F.sequence(F.lit(0), F.col("n") - span), _window(number, places))).otherwise(parts[0]))
    return rows.select(*ids, F.explode(F.concat(*parts)).alias("s")).select(*ids, "s.at", "s.seed")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where benchmark items stand in documents: key, doc_id, item_id, n_item, start, matched, one row per pair.

    ``documents`` has doc_id and text, ``benchmark`` item_id and text. A pair is returned if, laid
    side by side at any offset, some run of 13 tokens of the item (of all tokens if it has fewer) agrees with the document in
    80 % or more; tokens before or after the document agree with nothing. Every such offset is hit by a seed; items of 5 to 10
    tokens must lie between the document's ends. ``start`` is the document's token that the item's first
    falls on (it can be negative), ``matched`` the number of its tokens that agree, of the offset where most do
    (of equals, the first). ``key`` is a hash of doc_id and text.

    Null and empty texts have no tokens. Items of less than five tokens are never reported. Repeated documents give
    one row a pair, repeated items too. Empty tables give an empty one.
    """
    items = common.stored(
        benchmark.select("item_id", tokens(F.col("text")).alias("w"))
        .select("*", F.size("w").alias("n"))
        .filter(F.col("n") >= LEAST)
        .select("*", F.least(F.lit(OVERLAP), F.col("n")).alias("run"))
        .distinct()
    )
    lengths = [r[0] for r in items.select(F.least("n", F.lit(OVERLAP))).distinct().collect()]
    tests = common.stored(_seeds(["item_id"], items, lengths, True).withColumnRenamed("at", "place"))
    read = documents.select(common.row_key("doc_id", "text").alias("key"), "doc_id", tokens(F.col("text")).alias("w"))
    sized = read.select("*", F.size("w").alias("n"))
    training = _seeds(["key"], sized.filter(F.col("n") >= min((k[1] for k in _kinds(lengths)), default=SPAN)), lengths, False)
    hits = training.join(_small(tests, tests.count()), "seed").select("key", "item_id", (F.col("at") - F.col("place")).alias("start"))
    hits = common.stored(hits.distinct())
    count = hits.count()
    near = hits.join(_small(items, items.count()), "item_id")
    held = read.join(_small(near, count).withColumnRenamed("w", "v"), "key")
    agree = F.transform("v", lambda x, j: F.when(F.get(F.col("w"), j + F.col("start")) == x, 1).otherwise(0))
    laid = held.select("key", "doc_id", "item_id", "n", "run", "start", agree.alias("agree"))
    need = F.ceil(F.col("run") * SHARE)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    covered = F.exists(F.sequence(F.lit(1), F.col("n") - F.col("run") + 1), lambda i: total(F.slice("agree", i, F.col("run"))) >= need)
    verified = laid.filter(covered).select("key", "doc_id", "item_id", "n", F.struct(total(F.col("agree")).alias("m"), (-F.col("start")).alias("s")).alias("b"))
    return verified.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct("b", "n")).alias("x")).select(
        "key", "doc_id", "item_id", F.col("x.n").alias("n_item"), (-F.col("x.b.s")).alias("start"), F.col("x.b.m").alias("matched")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; all others stay as they are."""
    found = common.stored(leaks(docs, common.table(spark, sf_dir, "benchmark")).select("key").distinct())
    # The columns travel in one, so that no name of theirs can clash.
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), common.row_key("doc_id", "text").alias("key"))
    return marked.join(_small(found, found.count()), "key", "left_anti").select("row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "start", "matched")


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {
    "op2_decontamination": r"""
WITH words AS (
  SELECT doc_id, text, [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF w <> ''] AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), items AS (
  SELECT DISTINCT item_id, [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF w <> ''] AS w
  FROM benchmark
), masks(m, span, places) AS (
  VALUES (0, 11, [1, 2, 4, 5, 7, 8, 10, 11]), (1, 11, [1, 2, 3, 5, 8, 9, 10, 11]), (2, 5, range(1, 6)), (3, 6, range(1, 7)),
         (4, 7, range(1, 8)), (5, 8, range(1, 9)), (6, 9, range(1, 10)), (7, 10, range(1, 11))
), d AS (
  SELECT doc_id, text, m, i AS at, [w[i + p - 1] FOR p IN places] AS seed
  FROM words, masks, range(1, 1000000) r(i)
  WHERE m < 2 AND i <= len(w) - span + 1
), d_short AS (
  SELECT doc_id, text, m, i AS at, [w[i + p - 1] FOR p IN places] AS seed
  FROM words, (SELECT * FROM masks WHERE m >= 2 AND span IN (SELECT len(w) FROM items)), range(1, 1000000) r(i)
  WHERE i <= len(w) - span + 1
), t AS (
  SELECT item_id, w, m, i AS place, [w[i + p - 1] FOR p IN places] AS seed
  FROM items, masks, range(1, 10000) r(i)
  WHERE len(w) >= 5 AND ((m < 2 AND i <= len(w) - span + 1) OR (m >= 2 AND len(w) = span AND i = 1))
), hits AS (
  SELECT DISTINCT a.doc_id, a.text, t.item_id, t.w, a.at - t.place AS start
  FROM (SELECT * FROM d UNION ALL SELECT * FROM d_short) a JOIN t ON a.m = t.m AND a.seed = t.seed
), laid AS (
  SELECT h.doc_id, h.text, h.item_id, h.start, h.w AS v,
         [CASE WHEN j + h.start BETWEEN 1 AND len(x.w) AND x.w[j + h.start] = h.w[j] THEN 1 ELSE 0 END FOR j IN range(1, len(h.w) + 1)] AS agree
  FROM hits h JOIN words x ON x.doc_id IS NOT DISTINCT FROM h.doc_id AND x.text IS NOT DISTINCT FROM h.text
), verified AS (
  SELECT *, list_sum(agree) AS matched
  FROM laid
  WHERE list_max([list_sum(agree[i : i + least(13, len(v)) - 1]) FOR i IN range(1, len(v) - least(13, len(v)) + 2)]) >= ceil(least(13, len(v)) * 0.8)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY matched DESC, start, len(v) DESC) AS place FROM verified
)
SELECT doc_id, item_id, CAST(len(v) AS INTEGER) AS n_item, CAST(start AS INTEGER) AS start, CAST(matched AS INTEGER) AS matched
FROM best WHERE place = 1
"""
}
