"""Mixing sources to target weights: a min-cost flow over membership patterns, then a seeded choice of documents.

Documents that belong to the same set of sources form a pattern. A pattern can give its words once, twice, ... up to a
limit, each further time at a higher cost, and only to the sources it belongs to; every source wants its target.
The cheapest flow that fills most of the targets says how many words each pattern gives. Its documents, in
a seeded order, then give whole repeats and, at the end, a part of one.

Words are counted text by text in the JVM, so that memory follows the longest text, not a batch of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm import common
from foliospark.operators.ranking import running_sum

# Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words taken from a source or a document, in multiples of its size, at most.
MOST = 3
SEED = "mix 1 "


def word_count(text: Column) -> Column:
    """Number of words of a text, null as empty: every word, with the space after it, becomes one letter."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def source_targets(sizes: dict, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> dict:
    """Words each source wants: all sizes shared by weight, none above ``most`` times its size, the excess reshared.

    Sources stop in order of limit by weight, so one walk finds all that stop; the rest share what is left.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, left = sum(sizes.values()), sum(weight.values())
    targets = {}
    for s in sorted(order, key=lambda s: most * sizes[s] / weight[s]):
        if most * sizes[s] * left <= weight[s] * rest:
            targets[s] = float(most * sizes[s])
            rest, left = rest - most * sizes[s], left - weight[s]
    return {s: targets.get(s, weight[s] * rest / left if left else 0.0) for s in order}


def cheapest_flow(patterns: list[tuple[tuple, int]], wanted: dict, most: int = MOST) -> list[dict]:
    """Words that each pattern (its sources, its words) gives to each of its sources.

    Fills as much of ``wanted`` (source to words) as can be, at least total cost; the n-th repeat of a word costs 2n - 1.
    Shortest augmenting paths; patterns and sources that share no source are solved apart.
    """
    part: dict = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for i, (members, _) in enumerate(patterns):
        for s in members:
            part[root(("p", i))] = root(("s", s))
    groups: dict = {}
    for i in range(len(patterns)):
        groups.setdefault(root(("p", i)), []).append(i)
    out: list[dict] = [{} for _ in patterns]
    for chosen in groups.values():
        sources = sorted({s for i in chosen for s in patterns[i][0]}, key=lambda s: (s is None, s or ""))
        number = {("p", i): 1 + k for k, i in enumerate(chosen)}
        number |= {("s", s): 1 + len(chosen) + k for k, s in enumerate(sources)}
        sink = 1 + len(number)
        arcs: list[list] = []  # to, capacity left, cost; the arc back is the next or the one before
        leaving: list[list[int]] = [[] for _ in range(sink + 1)]

        def arc(a, b, capacity, cost, arcs=arcs, leaving=leaving):
            leaving[a].append(len(arcs))
            leaving[b].append(len(arcs) + 1)
            arcs.extend(([b, capacity, cost], [a, 0, -cost]))

        routes = {}
        for i in chosen:
            members, words = patterns[i]
            for n in range(1, most + 1):
                arc(0, number["p", i], words, 2 * n - 1)
            for s in members:
                routes[i, s] = len(arcs)
                arc(number["p", i], number["s", s], most * words, 0)
        for s in sources:
            arc(number["s", s], sink, wanted.get(s, 0), 0)
        while True:
            cost, via = [float("inf")] * (sink + 1), [-1] * (sink + 1)
            cost[0] = 0
            queue = [0]
            while queue:
                waiting = []
                for a in queue:
                    for e in leaving[a]:
                        b, capacity, price = arcs[e]
                        if capacity > 0 and cost[a] + price < cost[b]:
                            cost[b], via[b] = cost[a] + price, e
                            waiting.append(b)
                queue = list(dict.fromkeys(waiting))
            if via[sink] < 0:
                break
            path, at = [], sink
            while at:
                path.append(via[at])
                at = arcs[via[at] ^ 1][0]
            flow = min(arcs[e][1] for e in path)
            for e in path:
                arcs[e][1] -= flow
                arcs[e ^ 1][1] += flow
        for (i, s), e in routes.items():
            out[i][s] = arcs[e ^ 1][1]
    return out


def choose(documents: DataFrame, members: Column, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each document, and the sources with size and target.

    ``members`` is the array of sources that a document (doc_id, text, any others) belongs to; a null in it is a
    source of its own. The first frame has one row per different document: key (a hash of doc_id and text), doc_id,
    members, size, rows (how often it is there) and taken (words taken of each of these). The second has source,
    source_size (words of all documents that belong to it) and target. The words taken of a pattern add up to what the
    flow gave it, to within the number of equal rows.

    The order is that of a hash of the seed and doc_id, so reruns agree. Null and empty texts have size 0. An empty table
    gives empty frames. Patterns and sources pass through the driver, documents do not.
    """
    spark = documents.sparkSession
    marked = documents.select(
        common.row_key("doc_id", "text").alias("key"),
        "doc_id",
        F.to_json(F.array_sort(F.array_distinct(members))).alias("pattern"),
        F.array_distinct(members).alias("members"),
        word_count(F.col("text")).alias("size"),
    )
    sized = common.stored(marked)
    collected = sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.first("members").alias("members")).orderBy("pattern").collect()
    patterns = [(tuple(r.members), int(r.words)) for r in collected]
    sizes: dict = {}
    for of, words in patterns:
        for s in of:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, weights, most)
    flows = cheapest_flow(patterns, {s: int(np.floor(t + 0.5)) for s, t in targets.items()}, most)
    plan = [
        (r.pattern, r.members, sum(f.values()) // max(words, 1), sum(f.values()) % max(words, 1))
        for r, f, (_, words) in zip(collected, flows, patterns, strict=True)
    ]
    plan = spark.createDataFrame(plan, "pattern string, members array<string>, whole long, part long")
    units = sized.groupBy("key", "doc_id", "pattern", "size").agg(F.count("*").alias("rows"))
    units = units.withColumn("words", F.col("rows") * F.col("size"))
    units = units.withColumn("place", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    along = running_sum(units, ["pattern"], [F.col("place"), F.col("size"), F.col("key")], "words", "so_far")
    rest = F.greatest(F.lit(0), F.least(F.col("part") - (F.col("so_far") - F.col("words")), F.col("words")))
    taken = F.floor((F.col("whole") * F.col("words") + rest) / F.col("rows")).cast("long")
    decided = common.stored(along.join(plan, "pattern").select("key", "doc_id", "members", "size", "rows", taken.alias("taken")))
    sources = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "source string, source_size long, target double")
    return decided, sources


def _with_source(decided: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds what is known of the first source."""
    named = sources.withColumnRenamed("source", "_source")
    return decided.join(named, F.col("members")[0].eqNullSafe(F.col("_source")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken; repeats are counted, not copied.

    Columns of ``docs`` with these names are replaced.
    """
    decided, sources = choose(docs, F.array("source"))
    parts = _with_source(decided.filter("taken > 0"), sources).select("key", "members", "size", "source_size", "target", "taken")
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in added]
    names = [f"_{i}" for i in range(len(kept))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), common.row_key("doc_id", "text").alias("key"), F.array("source").alias("of"))
    same = (keyed["key"] == parts["key"]) & (keyed["of"] == parts["members"])
    # Equal rows of one key and source have one decision; the key alone settles all but texts that hash alike.
    return keyed.join(parts, same).select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), *added)


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    decided, sources = choose(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.array("source"))
    each = decided.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return _with_source(each, sources).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_source_mix": op5_source_mix}
ORACLES = {
    "op5_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), walk AS (
  SELECT *, 3 * source_size AS most,
         sum(3 * source_size) OVER w - 3 * source_size AS before, sum(weight) OVER w - weight AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM per
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), marked AS (
  SELECT *, most * (weights - weight_before) <= weight * (total - before) AS stops FROM walk
), aimed AS (
  SELECT source, source_size,
         CASE WHEN stops THEN CAST(most AS DOUBLE)
              ELSE CAST(weight * (total - sum(CASE WHEN stops THEN most ELSE 0 END) OVER ()) AS DOUBLE) / CAST(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM marked
), routed AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS flow FROM aimed
), units AS (
  SELECT doc_id, source, text, size, count(*) AS n, CAST(count(*) * size AS BIGINT) AS words FROM sized GROUP BY doc_id, source, text, size
), along AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY md5('mix 1 ' || coalesce(CAST(doc_id AS VARCHAR), '')), size, text NULLS FIRST ROWS UNBOUNDED PRECEDING) - words AS before FROM units
), decided AS (
  SELECT a.*, r.source_size, r.target,
         CASE WHEN r.source_size = 0 THEN 0
              ELSE (r.flow // r.source_size * a.words + greatest(0, least(r.flow % r.source_size - a.before, a.words))) // a.n END AS taken
  FROM along a JOIN routed r ON a.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM decided, range(n)
"""
}
