"""Phrases whose words occur together more often than their parts explain, from a weighted de Bruijn graph of words.

Nodes are runs of LONGEST - 1 words, an edge joins two nodes that overlap in all but one word, and its weight is how often its
LONGEST words occur. Only edges are counted in the texts. All shorter counts follow from the graph: a run of words
occurs as often as the edges that begin with it, plus once for every piece that ends before such an edge is complete. So a
piece gives, besides its edges, one stub for each of its last LONGEST - 1 words, and a prefix sum over edges and stubs gives
the counts of all lengths.

Edges and stubs are keyed by their first words (the root) and the rest (the tail). All prefixes of at least the root's length
share the root, so one shuffle serves three lengths; one more gives pairs. Copies are counted within a slice of text
before they are shuffled, so a text that is a third of all rows costs one row per slice and edge.

Two neighbouring words that occur less often than a phrase must are in no phrase, so pieces are cut between them. Which
pairs these are is read from counts of hashed pairs: a bit table of fixed size says of each bucket whether its pairs together
are frequent. A rare pair may share a bucket with a frequent one; that costs a few rows more and changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm import common
from foliospark.operators.ranking import top_rows

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text whose edges are counted together before they are shuffled.
SLICE = 1 << 20
#: Lanes of 64 bits of the table of frequent pairs: 32 MB at any size of the corpus.
LANES = 1 << 22

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _slices(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Whole rows of about SLICE bytes; a longer row in parts that end where one of its pieces does."""
    for a, b in common.row_groups(starts, SLICE):
        at, end = int(starts[a]), int(starts[b])
        if end - at > SLICE and b == a + 1:
            ends = np.flatnonzero(_KIND[raw[at:end]] == 2) + at + 1
            near = np.searchsorted(ends, np.arange(at + SLICE, end, SLICE))
            for cut in np.unique(ends[near[near < len(ends)]]):
                yield at, int(cut)
                at = int(cut)
        if at < end:
            yield at, end


def _pieces(batch: pa.RecordBatch):
    """The batch in slices: for each, language and piece of every word, its number, the words."""
    langs = batch.column(0).dictionary_encode()
    of_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw, starts = common.byte_rows(batch.column(1))
    for a, b in _slices(raw, starts):
        part, kind = _LOWER[raw[a:b]], _KIND[raw[a:b]]
        begins = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        word = kind == 0
        first, past = common.word_spans(word, begins)
        if not len(first):
            continue
        codes, words = common.encode_words(part, word, past - first)
        bounds = np.union1d(np.flatnonzero(kind == 2), begins)
        row = np.searchsorted(starts, first + a, side="right") - 1
        yield langs.dictionary, of_row[row], np.searchsorted(bounds, first, side="right"), codes, words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for langs, lang, _, codes, words in _pieces(batch):
            key, n = np.unique(lang * len(words) + codes, return_counts=True)
            columns = [langs.take(pa.array(key // len(words))), words.take(pa.array(key % len(words))).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n: all words of ``texts`` (lang, text), neither null."""
    return texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _pair_buckets(langs: pa.Array, lang: np.ndarray, piece: np.ndarray, codes: np.ndarray, words: pa.Array) -> np.ndarray:
    """The bucket of each word and the one after it in its piece, -1 for the last word of a piece."""
    names = [np.array(x.to_pylist(), object) for x in (langs, words)]
    of_lang, of_word = (pd.util.hash_array(x, categorize=False) if len(x) else np.zeros(0, np.uint64) for x in names)
    out = np.full(len(codes), -1, np.int64)
    at = np.flatnonzero(piece[1:] == piece[:-1])
    h = of_word[codes[at]] * np.uint64(0x9E3779B97F4A7C15) + of_word[codes[at + 1]] + of_lang[lang[at]] * np.uint64(0xC2B2AE3D27D4EB4F)
    out[at] = (common.Fingerprints.scramble(h) % np.uint64(64 * LANES)).astype(np.int64)
    return out


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slice_ in _pieces(batch):
            bucket = _pair_buckets(*slice_)
            key, n = np.unique(bucket[bucket >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["bucket", "n"])


def _frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """The bit table of the buckets whose pairs occur at least ``least`` times; never more than LANES rows reach the driver."""
    buckets = texts.mapInArrow(_count_pairs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bucket") % 64).cast("int"))
    found = buckets.groupBy(F.floor(F.col("bucket") / 64).alias("lane")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(LANES, np.uint64)
    table[found.column("lane").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _joined(words: pa.Array, codes: list[np.ndarray]) -> pa.Array:
    """The words of each row, parted by spaces; a number of -1 is no word, and none follows it."""
    none = pa.array([""], words.type)
    first = pa.concat_arrays([none, words]).take(pa.array(codes[0] + 1))
    later = pa.concat_arrays([none, pc.binary_join_element_wise(pa.scalar(" ", words.type), words, pa.scalar("", words.type))])
    return pc.binary_join_element_wise(first, *(later.take(pa.array(c + 1)) for c in codes[1:]), pa.scalar("", words.type)).cast(pa.string())


def _edges(frequent, longest: int):
    root = max(longest - 2, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            for langs, lang, piece, codes, words in _pieces(batch):
                bucket = _pair_buckets(langs, lang, piece, codes, words)
                lane = np.maximum(bucket, 0) // 64
                goes_on = (bucket >= 0) & ((table[lane] >> (bucket % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)
                # What is left of a piece ends with each word that does not go on; single words are counted apart.
                stops = np.flatnonzero(~goes_on) + 1
                at = np.flatnonzero(goes_on)
                length = np.minimum(stops[np.searchsorted(stops, at, side="right")] - at, longest)
                grams = np.full((longest, len(at)), -1, np.int64)
                for k in range(longest):
                    some = length > k
                    grams[k, some] = codes[at[some] + k]
                # Two words to a sorting key; numbers of words are below 2^31.
                keys = [lang[at], *grams]
                keys = [keys[i] * (1 << 31) + (keys[i + 1] + 1 if i + 1 < len(keys) else 0) for i in range(0, len(keys), 2)]
                order = np.lexsort(keys[::-1])
                new = np.ones(len(order), bool)
                if len(order) > 1:
                    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in keys], axis=0)
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(order)))
                one = order[heads]
                columns = [langs.take(pa.array(lang[at][one])), _joined(words, list(grams[:root, one])), _joined(words, list(grams[root:, one])), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "root", "tail", "n"])

    return run


def edges(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, root, tail, n: edges of ``longest`` words and shorter stubs at the ends of pieces, each counted once or more.

    ``texts`` has lang and text, neither null. Rows of one edge are to be added up. Pieces also end between two words whose
    bucket of pairs occurs fewer than ``least`` times; a piece of one word gives no row.
    """
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent_pairs(texts, least))
    return texts.mapInArrow(_edges(frequent, longest), "lang string, root string, tail string, n long")


def _n_words(phrase: Column) -> Column:
    return F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)


def _part(phrase: str, n: int | Column) -> Column:
    """The first ``n`` words, or the last ones for a negative number."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n if isinstance(n, Column) else F.lit(n))


def node_flow(rows: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, n: all runs of 2 to ``longest`` words with at least ``least`` occurrences, from ``edges``.

    The flow through a run is the weight of the edges and stubs that begin with it.
    """
    width = max(longest - 2, 1)
    # One shuffle by root; both sums below keep that partitioning.
    whole = rows.repartition("lang", "root").groupBy("lang", "root", "tail").agg(F.sum("n").alias("n"))
    sizes = F.transform(F.sequence(F.lit(0), _n_words(F.col("tail"))), lambda k: F.when(k == 0, "").otherwise(_part("tail", k)))
    spread = whole.select("lang", "root", F.explode(sizes).alias("tail"), "n")
    flow = spread.groupBy("lang", "root", "tail").agg(F.sum("n").alias("n"))
    flow = common.stored(flow.filter((F.col("n") >= least) | (F.col("tail") == "")))
    phrase = F.concat_ws(" ", "root", F.when(F.col("tail") != "", F.col("tail")))
    long = flow.filter((F.col("n") >= least) & (_n_words(F.col("root")) == width)).select("lang", phrase.alias("phrase"), "n")
    short = flow.filter("tail = ''").select("lang", "root", "n")
    parts = [long]
    for k in range(width - 1, 1, -1):
        # Stubs of fewer words stay as they are and wait for their length.
        short = short.select("lang", _part("root", k).alias("root"), "n").groupBy("lang", "root").agg(F.sum("n").alias("n"))
        parts.append(short.filter((F.col("n") >= least) & (_n_words(F.col("root")) == k)).select("lang", F.col("root").alias("phrase"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("lang", "phrase", _n_words(F.col("phrase")).alias("words"), "n")


def compact_paths(flow: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The frequent edges with the path each lies on: lang, phrase, n, path (its first edge), place in it, path_words.

    Two edges follow one another on a path if all occurrences of the node between them come in by the first and go out by the
    second, so a path is one passage that is always repeated as a whole. Places are found by doubling the distance that an
    edge looks back: as many rounds as the logarithm of the longest path. A path cannot close to a cycle, as every
    occurrence begins in some piece, and that would come into a node beside the cycle.
    """
    node = _part("phrase", longest - 1)
    ends = _part("phrase", 1 - longest)
    frequent = flow.filter(F.col("words") == longest)
    inner = flow.filter(F.col("words") == longest - 1).select("lang", F.col("phrase").alias("node"), F.col("n").alias("through"))
    into = frequent.select("lang", ends.alias("node"), F.col("phrase").alias("before"), F.col("n").alias("n_in"))
    out = frequent.select("lang", node.alias("node"), "phrase", F.col("n").alias("n_out"))
    # The whole flow in one edge leaves none for others, so there is at most one such edge on each side.
    links = inner.join(into, ["lang", "node"]).filter("n_in = through").join(out, ["lang", "node"]).filter("n_out = through")
    links = links.filter("before <> phrase").select("lang", "phrase", "before")
    at = frequent.select("lang", "phrase", "n").join(links, ["lang", "phrase"], "left")
    at = common.stored(at.withColumn("place", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long")))
    # "before" is the edge that an edge looks back to, "place" how far that is; at the head of a path there is none.
    at = at.select("lang", "phrase", "n", F.coalesce("before", "phrase").alias("path"), "place")
    while True:
        back = at.select("lang", F.col("phrase").alias("path"), F.col("path").alias("further"), F.col("place").alias("more"))
        ahead = at.join(back, ["lang", "path"])
        moved = common.stored(ahead.select("lang", "phrase", "n", F.col("further").alias("path"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")))
        at = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    sizes = at.groupBy("lang", "path").agg((F.max("place") + longest).alias("path_words"))
    return at.join(sizes, ["lang", "path"]).select("lang", "phrase", "n", "path", "place", "path_words")


def score_phrases(flow: DataFrame, counts: DataFrame, least: int = LEAST, share: int = 100, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """The best phrases of each language with the cut that explains them best.

    A phrase cut in two parts that occur l and r times scores floor(1000 * a * n / (l * r)), n being all words of the
    language; the least of its cuts counts. A phrase inside a longer one that occurs at least ``share`` percent as often is
    left out: whether one word more on either side is that frequent decides it, as anything longer is rarer still.
    """
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = common.stored(flow.select("lang", "phrase", "n").unionByName(counts.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n")))
    one_less = F.array(_part("phrase", F.col("words") - 1), _part("phrase", 1 - F.col("words")))
    around = flow.filter("words > 2").select("lang", F.explode(one_less).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = flow.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n"))).drop("longer")
    cuts = kept.select("lang", "phrase", F.col("words"), F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("*", _part("phrase", F.col("cut")).alias("left"), _part("phrase", F.col("cut") - F.col("words")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = {x: F.col(x).cast("decimal(19,0)") for x in ("a", "total", "l", "r")}
    product = (F.lit(1000).cast("decimal(4,0)") * wide["a"]).cast("decimal(23,0)") * wide["total"].cast("decimal(15,0)")
    cuts = cuts.join(totals, "lang").withColumn("above", product.cast("decimal(38,0)")).withColumn("below", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "n", F.col("cut.score").alias("score"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))
    return top_rows(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)


def phrases(documents: DataFrame, least: int = LEAST, share: int = 100, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words: the ``top`` phrases of 2 to ``longest`` words of each language.

    ``documents`` has lang and text; a null lang is ``und``, a null text empty; other columns are not read. Letters A to Z are
    lower-cased, texts are split into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs. Repeated rows
    count as often as they are there. A long text is taken slice by slice, cut between its pieces. Ties go to the
    more frequent phrase, then to the smaller one by bytes. path_words is the length of the passage that a phrase
    of ``longest`` words always stands in, null for shorter ones. An empty table, or one without a frequent word, gives no rows.
    """
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = common.stored(word_counts(texts))
    flow = common.stored(node_flow(edges(texts, least, longest), least, longest))
    paths = compact_paths(flow, longest).select("lang", "phrase", "path_words")
    best = score_phrases(flow, counts, least, share, top, longest)
    best = best.join(paths, ["lang", "phrase"], "left")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return phrases(common.table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT row_number() OVER () AS id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), placed AS (
  SELECT id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM listed
), led AS (
  SELECT lang, x, lead(x, 1) OVER p AS x1, lead(x, 2) OVER p AS x2, lead(x, 3) OVER p AS x3, lead(x, 4) OVER p AS x4
  FROM placed WINDOW p AS (PARTITION BY id ORDER BY i)
), grams AS (
  SELECT lang, [x] AS g, 1 AS k FROM led
  UNION ALL SELECT lang, [x, x1], 2 FROM led WHERE x1 IS NOT NULL
  UNION ALL SELECT lang, [x, x1, x2], 3 FROM led WHERE x2 IS NOT NULL
  UNION ALL SELECT lang, [x, x1, x2, x3], 4 FROM led WHERE x3 IS NOT NULL
  UNION ALL SELECT lang, [x, x1, x2, x3, x4], 5 FROM led WHERE x4 IS NOT NULL
), counted AS (
  SELECT lang, g, k, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM counted WHERE k > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT lang, sub FROM (
    SELECT lang, f, g[i:i + s - 1] AS sub FROM frequent, range(2, 5) AS sizes(s), range(1, 5) AS places(i) WHERE s < k AND i + s - 1 <= k) x
  JOIN frequent y USING (lang) WHERE y.g = x.sub AND 100 * x.f >= 100 * y.f
), kept AS (
  SELECT q.* FROM frequent q ANTI JOIN inside s ON q.lang = s.lang AND q.g = s.sub
), cuts AS (
  SELECT q.lang, q.g, q.f AS a, c, l.f AS l, r.f AS r, t.n,
         (1000::HUGEINT * q.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM kept q, range(1, 5) AS cut(c)
  JOIN totals t ON t.lang = q.lang
  JOIN counted l ON l.lang = q.lang AND l.g = q.g[1:c]
  JOIN counted r ON r.lang = q.lang AND r.g = q.g[c + 1:q.k]
  WHERE c < q.k
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1
), follows AS (
  SELECT x.lang, x.g AS before, y.g FROM frequent x
  JOIN frequent y ON y.lang = x.lang AND y.g[1:4] = x.g[2:5] AND y.f = x.f AND y.k = 5
  JOIN frequent z ON z.lang = x.lang AND z.g = x.g[2:5] AND z.f = x.f
  WHERE x.k = 5 AND x.g <> y.g
), walked AS (
  SELECT lang, g AS head, g, 0 AS place FROM frequent f WHERE k = 5 AND NOT EXISTS (SELECT 1 FROM follows y WHERE y.lang = f.lang AND y.g = f.g)
  UNION ALL
  SELECT w.lang, w.head, y.g, w.place + 1 FROM walked w JOIN follows y ON y.lang = w.lang AND y.before = w.g
), paths AS (
  SELECT lang, g, CAST(max(place) OVER (PARTITION BY lang, head) + 5 AS BIGINT) AS path_words FROM walked
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS place FROM best
)
SELECT q.lang, CAST(place AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score, p.path_words
FROM ranked q LEFT JOIN paths p ON q.lang = p.lang AND q.g = p.g WHERE place <= 2000
"""
}
