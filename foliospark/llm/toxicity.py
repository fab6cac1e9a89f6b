"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are all words of the examples and the beginnings of these words. A term's weight is its frequency in the text, its inverse
document frequency over all documents, and its mutual information with the label among the examples, drawn towards zero
where few rows speak for it. So every term takes part at every size of the corpus, and those that say something about the label
decide which texts are near. The index of examples is bounded; every document is a query against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.llm import common
from foliospark.llm.quality import labelled_sample

#: Labelled rows learned from, at most: those whose hashed doc_id comes first.
EXAMPLES = 3000
#: Lengths in characters of the beginnings that count as terms.
STEMS = (4, 6)
#: Likelihood ratio at which a term's mutual information counts half.
DOUBT = 20.0
#: Neighbours that vote, rows of one block of the index, blocks read at once, weight of a neighbour at distance 0 (1 / NEAR).
NEIGHBOURS, BLOCK, READ, NEAR = 16, 32, 8, 0.1
#: Share of the examples from which on a term is common; queries answered together.
COMMON, TOGETHER = 0.05, 128
#: Neighbours named as evidence.
SHOWN = 3
#: Rows with remainder HELD of crc32(doc_id) by FOLDS are never learned from; scores from CUT on are called toxic.
FOLDS, HELD, CUT = 4, 2, 0.3
#: Bytes of texts taken together, terms of one piece of the document frequencies, groups that tasks' pieces are first added up in.
SLICE, PIECE, GROUPS = 1 << 20, 1 << 14, 512

# Control characters, white space and ASCII punctuation stand between words.
_WORD = np.array([chr(c).isalnum() or c > 127 for c in range(256)])


def term_names(words: list[str]) -> np.ndarray:
    """64-bit names of a word and its beginnings, one column each; 0 where a word is too short to have that beginning."""
    out = np.zeros((len(words), 1 + len(STEMS)), np.uint64)
    for j, forms in enumerate([words, *([w[:n] + "-" if len(w) >= n else "" for w in words] for n in STEMS)]):
        some = np.array([bool(f) for f in forms], bool)
        if some.any():
            out[some, j] = pd.util.hash_array(np.array([f for f in forms if f], object), categorize=False)
    return out


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first and past-last row, the row of each word, the number of each word, the names of its terms by number."""
    raw, starts = common.byte_rows(column)
    for a, b in common.row_groups(starts, SLICE):
        part, begins = raw[starts[a] : starts[b]], starts[a:b] - starts[a]
        word = _WORD[part]
        first, past = common.word_spans(word, begins)
        codes, words = common.encode_words(part, word, past - first)
        yield a, b, np.searchsorted(begins, first, side="right") - 1, codes, term_names([w.lower() for w in words.to_pylist()])


def text_terms(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first and past-last row, then row, term and frequency of each different (row, term), in order.

    A term is its place in ``known`` (sorted names), those not in it being left out; without it, the name itself.
    """
    for a, b, row, codes, names in _slices(column):
        if known is not None:
            place = np.searchsorted(known, names).clip(max=max(len(known) - 1, 0))
            here = (known[place] == names) & (names != 0) if len(known) else np.zeros(names.shape, bool)
            terms = np.where(here, place, -1)
            pair, times = np.unique(row * max(len(names), 1) + codes, return_counts=True)
            row, codes = pair // max(len(names), 1), pair % max(len(names), 1)
            key = row[:, None] * max(len(known), 1) + terms[codes]
            keep = terms[codes] >= 0
            key, times = key[keep], np.repeat(times[:, None], names.shape[1], 1)[keep]
            key, where = np.unique(key, return_inverse=True)
            yield a, b, key // max(len(known), 1), key % max(len(known), 1), np.bincount(where, times, len(key)).astype(np.int64)
        else:
            each = names[codes]
            keep = each != 0
            owner = np.repeat(row[:, None], names.shape[1], 1)[keep]
            order = np.lexsort((each[keep], owner))
            owner, name = owner[order], each[keep][order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (name[1:] != name[:-1])
            heads = np.flatnonzero(new)
            yield a, b, owner[heads], name[heads], np.diff(np.append(heads, len(owner)))


class BlockMaxIndex:
    """Exact nearest neighbours by inner product over sparse rows, for many queries at once.

    Rows are cut into blocks of neighbours. Rare terms have postings, which are followed for every query. Common terms, whose
    postings would be most of the work, have a column of weights, and for each block the largest weight in it. What a row of a
    block can score is bounded by its part from rare terms and by the block's largest weights. Each query reads the
    blocks of the highest bounds first, then those whose bound reaches the last of the k best found there.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int, block: int = BLOCK):
        self.block, self.blocks, self.n_rows = block, -(-max(n_rows, 1) // block), n_rows
        common_ = np.flatnonzero(np.bincount(term, minlength=n_terms) > COMMON * n_rows)
        self.column = np.full(n_terms, -1)
        self.column[common_] = np.arange(len(common_))
        far = self.column[term] < 0
        self.wide = np.zeros((self.blocks * block, len(common_)))
        self.wide[row[~far], self.column[term[~far]]] = weight[~far]
        self.most = self.wide.reshape(self.blocks, block, len(common_)).max(1)
        order = np.lexsort((row[far], term[far]))
        self.row, self.weight = row[far][order].astype(np.int32), weight[far][order]
        self.first = np.searchsorted(term[far][order], np.arange(n_terms + 1))

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> list[list[tuple[int, float]]]:
        """For each of ``n`` queries, given as (query, term, weight), the k rows of greatest product above 0, ties to the smaller
        number; row ``skip`` of a query takes no part."""
        size = self.blocks * self.block
        column = self.column[term]
        far = column < 0
        posting, pair = common.expand(self.first[term[far]], self.first[term[far] + 1] - self.first[term[far]])
        score = np.bincount(query[far][pair] * size + self.row[posting], weight[far][pair] * self.weight[posting], n * size).astype(float).reshape(n, size)
        if skip is not None:
            score[np.arange(n), skip] = -np.inf
        asked = np.zeros((n, self.wide.shape[1]))
        asked[query[~far], column[~far]] = weight[~far]
        bound = asked @ self.most.T + score.reshape(n, self.blocks, self.block).max(2)
        read = np.zeros((n, self.blocks), bool)
        least = np.zeros(n)
        for turn in range(2):
            if turn == 0:
                now = np.zeros((n, self.blocks), bool)
                ahead = min(READ, self.blocks)
                np.put_along_axis(now, np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead], True, axis=1)
            else:
                now = (bound >= least[:, None] - 1e-12) & ~read
            for b in np.flatnonzero(now.any(0)).tolist():
                who = np.flatnonzero(now[:, b])
                rows = slice(b * self.block, (b + 1) * self.block)
                score[who, rows] += asked[who] @ self.wide[rows].T
            read |= now
            if k <= size:
                seen = np.where(np.repeat(read, self.block, axis=1), score, 0.0)
                least = np.maximum(np.partition(seen, size - k, axis=1)[:, size - k], 0.0)
        # Rounded, so that equal products do not differ by the order of their terms.
        seen = np.round(seen if k <= size else score, 12)
        owner, rows = np.nonzero(seen >= np.maximum(np.round(least, 12), 1e-12)[:, None])
        order = np.lexsort((rows, -seen[owner, rows], owner))
        owner, rows = owner[order], rows[order]
        ends = np.searchsorted(owner, np.arange(n + 1))
        return [[(int(r), float(seen[q, r])) for r in rows[ends[q] : min(ends[q] + k, ends[q + 1])]] for q in range(n)]


def rising_means(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration: the rising step function of x that fits y best, as (steps' starts, values). Neighbours out of order merge."""
    at, where = np.unique(x, return_inverse=True)
    total, count = np.bincount(where, y), np.bincount(where).astype(float)
    steps: list[list[float]] = []
    for a, t, n in zip(at.tolist(), total.tolist(), count.tolist(), strict=True):
        steps.append([a, t, n])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            _, t, n = steps.pop()
            steps[-1][1] += t
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def information(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """Mutual information of a term's presence (in n0 rows of label 0, n1 of label 1) with the label, less where it may be chance."""
    n, both = all0 + all1, n0 + n1
    share = all1 / max(n, 1)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    ratio = 2 * (part(n1, both * share) + part(n0, both * (1 - share)) + part(all1 - n1, (n - both) * share) + part(all0 - n0, (n - both) * (1 - share)))
    # Chance alone gives a ratio of 1 on average.
    ratio = np.maximum(ratio - 1, 0)
    return ratio / max(2 * n, 1) * ratio / (ratio + DOUBT)


@dataclass
class Model:
    """Names of the terms, their weights, the index of the examples, their ids and labels, the calibration, and the overall share."""

    names: np.ndarray
    weights: np.ndarray
    index: BlockMaxIndex
    examples: list
    labels: np.ndarray
    steps: np.ndarray
    chances: np.ndarray
    without: float
    share: float

    def near(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, skip: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """The nearest examples of each of ``n`` texts given as (row, term, frequency) in order of rows."""
        weight = (1 + np.log(count)) * self.weights[term]
        length = np.sqrt(np.bincount(row, weight**2, n))
        weight = weight / np.maximum(length, 1e-300)[row]
        begin = np.searchsorted(row, np.arange(n + 1))
        for a in range(0, n, TOGETHER):
            b = min(a + TOGETHER, n)
            at = slice(begin[a], begin[b])
            yield from zip(range(a, b), self.index.nearest(row[at] - a, term[at], weight[at], b - a, NEIGHBOURS, None if skip is None else skip[a:b]), strict=True)

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Share of label 1 among the neighbours, each by the inverse of its distance; one vote of the overall share."""
        weight = [1 / (1 - min(c, 1.0) + NEAR) for _, c in near]
        return (sum(w * self.labels[r] for w, (r, _) in zip(weight, near, strict=True)) + self.share) / (sum(weight) + 1)

    def judge(self, near: list[tuple[int, float]]) -> float:
        if not near:
            return self.without
        return float(self.chances[max(int(np.searchsorted(self.steps, self.vote(near), side="right")) - 1, 0)])


def build(doc_ids: list, labels: np.ndarray, row: np.ndarray, name: np.ndarray, count: np.ndarray, frequency=None) -> Model:
    """The model of examples given as (row, term name, frequency); ``frequency`` gives (documents, document frequency by name).

    Terms that say no more about the label than chance would have no weight and are left out. Rows without any other term
    vote for nothing; their share of label 1 is what a text without any known term scores.
    """
    n, all1 = len(labels), int(labels.sum())
    share = all1 / max(n, 1)
    names, term = np.unique(name, return_inverse=True)
    seen1 = np.bincount(term, labels[row], len(names))
    seen0 = np.bincount(term, minlength=len(names)) - seen1
    weights = information(seen0, seen1, n - all1, all1)
    told = weights > 0
    term, told_here = (np.cumsum(told) - 1)[term], told[term]
    row, term, count = row[told_here], term[told_here], count[told_here]
    names, weights = names[told], weights[told]
    documents, df = frequency(names) if frequency else (n, (seen0 + seen1)[told])
    weights = weights * (np.log((1 + documents) / (1 + df)) + 1)
    weight = (1 + np.log(count)) * weights[term]
    length = np.sqrt(np.bincount(row, weight**2, n))
    # Rows of like size lie together, so that a block's largest weights are like those of its rows.
    order = np.lexsort((np.arange(n), np.bincount(row, minlength=n)))
    order = order[length[order] > 0]
    place = np.full(n, -1)
    place[order] = np.arange(len(order))
    sort = np.lexsort((term, place[row]))
    row, term, count, weight = place[row][sort], term[sort], count[sort], (weight / length[row])[sort]
    index = BlockMaxIndex(row, term, weight, len(order), len(names))
    empty = labels[length == 0]
    without = (float(empty.sum()) + share) / (len(empty) + 1)
    model = Model(names, weights, index, [doc_ids[i] for i in order], labels[order].astype(float), np.zeros(1), np.zeros(1), without, share)
    if len(order):
        # Each example is judged by the others; what comes of that calibrates the votes.
        votes = [model.vote(near) for _, near in model.near(row, term, count, len(order), np.arange(len(order)))]
        model.steps, model.chances = rising_means(np.array(votes), model.labels)
    return model


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, row, name, count in text_terms(batch.column("text")):
            offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (name.view(np.int64), count)]
            ids = [batch.column(c).slice(a, b - a) for c in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*ids, *lists], ["doc_id", "label", "names", "counts"])


def _frequencies(names: np.ndarray):
    """How many texts of a task hold each term, in pieces; piece -1 is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(len(names), np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, _, term, _ in text_terms(batch.column("text"), names):
                found += np.bincount(term, minlength=len(names))
        cuts = np.arange(0, len(names), PIECE)
        counts = [pa.scalar([texts], pa.list_(pa.int64())), *(pa.scalar(found[c : c + PIECE].tolist(), pa.list_(pa.int64())) for c in cuts)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(cuts // PIECE)], pa.int32()), pa.array([c.as_py() for c in counts], pa.list_(pa.int64()))], ["piece", "counts"])

    return run


def _added(group: pa.Table) -> pa.Table:
    """One row per piece: the sum of its counts, taken up row by row."""
    total: np.ndarray | None = None
    for batch in group.to_batches():
        for counts in batch.column("counts"):
            values = counts.values.to_numpy()
            total = values.copy() if total is None else total + values
    return pa.table({"piece": group.column("piece").slice(0, 1), "counts": pa.array([total], pa.list_(pa.int64()))})


def document_frequencies(documents: DataFrame, names: np.ndarray) -> tuple[int, np.ndarray]:
    """All documents, and how many of them hold each term. Tasks' counts are added up in groups first, then over the groups."""
    shape = "piece int, counts array<long>"
    parts = documents.select("text").mapInArrow(_frequencies(names), shape).withColumn("group", F.spark_partition_id() % GROUPS)
    grouped = parts.groupBy("piece", "group").applyInArrow(lambda table: _added(table.drop_columns(["group"])), shape)
    found = grouped.groupBy("piece").applyInArrow(_added, shape).toArrow().sort_by("piece")
    counts = [x.values.to_numpy() for x in found.column("counts")]
    return (int(counts[0][0]) if counts else 0), (np.concatenate(counts[1:]) if len(counts) > 1 else np.zeros(len(names), np.int64))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Model:
    """The examples' index; without labelled rows every text scores 0.

    At most ``examples`` labelled rows and their terms pass through the driver; document frequencies are of all documents.
    """
    sample = labelled_sample(documents, labels, label, FOLDS, HELD, examples)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(_example_terms, f"doc_id {kind}, label int, names array<long>, counts array<long>").dropDuplicates(["doc_id"])
    found = common.stored(rows).orderBy("doc_id").toArrow().combine_chunks()
    lists = found.column("names").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int64()))
    row = np.repeat(np.arange(found.num_rows), lists.value_lengths().to_numpy().astype(np.int64))
    counts = found.column("counts").combine_chunks().flatten().to_numpy() if found.num_rows else np.zeros(0, np.int64)
    name = lists.flatten().to_numpy().view(np.uint64)
    y = found.column("label").to_numpy().astype(np.int64) if found.num_rows else np.zeros(0, np.int64)
    return build(found.column("doc_id").to_pylist(), y, row, name, counts, lambda names: document_frequencies(documents, names))


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = [], []
            for a, b, row, term, count in text_terms(batch.columns[-1], model.names):
                for _, near in model.near(row, term, count, b - a):
                    scores.append(model.judge(near))
                    evidence.append([model.examples[r] for r, _ in near[:SHOWN]])
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "score", "evidence"])

    return run


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (chance of label 1), predicted (1 from 0.3 on) and evidence of every row, from its text.

    The evidence is the doc_ids of the nearest examples, none if the text has no term that the examples know, as null and
    empty texts. A long text is read whole. A null doc_id is not held out. Rows may repeat; an empty table gives an empty one;
    further columns do not matter.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(_judge(model), f"doc_id {kind}, score double, evidence array<long>")
    held = F.coalesce(~common.learned_row(FOLDS, HELD), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not called toxic, unchanged; learned from the labels of the documents given."""
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    numbered = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(docs.columns, names, strict=True))
    judged = numbered.mapInArrow(_judge_rows(model, docs.columns.index("text")), schema)
    return judged.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def _judge_rows(model: Model, text: int):
    """Keeps the rows whose text, in the column of that number, is not called toxic."""
    judge = _judge(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (scored,) = judge(iter([batch.select([text])]))
            yield batch.filter(pa.array(scored.column("score").to_numpy() < CUT))

    return run


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return score_toxicity(documents, fit(documents, common.table(spark, sf_dir, "labels"))).drop("evidence")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
