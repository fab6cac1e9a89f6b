"""Quality classifier: supervised subword embeddings.

A document is the sum of three averages of learned vectors: of its hashed words, of its hashed character n-grams, and
of a mark at each word that says whether it repeats the word before. A softmax over the classes reads that vector.
Vectors and output are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.llm import common

#: Buckets of words and of character n-grams (a power of two each), length of the vectors, bytes of the n-grams.
BUCKET_BITS, DIMENSION, GRAMS = 17, 8, (3, 4)
#: Labelled rows learned from, at most: those whose hashed doc_id comes first.
EXAMPLES = 3000
#: Passes over the sample, and steps made at least, however small it is.
EPOCHS, STEPS, RATE, SEED = 5, 15_000, 0.5, 7
#: Bytes looked at at once. Longer texts are read in pieces that end after white space; n-grams do not cross the cut.
PIECE = 1 << 20
#: Rows with remainder HELD of crc32(doc_id) by FOLDS are never learned from; scores from CUT on are called good.
FOLDS, HELD, CUT = 5, 0, 0.3


def pieces(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in runs of about PIECE bytes: bytes, starts in them, row numbers. Long rows come as several rows."""
    for low, high, begin, end in common.slices(starts, PIECE, 0):
        if high - low > 1 or end - begin <= PIECE and starts[low] == begin and starts[high] == end:
            yield raw[begin:end], starts[low : high + 1] - begin, np.arange(low, high)
    for row in np.flatnonzero(np.diff(starts) > PIECE):
        at, last = int(starts[row]), int(starts[row + 1])
        while at < last:
            past = min(at + PIECE, last)
            blank = np.flatnonzero(raw[at:past] <= 32)
            if past < last and len(blank):
                past = at + int(blank[-1]) + 1
            yield raw[at:past], np.array([0, past - at]), np.array([row])
            at = past


def features(prints: common.Fingerprints, raw: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, the bucket and the row of each one found."""
    sums = prints.sums(raw, 0)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    size = 1 << BUCKET_BITS
    shift = np.uint64(64 - BUCKET_BITS)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    head = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
    tail = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    whole = prints.of(sums, 0, head, tail)
    of = row[head]
    same = np.zeros(len(head), np.int64)
    same[1:] = (whole[1:] == whole[:-1]) & (of[1:] == of[:-1])
    grams, rows = [], []
    for n in GRAMS:
        at = np.arange(max(len(raw) - n + 1, 0))
        at = at[row[at] == row[at + n - 1]]
        grams.append((prints.of(sums, 0, at, at + n) >> shift).astype(np.int64))
        rows.append(row[at])
    return [
        ((whole >> shift).astype(np.int64), of),
        (size + np.concatenate(grams), np.concatenate(rows)),
        (2 * size + same, of),
    ]


@dataclass
class Model:
    """One number per bucket: what its vector adds to the difference of the two outputs; and that of the biases.

    A softmax over two classes depends on that difference alone, and it is linear in the averaged vectors.
    """

    weights: np.ndarray
    bias: float

    def scores(self, prints: common.Fingerprints, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(starts) - 1
        total, count = np.zeros((3, n)), np.zeros((3, n))
        for part, at, rows in pieces(raw, starts):
            for kind, (bucket, row) in enumerate(features(prints, part, at)):
                total[kind][rows] += np.bincount(row, self.weights[bucket], len(rows))
                count[kind][rows] += np.bincount(row, minlength=len(rows))
        logit = self.bias + (total / np.maximum(count, 1)).sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent over (buckets, weights) of each document; classes 0 and 1."""
    rand = np.random.default_rng(SEED)
    n = 2 * (1 << BUCKET_BITS) + 2
    vectors = rand.normal(0, 0.1, (n, DIMENSION)).astype(np.float32)
    output, bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(bags)))
    steps = epochs * len(bags)
    done = 0
    for _ in range(epochs):
        for i in rand.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            bucket, weight = bags[i]
            hidden = weight @ vectors[bucket]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * p
            # Each vector is seldom met and has a small weight; scaling by the bag's own length keeps its steps of use.
            vectors[bucket] -= (rate / max(float(weight @ weight), 1e-6) ** 0.5) * weight[:, None] * back[None, :]
    difference = output[:, 1] - output[:, 0]
    return Model(vectors @ difference, float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and weights of each row; the columns before the text stay."""
    prints = common.Fingerprints(2 * PIECE)
    for batch in batches:
        raw, starts = common.byte_rows(batch.columns[-1])
        found: list[list] = [[] for _ in range(len(starts) - 1)]
        for part, at, rows in pieces(raw, starts):
            for bucket, row in features(prints, part, at):
                order = np.argsort(row, kind="stable")
                for r, own in zip(rows, np.split(bucket[order], np.searchsorted(row[order], np.arange(1, len(rows)))), strict=True):
                    found[r].append(own)
        ids, weights = [], []
        for kinds in found:
            bucket, count = np.unique(np.concatenate(kinds) if kinds else np.zeros(0, np.int64), return_counts=True)
            kind = bucket >> BUCKET_BITS
            weights.append((count / np.maximum(np.bincount(kind, count, 3), 1)[kind]).astype(np.float32))
            ids.append(bucket.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], [*batch.schema.names[:-1], "bucket", "weight"]
        )


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """doc_id, label (0 or 1) and text of at most ``most`` labelled doc_ids outside the held-out fold.

    Rows without a label or doc_id do not count; a doc_id with several labels has the one that most of them say, 1 if even.
    Which ones are taken depends on their hashed doc_id alone. Their number bounds what is sent to executors.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(common.learned_row(folds, held))
    known = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    chosen = known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.select("doc_id", "text").join(F.broadcast(common.stored(chosen)), "doc_id").select("doc_id", "label", "text")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES) -> Model:
    """The trained model; without labelled rows it scores every text 0.5."""
    sample = labelled_sample(documents, labels, label, FOLDS, HELD, examples)
    kind = documents.schema["doc_id"].dataType.simpleString()
    bags = sample.mapInArrow(_bags, f"doc_id {kind}, label int, bucket array<int>, weight array<float>").dropDuplicates(["doc_id"]).toArrow()
    if not bags.num_rows:
        return Model(np.zeros(2 * (1 << BUCKET_BITS) + 2, np.float32), 0.0)
    bags = bags.sort_by("doc_id").combine_chunks()
    pairs = [tuple(bags.column(c)[i].values.to_numpy() for c in ("bucket", "weight")) for i in range(bags.num_rows)]
    return train(pairs, bags.column("label").to_numpy())


def _scorer(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = common.Fingerprints(2 * PIECE)
        for batch in batches:
            raw, starts = common.byte_rows(batch.columns[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(prints, raw, starts))], [*batch.schema.names[:-1], name])

    return run


def score_quality(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (chance of label 1) and predicted (1 from 0.3 on) of every row, from its whole text alone.

    Null and empty texts score what the biases say. A null doc_id is not held out. Rows may repeat; an empty table gives
    an empty one; further columns do not matter.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(_scorer(model, "score"), f"doc_id {kind}, score double")
    held = F.coalesce(~common.learned_row(FOLDS, HELD), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return score_quality(documents, fit(documents, common.table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
