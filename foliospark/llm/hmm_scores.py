"""Hidden Markov language model: Baum-Welch counts added up over partitions, exact likelihood by scaled forward steps.

States emit classes of words. Each of the most frequent words is a class of its own; the others share a fixed number of
hashed classes, inside which a word has its share by corpus counts, and words never seen have the share that words seen
once had. The model's size is fixed, whatever the vocabulary; counts of words outside the head stay in a table and are
joined to the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm import common

STATES = 8
#: Words sent to executors with their counts; words with a class of their own; hashed classes of all others.
HEAD, OWN, SHARED = 1 << 17, 1 << 14, 1 << 11
#: Passes over all training texts, after passes over a few texts that only give the start values.
PASSES, START_PASSES, START_TEXTS, START_LENGTH = 2, 12, 1000, 20_000
#: Added to a state's counts, dealt by the classes' overall shares; to transitions; weight of staying in the start values.
SMOOTH, MOVE, STAY, SEED = 50.0, 0.1, 0.9, 11
#: Tokens laid side by side at once, and tokens gathered before they are sorted by length.
STEP, GATHER = 500_000, 2_000_000
FOLDS, HELD = 10, 0
#: What the base adds to each count.
ADD = 0.1


def training(doc_id: Column) -> Column:
    """Whether a row is learned from; rows without a doc_id are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS != HELD, F.lit(True))


@dataclass
class Words:
    """The head: number of each word by rank, counts, and what is known of all words."""

    rank: dict[bytes, int]
    counts: np.ndarray
    total: int  # all training tokens
    distinct: int  # different ones
    texts: int  # training texts, that is ends
    shares: np.ndarray  # of the classes; the last is the end
    mass: np.ndarray  # of the hashed classes, in counts: what the words in them have and what unseen words have
    unseen: float  # in counts, for each hashed class

    def classes(self) -> np.ndarray:
        """Class of each word of the head."""
        out = np.arange(len(self.counts), dtype=np.int32)
        for word, i in self.rank.items():
            if i >= OWN:
                out[i] = OWN + crc32(word) % SHARED
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / (self.total + ADD * (self.distinct + 1)))


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    raw, starts = common.byte_rows(batch.column("text"))
    at = starts.tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield raw[a:b].tobytes().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their number, some of them several times; the row without a word counts the texts."""
    counts: Counter = Counter()
    texts = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        texts += batch.num_rows
        for words in _texts(batch):
            counts.update(words)
            if len(counts) > 300_000:
                yield out()
                counts.clear()
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts], pa.int64())], ["word", "n"])


def count_words(documents: DataFrame) -> tuple[DataFrame, Words]:
    """The table (word, n) of all training words, and the head of it."""
    table = common.stored(documents.filter(training(F.col("doc_id"))).select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    words = table.filter("word IS NOT NULL")
    texts = table.filter("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number, tokens, once = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    top = words.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    rank = {w: i for i, w in enumerate(top.column("word").to_pylist())}
    counts = top.column("n").to_numpy().astype(np.int64)
    distinct, total = number + bool(texts), tokens + texts
    mass = np.zeros(SHARED)
    for b, n in words.groupBy((F.crc32("word") % SHARED).alias("b")).agg(F.sum(F.col("n") + ADD)).collect():
        mass[b] = n
    for w, i in rank.items():
        if i < OWN:
            mass[crc32(w) % SHARED] -= counts[i] + ADD
    unseen = max(once, ADD) / SHARED
    mass = np.maximum(mass, 0) + unseen
    shares = np.concatenate([counts[:OWN] + ADD, np.zeros(max(OWN - len(counts), 0)), mass, [texts + ADD]])
    return words, Words(rank, counts, total, distinct, texts, shares / shares.sum(), mass, unseen)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class by state


def _from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
    emit = emit + SMOOTH * shares[:, None]
    return Model((start + MOVE) / (start + MOVE).sum(), (move + MOVE) / (move + MOVE).sum(1, keepdims=True), emit / emit.sum(0))


def side_by_side(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Texts in groups of about STEP tokens, longest first: their numbers, the classes."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    group: list[int] = []
    size = 0
    for i in order:
        if group and size + len(texts[i]) > STEP:
            yield np.array(group), [texts[j] for j in group]
            group, size = [], 0
        group.append(i)
        size += len(texts[i])
    if group:
        yield np.array(group), [texts[j] for j in group]


def forward_backward(model: Model, texts: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log likelihood of each text (longest first, none empty); adds expected counts to ``counts`` if given.

    All texts take a step at once; those that have ended lie at the back and are left out.
    """
    lengths = np.array([len(t) for t in texts])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
    begin = np.concatenate([[0], np.cumsum(active)])
    time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = begin[time] + owner
    tokens, text = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    tokens[place], text[place] = np.concatenate(texts), owner
    emit = model.emit[tokens]
    alpha, scale = np.empty_like(emit), np.empty(len(place))
    state = np.broadcast_to(model.start, (active[0], len(model.start)))
    for t, n in enumerate(active.tolist()):
        at = slice(begin[t], begin[t] + n)
        state = (state[:n] @ model.move if t else state) * emit[at]
        weight = state.sum(1)
        state = state / weight[:, None]
        alpha[at], scale[at] = state, weight
    likelihood = np.bincount(text, np.log(scale), len(texts))
    if counts is not None:
        start, move, seen = counts
        after = np.ones((active[-1], len(model.start)))
        emit /= scale[:, None]
        back = model.move.T.copy()
        joint = np.zeros_like(model.move)
        for t in range(len(active) - 1, 0, -1):
            at, n = slice(begin[t], begin[t + 1]), active[t]
            ahead = emit[at] * after
            alpha[at] *= after
            before = alpha[begin[t - 1] : begin[t]]
            joint += before[:n].T @ ahead
            after = np.ones_like(before)
            after[:n] = ahead @ back
        alpha[: active[0]] *= after
        move += joint * model.move
        start += alpha[: active[0]].sum(0)
        for s in range(alpha.shape[1]):
            seen[:, s] += np.bincount(tokens, alpha[:, s], len(seen))
    return likelihood


def _class_lists(words: Words):
    """Reads texts as classes, each with the end; also the words outside the head."""
    kinds, end = words.classes(), len(words.shares) - 1

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        get = words.rank.get
        for text in _texts(batch):
            rank = np.fromiter(map(get, text, repeat(-1)), np.int64, len(text))
            out = np.empty(len(text) + 1, np.int64)
            out[-1] = end
            far = np.flatnonzero(rank < 0).tolist()
            out[:-1] = kinds[rank] if len(kinds) else 0
            rare = [text[i] for i in far]
            out[far] = [OWN + crc32(w) % SHARED for w in rare]
            yield out, rank, rare

    return read


def _expected(words: Words, model: Model):
    """Expected counts of one partition: kind (0 start, 1 move, 2 emit), row and one number per state."""
    read = _class_lists(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.start)
        counts = np.zeros(k), np.zeros((k, k)), np.zeros((len(words.shares), k))
        waiting: list[np.ndarray] = []
        size = 0

        def settle():
            for _, texts in side_by_side(waiting):
                forward_backward(model, texts, counts)
            waiting.clear()

        for batch in batches:
            for classes, _, _ in read(batch):
                waiting.append(classes)
                size += len(classes)
                if size > GATHER:
                    settle()
                    size = 0
        settle()
        table = np.concatenate([counts[0][None, :], *counts[1:]])
        kind = np.repeat([0, 1, 2], [1, k, len(counts[2])])
        row = np.concatenate([[0], np.arange(k), np.arange(len(counts[2]))])
        some = table.any(1)
        columns = [pa.array(kind[some], pa.int32()), pa.array(row[some], pa.int32()), *(pa.array(table[some, s]) for s in range(k))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "row", *(f"n{s}" for s in range(k))])

    return run


def _as_classes(words: Words):
    read = _class_lists(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.astype(np.int32) for c, _, _ in read(batch)], pa.list_(pa.int32()))], ["classes"])

    return run


def train(documents: DataFrame, words: Words) -> Model:
    """Start values from a few texts, then full passes whose expected counts are added up over all partitions."""
    rand = np.random.default_rng(SEED)
    texts = documents.filter(training(F.col("doc_id"))).select("doc_id", "text")
    few = texts.filter(F.octet_length("text") <= START_LENGTH).orderBy(F.xxhash64("doc_id", "text")).limit(START_TEXTS)
    lists = [np.array(r[0], np.int64) for r in few.mapInArrow(_as_classes(words), "classes array<int>").collect()]
    move = STAY * np.eye(STATES) + (1 - STAY) / STATES
    emit = np.zeros((len(words.shares), STATES))
    for classes in lists:  # each text begins mostly in one state
        np.add.at(emit, (classes, rand.integers(STATES)), 1.0)
    model = _from_counts(np.ones(STATES), move * len(lists), emit, words.shares)
    for _ in range(START_PASSES if lists else 0):
        counts = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(emit)
        for _, group in side_by_side(lists):
            forward_backward(model, group, counts)
        model = _from_counts(*counts, words.shares)
    shape = "kind int, row int, " + ", ".join(f"n{s} double" for s in range(STATES))
    for _ in range(PASSES if words.texts else 0):
        found = texts.select("text").mapInArrow(_expected(words, model), shape).groupBy("kind", "row").agg(*(F.sum(f"n{s}").alias(f"n{s}") for s in range(STATES))).toArrow()
        kind, row = found.column("kind").to_numpy(), found.column("row").to_numpy()
        table = np.stack([found.column(f"n{s}").to_numpy() for s in range(STATES)], axis=1)
        counts = np.zeros((1, STATES)), np.zeros((STATES, STATES)), np.zeros_like(emit)
        for i, into in enumerate(counts):
            into[row[kind == i]] = table[kind == i]
        model = _from_counts(counts[0][0], counts[1], counts[2], words.shares)
        common.release(documents.sparkSession)
    return model


def _score(words: Words, model: Model):
    """Per text: tokens, and, without the words outside the head, known tokens and both scores; and those words."""
    read = _class_lists(words)
    head = words.base(words.counts)
    kinds = words.classes()
    inside = np.zeros(len(words.counts))
    far = kinds >= OWN
    inside[far] = np.log10((words.counts[far] + ADD) / words.mass[kinds[far] - OWN])
    end = float(words.base(np.array(words.texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.select([0, 1])
            waiting: list[tuple] = []
            done = size = 0

            def settle():
                likelihood = np.zeros(len(waiting))
                for at, texts in side_by_side([w[0] for w in waiting]):
                    likelihood[at] = forward_backward(model, texts)
                model_score = likelihood / np.log(10) + [w[3] for w in waiting]
                columns = [*ids.slice(done, len(waiting)).columns, pa.array([len(w[0]) for w in waiting], pa.int64()), pa.array([w[1] for w in waiting], pa.int64())]
                columns += [pa.array([w[2] for w in waiting], pa.float64()), pa.array(model_score, pa.float64()), pa.array([w[4] for w in waiting], pa.list_(pa.binary()))]
                return pa.RecordBatch.from_arrays(columns, [*ids.schema.names, "n_tokens", "n_known", "base_score", "score", "rare"])

            for classes, rank, rare in read(batch):
                near = rank[rank >= 0]
                waiting.append((classes, len(near) + (words.texts > 0), float(head[near].sum()) + end, float(inside[near].sum()), rare))
                size += len(classes)
                if size > GATHER:
                    yield settle()
                    done, size = done + len(waiting), 0
                    waiting = []
            if waiting:
                yield settle()

    return run


def score_texts(documents: DataFrame, table: DataFrame, words: Words, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``documents``.

    Null and empty texts are an end alone. Rows may repeat, each is scored; an empty table gives an empty one; further
    columns do not matter. Without any training text every score of the base is 0.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    shape = f"key long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    read = documents.select(common.row_key("doc_id", "text").alias("key"), "doc_id", "text").mapInArrow(_score(words, model), shape)
    scored = common.stored(read)
    rare = scored.select("key", F.explode("rare").alias("word"))
    scale = words.total + ADD * (words.distinct + 1)
    masses = documents.sparkSession.createDataFrame(list(enumerate(words.mass.tolist())), "b long, mass double")
    count = F.coalesce("n", F.lit(0))
    within = F.when(count > 0, count + ADD).otherwise(F.lit(words.unseen)) / F.col("mass")
    met = rare.join(table, "word", "left").withColumn("b", (F.crc32("word") % SHARED)).join(F.broadcast(masses), "b")
    sums = met.groupBy("key").agg(
        F.count_if(count > 0).alias("more_known"), F.sum(F.log10((count + ADD) / F.lit(scale))).alias("more_base"), F.sum(F.log10(within)).alias("more_score")
    )
    rows = scored.groupBy("key", "doc_id").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    # The words of equal rows were added up together; each row has its share of the sums.
    joined = rows.join(sums, "key", "left")
    part = lambda c: F.coalesce(F.col(c) / F.col("rows"), F.lit(0.0))
    return joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        "doc_id",
        (~training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + part("more_known")).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + part("more_base")).alias("base_score"),
        (F.col("score") + part("more_score")).alias("score"),
    )


def op6_hmm_scores(spark, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    table, words = count_words(documents)
    return score_texts(documents, table, words, train(documents, words))


QUERIES = {"op6_hmm_scores": op6_hmm_scores}
ORACLES: dict[str, str] = {}
