"""Removal of byte strings that occur more than once in a corpus, by distributed prefix doubling.

Prefix doubling ranks every position by its first h bytes, then sorts pairs of ranks to rank it by more, until its rank
is unique or the length asked for is reached. Three things make it fit a cluster:

* Ranks are content fingerprints, so two positions anywhere have the same rank exactly if their bytes agree, and the
  rank at an offset is read from the text at hand instead of fetched by a join on positions.
* Positions are ranked in classes. Every window of T bytes is put down to the least G-gram in it (the leftmost of least
  fingerprint), so equal windows have equal grams at the same place. The pair sorted is (rank of the shared core, rank
  of the whole string that the class's windows cover).
* Only what is undecided goes on. A core that occurs once ends the search for all its windows. Equal whole strings
  decide all their windows at once. Of the rest, one position per different string goes to the next length.

Lengths grow from G to T - 7 (runs of eight windows) to T (single windows), which is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliospark.llm import common

#: Length in bytes from which a repeated string is removed.
THRESHOLD = 200
#: Length of the grams that positions are sampled by.
GRAM = 32
#: Windows per class on the second length.
RUN = 8
#: Bytes handled at once inside a task.
SLICE = 1 << 18
MASK24 = np.uint64((1 << 24) - 1)

#: Row, first window, number of windows, place of the gram after the first window, rank of the core, rank of the whole.
CLASSES = "key long, s int, l int, o int, g long, c long"
RUNS = "key long, s int, l int, o int, parent int, g long, c long"


def sample_windows(prints: common.Fingerprints, raw: np.ndarray, begins: np.ndarray, threshold: int, gram: int):
    """All windows of one slice in classes: row, first window, number of windows, place of the gram, both ranks."""
    if len(raw) < threshold:
        return None
    sums = [prints.sums(raw, 0), prints.sums(raw, 1)]
    at = np.arange(len(raw) - gram + 1)
    grams = prints.of(sums[0], 0, at, at + gram)
    least = common.sliding_min((grams & ~MASK24) | at.astype(np.uint64), threshold - gram + 1)
    chosen = (least & MASK24).astype(np.int64)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    whole = np.flatnonzero(row[: len(chosen)] == row[threshold - 1 :])
    if not len(whole):
        return None
    chosen, row = chosen[whole], row[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:] - 1, len(whole) - 1)
    first, last, gram_at = whole[head], whole[tail], chosen[head]
    context = prints.of(sums[1], 1, first, last + threshold)
    span = (gram_at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    return row[head], first, last - first + 1, gram_at - first, grams[gram_at], prints.scramble(context ^ prints.scramble(span))


def split_windows(prints: common.Fingerprints, raw: np.ndarray, begins: np.ndarray, count: np.ndarray, place: np.ndarray, threshold: int, run: int):
    """The windows of undecided classes in runs that are aligned with the gram: class, first, number, place, ranks."""
    sums = [prints.sums(raw, 0), prints.sums(raw, 1)]
    low = np.floor_divide(-place, run)
    block, owner = common.expand(low, np.floor_divide(count - 1 - place, run) - low + 1)
    origin = block * run + place[owner]
    first = np.maximum(origin, 0)
    past = np.minimum(origin + run, count[owner])
    base = begins[:-1][owner]
    core = prints.of(sums[0], 0, base + origin + run - 1, base + origin + threshold)
    covered = prints.of(sums[1], 1, base + first, base + past - 1 + threshold)
    span = (first - origin).astype(np.uint64) << np.uint64(32) | (past - first).astype(np.uint64)
    return owner, first, past - first, place[owner] - first, core, prints.scramble(covered ^ prints.scramble(span))


def _sampler(threshold: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = common.Fingerprints(SLICE + 2 * threshold)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            raw, starts = common.byte_rows(batch.column(1))
            for low, high, begin, end in common.slices(starts, SLICE, threshold - 1):
                begins = np.clip(starts[low : high + 1], begin, end) - begin
                found = sample_windows(prints, raw[begin:end], begins, threshold, gram)
                if found is None:
                    continue
                row, first, count, place, core, whole = found
                s = first + begin - starts[low + row]
                columns = [keys[low + row], *(x.astype(np.int32) for x in (s, count, place)), core.view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "s", "l", "o", "g", "c"])

    return run


def _splitter(threshold: int, run_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = common.Fingerprints(SLICE + 2 * threshold)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            s, l, o = (batch.column(x).to_numpy().astype(np.int64) for x in "slo")
            raw, starts = common.byte_rows(batch.column("piece"))
            # A piece is at most two thresholds long, so none is ever cut.
            for low, high, begin, end in common.slices(starts, SLICE, 0):
                at = slice(low, high)
                owner, first, count, place, core, whole = split_windows(
                    prints, raw[begin:end], starts[low : high + 1] - begin, l[at], o[at], threshold, run_length
                )
                columns = [keys[at][owner], *(x.astype(np.int32) for x in (s[at][owner] + first, count, place, s[at][owner])), core.view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "s", "l", "o", "parent", "g", "c"])

    return run


def _decide(classes: DataFrame, extra: list[str], threshold: int) -> tuple[DataFrame, DataFrame]:
    """Repeated byte ranges among the classes, and one class per different string where a core is still shared.

    The sides of each join are stored tables, so that Spark can split the rows of a core that a large part has.
    """
    shared = common.stored(classes.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    alive = common.stored(classes.join(shared, "g"))
    common.discard(classes, shared)
    strings = common.stored(
        alive.groupBy("g", "c").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("key", "s", "l", "o", *extra)))
    )
    equal = strings.filter("n > 1").select("g", "c")
    found = common.stored(alive.join(equal, ["g", "c"]).select("key", "s", (F.col("s") + F.col("l") - 1 + threshold).alias("e")))
    several = common.stored(strings.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    undecided = common.stored(strings.join(several, "g").select("key", "s", "l", "o", *extra))
    common.discard(alive, strings, several)
    return found, undecided


def repeated_ranges(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Byte ranges [s, e) of ``rows`` (key long, text) that lie in a string of ``threshold`` bytes found elsewhere too.

    Ranges of one key may overlap. Two rows with one key must be equal; then each is a repeat of the other.
    """
    gram = min(GRAM, threshold)
    windows = rows.select("key", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= threshold)
    classes = common.stored(windows.mapInArrow(_sampler(threshold, gram), CLASSES))
    whole, undecided = _decide(classes, [], threshold)
    piece = F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("l") + threshold - 1)
    pieces = common.stored(undecided.join(windows, "key").select("key", "s", "l", "o", piece.alias("piece")))
    runs = common.stored(pieces.mapInArrow(_splitter(threshold, min(RUN, threshold)), RUNS))
    in_runs, open_runs = _decide(runs, ["parent"], threshold)
    parents = pieces.select("key", F.col("s").alias("parent"), "piece")
    inner = F.substring("piece", F.col("s") - F.col("parent") + 1, F.col("l") + threshold - 1)
    narrow = open_runs.join(parents, ["key", "parent"]).select("key", "s", "l", "o", inner.alias("piece"))
    single = common.stored(narrow.mapInArrow(_splitter(threshold, 1), RUNS))
    common.discard(undecided, open_runs, pieces)
    equal = common.stored(single.groupBy("g", "c").agg(F.count("*").alias("n")).filter("n > 1").select("g", "c"))
    last = single.join(equal, ["g", "c"]).select("key", "s", (F.col("s") + threshold).alias("e"))
    return reduce(DataFrame.unionByName, (whole, in_runs, last))


def merged(starts: np.ndarray, counts: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [s, e) of rows laid end to end, ``counts`` of them in each, as maximal runs: row, first byte, past-last byte."""
    row = np.repeat(np.arange(len(counts)), counts)
    # One place more between rows keeps their ranges apart.
    first, past = starts[row] + row + s, starts[row] + row + e
    order = np.argsort(first, kind="stable")
    row, first, past = row[order], first[order], np.maximum.accumulate(past[order])
    new = np.ones(len(row), bool)
    new[1:] = first[1:] > past[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row))[: len(head)] - 1
    return row[head], first[head] - row[head], past[tail] - row[head]


def _cutter(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = common.byte_rows(batch.column("text"))
            ranges = batch.column("ranges")
            counts = np.asarray(ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = ranges.flatten()
            row, first, past = merged(starts, counts, flat.field("s").to_numpy(), flat.field("e").to_numpy())
            n = len(starts) - 1
            removed = np.bincount(row, past - first, n).astype(np.int64)
            spans = np.bincount(row, minlength=n)
            data = raw.tobytes()
            cut = [data[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            begin = np.searchsorted(row, np.arange(n + 1))
            for i in np.flatnonzero(spans).tolist():
                own = slice(begin[i], begin[i + 1])
                edges = zip([0, *(past[own] - starts[i]).tolist()], [*(first[own] - starts[i]).tolist(), len(cut[i])], strict=True)
                cut[i] = b"".join([cut[i][a:b] for a, b in edges])
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("text", "ranges")]
            names = [name for name in batch.schema.names if name not in ("text", "ranges")]
            rest += [pa.array(np.diff(starts)), pa.array(removed), pa.array(spans)]
            names += ["n_bytes", "n_removed", "n_spans"]
            if with_text:
                rest.append(pa.array([x.decode("utf-8", "ignore") for x in cut], pa.string()))
                names.append("kept_text")
            else:
                rest.append(pa.array([hashlib.sha256(x).hexdigest() for x in cut], pa.string()))
                names.append("kept_sha256")
            yield pa.RecordBatch.from_arrays(rest, names)

    return run


def remove_repeats(documents: DataFrame, threshold: int = THRESHOLD, with_text: bool = True) -> DataFrame:
    """Each row of ``documents`` (doc_id, text, any others) with every byte cut that a repeated string covers.

    A byte goes if some string of ``threshold`` bytes over it also starts anywhere else, in the same text or another;
    matches never run from one text into the next. All strings are judged on the input. Adds n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_text (bytes of a character cut in two are left out) or, without text,
    kept_sha256 of the exact remaining bytes. With text, the input columns are kept.

    Null texts count as empty and give an empty kept_text; texts shorter than the threshold are never touched. Equal
    rows are repeats of each other, whatever their doc_id. An empty table gives an empty table. Columns named like the
    added ones are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256")
    kept = [c for c in documents.columns if c not in added] if with_text else ["doc_id"]
    # Input columns travel under numbers, so no name of theirs can clash.
    numbered = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)]
    keyed = documents.select(common.row_key("doc_id", "text").alias("key"), F.col("text"), *numbered)
    found = common.stored(
        repeated_ranges(keyed.select("key", "text"), threshold).groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    )
    rows = keyed.join(found, "key", "left").drop("key")
    shape = T.StructType(
        [f for f in rows.schema.fields if f.name not in ("text", "ranges")]
        + [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_text" if with_text else "kept_sha256", T.StringType())]
    )
    out = rows.mapInArrow(_cutter(with_text), shape)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(kept)), *out.columns[len(kept) :])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated strings cut out; no row is dropped, n_chars follows the text."""
    cut = remove_repeats(docs)
    return cut.select(
        *(F.col("kept_text").alias("text") if c == "text" else F.length("kept_text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns)
    )


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
