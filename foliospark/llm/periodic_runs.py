"""Periodic runs of words: stretches that repeat a short sequence of words three times or more.

A run with period p is a maximal stretch whose words agree with those p further on. Two words agree over such a stretch as
far as the longest common extension (LCE) of their places to the right and to the left says, so a run is found from any one place
in it. For each period only places on a grid are asked, spaced so that no run long enough can fall between two of them; over all
periods that is a harmonic sum, n log n places for n words.

The LCE of two places is found from a difference cover: a set of places such that any two distances apart can be shifted by
the same few words onto it. Only suffixes that begin on the cover are sorted, by prefix doubling over blocks of the cover's
length. A query compares the few words up to the shift, then takes the least common prefix between two ranks of the sorted
suffixes from a sparse table.

Texts are independent of each other, so there is no shuffle. Short texts are taken together, with words between them that occur
nowhere else; a long text is taken alone, and needs about 150 bytes of memory per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm import common

SHORTEST = 24
#: Times that a run has its period at least.
REPEATS = 3
#: Bytes of texts taken together.
SLICE = 1 << 20
#: Places asked at once.
BLOCK = 1 << 20

# A perfect difference set, every distance modulo 31 is the difference of two of its elements.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _shifts() -> np.ndarray:
    """The least shift that brings two residues onto the cover."""
    on = np.isin(np.arange(PERIOD), COVER)
    both = [np.roll(on, -d)[:, None] & np.roll(on, -d)[None, :] for d in range(PERIOD)]
    return np.argmax(np.stack(both), axis=0)


class Extensions:
    """Longest common extensions to the right in a sequence of whole numbers from 1 whose last one occurs once."""

    SHIFTS = _shifts()

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, np.zeros(2 * PERIOD, words.dtype)])
        cover = np.array(COVER)
        blocks = -(-len(words) // PERIOD)
        places = (np.arange(blocks)[:, None] * PERIOD + cover).ravel()
        places = places[places < len(words)]
        # Number of a place on the cover: that of its block, then that inside the block.
        self.inside = np.full(PERIOD, -1)
        self.inside[cover] = np.arange(len(cover))
        self.m = m = len(places)
        heads = np.lib.stride_tricks.sliding_window_view(self.words, PERIOD)[places].astype(">u4")
        _, rank = np.unique(np.ascontiguousarray(heads).view(np.dtype((np.void, 4 * PERIOD))).ravel(), return_inverse=True)
        del heads
        ranks, step = [rank.ravel()], len(cover)
        while m and ranks[-1].max() < m - 1:
            after = np.zeros(m, np.int64)
            after[: max(m - step, 0)] = ranks[-1][step:] + 1
            ranks.append(np.unique(ranks[-1] * (m + 1) + after, return_inverse=True)[1].ravel())
            step *= 2
        self.rank = ranks[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        self.table = [self._neighbours(order, ranks, places)]
        width = 1
        while 2 * width < m:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _neighbours(self, order: np.ndarray, ranks: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Words that suffixes next to each other in the order have in common, block by block from the longest."""
        a, b = order[:-1].copy(), order[1:].copy()
        common_words = np.zeros(len(a), np.int64)
        step = len(COVER) << (len(ranks) - 1)
        for rank in reversed(ranks):
            some = np.flatnonzero((a < self.m) & (b < self.m))
            some = some[rank[a[some]] == rank[b[some]]]
            a[some] += step
            b[some] += step
            common_words[some] += step // len(COVER) * PERIOD
            step //= 2
        left, right = places[order[:-1]] + common_words, places[order[1:]] + common_words
        return (common_words + self._compare(left, right, np.full(len(left), PERIOD))).astype(np.int32)

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from two places on, ``most`` at most, one by one."""
        out = np.zeros(len(a), np.int64)
        on = np.flatnonzero(most > 0)
        for k in range(PERIOD):
            on = on[self.words[a[on] + k] == self.words[b[on] + k]]
            if not len(on):
                break
            out[on] += 1
            on = on[most[on] > k + 1]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shift = self.SHIFTS[a % PERIOD, b % PERIOD]
        out = self._compare(a, b, shift)
        far = np.flatnonzero(out == shift)
        if len(far):
            x, y = a[far] + shift[far], b[far] + shift[far]
            x, y = (self.rank[p // PERIOD * len(COVER) + self.inside[p % PERIOD]] for p in (x, y))
            x, y = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            found = np.empty(len(far), np.int64)
            for k in np.unique(level):
                some = level == k
                found[some] = np.minimum(self.table[k][x[some]], self.table[k][y[some] - (1 << k)])
            out[far] += found
        return out


def _grid(begins: np.ndarray, sizes: np.ndarray, shortest: int, repeats: int):
    """Blocks of (place, period) to ask: any window of agreeing places that a run has at least holds one of them."""
    most = np.where(sizes >= shortest, sizes // repeats, 0)
    period, text = common.expand(np.ones(len(sizes), np.int64), most)
    step = np.maximum((repeats - 1) * period, shortest - period)
    count = -(-(sizes[text] - period) // step)
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        past = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")), at + 1)
        place, one = common.expand(np.zeros(past - at, np.int64), count[at:past])
        yield begins[text[at:past]][one] + place * step[at:past][one], period[at:past][one], text[at:past][one]
        at = past


def _near(words: np.ndarray, place: np.ndarray, period: np.ndarray, least: int) -> np.ndarray:
    """Of places that agree with the one a period on, those that have ``least`` agreeing neighbours or more, by comparing few words."""
    on = np.flatnonzero(words[place] == words[place + period])
    found = np.ones(len(on), np.int64)
    for way in (1, -1):
        some = np.arange(len(on))
        for k in range(1, least):
            p = place[on[some]] + way * k
            some = some[words[p] == words[p + period[on[some]]]]
            if not len(some):
                break
            found[some] += 1
    return on[found >= least]


def _laid_out(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each between words of its own, and where each begins."""
    begins = np.cumsum(sizes) - sizes + np.arange(len(sizes)) + 1
    words = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    words[np.append(begins - 1, len(words) - 1)] = codes.max(initial=0) + 2 + np.arange(len(sizes) + 1)
    place, _ = common.expand(begins, sizes)
    words[place] = codes + 1
    return words, begins


def find_runs(codes: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> tuple[np.ndarray, ...]:
    """All runs of texts laid end to end (numbers of their words, words per text): text, start, length, period.

    Ordered by text, start and period; starts count from the text's first word.
    """
    # The least window of agreeing places of a run, over all periods.
    least = min(max((repeats - 1) * p, shortest - p) for p in range(1, shortest + 1))
    words, begins = _laid_out(codes, sizes)
    hit = np.zeros(len(sizes), bool)
    for place, period, text in _grid(begins, sizes, shortest, repeats):
        hit[text[_near(words, place, period, least)]] = True
    chosen = np.flatnonzero(hit)
    if not len(chosen):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # Only texts with such a window are sorted.
    first = np.cumsum(sizes) - sizes
    where, _ = common.expand(first[chosen], sizes[chosen])
    words, begins = _laid_out(codes[where], sizes[chosen])
    after, before = Extensions(words), Extensions(words[::-1].copy())
    found = []
    for place, period, text in _grid(begins, sizes[chosen], shortest, repeats):
        some = _near(words, place, period, least)
        place, period, text = place[some], period[some], text[some]
        if not len(some):
            continue
        start = place - before(len(words) - place, len(words) - place - period)
        end = place + period + after(place, place + period)
        good = end - start >= np.maximum(shortest, repeats * period)
        found.append(_least_periods(start[good], end[good], period[good], text[good]))
    start, end, period, text = _least_periods(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else [np.zeros(0, np.int64)] * 4
    start, end = start - begins[text], end - begins[text]
    order = np.lexsort((period, start, text))
    return chosen[text][order], start[order], (end - start)[order], period[order]


def _least_periods(start, end, period, text):
    """Each stretch once, with its least period: a multiple of a run's period gives the same stretch."""
    order = np.lexsort((period, end, start))
    start, end, period, text = (x[order] for x in (start, end, period, text))
    new = np.ones(len(order), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new], text[new]


def _collapsed(raw: np.ndarray, first: np.ndarray, past: np.ndarray, sizes: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by spaces."""
    text = np.repeat(np.arange(len(sizes)), sizes)[kept]
    length = past[kept] - first[kept] + 1
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    length = length - last
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    width = past[kept] - first[kept]
    # Slice by slice, so that memory besides the result stays small for a long text too.
    at = 0
    while at < len(width):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")), at + 1)
        source, _ = common.expand(first[kept][at:stop], width[at:stop])
        target, _ = common.expand((ends - length)[at:stop], width[at:stop])
        out[target] = raw[source]
        at = stop
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, weights=length, minlength=len(sizes)))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _scan(shortest: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = common.byte_rows(batch.column(1))
            for a, b in common.row_groups(starts, SLICE):
                part = raw[starts[a] : starts[b]]
                begins = starts[a : b + 1] - starts[a]
                word = ~_SPACE[part]
                first, past = common.word_spans(word, begins[:-1])
                codes, _ = common.encode_words(part, word, past - first)
                sizes = np.diff(np.searchsorted(first, begins)).astype(np.int64)
                text, start, length, period = find_runs(codes, sizes, shortest, repeats)
                cover = np.zeros(len(codes) + 1, np.int64)
                base = (np.cumsum(sizes) - sizes)[text] + start
                np.add.at(cover, base + period, 1)
                np.add.at(cover, base + length, -1)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                offsets = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                columns = [batch.column(0).slice(a, b - a), pa.array(sizes), pa.ListArray.from_arrays(offsets, runs), _collapsed(part, first, past, sizes, kept).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, text: Column, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of each row.

    A run is a stretch of at least ``shortest`` words and ``repeats`` times its smallest period, in which words a period apart
    are the same and which no neighbouring word extends. ``collapsed`` has the words that no run holds after that run's first
    period, joined by one space. Words are what stands between white space (space, tab, line ends). A null or empty text has
    no words, no runs and an empty ``collapsed``; repeated rows are each judged alone; other columns are not
    read. An empty table gives an empty one. The whole text is looked at, whatever its length.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text.alias("text"))
    return rows.mapInArrow(_scan(shortest, repeats), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped_text(text: Column, doc_id: Column) -> Column:
    """The text, or for about a tenth of all doc_ids one whose words from some place on repeat with some period.

    A null doc_id leaves the text as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, made).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(common.table(spark, sf_dir, "documents"), looped_text(F.col("text"), F.col("doc_id")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    # Two different fractions of numbers below 2^25 differ as doubles too, and equal ones agree.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r.length / r.period).alias("x"), (-r.start).alias("start"), (-r.period).alias("period"), r.length.alias("length"))))
    found = found.select("doc_id", "runs", "collapsed", lines.alias("lines"), best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor((1000 * length - (1000 * length) % period) / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
