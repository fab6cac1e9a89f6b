"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

Two fingerprints that differ in at most t bits must, for any partition of the bits and any thresholds with
sum(threshold + 1) = t + 1, differ in at most threshold[i] bits of some part i. Bits that go together are put into one
part, and the thresholds are dealt out by dynamic programming on the candidates expected from each choice. A part with
threshold r is probed by one signature for each choice of r bits to ignore.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm import common
from foliospark.llm.components import connected_components

BITS = 64
WORDS = 4
SEED = 42
DISTANCE = 4
#: Fingerprints compared with one another in one go; a larger bucket is dealt out in pairs of blocks.
BLOCK = 2048
#: Shingles hashed before their bits are added up.
CHUNK = 1 << 16
#: What making and shuffling one signature costs, in comparisons of two fingerprints.
SIGNATURE_COST = 200.0


def fingerprint(text: str | bytes | None, size: int = WORDS, seed: int = SEED) -> int:
    """Bit b is set if it is set in more than half of the shingles' hashes; 0 without words."""
    if not text:
        return 0
    words = (text.encode() if isinstance(text, str) else bytes(text)).lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), CHUNK):
        pairs = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], seed) for a, b in pairs], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts = common.byte_rows(batch.column("text"))
        data, at = raw.tobytes(), starts.tolist()
        found = np.array([fingerprint(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*batch.schema.names[1:], "fingerprint"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bits are both set."""
    sums = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        values = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
        for at in range(0, len(values), CHUNK):
            bits = np.unpackbits(values[at : at + CHUNK], axis=1, bitorder="little").astype(np.float32)
            sums += (bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums.ravel())], ["i", "j", "n"])


def bit_groups(joint: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of near-equal size, correlated bits together: closest pairs merge while they fit."""
    share = np.diag(joint) / total
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs(joint / total - np.outer(share, share)) / np.outer(spread, spread)
    room = -(-BITS // parts)
    group = {b: [b] for b in range(BITS)}
    of = list(range(BITS))
    order = np.dstack(np.unravel_index(np.argsort(-strength, axis=None, kind="stable"), strength.shape))[0]
    for a, b in order:
        x, y = of[a], of[b]
        if x != y and len(group[x]) + len(group[y]) <= room:
            group[x] += group.pop(y)
            for bit in group[x]:
                of[bit] = x
    line = [bit for cluster in sorted(group.values(), key=lambda c: (-len(c), c)) for bit in cluster]
    return [sorted(map(int, part)) for part in np.array_split(line, parts)]


def expected_candidates(joint: np.ndarray, total: int, group: list[int], most: int) -> list[float]:
    """Pairs that share a signature of the group, for each threshold from 0 to ``most``.

    The chance that two rows agree in a bit is taken given that they agree in the bit before it that it goes with most.
    """
    share = np.diag(joint) / total
    agree = share**2 + (1 - share) ** 2
    chances = []
    for k, b in enumerate(group):
        best = agree[b]
        for a in group[:k]:
            both, only_a, only_b = joint[a, b] / total, (joint[a, a] - joint[a, b]) / total, (joint[b, b] - joint[a, b]) / total
            pair = both**2 + only_a**2 + only_b**2 + (1 - both - only_a - only_b) ** 2
            best = max(best, min(1.0, pair / max(agree[a], 1e-12)))
        chances.append(best)
    out = []
    # ways[r]: sum, over the choices of r ignored bits, of the chance to agree in all others.
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for p in chances:
        ways = ways * p + np.append(0.0, ways[:-1])
    for r in range(most + 1):
        out.append(float(ways[r]) * total * (total - 1) / 2 if r < len(group) else np.inf)
    return out


def allocate(joint: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds, of least expected cost; a group with threshold -1 is not probed."""
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for parts in range(1, distance + 2):
        groups = bit_groups(joint, total, parts)
        # cost[s]: least cost of the groups so far with sum(threshold + 1) = s.
        cost: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (distance + 1)
        for group in groups:
            pairs = expected_candidates(joint, total, group, distance)
            price = [0.0] + [total * comb(len(group), r) * SIGNATURE_COST + pairs[r] for r in range(distance + 1)]
            cost = [
                min(((cost[s - r][0] + price[r], [*cost[s - r][1], r - 1]) for r in range(s + 1)), key=lambda x: x[0])
                for s in range(distance + 2)
            ]
        if cost[-1][0] < best[0]:
            best = cost[-1][0], list(zip(groups, cost[-1][1], strict=True))
    return best[1]


def signature_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """For each signature the bits that it looks at, as a signed 64-bit number."""
    masks = []
    for group, threshold in plan:
        for ignored in combinations(group, threshold) if threshold >= 0 else ():
            mask = sum(1 << b for b in set(group) - set(ignored))
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


class Forest:
    """Disjoint sets over the rows of one task: which links join two sets that were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def linked(values: np.ndarray) -> list[tuple[int, int]]:
            out = []
            bits = values.view(np.uint64)
            # Values of one set have one label, so a dense group costs a look at each row, not at each pair.
            label = np.array([forest.find(v) for v in values.tolist()], np.int64)
            for i in range(0, len(bits), 256):
                near = np.bitwise_count(bits[i : i + 256, None] ^ bits[None, i:]) <= distance
                for r, row in enumerate(near):
                    mine = label[i + r]
                    apart = label[i:][row]
                    for other in np.unique(apart[apart != mine]):
                        at = i + int(np.argmax(row & (label[i:] == other)))
                        out.append((int(values[i + r]), int(values[at])))
                        forest.join(*out[-1])
                        label[label == other] = mine
            return out

        def packed(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        key, rest = None, np.zeros(0, np.int64)
        for batch in batches:
            group, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            pairs = []
            for k, part in zip(group[np.append(0, cuts)].tolist(), np.split(values, cuts), strict=True) if len(group) else ():
                if k != key:
                    pairs += linked(rest)
                    key, rest = k, part
                else:
                    rest = np.concatenate([rest, part])
            if pairs:
                yield packed(pairs)
        if pairs := linked(rest):
            yield packed(pairs)

    return run


def links(values: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all ``values`` (fingerprint long, distinct) within ``distance`` bits of one another.

    Every pair of a bucket is compared, but only a link that joins two groups still apart in its task is returned, so
    the result is no longer than the signatures. A bucket of more than ``block`` values is dealt out in blocks, every
    two of which meet in a group of their own.
    """
    counted = values.mapInArrow(_together, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    joint = np.zeros((BITS, BITS))
    for i, j, n in counted:
        joint[i, j] = n
    total = values.count()
    if total < 2:
        return values.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)
    masks = signature_masks(allocate(joint, total, distance))
    probes = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)))
    signed = values.select("fingerprint", F.explode(probes).alias("p")).select(
        F.xxhash64(F.col("p.part"), F.col("fingerprint").bitwiseAND(F.col("p.mask"))).alias("bucket"), "fingerprint"
    )
    sizes = common.stored(signed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    met = signed.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.withColumn("mine", mine).withColumn("other", other).select(
        F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("meeting"), "fingerprint"
    )
    dealt = common.stored(dealt)
    return dealt.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_links(distance), "a long, b long")


def near_groups(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (least doc_id of all rows that links lead to) of each row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with equal fingerprints are linked.
    A null doc_id never names a component unless the component has no other. Rows may repeat; an empty table gives an
    empty one.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    marked = common.stored(documents.select("text", "doc_id").mapInArrow(_fingerprints, f"doc_id {kind}, fingerprint long"))
    placed = fingerprint_roots(marked, F.min("doc_id").alias("least"), distance)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    components = common.stored(placed.join(named, "root").select("fingerprint", "component_id"))
    return marked.join(components, "fingerprint").select("doc_id", "fingerprint", "component_id")


def fingerprint_roots(marked: DataFrame, least: Column, distance: int = DISTANCE) -> DataFrame:
    """fingerprint, least (an aggregate over its rows) and root: one fingerprint of the group that links lead to."""
    values = common.stored(marked.groupBy("fingerprint").agg(least))
    roots = connected_components(links(values.select("fingerprint"), distance))
    placed = values.join(roots, F.col("fingerprint") == F.col("node"), "left")
    return common.stored(placed.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id, of equal ones the one with the least content.

    Rows that are equal in every column are one document. Groups are told apart by their fingerprints, not by doc_ids, so
    unlike rows that share a doc_id both stay. Documents without words share a fingerprint, so one stays; a document without
    an id comes behind all others of its group.
    """
    key = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    names = [f"_{i}" for i in range(len(docs.columns))]
    numbered = docs.select(key.alias("_key"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = common.stored(docs.select("text", "doc_id", key.alias("_key")).mapInArrow(_fingerprints, f"doc_id {kind}, _key long, fingerprint long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    placed = fingerprint_roots(marked, F.min(order).alias("least"))
    first = common.stored(placed.groupBy("root").agg(F.min("least").alias("least")).select("least._key"))
    kept = numbered.join(first, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(common.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLES: dict[str, str] = {}
