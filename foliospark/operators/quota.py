"""Rolling quotas: at most 20 accepted requests in 24 hours and 10 seconds between accepted ones.

Only accepted requests count, so each decision depends on the earlier ones of the same user, and one user may
send a third of all requests. What makes it parallel: after an accepted request nothing can be accepted before
a known moment, the later of "last + 10 s" and "20th last + 24 h". So the accepted requests are a chain, each
one the first request at or after that moment, and almost no request takes part in it.

* Per (user, slot of 10 s) only the first request is a candidate. That is a grouped minimum, and the number of
  candidates depends on time, not on traffic.
* The chain is walked over the candidates, then each step is checked against all requests in the 10 seconds
  after its moment. Where a request was passed over, it becomes a candidate, and with it requests around every
  moment of that user, close ones densely and far ones sparsely; then the walk is repeated. When no step passes
  over anything, the chain is exact.
* Every other request is refused; the accepted one before it tells by which rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark import schemas as S
from foliospark.operators.ranking import record_batch, running_sum
from foliospark.session import cut_lineage

SECOND = 1_000_000
HOUR = 3600 * SECOND
CELLS_PER_OCTAVE = 64
OPEN_END = 2**62
STEP = pa.schema([(c, pa.int64()) for c in ("user_id", "at_us", "event_id", "not_before", "day_block", "next_us", "next_event")])
STEP_DDL = ", ".join(f"{name} long" for name in STEP.names)


def _walker(limit: int, window: int, spacing: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of each user in order; holds the last ``limit`` accepted times of one user.

        An accepted row says from which moment it was allowed, until when the day rule blocks after it, and
        which accepted request follows. The row with a null event is the user's last, still open moment.
        """
        user_now, recent, moment, last = None, [], 0, None

        def closed(next_us, next_event):
            return [(*last, next_us, next_event)] if last else []

        def tail():
            open_step = (user_now, OPEN_END, None, moment, 0, OPEN_END, OPEN_END)
            return closed(OPEN_END, OPEN_END) + [open_step] if last else []

        for batch in batches:
            out = []
            for user, at, event in zip(*(batch.column(c).to_pylist() for c in ("user_id", "at_us", "event_id"))):
                if user != user_now:
                    out += tail()
                    user_now, recent, moment, last = user, [], at, None
                if at < moment:
                    continue
                out += closed(at, event)
                recent = (recent + [at])[-limit:]
                block = recent[0] + window if len(recent) == limit else 0
                last = (user, at, event, moment, block)
                moment = max(at + spacing, block)
            yield record_batch(out, STEP)
        yield record_batch(tail(), STEP)

    return walk


def accepted_chain(
    requests: DataFrame,
    limit: int = S.DAILY_LIMIT,
    window_seconds: int = S.DAY_SECONDS,
    spacing_seconds: int = S.SPACING_SECONDS,
) -> DataFrame:
    """The accepted requests with the moments around them. ``requests``: user_id, at_us, event_id."""
    spacing, window = spacing_seconds * SECOND, window_seconds * SECOND
    slot = spacing
    slotted = requests.select("user_id", "at_us", "event_id", F.floor(F.col("at_us") / slot).alias("slot"))
    firsts = slotted.groupBy("user_id", "slot").agg(F.min(F.struct("at_us", "event_id")).alias("first"))
    candidates = firsts.select("user_id", "first.at_us", "first.event_id")
    walk = _walker(limit, window, spacing)
    while True:
        chain = cut_lineage(
            candidates.repartition("user_id")
            .sortWithinPartitions("user_id", "at_us", "event_id")
            .mapInArrow(walk, STEP_DDL)
        )
        first_slot = F.floor(F.col("from_us") / slot)
        probes = chain.select(
            "user_id",
            F.col("not_before").alias("from_us"),
            F.struct("at_us", F.coalesce("event_id", F.lit(OPEN_END)).alias("event_id")).alias("taken"),
        ).withColumn("slot", F.explode(F.array(first_slot - 1, first_slot, first_slot + 1)))
        behind = F.col("at_us") - F.col("from_us")
        near = slotted.join(probes, ["user_id", "slot"]).where(F.abs(behind) < slot)
        request = F.struct("at_us", "event_id")
        missing = cut_lineage(
            near.where(behind >= 0)
            .groupBy("user_id", "from_us", "taken")
            .agg(F.min(request).alias("first"))
            .where(F.col("first") < F.col("taken"))
            .select("user_id")
            .distinct()
        )
        if missing.isEmpty():
            return chain.where(F.col("event_id").isNotNull())
        # A passed-over request makes all later moments of the user come too late, so the right ones lie before them.
        distance = F.floor(F.log2(F.abs(behind) + 1) * CELLS_PER_OCTAVE)
        finer = (
            near.join(missing, "user_id", "left_semi")
            .groupBy("user_id", "from_us", (behind >= 0).alias("ahead"), distance.alias("cell"))
            .agg(F.min(request).alias("first"))
            .select("user_id", "first.at_us", "first.event_id")
        )
        candidates = cut_lineage(candidates.unionByName(finer).distinct())


def decide_requests(
    requests: DataFrame,
    limit: int = S.DAILY_LIMIT,
    window_seconds: int = S.DAY_SECONDS,
    spacing_seconds: int = S.SPACING_SECONDS,
) -> DataFrame:
    """Each request with its decision: accepted, AI_DAILY_LIMIT or AI_RATE_LIMIT.

    Requests meet the accepted one before them in an equi join on (user, hour) with a range condition, so the
    requests of a busy user are spread by time.
    """
    chain = accepted_chain(requests, limit, window_seconds, spacing_seconds)
    until = requests.groupBy("user_id").agg(F.max("at_us").alias("until_us"))
    last_hour = F.floor(F.least("next_us", "until_us") / HOUR)
    spans = chain.join(until, "user_id").select(
        "user_id",
        F.struct("at_us", "event_id").alias("taken"),
        F.struct(F.col("next_us").alias("at_us"), F.col("next_event").alias("event_id")).alias("next"),
        "day_block",
        F.explode(F.sequence(F.floor(F.col("at_us") / HOUR), last_hour)).alias("hour"),
    )
    placed = requests.select("user_id", "at_us", "event_id", F.floor(F.col("at_us") / HOUR).alias("hour"))
    request = F.struct("at_us", "event_id")
    decision = (
        F.when(request == F.col("taken"), "accepted")
        .when(F.col("at_us") < F.col("day_block"), "AI_DAILY_LIMIT")
        .otherwise("AI_RATE_LIMIT")
    )
    # Spark sizes the exploded hours by the rows before them, so it must not choose to broadcast them.
    return (
        placed.join(spans.hint("merge"), ["user_id", "hour"])
        .where((request >= F.col("taken")) & (request < F.col("next")))
        .select("user_id", "event_id", "at_us", decision.alias("decision"))
    )


def attempt_rates(requests: DataFrame, windows_seconds: dict[str, int]) -> DataFrame:
    """Earlier attempts of the same user inside each window, not counting one exactly a window old.

    A count in a window is the difference of two running counts, so no window ever holds a user's rows.
    """

    def point(at: Column, side: int, mark: str, one: int) -> Column:
        return F.struct(at.alias("at"), F.lit(side).alias("side"), F.lit(mark).alias("mark"), F.lit(one).alias("one"))

    # At one moment: what was seen before it, then the attempts, then what a window starting here leaves out.
    marks = [point(F.col("at_us"), 0, "now", 0), point(F.col("at_us"), 1, "event", 1)]
    marks += [point(F.col("at_us") - seconds * SECOND, 2, name, 0) for name, seconds in windows_seconds.items()]
    points = requests.select("user_id", "event_id", F.explode(F.array(*marks)).alias("p")).select(
        "user_id", "event_id", "p.*"
    )
    order = [F.col("at"), F.col("side"), F.col("event_id"), F.col("mark")]
    counted = running_sum(points, ["user_id"], order, "one", "seen")

    def seen(mark: str) -> Column:
        return F.max(F.when(F.col("mark") == mark, F.col("seen")))

    return counted.groupBy("user_id", "event_id").agg(
        *[(seen("now") - seen(name)).cast("long").alias(name) for name in windows_seconds]
    )
