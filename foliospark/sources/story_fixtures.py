"""Tables for the extensions, derived from the given tables in the same way as the others; ``FIXTURES.md`` lists them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators import mentions, vectors
from foliospark.sources.fixtures import EPOCH_US, Corpus

MINUTE = 60_000_000


def _source(number: Column) -> Column:
    return F.concat(F.lit("src"), number.cast("string"))


def _hot(key: str, value: Column) -> Column:
    """The value 0 for a third of all rows."""
    return F.when(F.col(key) % 3 == 0, 0).otherwise(value).cast("long")


class StoryCorpus(Corpus):
    @cached_property
    def vectors(self) -> DataFrame:
        """A vector of the chapter of its number, in that chapter's project; where there is no such chapter, in one by its number."""
        of = self.chapter_keys.select(F.col("chapter_id").alias("vec_id"), "project_id")
        rows = self.table("embeddings").select("vec_id", "embedding").join(of, "vec_id", "left")
        project = F.coalesce("project_id", _source(F.col("vec_id") % 20))
        return self._kept_rows("vectors", vectors.usable_vectors(rows.withColumn("project_id", project)))

    @cached_property
    def vector_queries(self) -> DataFrame:
        return self.vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")

    @cached_property
    def vector_index(self) -> str:
        return self._kept("vector_index", lambda path: vectors.write_vector_index(self.vectors, path))

    @cached_property
    def story_events(self) -> DataFrame:
        """Told in the order of their ids; when they happen departs from that by up to six hours."""
        told = F.floor((F.col("at_us") - EPOCH_US) / MINUTE)
        return self.events.select("event_id", _source(F.col("event_id") % 20).alias("project_id"), (told + F.col("k") % 7 * 60).alias("story_time"))

    @cached_property
    def statements(self) -> DataFrame:
        """Each event comes before a later one of its project, a few before an earlier one or itself, the last ones of 2,000 before none."""
        event, k = F.col("event_id"), F.col("k")
        target = F.when(k == 50, event).when(k % 29 == 0, event - 20 * (1 + k % 11)).otherwise(event + 20 * (1 + k % 5))
        same = F.floor(F.col("target") / 2000) == F.floor(event / 2000)
        rows = self.events.select("event_id", target.alias("target"))
        return rows.select(event.alias("before"), F.when(same, F.col("target")).alias("after"), _source(event % 20).alias("project_id"))

    @cached_property
    def states(self) -> DataFrame:
        """A state of a character per event; a third of all are the first character's."""
        kind = F.col("event_type")
        state = F.when(kind == "error", "dead").when(kind == "purchase", "missing").when(kind == "view", "asleep").when(kind == "click", "awake").otherwise("alive")
        return self.events.select(
            F.col("event_id").alias("state_id"),
            _hot("event_id", F.col("user_id")).alias("character_id"),
            F.floor((F.col("at_us") - EPOCH_US) / MINUTE).alias("story_time"),
            state.alias("state"),
        )

    @cached_property
    def scenes(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("scene_id"),
            _hot("o_orderkey", F.col("o_custkey") % 150).alias("character_id"),
            (key * 37 % 44640).alias("starts"),
            F.when(key % 997 != 0, key * 37 % 44640 + key % 90).alias("ends"),
            (key % 11 == 0).alias("is_flashback"),
        )

    @cached_property
    def knowledge(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
            _hot("l_orderkey", F.col("l_suppkey") % 50).alias("character_id"),
            _hot("l_orderkey", F.col("l_partkey") % 100).alias("fact_id"),
            F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("story_time"),
            F.when(F.col("l_returnflag") == "R", "not_known").otherwise("known").alias("state"),
        )

    @cached_property
    def uses(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("use_id"),
            _hot("event_id", F.col("user_id") % 60).alias("character_id"),
            _hot("event_id", F.col("k")).alias("fact_id"),
            (F.col("event_id") * 7 % 3600).alias("story_time"),
        )

    @cached_property
    def canon_events(self) -> DataFrame:
        kind = F.col("event_type")
        user = _hot("event_id", F.col("user_id"))
        return self.events.select(
            "event_id",
            _source(user % 20).alias("project_id"),
            F.concat(F.lit("s"), user.cast("string")).alias("subject"),
            F.concat(F.lit("p"), (F.col("k") % 2).cast("string")).alias("predicate"),
            (F.col("k") % 5).alias("fact_id"),
            "at_us",
            F.when(kind.isin("purchase", "click"), "approve").when(kind == "error", "retract").otherwise("propose").alias("kind"),
        )

    @cached_property
    def triples(self) -> DataFrame:
        who = _hot("o_orderkey", F.col("o_custkey"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("fact_id"),
            _source(who % 20).alias("project_id"),
            F.concat(F.lit("n"), who.cast("string")).alias("subject"),
            F.concat_ws("/", "o_orderpriority", F.month("o_orderdate").cast("string")).alias("predicate"),
            F.col("o_orderstatus").alias("object"),
        )

    @cached_property
    def aliases(self) -> DataFrame:
        """Most customers share a name with one up to three before it in the same project."""
        key = F.col("c_custkey")
        other = key - 20 * (1 + F.col("c_nationkey") % 3)
        name = F.when((other >= 0) & (key % 7 != 0), F.concat(F.lit("n"), other.cast("string")))
        return self.table("customer").select(_source(key % 20).alias("project_id"), F.concat(F.lit("n"), key.cast("string")).alias("name"), name.alias("other"))

    @cached_property
    def named_characters(self) -> DataFrame:
        """The characters with an alias of two words and one of one."""
        aliases = F.array(F.concat_ws(" ", "name", F.col("aliases")[0]), F.col("aliases")[1])
        return self.characters.select("character_id", "project_id", "name", aliases.alias("aliases"), "deleted_at")

    @cached_property
    def positions(self) -> tuple[DataFrame, DataFrame]:
        return mentions.read_positions(self.spark, self._kept("positions", lambda path: mentions.write_positions(self.chapters, path)))

    @cached_property
    def mentions(self) -> DataFrame:
        return self._kept_rows("mentions", mentions.mentions(self.named_characters, *self.positions))

    @cached_property
    def places(self) -> DataFrame:
        rows = self.table("part").select(F.floor(F.col("p_partkey") / 2).alias("chapter_id"), F.col("p_brand").alias("location"))
        return self._kept_rows("places", rows)

    @cached_property
    def stored_facts(self) -> DataFrame:
        rows = self.facts.join(self.chunks.select("chunk_id", "chapter_id"), "chunk_id").select("fact_id", "project_id", "chapter_id", "status")
        return self._kept_rows("stored_facts", rows)

    @cached_property
    def hybrid_requests(self) -> DataFrame:
        return self.vector_queries.withColumn("character_id", F.substring("project_id", 4, 10).cast("long"))

    @cached_property
    def memory_before(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        kind = F.when(status == "F", "event").when(status == "O", "state").otherwise("timeline entry")
        rows = self.table("orders").select(_source(F.col("o_custkey") % 20).alias("project_id"), kind.alias("kind"), key.alias("row_id"), F.col("o_orderpriority").alias("body"))
        return rows

    @cached_property
    def memory_after(self) -> DataFrame:
        """Some rows are gone, some say something else, some have a new row beside them."""
        key = F.col("row_id")
        kept = self.memory_before.where(key % 997 != 5)
        body = F.when(key % 499 == 7, F.concat("body", F.lit(" (revised)"))).otherwise(F.col("body"))
        new = self.memory_before.where(key % 701 == 11).withColumn("row_id", key + 1_000_000_000)
        return kept.withColumn("body", body).unionByName(new)
