"""The manuscript tables as views of the given corpus tables.

Each derivation is row by row or an equi join, so its size follows the corpus. ``FIXTURES.md`` lists them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.functions.text import md5_text
from foliospark.operators.chunking import chunk_chapters
from foliospark.operators.retrieval import query_terms, with_grounding
from foliospark.session import freed_shuffles, run_folder
from foliospark.sources.tables import read_index, write_index

SECOND = 1_000_000
# 2024-01-01 00:00:00 UTC.
EPOCH_US = 1_704_067_200_000_000


def _at(seconds: Column) -> Column:
    return F.lit(EPOCH_US) + seconds * SECOND


# Tables written once a session, by session, folder, state of its documents, and name.
_KEPT: dict[tuple, str] = {}


class Corpus:
    """Derived tables over one folder of parquet files.

    What a product stores at save time (hashes of texts, chunks, the token index) is written when first needed and read
    by every later query of the session.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _kept(self, name: str, write: Callable[[str], None]) -> str:
        documents = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents.parquet")
        files = documents.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        state = files.getFileStatus(documents).getModificationTime(), files.getContentSummary(documents).getLength()
        key = (self.spark.sparkContext.applicationId, self.folder, state, name)
        if key not in _KEPT:
            path = run_folder(self.spark, name)
            with freed_shuffles(self.spark):
                write(path)
            _KEPT[key] = path
        return _KEPT[key]

    def _kept_rows(self, name: str, rows: DataFrame) -> DataFrame:
        return self.spark.read.schema(rows.schema).parquet(self._kept(name, rows.write.parquet))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "source", "text")

    @cached_property
    def projects(self) -> DataFrame:
        number = F.substring("source", 4, 10).cast("int")
        return self.table("documents").select("source").distinct().select(
            F.col("source").alias("project_id"),
            F.concat(F.lit("user"), (number % 5).cast("string")).alias("owner_id"),
            F.col("source").alias("title"),
            F.lit("").alias("genre"),
        )

    @cached_property
    def chapters(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("chapter_id"),
            F.col("source").alias("project_id"),
            F.concat(F.lit("Bab "), F.col("doc_id").cast("string")).alias("title"),
            F.lit('{"type":"doc"}').alias("content_json"),
            F.col("text").alias("plain_text"),
            (F.col("doc_id") % 4 + 1).alias("revision_number"),
            F.floor(F.col("doc_id") / 20).alias("position"),
        )

    @cached_property
    def chapter_keys(self) -> DataFrame:
        """The chapters without their texts, with the hash that is stored at save time."""
        keys = self.chapters.withColumn("text_hash", md5_text(F.col("plain_text"))).drop("content_json", "plain_text")
        return self._kept_rows("chapter_keys", keys)

    @cached_property
    def jobs(self) -> DataFrame:
        turn = F.col("chapter_id") % 10
        return self.chapter_keys.select(
            "chapter_id",
            "project_id",
            F.col("revision_number").alias("source_revision"),
            F.col("text_hash").alias("source_hash"),
            F.when(turn == 0, "failed").when(turn == 1, "queued").otherwise("ready").alias("status"),
            F.when(turn == 0, F.col("chapter_id") % 4).otherwise(0).cast("long").alias("attempts"),
            _at(F.col("chapter_id") % 1000).alias("available_us"),
            F.when(turn == 0, F.lit("INDEX_FAILED")).alias("error"),
        )

    @cached_property
    def fresh_chunks(self) -> DataFrame:
        return chunk_chapters(self.chapters)

    @cached_property
    def chunks(self) -> DataFrame:
        """The stored chunk table; chunks of every seventh chapter are of the revision before."""
        behind = F.when(F.col("chapter_id") % 7 == 0, 1).otherwise(0)
        rows = chunk_chapters(self.chapters.withColumn("revision_number", F.col("revision_number") - behind))
        # Stored evenly by chunk, so that no reader depends on how the texts came in.
        return self._kept_rows("chunks", rows.repartition("chunk_id"))

    def index(self, terms: DataFrame) -> DataFrame:
        """Rows of the stored token index for a table of query words."""
        return read_index(self.spark, self._kept("token_index", lambda path: write_index(self.chunks, path)), terms)

    def prepare(self) -> None:
        """Write the kept tables now, so that no query pays for them."""
        self.chapter_keys, self.index_for(self.questions), self.grounded_facts

    def index_for(self, queries: DataFrame) -> DataFrame:
        return self.index(query_terms(queries))

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.table("benchmark").select("item_id", "text")

    @cached_property
    def questions(self) -> DataFrame:
        return self.benchmark.select(
            F.col("item_id").alias("query_id"),
            F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("project_id"),
            F.col("text").alias("query"),
        )

    @cached_property
    def asked(self) -> DataFrame:
        """The questions with who asks: some by others than the owner, some blank, some too long."""
        key = F.col("query_id")
        asker = F.concat(F.lit("user"), ((key + F.when(key % 6 == 0, 1).otherwise(0)) % 5).cast("string"))
        text = F.when(key % 9 == 4, "  ").when(key % 11 == 5, F.rpad("query", 1501, "x")).otherwise(F.col("query"))
        return self.questions.select("query_id", "project_id", text.alias("query"), asker.alias("asker"))

    @cached_property
    def asked_searches(self) -> DataFrame:
        """The searches with who asks; some needles are too short, some pages too deep."""
        key = F.col("request_id")
        asker = F.concat(F.lit("user"), ((key + F.when(key % 6 == 0, 1).otherwise(0)) % 5).cast("string"))
        return self.searches.select(
            "request_id",
            "project_id",
            F.when(key % 7 == 3, F.substring("query", 1, 1)).otherwise(F.col("query")).alias("query"),
            F.when(key % 13 == 6, 1_000_000).otherwise(F.col("offset")).cast("long").alias("offset"),
            asker.alias("asker"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """One fact per chunk, over all items in turn; those of every fifth chapter quote something that is not there."""
        claims = self.benchmark.select(F.col("item_id").alias("_item"), F.col("text").alias("claim"))
        chapter, number = F.col("chapter_id"), F.col("chapter_id") * 1000 + F.col("chunk_index")
        return self.chunks.withColumn("_item", chapter % self.benchmark.count()).join(claims, "_item").select(
            F.concat(F.lit("f"), F.col("chunk_id")).alias("fact_id"),
            "project_id",
            "chunk_id",
            "claim",
            F.when(chapter % 5 == 4, F.concat(F.lit("tidak ada "), chapter.cast("string")))
            .otherwise(F.substring("content", 1, 60))
            .alias("quote"),
            F.when(number % 3 == 0, "pending").when(number % 3 == 1, "approved").otherwise("ignored").alias("status"),
            F.lit(0).cast("long").alias("revision"),
            number.alias("created_at"),
        )

    @cached_property
    def grounded_facts(self) -> DataFrame:
        """The facts as a product stores them: with whether their quote was found in the chunk."""
        return self._kept_rows("grounded_facts", with_grounding(self.facts, self.chunks))

    @cached_property
    def insights(self) -> DataFrame:
        """An insight for every chunk of a labelled document."""
        labelled = self.table("labels").select(F.col("doc_id").alias("chapter_id"))
        return self.chunks.join(labelled, "chapter_id", "left_semi").select(
            F.concat(F.lit("i"), F.col("chunk_id")).alias("insight_id"),
            "project_id",
            "chunk_id",
            F.substring("content", 1, 80).alias("summary"),
            (F.col("chapter_id") * 1000 + F.col("chunk_index")).alias("created_at"),
        )

    @cached_property
    def characters(self) -> DataFrame:
        word = F.split("text", " ")
        attributes = [
            piece
            for name in ("appearance", "personality", "background", "goals", "fears", "arc")
            for piece in (F.lit(name), F.concat(F.lit("goal "), F.col("item_id").cast("string")) if name == "goals" else F.lit(""))
        ]
        return self.benchmark.select(
            F.col("item_id").alias("character_id"),
            F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("project_id"),
            word[0].alias("name"),
            F.array(word[1], word[2]).alias("aliases"),
            F.lit("supporting").alias("role"),
            F.lit("").alias("description"),
            F.create_map(*attributes).alias("attributes"),
            (F.col("item_id") % 2 == 0).alias("include_in_ai_context"),
            F.when(F.col("item_id") % 9 == 0, F.lit("archived")).alias("deleted_at"),
            F.col("item_id").alias("created_at"),
        )

    @cached_property
    def bibles(self) -> DataFrame:
        empty = [F.lit("").alias(f) for f in ("synopsis", "themes", "tone", "style_instructions", "world_rules")]
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("bible_id"),
            F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("project_id"),
            F.col("n_name").alias("premise"),
            *empty,
        )

    @cached_property
    def notes(self) -> DataFrame:
        note = F.col("conv_id") * 1000 + F.col("turn")
        return self.table("conversations").select(
            note.alias("note_id"),
            F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("project_id"),
            F.col("role").alias("title"),
            F.lit("general").alias("note_type"),
            F.col("text").alias("plain_text"),
            (F.col("turn") % 2 == 0).alias("include_in_ai_context"),
            F.when(F.col("turn") % 5 == 0, F.lit("archived")).alias("deleted_at"),
            note.alias("created_at"),
        )

    @cached_property
    def outline(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("item_id"),
            F.concat(F.lit("src"), (key % 20).cast("string")).alias("project_id"),
            F.col("p_name").alias("title"),
            F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("description"),
            F.when(key % 6 == 0, "act").when(key % 6 == 1, "scene").when(key % 6 == 2, "chapter").otherwise("other").alias("item_type"),
            F.when(key % 4 == 0, "drafted").otherwise("planned").alias("status"),
            F.col("p_size").cast("long").alias("position"),
            F.floor(key / 2).alias("chapter_id"),
            F.when(key % 11 == 0, F.lit("archived")).alias("deleted_at"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.shape_events(self.table("events"))

    @staticmethod
    def shape_events(raw: DataFrame) -> DataFrame:
        return raw.select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            "props",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def saves(self) -> DataFrame:
        return self.shape_saves(self.events)

    @staticmethod
    def shape_saves(events: DataFrame) -> DataFrame:
        """Saves of the chapter numbered like the user; a few name a chapter that does not exist."""
        unknown = F.when(F.col("k") >= 95, 1_000_000_000).otherwise(0)
        return events.select(
            "event_id",
            (F.col("user_id") + unknown).alias("chapter_id"),
            "at_us",
            (F.col("k") % 8).alias("base_revision"),
            F.concat(F.lit("Bab "), F.col("user_id").cast("string")).alias("title"),
            F.when(F.col("event_type") == "error", '{"type":"note"}').otherwise('{"type":"doc"}').alias("content_json"),
            F.concat_ws(" ", "event_type", "props").alias("plain_text"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.events.select("user_id", "at_us", "event_id")

    @cached_property
    def job_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "purchase", "save").when(F.col("k") % 3 == 0, "ok").otherwise("fail")
        return self.events.select(F.col("user_id").alias("chapter_id"), "at_us", "event_id", kind.alias("kind"))

    @cached_property
    def generations(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("generation_id"),
            "user_id",
            F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project_id"),
            F.when(kind == "click", "rewrite")
            .when(kind == "signup", "continue")
            .when(kind == "purchase", "brainstorm")
            .otherwise("chat")
            .alias("action"),
            F.when(kind == "view", F.concat(F.lit("[Ask My Story] "), F.col("props")))
            .when(kind == "purchase", F.concat(F.lit("[Memory] "), F.col("props")))
            .otherwise(F.col("props"))
            .alias("prompt"),
            F.concat(F.lit("Jawaban "), F.col("props")).alias("result"),
            F.when(kind == "click", "nebius:other/model")
            .when(kind == "view", F.concat(F.lit("gateway:any/model-"), F.col("k").cast("string")))
            .otherwise(F.concat(F.lit("nebius:nvidia/nemotron-"), F.col("k").cast("string")))
            .alias("model"),
            F.when(kind == "error", "error").otherwise("complete").alias("status"),
            F.array_repeat(F.lit("Bab"), (F.col("k") % 7).cast("int")).alias("context_sources"),
            F.to_json(
                F.struct(
                    (F.col("k") - F.floor(F.col("k") / 3)).alias("inputTokens"),
                    F.floor(F.col("k") / 3).alias("outputTokens"),
                    F.col("k").alias("totalTokens"),
                    F.col("value").alias("latency_ms"),
                )
            ).alias("token_usage"),
            F.col("at_us").alias("created_us"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """One recorded answer per chunk, in eight kinds from valid to broken."""
        number = F.col("chapter_id") * 1000 + F.col("chunk_index")
        kind = (F.col("chapter_id") + F.col("chunk_index")) % 8
        quote = F.substring("content", 3, 60)

        def claim(text: Column, source: Column, cited: Column) -> Column:
            return F.struct(text.alias("text"), source.alias("source_id"), cited.alias("quote"))

        def doc(*claims: Column) -> Column:
            return F.to_json(F.struct(F.array(*claims).alias("claims")))

        good = claim(F.concat(F.lit("Klaim "), F.col("chapter_id").cast("string")), F.col("chunk_id"), quote)
        untyped = claim(F.col("chapter_id"), F.col("chunk_id"), quote)
        payload = (
            F.when(kind == 0, doc(good))
            .when(kind == 1, doc(good, claim(F.lit("Klaim"), F.lit("bukan sumber"), quote)))
            .when(kind == 2, doc(claim(F.lit("Klaim"), F.col("chunk_id"), F.concat(quote, F.lit("~~")))))
            .when(kind == 3, F.lit('{"claims":[]}'))
            .when(kind == 4, F.lit('{"claims": ['))
            .when(kind == 5, F.concat(F.lit("```json\n"), doc(good, good), F.lit("\n```")))
            .when(kind == 6, doc(*[good] * 7))
            .otherwise(doc(untyped))
        )
        return self.chunks.select(number.alias("answer_id"), payload.alias("payload"))

    @cached_property
    def answer_sources(self) -> DataFrame:
        """The retrieved set of each answer: its chunk and the next one of the chapter."""
        number = F.col("chapter_id") * 1000 + F.col("chunk_index")
        uses = F.when(F.col("chunk_index") == 0, F.array(number)).otherwise(F.array(number, number - 1))
        return self.chunks.select(
            F.explode(uses).alias("answer_id"),
            F.col("chunk_id").alias("source_id"),
            "content",
            "chapter_id",
            "project_id",
            "source_revision",
            "source_hash",
        )

    @cached_property
    def analyses(self) -> DataFrame:
        """One recorded analysis per chunk, in eight kinds."""
        number = F.col("chapter_id") + F.col("chunk_index")
        kind = number % 8
        quote = F.substring("content", 5, 40)

        def fact(claim: Column, cited: Column) -> Column:
            return F.struct(claim.alias("claim"), cited.alias("quote"))

        def doc(summary: Column, *facts: Column) -> Column:
            return F.to_json(F.struct(summary.alias("summary"), F.array(*facts).alias("facts")))

        text = F.concat(F.lit("Ringkasan "), F.col("chapter_id").cast("string"))
        good, wrong = fact(F.lit("fakta"), quote), fact(F.lit("salah"), F.concat(quote, F.lit("~~")))
        payload = (
            F.when(kind.isin(0, 6), doc(text, good, wrong))
            .when(kind == 1, doc(F.lit(" \n"), good))
            .when(kind == 2, F.concat(F.lit("```\n"), doc(text, good, good), F.lit("\n```")))
            .when(kind == 3, doc(text, *[good] * 9))
            .when(kind == 4, F.lit("bukan json"))
            .when(kind == 5, doc(text, fact(F.col("chapter_id"), quote)))
            .otherwise(doc(text, fact(F.lit("pendek"), F.substring("content", 1, 4)), good))
        )
        return self.chunks.select(
            F.concat(F.lit("a"), F.col("chunk_id")).alias("analysis_id"),
            F.when(kind == 6, F.lit("tidak dikenal")).otherwise(F.col("chunk_id")).alias("chunk_id"),
            number.alias("created_at"),
            payload.alias("payload"),
            F.when(number % 19 == 0, F.lit("tidak ada")).otherwise(F.concat(F.lit("g"), F.col("chunk_id"))).alias("generation_id"),
            F.concat(F.lit("user"), (F.col("chapter_id") % 5).cast("string")).alias("user_id"),
        )

    @cached_property
    def analysis_generations(self) -> DataFrame:
        """The generation of each analysis; some belong to another user or another project."""
        number = F.col("chapter_id") + F.col("chunk_index")
        user = F.col("chapter_id") + F.when(number % 23 == 0, 1).otherwise(0)
        return self.chunks.select(
            F.concat(F.lit("g"), F.col("chunk_id")).alias("generation_id"),
            F.concat(F.lit("user"), (user % 5).cast("string")).alias("user_id"),
            F.when(number % 17 == 0, F.lit("lain")).otherwise(F.col("project_id")).alias("project_id"),
        )

    @cached_property
    def ai_requests(self) -> DataFrame:
        """What the generation form takes in, from every turn of the conversations; many break a rule."""
        conv, turn = F.col("conv_id"), F.col("turn")
        key = conv * 1000 + turn
        name = F.md5(conv.cast("string").cast("binary"))
        uuid = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return self.table("conversations").select(
            key.alias("request_id"),
            F.when(conv % 5 == 0, F.lit("src1")).otherwise(uuid).alias("project_id"),
            F.when(turn % 4 == 0, F.lit(None)).when(turn % 4 == 1, F.col("role")).otherwise(F.upper(uuid)).alias("chapter_id"),
            F.when(key % 6 == 0, "rewrite").when(key % 6 == 1, "continue").when(key % 6 == 2, "other").otherwise("chat").alias("action"),
            F.col("text").alias("instruction"),
            F.when(key % 4 == 0, F.col("text")).otherwise(F.lit(" \n")).alias("selection"),
            (key % 3 != 0).alias("use_chapter"),
            F.repeat("text", (key % 40).cast("int")).alias("prompt"),
            F.col("role").alias("system"),
            (key % 3000).alias("max_output_tokens"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Four reviews per fact; the third names a revision already replaced. Some facts are unknown."""
        steps = F.array(
            *[
                F.struct(F.lit(n).alias("step"), F.lit(base).cast("long").alias("base_revision"), F.lit(status).alias("status"))
                for n, (base, status) in enumerate([(0, "approved"), (1, "ignored"), (1, "approved"), (2, "pending")])
            ]
        )
        unknown = F.when(F.col("created_at") % 13 == 0, "x").otherwise("")
        rows = self.facts.select(
            F.concat(unknown, F.col("fact_id")).alias("fact_id"), "claim", "created_at", F.explode(steps).alias("s")
        )
        event = F.col("created_at") * 4 + F.col("s.step")
        return rows.select(
            event.alias("event_id"), "fact_id", _at(event).alias("at_us"), "s.base_revision", "s.status", "claim"
        )

    @cached_property
    def context_requests(self) -> DataFrame:
        """Some name no chapter, some have its switch off; "continue" is refused then."""
        key = F.col("chapter_id")
        action = F.when(key % 4 == 0, "chat").when(key % 4 == 1, "rewrite").when(key % 4 == 2, "continue").otherwise("brainstorm")
        return self.chapters.select(
            key.alias("request_id"),
            "project_id",
            F.when(key % 10 != 9, key).alias("chapter_id"),
            action.alias("action"),
            (key % 7 != 0).alias("use_chapter"),
            (key % 2 == 0).alias("use_bible"),
            F.lit(True).alias("use_characters"),
            (key % 3 != 0).alias("use_notes"),
        )

    @cached_property
    def searches(self) -> DataFrame:
        """Short needles with many hits, long ones with few, and second pages."""
        key = F.col("item_id")
        needle = F.when(key % 2 == 0, F.substring("text", 4, 3)).otherwise(F.substring("text", 1, 14))
        return self.benchmark.select(
            key.alias("request_id"),
            F.concat(F.lit("src"), (key % 20).cast("string")).alias("project_id"),
            needle.alias("query"),
            F.when(key % 4 == 0, 20).otherwise(0).cast("long").alias("offset"),
        )
