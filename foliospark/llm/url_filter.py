"""URL filtering against a list of canonical URLs: a blocked Bloom filter, then an exact hash join of what it passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm import common

# The listed rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The filter has blocks of four 64-bit words, eight bits set per key and about this many bits a key.
WORDS, PROBES, BITS_PER_KEY = 4, 8, 24
#: Blocks (of 40 bytes) up to which the filter is sent to all executors; beyond, candidates are shuffled to their blocks.
BROADCAST_BLOCKS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null or a url without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER), F.regexp_extract(whole, PARTS, 2)


def _words(key: Column) -> list[Column]:
    """The bits of a key in the words of its block: eight places of a second hash, eight bits each."""
    second = F.xxhash64(key, F.lit(1))
    masks = []
    for word in range(WORDS):
        bits = []
        for probe in range(PROBES):
            place = F.shiftrightunsigned(second, 8 * probe).bitwiseAND(F.lit(WORDS * 64 - 1).cast("long"))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
            bits.append(F.when(F.floor(place / 64) == word, bit).otherwise(F.lit(0).cast("long")))
        masks.append(reduce(Column.bitwiseOR, bits))
    return masks


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocked filter of ``keys`` (key string) as rows (block, w0 ... w3)."""
    marked = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_words(F.col("key")))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def possible(candidates: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """The candidates (key string, any others) that the filter of ``keys`` passes; none that is listed is lost."""
    probes = candidates.select("*", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_words(F.col("key")))))
    hit = reduce(Column.__and__, (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(WORDS)))
    filter_rows = bloom_blocks(keys, blocks)
    return probes.join(F.broadcast(filter_rows) if blocks <= BROADCAST_BLOCKS else filter_rows, "block").filter(hit).select(*candidates.columns)


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages`` (url, any others).

    ``rules`` has host, path and verdict (block or allow). A rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest wins, of equally long ones block. Without a fitting rule, a url is not listed:
    rule null, verdict allow. Null urls and urls without ``://`` have empty host and path and fit no rule; hosts of
    rules are never empty. Rows may repeat; an empty table gives an empty one. Columns of the added names are replaced.

    A listed canonical url is the rule's host and path. Those that a url could fit are its host's endings at a label,
    each with the path's beginnings of every length that a listed path has. Different (host, path) are looked up once.
    """
    listed = rules.filter("host <> ''").select(F.concat("host", "path").alias("key"), "verdict")
    listed = listed.groupBy("key").agg(F.max("verdict").alias("verdict"))
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    blocks = -(-max(listed.count(), 1) * BITS_PER_KEY // (WORDS * 64))
    host, path = host_and_path(F.col("url"))
    # The columns travel in one, so that no name of theirs can clash.
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"))
    places = parts.select("host", "path").filter("host <> ''").distinct()
    # Few bytes, but much to work out for each: not to be merged into few partitions by size.
    places = places.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("host", "path"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    starts = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))), lambda n: n <= F.length("path"))
    starts = F.transform(starts, lambda n: F.substring("path", F.lit(1), n)) if lengths else F.array().cast("array<string>")
    candidates = places.select("host", "path", F.explode(endings).alias("ending"), starts.alias("starts"))
    candidates = candidates.select("host", "path", "ending", F.explode("starts").alias("start"))
    candidates = candidates.select("host", "path", F.concat("ending", "start").alias("key"))
    fits = possible(candidates, listed.select("key"), blocks).join(listed, "key")
    best = F.max(F.struct(F.length("key").alias("n"), "verdict", "key"))
    chosen = fits.groupBy("host", "path").agg(best.alias("b"))
    judged = parts.join(chosen, ["host", "path"], "left")
    return judged.select("row.*", "host", "path", F.col("b.key").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(common.table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(h, d, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT DISTINCT host, path FROM p),
f AS (
  SELECT host, path, h || d AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || d) DESC, v DESC) AS place
  FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, d)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path AND f.place = 1
"""
}
