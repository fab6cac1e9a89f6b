"""URL rules, top-k search, decontamination and mixing on small cases, and their queries against SQL."""

import io
import contextlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import llm
from foliospark.llm import decontaminate, mixing, topk_search, url_filter
from tests.conftest import SMALL

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = llm.QUERIES[name](spark, SMALL)
    cursor = con.execute(llm.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(cursor.fetchall())


def test_native_plans_hold_no_python(spark):
    for name in ("op2_decontamination", "op3_url_filter"):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            llm.QUERIES[name](spark, SMALL).explain()
        assert not any(x in text.getvalue() for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_url_rules(spark):
    want = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "https://WWW.Example.NET/en/1?q#f": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://x.example.com/de/a": ("x.example.com", "/de/a", "example.com/de/", "block"),
        "http://example.com/de": ("example.com", "/de", None, "allow"),
        "http://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"),
        "http://c.net": ("c.net", "", None, "allow"),
        "http://c.net?x=/": ("c.net", "", None, "allow"),
        "ftp://net/": ("net", "/", "net/", "block"),
        "no scheme a.net/": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "x\ny://d.net/é z": ("d.net", "/é z", "net/", "block"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = [(u, "old") for u in want] + [("http://a.net/x", "old")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "url string, verdict string"), rules).collect()
    assert len(got) == len(rows)
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    assert url_filter.judge_urls(spark.createDataFrame([], "url string"), rules).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([("http://a.net/",)], "url string"), rules.limit(0)).first().verdict == "allow"


def test_bloom_filter_loses_nothing_and_passes_little(spark):
    keys = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("key"))
    others = spark.range(2000, 12000).select(F.concat(F.lit("h"), "id").alias("key"))
    blocks = -(-2000 * url_filter.BITS_PER_KEY // 256)
    assert url_filter.possible(keys, keys, blocks).count() == 2000
    assert url_filter.possible(others, keys, blocks).count() < 100


def test_top_k_against_all_products(spark):
    rand = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rand.integers(-3, 4, 5) / 8 + 0.0003]) for i in range(400)]
    vectors += [(i, vectors[1][1]) for i in range(400, 450)] + [(1000, [1e-9] * 5)]
    odd = [(500, None), (600, [0.1, None, 0.2, 0.3, 0.1]), (700, [float("nan")] + [0.1] * 4), (800, [float("inf")] + [0.0] * 4), (None, [0.5] * 5)]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS copies", "vec_id AS query_id")
    got = sorted(map(tuple, topk_search.top_k(frame, F.col("vec_id") % 100 == 0, 10, tile=64).collect()))
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in [*vectors, odd[-1]]}
    want = []
    for q in (i for i in whole if i is not None and i % 100 == 0):
        best = sorted((-int(whole[q] @ v), i is None, i) for i, v in whole.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(best)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_top_k_of_few_repeated_and_huge(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [1e300]), (3, [])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 2, 2**63 - 1), (2, 1, 2048 * 1024), (3, 1, 2048 * 1024)]
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_top_k_leaves_out_only_the_row_itself(spark):
    rows = [(0, [1.0]), (0, [1.0]), (0, [3.0]), (1, [2.0]), (None, [2.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4)
    lists = {}
    for r in got.orderBy("rank").collect():
        lists.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score // 1024**2))
    # Two different vectors ask under one id; each is a candidate of the other, and the copy of the first too.
    assert sorted(map(str, lists[0])) == sorted(map(str, [(1, 0, 3), (2, 1, 2), (3, None, 2), (4, 0, 1), (1, 1, 6), (2, None, 6), (3, 0, 3), (4, 0, 3)]))


def test_columns_of_any_name(spark, tmp_path):
    pages = spark.createDataFrame([("http://a.net/x", 1, 2, "h")], "url string, _host int, _path int, host string")
    (row,) = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect()
    assert (row._host, row._path, row.host, row.rule) == (1, 2, "a.net", "net/")
    spark.createDataFrame([(1, "a passage of some eight words in all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "clean", 5, "k", "r"), (2, "x a passage of some eight words in all y", 6, "k", "r")], "doc_id long, text string, _leak_key int, key string, row string")
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "clean", 5, "k", "r")]


def test_leaks_with_substitutions(spark):
    rand = random.Random(4)
    word = lambda: "".join(rand.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = text(40), text(7)
    changed = long.split()
    for i in (3, 10, 17, 24, 31, 38):
        changed[i] = word()
    docs = [
        (1, text(30) + " " + long.upper() + " " + text(30)), (2, text(5) + ", " + " ".join(changed)), (3, " ".join(long.split()[:13])),
        (4, " ".join(long.split()[:7]) + " " + text(100)), (5, "x " + short), (6, " ".join(short.split()[:6])), (7, None), (8, ""), (9, text(20_000)),
        (None, long), (11, long), (11, long),
    ]
    items = [(1, long), (2, short), (3, None), (4, "too short"), (2, short)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS item_id", "text AS w")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_item, r.start, r.matched) for r in decontaminate.leaks(frame, bench).collect())
    assert got == Counter([(1, 1, 40, 30, 40), (2, 1, 40, 5, 34), (3, 1, 40, 0, 13), (5, 2, 7, 1, 7), (None, 1, 40, 0, 40), (11, 1, 40, 0, 40)])
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0


def _all_offsets(docs, items):
    """The 13-token rule at every offset, without seeds, for items of 11 tokens or more."""
    out = Counter()
    for d, text in docs:
        w = text.split()
        for i, item in items:
            v, best = item.split(), None
            run = min(13, len(v))
            for start in range(1 - len(v), len(w)):
                agree = [0 <= j + start < len(w) and w[j + start] == x for j, x in enumerate(v)]
                if any(10 * sum(agree[k : k + run]) >= 8 * run for k in range(len(v) - run + 1)):
                    best = max(best or (0, 0), (sum(agree), -start))
            if best:
                out[d, i, len(v), -best[1], best[0]] += 1
    return out


def test_leaks_of_every_pattern_of_two_changes(spark):
    rand = random.Random(11)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (11, 12, 13, 15, 20, 38, 59)]
    docs = []
    for _, item in items:
        v = item.split()
        changed = [p for p in itertools.combinations(range(len(v)), 2) if len(v) <= 13]
        changed += [[j for j in range(len(v)) if j % 5 == phase] for phase in range(5)]
        changed += [[j for j in range(len(v)) if rand.random() < share] for share in (0.15, 0.2, 0.25) for _ in range(20)]
        for gone in changed:
            for ahead in ("", "a b c "):
                docs.append((len(docs), ahead + " ".join("changed" if j in gone else x for j, x in enumerate(v))))
        docs += [(len(docs) + k, " ".join(v[k : len(v) - 2 + k])) for k in range(3)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _all_offsets(docs, items)
    # All 55, 66 and 78 pairs of changes, with and without words ahead, are among them.
    assert sum(n == 13 for _, _, n, _, _ in want) >= 2 * 78
    assert Counter((r.doc_id, r.item_id, r.n_item, r.start, r.matched) for r in decontaminate.leaks(frame, bench).collect()) == want


def test_leaks_of_short_items_with_changes(spark):
    items = [(n, [f"s{n}x{j}" for j in range(n)]) for n in range(5, 11)]
    docs, want = [], Counter()
    for n, v in items:
        for changes in range(4):
            for gone in itertools.combinations(range(n), changes):
                ahead = len(docs) % 3
                if 10 * (n - changes) >= 8 * n:
                    want[len(docs), n, n, ahead, n - changes] += 1
                docs.append((len(docs), " ".join(["ahead"] * ahead + ["changed" if j in gone else x for j, x in enumerate(v)] + ["after"] * (ahead // 2))))
    bench = spark.createDataFrame([(n, " ".join(v)) for n, v in items], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sum(want.values()) == sum(1 + n for n in range(5, 10)) + 1 + 10 + 45
    assert Counter((r.doc_id, r.item_id, r.n_item, r.start, r.matched) for r in got) == want


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop what is above its limit, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        left = {s: weight[s] for s in order if s not in fixed}
        share = {s: w * (total - sum(fixed.values())) / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets():
    rand = random.Random(6)
    for _ in range(200):
        sizes = {s: rand.choice([0, 1, 10, 1000, 10**6]) * rand.randint(0, 9) for s in rand.sample(["a", "b", "c", "d", "e", None, "é"], rand.randint(1, 7))}
        got = mixing.source_targets(sizes)
        if sum(sizes.values()):
            assert got == pytest.approx(plain_targets(sizes), abs=1e-6)
            assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_flow_over_shared_patterns():
    flows = mixing.cheapest_flow([(("a", "b"), 10), (("a",), 10), (("b", "c"), 5)], {"a": 12, "b": 9, "c": 100})
    assert [sum(f.values()) for f in flows] == [11, 10, 15]
    assert flows[0]["a"] + flows[1]["a"] == 12 and flows[0]["b"] == 9 and flows[2] == {"b": 0, "c": 15}


def test_mix(spark):
    rand = random.Random(8)
    docs = [(i, " ".join("w" * rand.randint(1, 3) for _ in range(rand.randint(0, 60))), rand.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs += [(1000, "x y z", "b")] * 3 + [(None, "n n", "a"), (1001, None, "c"), (1002, "\t\x0b\r", "c"), (1003, "v " * 20_000, "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "doc_id AS key", "doc_id AS taken", "source AS lang")
    out = mixing.stage(spark, frame, "").collect()
    decided, sources = mixing.choose(frame, F.array("source"))
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    targets = plain_targets(sizes)
    assert {r.source: (r.source_size, pytest.approx(r.target)) for r in sources.collect()} == {s: (n, targets[s]) for s, n in sizes.items()}
    taken = Counter()
    for r in decided.collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.members[0]] += r.taken * r["rows"]
    assert all(abs(taken[s] - targets[s]) <= 3 for s in sizes)
    assert sum(r.taken for r in out) == sum(taken.values()) and all(r.taken > 0 and r.text for r in out)
    assert mixing.choose(frame.limit(0), F.array("source"))[0].count() == 0
    # Documents of several sources.
    shared, _ = mixing.choose(frame, F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array("source")))
    assert all(0 <= r.taken <= 3 * r.size for r in shared.collect())
