import json

from foliospark.operators import evidence as E
from tests.helpers import chapters
from foliospark.operators.chunking import chunk_chapters

SOURCE = "Nadir menaruh peta laut di loteng; kuncinya dibawa Wening ke pasar ikan."
MAP = {"text": "Peta ada di loteng.", "source_id": "k7", "quote": "peta laut di loteng"}
KEY = {"text": "Wening membawa kunci.", "source_id": "k7", "quote": "kuncinya dibawa Wening"}


def answer(*claims):
    return json.dumps({"claims": list(claims)})


CASES = {
    1: ("not json", "INVALID_ANSWER", 0),
    2: ('{"claims":"none"}', "INVALID_ANSWER", 0),
    3: (answer(*[MAP, KEY] * 3, MAP), "INVALID_ANSWER", 0),
    4: (answer(), "abstained", 0),
    5: ("```\n%s\n```" % answer(), "abstained", 0),
    6: (answer(MAP), "accepted", 1),
    7: (answer(KEY, MAP, KEY), "accepted", 3),
    8: (answer(*[MAP, KEY] * 3), "accepted", 6),
    9: (answer(MAP | {"source_id": "k8"}), "UNSUPPORTED_CITATION", 1),
    10: (answer(KEY, MAP | {"quote": "peta laut di gudang"}), "UNSUPPORTED_CITATION", 2),
    11: (answer(MAP | {"quote": "peta"}), "UNSUPPORTED_CITATION", 1),
    12: (answer(MAP | {"text": "\t "}), "UNSUPPORTED_CITATION", 1),
    13: (answer(MAP | {"text": 17}), "UNSUPPORTED_CITATION", 1),
    14: (answer({"quote": "peta laut di loteng"}), "UNSUPPORTED_CITATION", 1),
}


def _frames(spark):
    answers = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "answer_id long, payload string")
    sources = spark.createDataFrame([(k, "k7", SOURCE) for k in CASES], "answer_id long, source_id string, content string")
    return answers, sources


def test_answers(spark):
    got = {r.answer_id: (r.outcome, r.claims) for r in E.answer_outcomes(*_frames(spark)).collect()}
    assert got == {k: v[1:] for k, v in CASES.items()}


def test_assembly(spark):
    got = {r.answer_id: r for r in E.assemble_answers(*_frames(spark)).collect()}
    assert set(got) == {k for k, v in CASES.items() if v[1] in ("accepted", "abstained")}
    assert got[7].answer == "Wening membawa kunci. [1]\n\nPeta ada di loteng. [2]\n\nWening membawa kunci. [3]"
    assert got[7].citations == "1:k7,2:k7,3:k7" and not got[7].abstained
    assert got[5].abstained and got[5].answer == E.NO_EVIDENCE and got[5].citations == ""


def test_analyses(spark):
    df = chapters(spark, ("p", 1, "Loteng", SOURCE, 0))
    chunks = chunk_chapters(df)
    chunk = chunks.first().chunk_id
    fact = {"claim": "Kunci ada pada Wening", "quote": "kuncinya dibawa Wening"}
    made_up = {"claim": "Peta terbakar", "quote": "peta itu terbakar"}
    payloads = [
        ("too many", chunk, 4, json.dumps({"summary": "s", "facts": [fact] * 9}), "INVALID_INSIGHTS"),
        ("no list", chunk, 4, json.dumps({"summary": "s"}), "INVALID_INSIGHTS"),
        ("later", chunk, 9, json.dumps({"summary": "Terlambat", "facts": [fact]}), "existing"),
        ("earlier", chunk, 5, json.dumps({"summary": "Peta dan kunci", "facts": [made_up, fact]}), "saved"),
        ("no summary", chunk, 4, json.dumps({"summary": "", "facts": []}), "INVALID_INSIGHTS"),
        ("no chunk", "nowhere", 4, json.dumps({"summary": "s", "facts": []}), "NOT_FOUND"),
    ]
    analyses = spark.createDataFrame([p[:4] for p in payloads], "analysis_id string, chunk_id string, created_at long, payload string")
    outcomes = E.analysis_outcomes(analyses, chunks, df, spark.createDataFrame([], "chunk_id string"))
    assert {r.analysis_id: r.outcome for r in outcomes.collect()} == {p[0]: p[4] for p in payloads}
    assert [f.claim for f in E.accepted_facts(outcomes).collect()] == [fact["claim"]]
    assert [i.summary for i in E.accepted_insights(outcomes).collect()] == ["Peta dan kunci"]


def test_changed_or_deleted_source_voids_an_answer(spark):
    df = chapters(spark, ("p", 1, "Loteng", SOURCE, 0))
    cited = chunk_chapters(df).selectExpr("1L as answer_id", "*")
    outcomes = spark.createDataFrame([(1, "accepted"), (2, "accepted")], "answer_id long, outcome string")
    after = lambda now: {r.answer_id: r.outcome for r in E.void_stale(outcomes, cited, now).collect()}
    assert after(df) == {1: "accepted", 2: "accepted"}
    assert after(chapters(spark, ("p", 1, "Loteng", SOURCE + " Tamat.", 0))) == {1: "STALE_SOURCE", 2: "accepted"}
    assert after(chapters(spark, ("p", 1, "Loteng", SOURCE, 4))) == {1: "STALE_SOURCE", 2: "accepted"}
    assert after(df.limit(0)) == {1: "STALE_SOURCE", 2: "accepted"}
