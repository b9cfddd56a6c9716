"""Parts that no query shows: deep templates, fetching, evaluation, environment, layout of the ingest profile."""

import pytest
from pyspark.sql import functions as F

from scenelake import runtime
from scenelake.functions import text as X
from scenelake.operators import index as I
from scenelake.operators import metrics as M
from scenelake.operators import search as S
from scenelake.sources import fetch, files, screenplay


def test_templates_go_however_deep(spark):
    deep = "{{a|" * 15 + "x" + "}}" * 15
    df = spark.createDataFrame([(f"Plot {deep}stays {{{{b}}}}here",), ("{{open stays",), (None,)], "t string")
    assert [r.p for r in df.select(X.wikitext_plain("t").alias("p")).collect()] == ["Plot stays here", "{{open stays", None]


def test_fields_are_sanitised(spark):
    df = spark.createDataFrame([("visual", ["visual", "action", "zzz", "action"]), ("zzz", None)], "a string, b array<string>")
    got = [r.f for r in df.select(X.sanitised_fields("a", "b", ["visual", "action"]).alias("f")).collect()]
    assert [(f.primary, f.secondary) for f in got] == [("visual", ["action"]), ("action", [])]


def test_second_columns_go(spark):
    lines = ["I know you.          PAUL      (CHAKOBSA SUBTITLED) yes", "PAUL          JESSICA     (FRENCH TRANSLATION)", "Two          columns stay"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r.p for r in df.select(X.strip_dual_column("t").alias("p")).collect()] == ["I know you.", "", lines[2]]


def test_ingest_columns(spark):
    rows = [("m", i, " " * n + "x") for i, n in enumerate([10] * 40 + [20] * 20 + [30] * 20 + [21, 0])]
    df = spark.createDataFrame(rows, "slug string, line_no int, line string")
    got = [len(r.line) - 1 for r in screenplay.remapped(df, "ingest").orderBy("line_no").collect()]
    assert got == [0] * 40 + [12] * 20 + [15] * 20 + [12, 0]


def test_a_slug_in_use_gets_the_first_free_number(spark):
    manifest = spark.createDataFrame([("a.pdf", "1", "A", "the_clock"), ("b.pdf", "2", "B", "the_clock_3")], "filename string, tmdb_id string, title string, slug string")
    found = spark.createDataFrame([("the-clock-1990.pdf",), ("the-clock.pdf",), ("the-clock.txt",), ("a.pdf",)], "filename string")
    got = {r.filename: r.slug for r in files.new_manifest_rows(found, manifest).collect()}
    assert sorted(got.values()) == ["the_clock_2", "the_clock_4", "the_clock_5"] and "a.pdf" not in got


def test_retries():
    slept, answers = [], [OSError("down"), (429, {"Retry-After": "7"}, ""), (200, {}, '{"a": 1}')]

    def transport(url, params):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert fetch.get_json("u", {}, transport, sleep=slept.append) == {"a": 1} and slept == [1, 7.0]
    with pytest.raises(ValueError):
        fetch.get_json("u", {}, lambda u, p: (404, {}, ""), sleep=slept.append)
    with pytest.raises(RuntimeError):
        fetch.get_json("u", {}, lambda u, p: (429, {}, ""), sleep=slept.append)


def test_evaluation_goes_on_after_an_error(spark, tmp_path):
    cases = [{"query": "one", "ground_truth": ["clock"], "expected_intent": "plot"}, {"query": "bad", "ground_truth": ["x"], "expected_intent": "plot"}, {"query": "three", "ground_truth": ["none"], "expected_intent": None}]
    scores = M.run(spark, cases, lambda q: 1 / 0 if q == "bad" else ["The Bridge", "The Clock"], lambda q: "plot").cache()
    got = {r["query"]: r for r in scores.collect()}
    assert got["one"].rr == 0.5 and got["bad"].error.startswith("ZeroDivisionError") and got["three"].hit == 0
    means = M.means(scores).first()
    assert means.queries == 2 and means.rr == 0.25 and means.intent_accuracy == 1.0
    M.write_scores(scores, f"{tmp_path}/scores")
    assert spark.read.json(f"{tmp_path}/scores").count() == 3


def test_environment(monkeypatch):
    monkeypatch.setenv("A_SWITCH", " Yes ")
    monkeypatch.setenv("A_NUMBER", "12")
    assert runtime.env_bool("A_SWITCH", False) and runtime.env_bool("NO_SUCH", True) and runtime.env_int("A_NUMBER", 1) == 12 and runtime.env_int("NO_SUCH", 3) == 3


def test_stored_index_scores_as_the_texts_do(spark, tmp_path):
    docs = spark.createDataFrame([("x", "1", "the lamp in the harbor"), ("x", "2", "a lamp a lamp"), ("x", "3", None), ("y", "1", "lamp"), ("y", "9", "the clock")], "index string, doc_key string, text string")
    asked = spark.createDataFrame([(0, "x", "lamp harbor lamp"), (1, "y", "the lamp"), (2, "x", "nothing here")], "query_id int, index string, query_text string")
    path = f"{tmp_path}/sparse"
    I.write_sparse(docs.where("doc_key <> '2'"), path)
    I.write_sparse(docs.where("doc_key = '2'"), path, "append")
    got = {(r.query_id, r.doc_key): round(r.score, 6) for r in S.stored_scores(I.SparseIndex(spark, path), asked).collect()}
    want = {}
    for n, i in ((0, "x"), (1, "y"), (2, "x")):
        want |= {(r.query_id, r.doc_key): round(r.score, 6) for r in S.bm25_scores(docs.where(F.col("index") == i), asked.where(F.col("query_id") == n)).collect()}
    assert got == want and got
    plan = S.stored_scores(I.SparseIndex(spark, path), asked.where("query_id = 0"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_hybrid_without_vectors_is_an_error(spark):
    from scenelake.plans.query_plan import QueryPlan

    docs = spark.createDataFrame([("plot", "1", "1", "lamp")], "index string, doc_key string, movie_id string, text string")
    registry = spark.createDataFrame([("1", "A", "1990", ["Drama"])], "movie_id string, title string, year string, genres array<string>")
    with pytest.raises(ValueError, match="needs vectors"):
        S.Retriever(docs, registry).retrieve(QueryPlan("plot_level", ["plot"]), "lamp", "hybrid")
