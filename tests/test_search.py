import math
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scenelake.operators import entities as N
from scenelake.operators import index as I
from scenelake.operators import metrics as M
from scenelake.operators import rerank as K
from scenelake.operators import search as S
from scenelake.operators import video as V
from scenelake.plans.query_plan import QueryPlan, classify, rule_based

DOCS = [(1, "the cat sat on the mat"), (2, "the dog"), (3, "a cat and a cat and a dog"), (4, None), (5, "zebra")]


def plain_bm25(docs, query):
    words = {k: re.sub("[^a-z0-9 ]", " ", (t or "").lower()).split() for k, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in idf.items()}
    out = {}
    for k, ws in words.items():
        tf = Counter(ws)
        s = sum(idf[q] * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for q in query.split() if tf[q])
        if any(tf[q] for q in query.split()):
            out[k] = s
    return out


def test_bm25_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_key int, text string").withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame([(7, "the cat cat"), (8, "nothing here"), (9, "")], "query_id int, query_text string")
    got = {r.doc_key: r.score for r in S.bm25_scores(docs, asked).collect()}
    want = plain_bm25(DOCS, "the cat cat")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_zero_scores_fill_in_key_order_and_lists_end_at_zero(spark):
    docs = spark.createDataFrame(DOCS, "doc_key int, text string")
    asked = spark.createDataFrame([(7, "zebra")], "query_id int, query_text string")
    ranked = S.top(S.with_zero_scores(S.bm25_scores(docs, asked), docs, asked, 4), 4, ["query_id"])
    assert [r.doc_key for r in ranked.orderBy("rank").collect()] == [5, 1, 2, 3]
    assert [r.doc_key for r in S.until_zero(ranked, ["query_id"]).collect()] == [5]


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_key int, text string")
    asked = spark.createDataFrame([(7, "zebra")], "query_id int, query_text string")
    assert S.bm25_scores(docs, asked).count() == 0


def test_dense_and_similarity(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "doc_key int, vec array<double>")
    q = spark.createDataFrame([(0, [0.0, 5.0])], "query_id int, query_vec array<double>")
    got = {r.doc_key: (round(r.score, 6), r.s) for r in S.dense_scores(v, q).withColumn("s", S.similarity("score")).collect()}
    assert got == {1: (0.8, 0.9), 2: (1.0, 1.0), 3: (0.0, 0.5)}


def test_hashed_vectors_by_hand_and_in_time(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (1, "dog"), (2, "?!"), (3, None), (None, "a b c d e")], "doc_key int, text string")
    got = {r.doc_key: r.vec for r in I.hashed_vectors(docs, ["doc_key"], width=7).collect()}
    terms = spark.createDataFrame([(t,) for t in "cat dog a b c d e".split()], "term string")
    at = {r.term: (r.place, r.sign) for r in terms.select("term", F.expr("pmod(xxhash64(term), 7)").alias("place"), F.expr("if(pmod(xxhash64(term, 1), 2) = 0, 1, -1)").alias("sign")).collect()}
    assert got.keys() == {1, None}
    for key, words in ((1, "cat cat dog dog"), (None, "a b c d e")):
        raw = [0] * 7
        for w in words.split():
            raw[at[w][0]] += at[w][1]
        norm = math.sqrt(sum(x * x for x in raw))
        assert got[key] == [x / norm if norm else 0.0 for x in raw]
    many = spark.range(400).select(F.col("id").alias("doc_key"), F.expr("array_join(transform(sequence(1, 120), i -> concat('w', pmod(xxhash64(id, i), 5000))), ' ')").alias("text"))
    began = time.monotonic()
    assert I.hashed_vectors(many, ["doc_key"]).where("size(vec) = 384").count() == 400
    many_vectors = I.hashed_vectors(many, ["doc_key"]).select(F.round(I.dot(F.col("vec"), F.col("vec")), 9).alias("n")).distinct().collect()
    assert [r.n for r in many_vectors] == [1.0] and time.monotonic() - began < 60  # the length was worked out for every element: half a second a text


def test_unit_of_nulls_and_zeros(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [])], "id int, v array<double>")
    assert {r.id: r.u for r in rows.select("id", I.unit("v").alias("u")).collect()} == {1: [0.6, 0.8], 2: None, 3: [0.0, 0.0], 4: []}


def test_rrf_by_hand(spark):
    lists = spark.createDataFrame([(0, 0, "a", 1), (0, 0, "b", 2), (0, 1, "b", 1), (0, 1, "c", 2)], "query_id int, list_no int, doc_key string, rank int")
    hits = S.fused_order(S.rrf(lists, ["query_id"]), ["query_id"]).orderBy("rank").collect()
    assert [h.doc_key for h in hits] == ["b", "a", "c"]
    assert math.isclose(hits[0].rrf_score, 1 / 62 + 1 / 61)


def test_compaction_aggregation_and_exclusion(spark):
    ranked = spark.createDataFrame([(0, k, m, 1.0, i + 1) for i, (k, m) in enumerate([("x", "X"), ("a", "A"), ("y", "Y"), ("b", "B")])], "query_id int, doc_key string, movie_id string, score double, rank int")
    allowed = spark.createDataFrame([("A",), ("B",)], "movie_id string")
    assert [(r.doc_key, r.rank) for r in S.keep_allowed(ranked, allowed, ["query_id"]).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    hits = spark.createDataFrame([(0, "s1", "m1", 0.03, 1), (0, "s2", "m2", 0.02, 2), (0, "s3", "m1", 0.015, 3), (0, "s4", "m3", 0.01, 4)], "query_id int, doc_key string, movie_id string, rrf_score double, rank int")
    movies = S.by_movie(hits, ["query_id"], 3).orderBy("rank")
    assert [(r.movie_id, r.score, r.top_scenes) for r in movies.collect()] == [("m1", 0.045, ["s1", "s3"]), ("m2", 0.02, ["s2"])]
    out = spark.createDataFrame([("m1",)], "movie_id string")
    assert [r.movie_id for r in S.exclude(movies, out, ["query_id"]).collect()] == ["m2"]
    assert [r.movie_id for r in S.exclude(movies.where("movie_id = 'm1'"), out, ["query_id"]).collect()] == ["m1"]


def test_filters(spark):
    reg = spark.createDataFrame([("1", "A", "1989", ["Science Fiction"]), ("2", "B", "", ["Drama"]), ("3", "C", "1994", None)], "movie_id string, title string, year string, genres array<string>")
    ids = lambda df: None if df is None else sorted(r.movie_id for r in df.collect())
    assert ids(S.genre_ids(reg, "fiction")) == ["1"]
    assert ids(S.allowed_ids(reg, "western", None, None)) is None
    assert ids(S.allowed_ids(reg, None, 1990, 1999)) == ["2", "3"]
    assert ids(S.allowed_ids(reg, "fiction", 1990, None)) == []
    titles = spark.createDataFrame([("a",), ("",), (None,)], "title string")
    assert sorted((r.title, r.movie_id) for r in S.title_matches(reg, titles).collect()) == [("", "1"), ("", "2"), ("", "3"), ("a", "1")]


def test_people_in_queries(spark):
    people = spark.createDataFrame([("Tom Hanks", "1", "actor"), ("Ana Silva", "2", "director")], "name string, movie_id string, role string")
    asked = spark.createDataFrame([(1, "films with tom hanks"), (2, "tom henks film"), (3, "nobody")], "query_id int, query_text string")
    got = sorted((r.query_id, r.name, r.match) for r in N.people_in_queries(people, asked).collect())
    assert got == [(1, "Tom Hanks", "exact"), (2, "Tom Hanks", "fuzzy")]


def test_cast_matching_prefers_exact(spark):
    names = spark.createDataFrame([("s", "m", "SPARROW", 3), ("s", "m", "JACK", 1), ("s", "m", "NOBODY (V.O.)", 1)], "slug string, movie_id string, screenplay_name string, scene_count long")
    roles = spark.createDataFrame([("m", 0, "Jack Sparrow", "X"), ("m", 1, "Jack", "Y"), ("m", 2, "", "Z")], "movie_id string, tmdb_order int, tmdb_character string, actor string")
    got = {r.screenplay_name: (r.tmdb_character, r.match_type, r.tmdb_order) for r in N.match_cast(names, roles.where("tmdb_character <> ''")).collect()}
    assert got == {"SPARROW": ("Jack Sparrow", "token", 0), "JACK": ("Jack", "exact", 1), "NOBODY (V.O.)": (None, "unmatched", -1)}


def test_listwise_and_pairwise(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "movie_id string, rank int")
    assert [r.movie_id for r in K.list_wise(ranked, lambda query, rows: ["c", "z", "c"], 3).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.movie_id for r in K.list_wise(ranked, lambda query, rows: 1 / 0, 2).orderBy("rank").collect()] == ["a", "b"]
    assert K.pair_wise([3, 1, 2], lambda a, b: a < b, key=lambda x: x) == [1, 2, 3]
    assert K.pair_wise([3, 1, 2], lambda a, b: True, key=lambda x: x) == [3, 1, 2]


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "The Hit"), (1, 3, "hit again")], "query_id int, rank int, title string")
    cases = spark.createDataFrame([(1, ["hit"], "plot"), (2, ["no"], None)], "query_id int, ground_truth array<string>, expected_intent string")
    got = {r.query_id: r for r in M.per_query(results, cases).collect()}
    assert got[1].rr == 0.5 and math.isclose(got[1].precision, 2 / 3) and math.isclose(got[1].ndcg_ref, 1 / math.log2(3) + 0.5) and got[1].ndcg < 1
    assert got[2].rr == 0 and got[2].hit == 0
    assert M.means(M.per_query(results, cases)).first().rr == 0.25


def test_plans():
    raw = {"query_type": "multi_aspect", "intents": ["plot"], "sub_queries": [{"intent": "dialogue", "text": " x "}, {"intent": "bad", "text": "y"}], "filters": {"year_min": "1990", "year_max": "x"}}
    plan = QueryPlan.validated(raw)
    assert plan.intents == ["dialogue"] and plan.year_min == 1990 and plan.year_max is None and plan.sub_queries == [{"intent": "dialogue", "text": "x"}]
    assert QueryPlan.validated([1]) == QueryPlan() and QueryPlan.parsed("nonsense") == QueryPlan()
    assert QueryPlan.parsed('```json\n{"query_type": "thematic", "intents": ["plot"]}\n```').query_type == "thematic"
    assert rule_based('"I know"').intents == ["dialogue"] and rule_based("90s action film").year_min == 1990
    assert rule_based("heist film but not Ocean Seven").exclude_titles == ["Ocean Seven"] and rule_based("movies like Solaris").reference_title == "Solaris"
    assert classify("x", lambda q: 1 / 0) == QueryPlan()
    with pytest.raises(ValueError):
        QueryPlan.manual("nothing")


def test_clips(spark):
    js = '{"m": {"plot_summary": "p", "themes": ["a", "b"], "tone": " ", "clips": {"c1": {"action": "runs fast", "description": "d", "concatenated_transcript": "hello there", "youtube_link": "l", "timestamp": "1"}, "c2": {"action": "", "concatenated_transcript": ""}}}}'
    movies = V.parse_clips(spark.createDataFrame([(js,)], "value string"))
    docs = V.unpivot(movies)
    assert sorted(r.id for r in docs.collect()) == ["m__c1__action", "m__c1__description", "m__movie__plot_summary", "m__movie__themes"]
    assert [r.clip_id for r in V.transcripts(movies).collect()] == ["c1"]
    new = docs.where("field_type = 'action'").withColumn("content", F.lit("new"))
    assert sorted(r.content for r in V.upsert(docs, new).collect()) == ["a, b", "d", "new", "p"]
    assert V.query(docs, V.transcripts(movies), '"hello"').first().clip_id == "c1"
    with pytest.raises(ValueError):
        V.query(docs, docs, " ")


def test_retriever_opens_up_again(spark):
    docs = spark.createDataFrame([("plot", "1", "1", "A", "a letter in the harbor"), ("plot", "2", "2", "B", "a letter from home"), ("plot", "3", "3", "C", "nothing of note")], "index string, doc_key string, movie_id string, heading string, text string")
    reg = spark.createDataFrame([("1", "A", "1990", ["Drama"]), ("2", "B", "1991", ["War"]), ("3", "C", "1992", ["War"])], "movie_id string, title string, year string, genres array<string>")
    r = S.Retriever(docs, reg)
    plan = QueryPlan("plot_level", ["plot"])
    assert r.retrieve(plan, "letter harbor", "bm25", 2).orderBy("rank").first().movie_id == "1"
    assert [x.movie_id for x in r.retrieve(QueryPlan("filtered", ["plot"], genre="War"), "letter harbor", "bm25", 2).orderBy("rank").collect()][0] == "2"
    assert r.retrieve(QueryPlan("negation", ["plot"], exclude_titles=["A"]), "letter harbor", "bm25", 2).orderBy("rank").first().movie_id != "1"


def test_names_of_a_query_are_compared_once(spark, monkeypatch):
    docs = spark.createDataFrame([("plot", "1", "1", "A", "a letter in the harbor"), ("plot", "2", "2", "B", "a letter from home")], "index string, doc_key string, movie_id string, heading string, text string")
    reg = spark.createDataFrame([("1", "A", "1990", ["Drama"]), ("2", "B", "1991", ["War"])], "movie_id string, title string, year string, genres array<string>")
    people = spark.createDataFrame([("Tom Hanks", "2", "actor")], "name string, movie_id string, role string")
    passes = spark.sparkContext.accumulator(0)
    found = N.people_in_query

    def counted(table, text):
        def each(batches):
            for batch in batches:
                passes.add(len(batch))
                yield batch

        rows = found(table, text)
        return rows.mapInPandas(each, rows.schema)

    monkeypatch.setattr(N, "people_in_query", counted)
    hits = S.Retriever(docs, reg, people=people).retrieve(QueryPlan("filtered", ["plot"], genre="War"), "a letter to tom hanks", "bm25", 2)
    assert [r.movie_id for r in hits.collect()] == ["2"]
    assert passes.value == 1


def test_likeness_of_names_is_the_ratio(spark):
    from difflib import SequenceMatcher

    parts = ["hanks", "henks", "hank", "shank", "silva", "sliva", "banks", "hanukas"]
    people = spark.createDataFrame([(f"{p} {p}x", str(i), "actor") for i, p in enumerate(parts)], "name string, movie_id string, role string")
    words = ["hanks", "hanksx", "silva", "silvax"]
    got = {r.movie_id for r in N.people_in_query(people, " ".join(words)).collect()}
    like = lambda a: any(SequenceMatcher(None, a, w).ratio() >= N.FUZZY for w in words)
    assert got == {str(i) for i, p in enumerate(parts) if like(p) and like(p + "x")}
